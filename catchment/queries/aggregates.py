"""Aggregations, cleaning and reference factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import population_bucket
from ..functions.emissions import CH4_DEFAULTS, N2O_DEFAULTS
from ..operators.aggregate import (add_global_share, class_summary, grouped_sums, intensity,
                                   missing_report, pivot_sums, positive_share, rollup,
                                   rollup_levels, several_values, weighted_mean, weighted_rate)
from ..operators.clean import (iqr_audit, iqr_clean, mixed_groups, ratio_means,
                               reference_factors, screening_value)
from ..operators.draws import build_pools, index_records, level_loads, zeroed_share
from ..operators.clean import overall_ratio
from ..operators.hierarchy import region_totals
from ..operators.match import by_climate, sewer_emissions
from ..operators.proba import full_matrix
from ..operators.validate import holdout_jobs
from ..sources.readers import union_all
from ..plans.emission import LEVELS, city_loads
from .helpers import rounded
from .joins import MATRIX_SQL, SEWER_MATCH_SQL
from .registry import query
from .roles import CLASSES


@query("A2_weighted_mean", """
SELECT NAME_1, round(sum(CASE WHEN l_discount IS NOT NULL AND w > 0 THEN l_discount * w END)
  / sum(CASE WHEN l_discount IS NOT NULL AND w > 0 THEN w END), 9) AS mean,
  round(sum(CASE WHEN NAME_2 = 'none' THEN 1.0 END), 9)::DOUBLE AS nothing
FROM (SELECT NAME_1, NAME_2, l_discount, l_quantity - 10 AS w FROM {sales}) GROUP BY 1""")
def a2(t):
    rows = t.role("sales").withColumn("w", F.col("l_quantity") - 10)
    never = F.when(F.col("NAME_2") == "none", F.col("l_tax"))
    return rounded(rows.groupBy("NAME_1").agg(
        weighted_mean(F.col("l_discount"), F.col("w")).alias("mean"),
        weighted_mean(never, F.col("w")).alias("nothing")), 9)


@query("A3_first_attribute", """
SELECT NAME_0, arg_min(NAME_1, row_id) AS first_province, arg_min(NAME_3, row_id) AS first_district,
       round(sum(Population), 2) AS Population
FROM {city} GROUP BY 1""")
def a3(t):
    return rounded(rollup(t.role("city").withColumn("first_province", F.col("NAME_1"))
                          .withColumn("first_district", F.col("NAME_3")),
                          ["NAME_0"], ["Population"],
                          attributes=["first_province", "first_district"], order="row_id"), 2)


ROLLUP_SQL = """
SELECT '{level}' AS level, {keys}, round(sum(l_extendedprice), 2) AS l_extendedprice,
  round(sum(l_tax), 4) AS l_tax,
  round(sum(CASE WHEN l_quantity > 0 THEN l_discount * l_quantity END)
        / sum(CASE WHEN l_discount IS NOT NULL AND l_quantity > 0 THEN l_quantity END), 9) AS l_discount
FROM {{sales}} {group}"""


@query("A4_level_rollup", " UNION ALL ".join([
    ROLLUP_SQL.format(level="city", keys="NAME_0, NAME_1, NAME_2", group="GROUP BY ALL"),
    ROLLUP_SQL.format(level="province", keys="NAME_0, NAME_1, NULL AS NAME_2",
                      group="GROUP BY NAME_0, NAME_1"),
    ROLLUP_SQL.format(level="country", keys="NAME_0, NULL AS NAME_1, NULL AS NAME_2",
                      group="GROUP BY NAME_0"),
    ROLLUP_SQL.format(level="global", keys="NULL AS NAME_0, NULL AS NAME_1, NULL AS NAME_2",
                      group="")]))
def a4(t):
    levels = {"city": ["NAME_0", "NAME_1", "NAME_2"], "province": ["NAME_0", "NAME_1"],
              "country": ["NAME_0"], "global": []}
    out = rollup_levels(t.role("sales"), levels, ["l_extendedprice", "l_tax"], ["l_discount"],
                        "l_quantity")
    return rounded(rounded(rounded(out, 2, ["l_extendedprice"]), 4, ["l_tax"]), 9, ["l_discount"])


@query("A5_country_share", """
WITH c AS (SELECT NAME_0, NAME_1, sum(l_extendedprice) AS revenue, sum(l_quantity) AS quantity,
  sum(CASE WHEN l_quantity > 0 THEN l_discount * l_quantity END)
    / sum(CASE WHEN l_discount IS NOT NULL AND l_quantity > 0 THEN l_quantity END) AS discount
  FROM {sales} GROUP BY 1, 2)
SELECT NAME_0, NAME_1, round(revenue, 2) AS revenue, quantity, round(discount, 9) AS discount,
  round(revenue / (SELECT sum(revenue) FROM c) * 100, 9) AS "revenue_GlobalShare_pct",
  round(quantity / (SELECT sum(quantity) FROM c) * 100, 9) AS "quantity_GlobalShare_pct" FROM c""")
def a5(t):
    rows = t.role("sales").select(
        "NAME_0", "NAME_1", F.col("l_extendedprice").alias("revenue"),
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"),
        F.col("l_quantity").alias("weight"))
    country = rollup(rows, ["NAME_0", "NAME_1"], ["revenue", "quantity"], ["discount"], "weight")
    shared = add_global_share(country, ["revenue", "quantity"])
    return (rounded(rounded(shared, 2, ["revenue"]), 9,
                    ["discount", "revenue_GlobalShare_pct", "quantity_GlobalShare_pct"])
            .orderBy(F.col("revenue").desc()))


@query("A5_share_of_nothing", """
SELECT c_mktsegment, round(sum(c_acctbal), 2) AS balance, NULL::DOUBLE AS "zero_GlobalShare_pct",
       0.0::DOUBLE AS zero FROM customer GROUP BY 1""")
def a5_nothing(t):
    sums = rounded(t.customer.groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("balance")), 2)
    return add_global_share(sums.withColumn("zero", F.lit(0.0)), ["zero"])


@query("A6_several_values", """
SELECT o_custkey, count(DISTINCT o_orderstatus) AS o_orderstatus,
       count(DISTINCT o_orderpriority) AS o_orderpriority
FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1""")
def a6(t):
    return several_values(t.orders, "o_custkey", ["o_orderstatus", "o_orderpriority"])


@query("A7_missing_report", """
SELECT column_name, n - filled AS n_missing, n AS n_rows, round(filled * 100.0 / n, 9) AS filled_pct
FROM (SELECT 'NAME_1' AS column_name, count(*) AS n, count(NAME_1) AS filled FROM {city}
  UNION ALL SELECT 'NAME_3', count(*), count(NAME_3) FROM {city}
  UNION ALL SELECT 'pct_sewer_treated', count(*), count(pct_sewer_treated) FROM {city})""")
def a7(t):
    return rounded(missing_report(t.role("city"), ["NAME_1", "NAME_3", "pct_sewer_treated"]), 9)


@query("A7_value_counts", """
SELECT label, count(*) AS n FROM {plant} GROUP BY 1""")
def a7_counts(t):
    return t.role("plant").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("A8_pivot_sums", """
SELECT Country, CASE WHEN count(*) FILTER (WHERE Substance = 'CH4') > 0 THEN
    round(coalesce(sum(CASE WHEN Substance = 'CH4' THEN v END), 0), 2) END AS CH4,
  CASE WHEN count(*) FILTER (WHERE Substance = 'N2O') > 0 THEN
    round(coalesce(sum(CASE WHEN Substance = 'N2O' THEN v END), 0), 2) END AS N2O,
  CASE WHEN count(*) FILTER (WHERE Substance IN ('CH4', 'N2O')) > 0 THEN
    round(coalesce(sum(CASE WHEN Substance IN ('CH4', 'N2O') THEN v END), 0), 2) END AS GHG
FROM (SELECT Country, Substance, CASE WHEN Country <> 'NATION_3' THEN Y_2022 END AS v FROM {inventory}
      WHERE NOT (Country = 'NATION_5' AND Substance = 'N2O')) GROUP BY 1""")
def a8(t):
    rows = (t.role("inventory")
            .where(~((F.col("Country") == "NATION_5") & (F.col("Substance") == "N2O")))
            .withColumn("v", F.when(F.col("Country") != "NATION_3", F.col("Y_2022"))))
    return rounded(pivot_sums(rows, "Country", "Substance", ["CH4", "N2O"], "v", "GHG"), 2)


@query("A9_class_summary", """
SELECT NAME_0, count(*) AS Total_Facilities, count(*) FILTER (WHERE served > 100000) AS Positive_Count,
  round_even(count(*) FILTER (WHERE served > 100000) * 100.0 / count(*), 1) AS Rate_Count_pct,
  round_even(round(sum(served), 2), 0) AS Total_Pop,
  round_even(round(sum(CASE WHEN served > 100000 THEN served ELSE 0 END), 2), 0) AS Positive_Pop,
  round_even(sum(CASE WHEN served > 100000 THEN served ELSE 0 END) * 100 / sum(served), 1) AS Rate_Pop_pct
FROM {sewered} GROUP BY 1""")
def a9(t):
    rows = t.role("sewered").withColumn(
        "status", F.when(F.col("served") > 100000, "Anaerobic").otherwise("Non-Anaerobic"))
    return class_summary(rows, "NAME_0", "status", "Anaerobic", "served")


@query("A10_positive_share", """
SELECT NAME_0, Region, CASE WHEN sum(served) > 0 THEN
    round(sum(CASE WHEN temperature < 15 THEN served ELSE 0 END) / sum(served), 9) ELSE 0 END AS share,
  round(coalesce(sum(served), 0), 2) AS total
FROM {sewered} WHERE Region <> 'BUILDING' GROUP BY 1, 2""")
def a10(t):
    rows = (t.role("sewered")
            .withColumn("Region", F.when(F.col("Region") != "BUILDING", F.col("Region")))
            .withColumn("status", F.when(F.col("temperature") < 15, "Anaerobic")))
    out = positive_share(rows, ["NAME_0", "Region"], "status", "Anaerobic", "served", "share",
                         "total")
    return rounded(rounded(out, 9, ["share"]), 2, ["total"])


@query("A11_intensity", """
SELECT NAME_0, Region, CASE WHEN coalesce(sum(served), 0) > 0 THEN
   round(coalesce(sum(temperature), 0) / sum(served), 12) ELSE 0 END AS intensity,
   round(coalesce(sum(served), 0), 2) AS total FROM {sewered} GROUP BY 1, 2""")
def a11(t):
    out = intensity(t.role("sewered"), ["NAME_0", "Region"], "temperature", "served", "intensity",
                    "total")
    return rounded(rounded(out, 12, ["intensity"]), 2, ["total"])


@query("A12_by_climate", f"""
WITH {SEWER_MATCH_SQL}
SELECT rc AS Matched_Climate, count(served) AS n_plants,
  round_even(sum(e * (served * 200 / 1e6) * 365 / 1000) / 1e6, 4) AS CH4_Tg_yr,
  round_even(sum(e * (served * 200 / 1e6) * 365 / 1000 * 27) / 1e6, 4) AS CO2e_Mt_yr
FROM best GROUP BY 1 /* {{sewered}} */""")
def a12(t):
    return by_climate(sewer_emissions(t.role("sewered"), "served", "temperature", "precipitation"),
                      "served")


@query("A13_region_totals", """
SELECT NAME_0, Region, count(*) AS n_plants, round(sum(served), 2) AS Total_Served_Population
FROM {plant} GROUP BY 1, 2""")
def a13(t):
    return rounded(region_totals(t.role("plant"), "served"), 2)


IQR_SQL = """
q AS (SELECT class, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
      FROM rows WHERE v IS NOT NULL AND class IS NOT NULL GROUP BY 1),
b AS (SELECT class, n, q1, q3, q3 - q1 AS iqr,
        CASE WHEN n < 4 THEN 'insufficient_data' WHEN q3 - q1 = 0 THEN 'iqr_zero_skipped' ELSE 'IQR' END AS method
      FROM q),
f AS (SELECT rows.*, b.method, b.n, b.q1, b.q3, b.iqr,
        CASE WHEN b.method = 'IQR' THEN b.q1 - 1.5 * b.iqr END AS lower,
        CASE WHEN b.method = 'IQR' THEN b.q3 + 1.5 * b.iqr END AS upper,
        coalesce(b.method = 'IQR' AND (v < b.q1 - 1.5 * b.iqr OR v > b.q3 + 1.5 * b.iqr), FALSE) AS bad
      FROM rows JOIN b ON rows.class = b.class WHERE v IS NOT NULL)"""


@query("A14_iqr_clean", f"""
WITH rows AS (SELECT rec_id, class, CH4EF AS v FROM ch4), {IQR_SQL}
SELECT rec_id, class, v FROM f WHERE NOT bad /* {{ch4}} */""")
def a14(t):
    rows = t.role("ch4").select("rec_id", "class", F.col("CH4EF").alias("v"))
    return iqr_clean(rows, "class", "v")


@query("A14_iqr_audit", f"""
WITH rows AS (SELECT l_returnflag || l_linestatus AS class, l_extendedprice AS v FROM lineitem), {IQR_SQL}
SELECT class, method, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
  round(lower, 6) AS lower, round(upper, 6) AS upper, count(*) AS n_eligible,
  count(*) FILTER (WHERE bad) AS n_removed, round(avg(v), 6) AS mean_before,
  round(stddev_samp(v), 6) AS std_before, round(avg(CASE WHEN NOT bad THEN v END), 6) AS mean_after,
  count(*) FILTER (WHERE NOT bad) AS n_kept,
  round(count(*) FILTER (WHERE bad) * 100.0 / count(*), 6) AS pct_removed
FROM f GROUP BY ALL""")
def a14_audit(t):
    rows = t.lineitem.select(F.concat("l_returnflag", "l_linestatus").alias("class"),
                             F.col("l_extendedprice").alias("v"))
    return rounded(iqr_audit(rows, "class", "v"), 6)


@query("A15_ratio_means", """
SELECT class, round(avg(greatest(FB, 0.1)), 9) AS ratio_mean FROM {fb} WHERE class IS NOT NULL GROUP BY 1
UNION ALL SELECT NULL, round(avg(greatest(FB, 0.1)), 9) FROM {fb} WHERE class IS NOT NULL""")
def a15(t):
    return rounded(ratio_means(t.role("fb"), "class", "FB"), 9)


SCREEN_SQL = """
r AS (SELECT class, avg(greatest(FB, 0.1)) AS m FROM fb WHERE class IS NOT NULL GROUP BY 1),
g AS (SELECT avg(greatest(FB, 0.1)) AS m FROM fb WHERE class IS NOT NULL),
s AS (SELECT rec_id, n2o.class, N2OEF, mark, CASE WHEN mark = 'F' THEN N2OEF
        ELSE N2OEF / coalesce(nullif(r.m, 0), (SELECT m FROM g)) END AS v
      FROM n2o LEFT JOIN r ON n2o.class = r.class)"""


@query("A16_screening_value", f"""
WITH {SCREEN_SQL} SELECT rec_id, class, mark, round(v, 9) AS screen FROM s /* {{n2o}} {{fb}} */""")
def a16(t):
    means = ratio_means(t.role("fb"), "class", "FB")
    out = screening_value(t.role("n2o"), means, "class", "N2OEF", "mark")
    return rounded(out.select("rec_id", "class", "mark", "screen"), 9)


@query("A17_mixed_groups", """
SELECT class, count(*) FILTER (WHERE mark = 'F') AS n_f, count(*) FILTER (WHERE mark <> 'F') AS n_other
FROM {n2o} GROUP BY 1 HAVING count(*) FILTER (WHERE mark = 'F') > 0 AND count(*) FILTER (WHERE mark <> 'F') > 0""")
def a17(t):
    return mixed_groups(t.role("n2o"), "class", "mark")


@query("A18_reference_factors", f"""
WITH {SCREEN_SQL},
rows AS (SELECT rec_id, class, v FROM s), {IQR_SQL}
SELECT 'N2O' AS gas, class, round(avg(v), 9) AS reference FROM f WHERE NOT bad AND class <> 'Anaerobic' GROUP BY 2
UNION ALL SELECT 'N2O', 'Anaerobic', 0.0
UNION ALL SELECT 'CH4', class, round(avg(CH4EF), 9) FROM ch4 WHERE class IS NOT NULL GROUP BY 2
UNION ALL SELECT 'CH4', * FROM (VALUES ('Pond', 0.102::DOUBLE), ('Lagoon', 0.102), ('Anaerobic', 0.408)) /* {{n2o}} {{fb}} {{ch4}} */""")
def a18(t):
    means = ratio_means(t.role("fb"), "class", "FB")
    screened = screening_value(t.role("n2o"), means, "class", "N2OEF", "mark")
    n2o = reference_factors(iqr_clean(screened, "class", "screen"), "class", "screen", N2O_DEFAULTS)
    ch4 = reference_factors(t.role("ch4"), "class", "CH4EF", CH4_DEFAULTS)
    return rounded(n2o.select(F.lit("N2O").alias("gas"), "*")
                   .unionByName(ch4.select(F.lit("CH4").alias("gas"), "*")), 9)


@query("A26_weighted_rate", """
SELECT NAME_1, CASE WHEN sum(l_quantity) > 0 THEN round(sum(l_tax * l_quantity) / sum(l_quantity), 9) ELSE 0 END AS l_tax,
  sum(l_quantity) AS "l_quantity_Total" FROM {sales} GROUP BY 1""")
def a26(t):
    return rounded(weighted_rate(t.role("sales"), ["NAME_1"], {"l_tax": "l_quantity"}), 9)


LOADS_SQL = """
loads AS (SELECT *, coalesce(Anaerobic_digestion_ratio, 0) AS ad_ratio,
    BOD_all * (pct_sewer / 100 * coalesce(pct_sewer_treated, 0) / 100 * 1.25 * 0.811333
               + pct_septic / 100 * pct_septic_treated / 100 * 0.375) AS bod,
    TN_all * (pct_sewer / 100 * coalesce(pct_sewer_treated, 0) / 100 * 1.25
              + pct_septic / 100 * pct_septic_treated / 100 * 0.85) AS tn
  FROM (SELECT *, Population * BOD_PerCapita * 365 * 1e-9 AS BOD_all,
          Population * Protein_PerCapita * 0.16 * F_NONCON * N_HH * 44 / 28 * 365 * 1e-9 * Protein_consumed AS TN_all
        FROM city))"""


@query("A27_level_loads", f"""
WITH {LOADS_SQL}
SELECT 'country' AS level, NAME_0 AS key, round(sum(bod), 9) AS bod, round(sum(tn), 9) AS tn FROM loads GROUP BY NAME_0
UNION ALL SELECT 'continent', Continent, round(sum(bod), 9), round(sum(tn), 9) FROM loads GROUP BY Continent
UNION ALL SELECT 'income', Income_Level, round(sum(bod), 9), round(sum(tn), 9) FROM loads GROUP BY Income_Level
UNION ALL SELECT 'region', NAME_0 || ' | ' || Region, round(sum(bod), 9), round(sum(tn), 9) FROM loads GROUP BY NAME_0, Region
UNION ALL SELECT 'global', 'global', round(sum(bod), 9), round(sum(tn), 9) FROM loads /* {{city}} */""")
def a27(t):
    return rounded(level_loads(city_loads(t.role("city")), LEVELS), 9)


def query_pools(t, pool_size: int):
    """Pools of the role tables."""
    n2o = index_records(t.role("n2o"), "class", ["rec_id"])
    ratios = t.role("fb").where(F.col("class").isNotNull())
    fb = index_records(ratios, "class", ["rec_id"])
    ch4 = index_records(t.role("ch4").where(F.col("class").isNotNull()), "class", ["rec_id"])
    types = t.part.select(F.explode(F.array(*[F.lit(c) for c in CLASSES])).alias("class")).distinct()
    overall = F.coalesce(ratios.agg(F.avg("FB").alias("m")).scalar(), F.lit(1.0))
    return build_pools(types, n2o, ch4, fb, "class", overall, pool_size)


@query("A28_zeroed_share", f"""
WITH {MATRIX_SQL},
m AS (SELECT plant_id, sum(mean) AS total, sum(CASE WHEN class IN ('Lagoon') THEN mean ELSE 0 END) AS none
      FROM matrix GROUP BY 1)
SELECT round(sum(none / CASE WHEN total > 0 THEN total ELSE 1 END * served) / sum(served), 9) AS zeroed_share
FROM m JOIN plant ON m.plant_id = plant.plant_id /* {{plant}} {{predicted}} */""")
def a28(t):
    plants = t.role("plant")
    matrix = full_matrix(plants, t.role("predicted"), "plant_id", "label", CLASSES)
    pools = query_pools(t, 50)
    return rounded(zeroed_share(matrix, plants, pools, "plant_id", "served", "n2o_ef"), 9)


@query("A29_holdout_jobs", """
SELECT w.country, count(o.o_orderkey) AS n,
  CASE WHEN count(o.o_orderkey) > 400 THEN 0.2 WHEN count(o.o_orderkey) >= 100 THEN 0.5 END::DOUBLE AS fraction,
  CASE WHEN count(o.o_orderkey) = 0 THEN 'name not found' WHEN count(o.o_orderkey) < 100 THEN 'too few plants' ELSE 'run' END AS status
FROM (SELECT n_nationkey, n_name AS country FROM nation) w
LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 1000 * n_nationkey
LEFT JOIN orders o ON o_custkey = c_custkey GROUP BY 1""")
def a29(t):
    rows = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .where(F.col("c_acctbal") > 1000 * F.col("n_nationkey"))
            .select(F.col("n_name").alias("country")))
    wanted = t.nation.select(F.col("n_name").alias("country"))
    return holdout_jobs(rows, "country", wanted, 400, 100)


HOLDOUT_MODES = {
    "skip": {}, "whole_below": {"below": "whole"}, "small_below": {"below": "small"}, "whole": {"whole": True}}


@query("A29_holdout_modes", """
WITH c AS (SELECT n_name AS country, count(o.o_orderkey) AS n FROM nation
  LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 1000 * n_nationkey
  LEFT JOIN orders o ON o_custkey = c_custkey GROUP BY 1),
j AS (SELECT mode, country, n, unnest(CASE WHEN n = 0 OR mode = 'whole' THEN [NULL::DOUBLE] WHEN n > 400 THEN [0.1, 0.2]
    WHEN n >= 100 OR mode = 'small_below' THEN [0.3, 0.5] ELSE [NULL::DOUBLE] END) AS fraction
  FROM c, (VALUES ('skip'), ('whole_below'), ('small_below'), ('whole')) AS m(mode))
SELECT mode, country, n, fraction::DOUBLE AS fraction, CASE WHEN n = 0 THEN 'name not found'
  WHEN n < 100 AND mode = 'skip' THEN 'too few plants' ELSE 'run' END AS status FROM j""")
def a29_modes(t):
    rows = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .where(F.col("c_acctbal") > 1000 * F.col("n_nationkey"))
            .select(F.col("n_name").alias("country")))
    wanted = t.nation.select(F.col("n_name").alias("country"))
    return union_all([
        holdout_jobs(rows, "country", wanted, 400, 100, (0.1, 0.2), (0.3, 0.5), **options)
        .withColumn("mode", F.lit(name)) for name, options in HOLDOUT_MODES.items()])


@query("A1_bucket_sums", """
SELECT CASE WHEN o_totalprice <= 100000 THEN 's' WHEN o_totalprice <= 300000 THEN 'm' ELSE 'l' END AS bucket,
  round(sum(o_totalprice), 2) AS o_totalprice FROM orders GROUP BY 1""")
def a1_bucket(t):
    rows = t.orders.withColumn("bucket", population_bucket(F.col("o_totalprice"),
                                                           (100000.0, 300000.0), ("s", "m", "l")))
    return rounded(grouped_sums(rows, ["bucket"], ["o_totalprice"]), 2)


@query("A15_overall_ratio", """
SELECT p_brand, round(avg(p_size / 50.0) / (SELECT avg(greatest(FB, 0.1)) FROM {fb} WHERE class IS NOT NULL), 9) AS relative
FROM part GROUP BY 1""")
def a15_overall(t):
    means = ratio_means(t.role("fb"), "class", "FB")
    return rounded(t.part.groupBy("p_brand").agg(F.avg(F.col("p_size") / 50.0).alias("m"))
                   .select("p_brand", (F.col("m") / overall_ratio(means, "class")).alias("relative")), 9)
