"""Projections, predicates, orders and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import (climate_class, contains_ci, first_integer, join_key, name_or_null,
                                 off_scale, population_bucket, safe_name, split_key, status_label,
                                 to_number)
from ..functions.reference import COUNTRY_ALIASES, literal_table
from ..operators.aggregate import lead_columns, scale_columns
from ..operators.compare import (absent_countries, admin_fallback, order_rows, sector_split,
                                 year_column)
from ..operators.frames import available, lookup, replace_names, unmatched
from ..operators.proba import one_hot, wide_classes
from ..operators.ranking import with_row_number
from ..operators.validate import close_names, held_out
from ..sources.readers import union_all
from .helpers import rounded
from .registry import query
from .roles import CLASS_ROWS, CLASSES


@query("P1_population_bucket", """
SELECT plant_id, CASE WHEN served IS NULL THEN 'medium: 2000-10000'
  WHEN served <= 200000 THEN 'small: 0-2000' WHEN served <= 400000 THEN 'medium: 2000-10000'
  ELSE 'large: 10000+' END AS bucket FROM {sewered}""")
def p1(t):
    return t.role("sewered").select(
        "plant_id", population_bucket(F.col("served"), (200000.0, 400000.0)).alias("bucket"))


@query("P2_labelled_split", """
SELECT plant_id, label, 'train' AS part FROM {plant} WHERE label IS NOT NULL
UNION ALL SELECT plant_id, label, 'predict' FROM {plant} WHERE label IS NULL""")
def p2(t):
    plants = t.role("plant").select("plant_id", "label")
    return (plants.where(F.col("label").isNotNull()).withColumn("part", F.lit("train"))
            .unionByName(plants.where(F.col("label").isNull())
                         .withColumn("part", F.lit("predict"))))


@query("P3_in_list", """
SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""")
def p3(t):
    return (t.orders.where(F.col("o_orderpriority").isin(["1-URGENT", "5-LOW"]))
            .select("o_orderkey", "o_orderpriority"))


@query("P4_contains_split", """
SELECT coalesce(lower(source) LIKE '%wastewater%', FALSE) AS is_ww, Substance,
       count(*) AS n, round(sum(Y_2022), 2) AS total FROM {inventory} GROUP BY 1, 2""")
def p4(t):
    inventory = t.role("inventory")
    inside, outside = sector_split(inventory)
    both = inside.withColumn("is_ww", F.lit(True)).unionByName(
        outside.withColumn("is_ww", F.lit(False)))
    return rounded(both.groupBy("is_ww", "Substance").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Y_2022").alias("total")), 2)


@query("P5_named_regions", """
SELECT plant_id, Region FROM {plant} WHERE Region <> 'elsewhere'""")
def p5(t):
    plants = t.role("plant").withColumn(
        "Region", F.when(F.col("Region") == "elsewhere", "nan").otherwise(F.col("Region")))
    named = plants.withColumn("Region", name_or_null(F.col("Region")))
    return named.where(F.col("Region").isNotNull()).select("plant_id", "Region")


@query("P6_admin_fallback", """
WITH x AS (SELECT row_id, NAME_0, CASE WHEN Population > 60000 THEN '' ELSE NAME_1 END AS NAME_1,
                  CASE WHEN NAME_2 <> 'BUILDING' THEN NAME_2 END AS NAME_2 FROM {city})
SELECT row_id, NAME_0,
  CASE WHEN NAME_0 = 'ASIA' OR NAME_1 IS NULL OR NAME_1 = '' THEN NAME_0 ELSE NAME_1 END AS NAME_1,
  CASE WHEN NAME_0 = 'ASIA' OR NAME_1 IS NULL OR NAME_1 = '' THEN NAME_0
       WHEN NAME_2 IS NULL OR NAME_2 = '' THEN NAME_1 ELSE NAME_2 END AS NAME_2,
  CASE WHEN NAME_0 = 'ASIA' THEN 'Country_as_City'
       WHEN NAME_1 IS NULL OR NAME_1 = '' THEN 'Country_as_Province_as_City'
       WHEN NAME_2 IS NULL OR NAME_2 = '' THEN 'Province_as_City' ELSE 'City' END AS City_Level
FROM x""")
def p6(t):
    cities = t.role("city").select(
        "row_id", "NAME_0",
        F.when(F.col("Population") > 60000, "").otherwise(F.col("NAME_1")).alias("NAME_1"),
        F.when(F.col("NAME_2") != "BUILDING", F.col("NAME_2")).alias("NAME_2"))
    return admin_fallback(cities, ["ASIA"])


@query("P7_derived_totals", """
SELECT row_id, round(Population * BOD_PerCapita, 4) AS total,
       round(pct_sewer_treated + pct_septic_treated, 6) AS treated FROM {city}""")
def p7(t):
    return rounded(t.role("city").select(
        "row_id", (F.col("Population") * F.col("BOD_PerCapita")).alias("total"),
        (F.col("pct_sewer_treated") + F.col("pct_septic_treated")).alias("treated")), 4)


@query("P8_unit_scale", """
SELECT o_orderkey, round(o_totalprice / 1000.0, 6) AS o_totalprice FROM orders""")
def p8(t):
    scaled = scale_columns(t.orders.select("o_orderkey", "o_totalprice"),
                           ["o_totalprice", "not_there"], 1000.0)
    return rounded(scaled, 6)


@query("P9_column_order", "SELECT p_type, p_brand, p_partkey, p_size FROM part")
def p9(t):
    renamed = t.part.select(F.col("p_partkey").alias("key"), "p_brand", "p_type", "p_size")
    ordered = lead_columns(renamed.withColumnRenamed("key", "p_partkey"),
                           ["p_type", "missing", "p_brand"])
    assert ordered.columns == ["p_type", "p_brand", "p_partkey", "p_size"]
    return ordered


@query("P10_climate_class", """
SELECT plant_id, CASE WHEN precipitation * 12 < 500 AND temperature > 18 THEN 'Hot semi-arid'
  WHEN temperature < 10 THEN 'Humid continental'
  WHEN temperature < 15 AND precipitation * 12 BETWEEN 500 AND 1200 THEN 'Temperate oceanic'
  WHEN precipitation * 12 BETWEEN 500 AND 1200 AND temperature >= 15 THEN 'Mediterranean'
  ELSE 'Humid subtropical' END AS climate FROM {sewered}""")
def p10(t):
    return t.role("sewered").select(
        "plant_id", climate_class(F.col("temperature"), F.col("precipitation")).alias("climate"))


@query("P11_lookup_unknown", """
SELECT c_custkey, coalesce(r_name, 'Unknown') AS continent
FROM customer LEFT JOIN (SELECT n_nationkey, r_name FROM nation JOIN region
  ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA') ON c_nationkey = n_nationkey""")
def p11(t):
    table = (t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
             .where(F.col("r_name") != "AFRICA").select("n_nationkey", "r_name"))
    return (lookup(t.customer.select("c_custkey", "c_nationkey"), table, "c_nationkey",
                   "n_nationkey", ["r_name"], "Unknown")
            .select("c_custkey", F.col("r_name").alias("continent")))


@query("P11_unmatched_names", """
SELECT DISTINCT c_nationkey FROM customer WHERE c_nationkey NOT IN
  (SELECT n_nationkey FROM nation WHERE n_regionkey <> 0)""")
def p11_unmatched(t):
    return unmatched(t.customer, t.nation.where(F.col("n_regionkey") != 0), "c_nationkey",
                     "n_nationkey")


@query("P12_name_harmonise", """
SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'Vietnam' WHEN '2-HIGH' THEN 'Laos'
  WHEN '3-MEDIUM' THEN 'Côte d''Ivoire' ELSE o_orderpriority END AS name FROM orders""")
def p12(t):
    aliases = literal_table(t.spark, COUNTRY_ALIASES, "alias string, name string")
    spelled = F.create_map(F.lit("1-URGENT"), F.lit("Viet Nam"), F.lit("2-HIGH"), F.lit("Lao PDR"),
                           F.lit("3-MEDIUM"), F.lit("Cote d'Ivoire"))
    rows = t.orders.select("o_orderkey", F.coalesce(F.try_element_at(
        spelled, F.col("o_orderpriority")), F.col("o_orderpriority")).alias("name"))
    return replace_names(rows, aliases, "name")


@query("P13_year_column", """
SELECT Country, round(sum(Y_2022), 2) AS preferred, round(sum(Y_2021), 2) AS latest
FROM {inventory} GROUP BY 1""")
def p13(t):
    inventory = t.role("inventory")
    preferred = year_column(inventory.columns)
    latest = year_column([c for c in inventory.columns if c != preferred])
    return rounded(inventory.groupBy("Country").agg(F.sum(preferred).alias("preferred"),
                                                    F.sum(latest).alias("latest")), 2)


@query("P14_number_coercion", """
SELECT event_id, coalesce(TRY_CAST(v AS DOUBLE), 0) AS as_zero, TRY_CAST(v AS DOUBLE) AS as_null
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN event_type ELSE CAST(value AS VARCHAR) END AS v FROM events)""")
def p14(t):
    text = F.when(F.col("event_type") == "error", F.col("event_type")).otherwise(
        F.col("value").cast("string"))
    return t.events.select("event_id", to_number(text, 0.0).alias("as_zero"),
                           to_number(text).alias("as_null"))


@query("P15_constant_fill", """
SELECT plant_id, coalesce(served, 1.0) AS weight, coalesce(temperature, 0.0) AS load FROM {sewered}""")
def p15(t):
    return (t.role("sewered").select("plant_id", F.col("served").alias("weight"),
                                     F.col("temperature").alias("load"))
            .fillna({"weight": 1.0, "load": 0.0}))


@query("P16_status_label", """
SELECT doc_id, CASE WHEN toxic = 1 THEN 'Anaerobic' ELSE 'Non-Anaerobic' END AS status FROM labels""")
def p16(t):
    return t.labels.select("doc_id", status_label(F.col("toxic").cast("string")).alias("status"))


@query("P17_composite_key", """
SELECT row_id, NAME_0 || ' | ' || Region || ' | ' || NAME_2 AS region_key, NAME_0 AS left_part,
       Region || ' | ' || NAME_2 AS right_part FROM {city}""")
def p17(t):
    keyed = t.role("city").select("row_id", join_key(F.col("NAME_0"), F.col("Region"),
                                                     F.col("NAME_2")).alias("region_key"))
    left, right = split_key(F.col("region_key"))
    return keyed.select("row_id", "region_key", left.alias("left_part"), right.alias("right_part"))


@query("P18_one_hot", f"""
SELECT plant_id, c.class, CASE WHEN label = c.class THEN 1.0::DOUBLE ELSE 0.0 END AS mean,
       0.0::DOUBLE AS std
FROM {{plant}}, (VALUES {CLASS_ROWS}) AS c(i, class) WHERE label IN (SELECT class FROM (VALUES {CLASS_ROWS}) AS d(i, class))""")
def p18(t):
    return one_hot(t.role("plant"), "plant_id", "label", CLASSES)


@query("P19_available_columns", "SELECT p_partkey, p_size, p_retailprice FROM part")
def p19(t):
    chosen = available(t.part, ["p_partkey", "p_size", "HDI", "p_retailprice"])
    assert wide_classes(["A_mean", "A_std", "B_mean"]) == ["A"]
    return t.part.select(*chosen)


@query("P20_rounding", """
SELECT o_orderkey, round_even(o_totalprice / 1000.0, 1) AS one, round_even(o_totalprice, 0) AS whole
FROM orders""")
def p20(t):
    return t.orders.select("o_orderkey", F.bround(F.col("o_totalprice") / 1000.0, 1).alias("one"),
                           F.bround("o_totalprice", 0).alias("whole"))


@query("P21_safe_name", r"""
SELECT page_id, trim(regexp_replace(url, '[^\p{{L}}\p{{M}}\p{{N}}_\-]+', '_', 'g'), '_') AS stem FROM pages
""".replace("{{", "{").replace("}}", "}"))
def p21(t):
    return t.pages.select("page_id", safe_name(F.col("url")).alias("stem"))


@query("P22_first_integer", r"""
SELECT event_id, CASE WHEN regexp_extract(v, '(\d+)', 1) = '' THEN 1000000000000
  ELSE CAST(regexp_extract(v, '(\d+)', 1) AS BIGINT) END AS edge
FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 'Pool' ELSE props END AS v FROM events)""")
def p22(t):
    label = F.when(F.col("event_type") == "view", "Pool").otherwise(F.col("props"))
    return t.events.select("event_id", first_integer(label).alias("edge"))


@query("P23_close_names", """
SELECT DISTINCT wanted, p_name || ' ' || p_type AS candidate FROM part,
  (VALUES ('Ring, large', 'ring'), ('promo gear', 'promo'), ('RED-blue', 'red-blue'), ('ed', 'ed')) AS w(wanted, key)
WHERE contains(lower(p_name || ' ' || p_type), key)""")
def p23(t):
    names = t.part.select(F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return close_names(names, "name", ["Ring, large", "promo gear", "RED-blue", "ed"])


@query("A30_scale_marks", """
SELECT class, count(*) FILTER (WHERE mark NOT IN ('F', 'B')) AS n_neither,
       count(*) FILTER (WHERE mark <> 'F') AS n_not_f, count(*) FILTER (WHERE mark = 'B') AS n_b
FROM {n2o} GROUP BY 1""")
def a30(t):
    not_f, only_b = off_scale(F.col("mark")), off_scale(F.col("mark"), "==B")
    return t.role("n2o").groupBy("class").agg(
        F.count(F.when(not_f & ~only_b, 1)).alias("n_neither"),
        F.count(F.when(not_f, 1)).alias("n_not_f"), F.count(F.when(only_b, 1)).alias("n_b"))


@query("O1_zero_last_order", """
SELECT row_id, row_number() OVER (ORDER BY CASE WHEN coalesce(Population, 0) <= 0 THEN 1 ELSE 0 END,
  Population DESC NULLS LAST, row_id) AS pos FROM {city}""")
def o1(t):
    return order_rows(t.role("city").select("row_id", "Population"), "Population", "Population",
                      "row_id", "pos").select("row_id", "pos")


@query("O2_descending_order", """
SELECT n_name, total, row_number() OVER (ORDER BY total DESC NULLS LAST, n_name) AS pos
FROM (SELECT n_name, round(sum(s_acctbal), 2) AS total FROM supplier JOIN nation
  ON s_nationkey = n_nationkey GROUP BY 1)""")
def o2(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    totals = rounded(rows.groupBy("n_name").agg(F.sum("s_acctbal").alias("total")), 2)
    order = [F.col("total").desc_nulls_last(), F.col("n_name").asc()]
    return with_row_number(totals, [], order, None, "pos").drop("pos_total").orderBy("pos")


@query("O3_top_ten", """
SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def o3(t):
    return (t.customer.select("c_custkey", "c_acctbal")
            .orderBy(F.col("c_acctbal").desc_nulls_last(), "c_custkey").limit(10))


@query("O4_category_order", """
SELECT o_orderstatus AS stratum, CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS pos,
       count(*) AS n FROM orders GROUP BY 1, 2""")
def o4(t):
    position = F.array_position(F.array(F.lit("P"), F.lit("O"), F.lit("F")), F.col("stratum"))
    return (t.orders.groupBy(F.col("o_orderstatus").alias("stratum"))
            .agg(F.count(F.lit(1)).alias("n")).withColumn("pos", position).orderBy("pos"))


@query("U1_union_by_name", """
SELECT c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def u1(t):
    return union_all([
        t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"),
                          F.col("c_mktsegment").alias("segment")),
        t.supplier.select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"))])


@query("U2_distinct_keys", """
SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders""")
def u2(t):
    keys = ["o_orderstatus", "o_orderpriority"]
    return t.orders.select(*keys).distinct().orderBy(*keys)


@query("U3_set_difference", """
SELECT Country FROM (SELECT DISTINCT n_name AS Country FROM nation) WHERE Country NOT IN
  (SELECT Country FROM {inventory} WHERE lower(source) LIKE '%wastewater%' AND Y_2022 > 495000)""")
def u3(t):
    high = t.role("inventory").where(F.col("Y_2022") > 495000)
    return absent_countries(high, t.nation.select(F.col("n_name").alias("Country")))


@query("J14_held_out_complement", """
SELECT plant_id, Region FROM {plant} WHERE NOT (NAME_0 = 'ASIA' AND served > 3000)""")
def j14(t):
    plants = t.role("plant").select("plant_id", "NAME_0", "Region", "served")
    test = plants.where((F.col("NAME_0") == "ASIA") & (F.col("served") > 3000))
    return held_out(plants, "plant_id", test).select("plant_id", "Region")


@query("P4_contains_rows", """
SELECT page_id, coalesce(contains(lower(html), 'wastewater'), FALSE) AS ww,
       coalesce(contains(lower(html), 'lang="fr"'), FALSE) AS fr FROM pages""")
def p4_rows(t):
    return t.pages.select("page_id", contains_ci(F.col("html"), "wastewater").alias("ww"),
                          contains_ci(F.col("html"), 'LANG="fr"').alias("fr"))
