"""Joins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.reference import SEWER_NETWORKS
from ..functions.uniform import digest
from ..operators.aggregate import grouped_sums, merge_regions, rollup
from ..operators.compare import theta_rank
from ..operators.draws import draw_factors, expand_draws, pool_table, with_class_cdf
from ..operators.match import nearest_reference
from ..operators.proba import full_matrix, to_arrays
from ..operators.validate import parameter_key, remaining, with_grid
from .helpers import rounded
from .registry import query, u
from .roles import CLASS_ROWS, CLASSES

NETWORK_ROWS = ", ".join(f"({i}, '{n}', {math.log10(pe)!r}::DOUBLE, '{c}', {e}::DOUBLE)"
                         for i, (n, pe, c, e) in enumerate(SEWER_NETWORKS))

CLIMATE_SQL = """CASE WHEN precipitation * 12 < 500 AND temperature > 18 THEN 'Hot semi-arid'
  WHEN temperature < 10 THEN 'Humid continental'
  WHEN temperature < 15 AND precipitation * 12 BETWEEN 500 AND 1200 THEN 'Temperate oceanic'
  WHEN precipitation * 12 BETWEEN 500 AND 1200 AND temperature >= 15 THEN 'Mediterranean'
  ELSE 'Humid subtropical' END"""

SEWER_MATCH_SQL = f"""
x AS (SELECT plant_id, NAME_0, Region, served, temperature, precipitation, {CLIMATE_SQL} AS climate,
             CASE WHEN served IS NOT NULL THEN log10(greatest(served, 1.0)) END AS lp FROM sewered),
d AS (SELECT x.*, r.ord, r.net, r.rc, r.e,
             CASE WHEN x.climate <> r.rc THEN 3.0::DOUBLE ELSE 0.0 END + abs(x.lp - r.lpe) AS dist
      FROM x, (VALUES {NETWORK_ROWS}) AS r(ord, net, lpe, rc, e)),
best AS (SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY plant_id
           ORDER BY dist NULLS FIRST, ord) AS rn FROM d) WHERE rn = 1)"""


@query("J1_join_of_aggregates", """
SELECT NAME_0, NAME_1, round(sum(l_extendedprice), 2) AS l_extendedprice,
  round(sum(CASE WHEN l_discount IS NOT NULL AND l_quantity > 0 THEN l_discount * l_quantity END)
  / sum(CASE WHEN l_discount IS NOT NULL AND l_quantity > 0 THEN l_quantity END), 9) AS l_discount
FROM {sales} GROUP BY 1, 2""")
def j1(t):
    out = rollup(t.role("sales"), ["NAME_0", "NAME_1"], ["l_extendedprice"], ["l_discount"],
                 "l_quantity")
    return rounded(rounded(out, 2, ["l_extendedprice"]), 9, ["l_discount"])


@query("J2_outer_merge", """
WITH a AS (SELECT n_name, count(*) AS n_sup, round(sum(s_acctbal), 2) AS w FROM supplier
  JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 4000 GROUP BY 1),
b AS (SELECT n_name, count(*) AS n_cust, round(sum(c_acctbal) / 20, 2) AS w FROM customer
  JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey <> 3 GROUP BY 1)
SELECT coalesce(a.n_name, b.n_name) AS n_name, n_sup, n_cust,
  CASE WHEN a.w IS NULL THEN b.w WHEN b.w IS NULL THEN a.w ELSE greatest(a.w, b.w) END AS w
FROM a FULL JOIN b ON a.n_name = b.n_name""")
def j2(t):
    nation = t.nation.select("n_nationkey", "n_name")
    a = (t.supplier.where(F.col("s_acctbal") > 4000)
         .join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name")
         .agg(F.count(F.lit(1)).alias("n_sup"), F.round(F.sum("s_acctbal"), 2).alias("w")))
    b = (t.customer.where(F.col("c_nationkey") != 3)
         .join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name")
         .agg(F.count(F.lit(1)).alias("n_cust"), F.round(F.sum("c_acctbal") / 20, 2).alias("w")))
    return merge_regions(a, b, ["n_name"], "w")


@query("J3_type_lookup", """
WITH m AS (SELECT class, avg(N2OEF) AS reference FROM {n2o} WHERE class <> 'OD' GROUP BY 1)
SELECT l.class, count(*) AS n, round(sum(l.CH4EF), 4) AS ch4, round(max(m.reference), 9) AS reference
FROM {ch4} l LEFT JOIN m ON l.class = m.class GROUP BY 1""")
def j3(t):
    means = (t.role("n2o").where(F.col("class") != "OD").groupBy("class")
             .agg(F.avg("N2OEF").alias("reference")))
    out = t.role("ch4").join(means, "class", "left").groupBy("class").agg(
        F.count(F.lit(1)).alias("n"), F.sum("CH4EF").alias("ch4"),
        F.max("reference").alias("reference"))
    return rounded(rounded(out, 4, ["ch4"]), 9, ["reference"])


MATRIX_SQL = f"""
matrix AS (SELECT p.plant_id, c.i, c.class,
    coalesce(p.label IN (SELECT class FROM (VALUES {CLASS_ROWS}) AS k(i, class)), FALSE) AS is_known,
    CASE WHEN coalesce(p.label IN (SELECT class FROM (VALUES {CLASS_ROWS}) AS k(i, class)), FALSE)
         THEN CASE WHEN p.label = c.class THEN 1.0::DOUBLE ELSE 0.0 END
         ELSE coalesce(q.mean, 0.0) END AS mean,
    CASE WHEN coalesce(p.label IN (SELECT class FROM (VALUES {CLASS_ROWS}) AS k(i, class)), FALSE)
         THEN 0.0::DOUBLE ELSE coalesce(q.std, 0.0) END AS std
  FROM plant p CROSS JOIN (VALUES {CLASS_ROWS}) AS c(i, class)
  LEFT JOIN predicted q ON q.plant_id = p.plant_id AND q.class = c.class)"""


@query("J4_align_predictions", f"""
WITH {MATRIX_SQL} SELECT plant_id, class, round(mean, 9) AS mean, round(std, 9) AS std, is_known
FROM matrix /* {{plant}} {{predicted}} */""")
def j4(t):
    return rounded(full_matrix(t.role("plant"), t.role("predicted"), "plant_id", "label", CLASSES), 9)


@query("J5_nearest_reference", f"""
WITH {SEWER_MATCH_SQL}
SELECT plant_id, net AS Matched_Network, rc AS Matched_Climate, e AS E_ML_kg_per_ML,
       round(dist, 9) AS Match_Distance FROM best /* {{sewered}} */""")
def j5(t):
    from ..functions.columns import climate_class
    plants = t.role("sewered").withColumn(
        "climate", climate_class(F.col("temperature"), F.col("precipitation")))
    out = nearest_reference(plants, "served", "climate", SEWER_NETWORKS)
    return rounded(out.select("plant_id", "Matched_Network", "Matched_Climate", "E_ML_kg_per_ML",
                              "Match_Distance"), 9)


@query("J6_semi_anti", """
SELECT 'semi' AS kind, c_custkey FROM customer WHERE c_custkey IN
  (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
UNION ALL SELECT 'anti', c_custkey FROM customer WHERE c_custkey NOT IN
  (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def j6(t):
    high = t.orders.where(F.col("o_totalprice") > 300000).select(F.col("o_custkey").alias("c_custkey"))
    base = t.customer.select("c_custkey")
    return (base.join(high, "c_custkey", "left_semi").select(F.lit("semi").alias("kind"), "c_custkey")
            .unionByName(base.join(high, "c_custkey", "left_anti")
                         .select(F.lit("anti").alias("kind"), "c_custkey")))


@query("J10_theta_rank", """
WITH s AS (SELECT Country, Y_2022 AS v FROM {inventory}
           WHERE Substance = 'CH4' AND NOT coalesce(lower(source) LIKE '%wastewater%', FALSE)
             AND Country <> 'NATION_7')
SELECT o.Country, CASE WHEN count(s.Country) = 0 THEN NULL
         ELSE count(*) FILTER (WHERE s.v > o.CH4_Total) + 1 END AS CH4_Total_rank,
       CASE WHEN count(s.Country) = 0 THEN NULL
         ELSE count(*) FILTER (WHERE s.v > o.N2O_Total) + 1 END AS N2O_Total_rank
FROM {ours} o LEFT JOIN s ON s.Country = o.Country GROUP BY 1""")
def j10(t):
    sectors = t.role("inventory").where(
        (F.col("Substance") == "CH4") & (F.col("Country") != "NATION_7")
        & ~F.coalesce(F.lower("source").contains("wastewater"), F.lit(False)))
    return (theta_rank(t.role("ours"), sectors, ["Country"], "Y_2022", ["CH4_Total", "N2O_Total"])
            .select("Country", "CH4_Total_rank", "N2O_Total_rank"))


@query("J11_drawn_pool_slot", f"""
WITH p AS (SELECT plant_id, list(mean ORDER BY i) AS m FROM
  (SELECT q.plant_id, c.i, coalesce(max(CASE WHEN q.class = c.class THEN q.mean END), 0.0) AS mean
   FROM {{predicted}} q, (VALUES {CLASS_ROWS}) AS c(i, class) GROUP BY 1, 2) GROUP BY 1),
c AS (SELECT plant_id, i, sum(m[i + 1]) OVER (PARTITION BY plant_id ORDER BY i) AS cum
      FROM p, (VALUES {CLASS_ROWS}) AS k(i, class)),
t AS (SELECT plant_id, max(cum) AS total FROM c GROUP BY 1),
sims AS (SELECT unnest(range(20)) AS sim),
k AS (SELECT c.plant_id, sim, min(i) FILTER (WHERE {u("'11|' || sim || '|' || c.plant_id")} < cum / total) AS ci
      FROM c JOIN t ON c.plant_id = t.plant_id, sims GROUP BY 1, 2),
pool AS (SELECT (o_orderkey % 6)::INT AS class_idx, (o_orderkey // 6)::INT AS slot, o_totalprice AS v
         FROM orders)
SELECT k.plant_id, k.sim::INT AS sim, k.ci::INT AS class_idx, a.v AS ch4_ef, b.v * 2 AS n2o_ef
FROM k CROSS JOIN (SELECT max(slot) + 1 AS size FROM pool) LEFT JOIN pool a ON a.class_idx = k.ci AND a.slot = floor({u("'11|' || k.sim || '|' || k.plant_id", 1)} * size)
LEFT JOIN pool b ON b.class_idx = k.ci AND b.slot = floor({u("'11|' || k.sim || '|' || k.plant_id", 2)} * size)""")
def j11(t):
    arrays = with_class_cdf(to_arrays(t.role("predicted"), "plant_id", CLASSES), len(CLASSES))
    # Orders dealt out as pool slots: six classes in turn.
    pools = t.orders.select(
        F.element_at(F.array(*[F.lit(c) for c in CLASSES]),
                     (F.col("o_orderkey") % 6 + 1).cast("int")).alias("class"),
        F.floor(F.col("o_orderkey") / 6).cast("int").alias("slot"),
        F.col("o_totalprice").alias("ch4_ef"), (F.col("o_totalprice") * 2).alias("n2o_ef"))
    draws = expand_draws(arrays.select("plant_id", "cdf"), "plant_id", 20, 11, len(CLASSES), None)
    # The pool grows with the orders: slots are drawn from all of it, and it is not broadcast.
    size = pools.agg(F.max("slot") + 1).first()[0] or 0
    out = draw_factors(draws, pool_table(pools, CLASSES), len(CLASSES), size, broadcast_rows=0)
    return out.select("plant_id", "sim", "class_idx", "ch4_ef", "n2o_ef")


GRID = {"max_depth": [4, 5, 6, 8], "n_estimators": [100, 200, 300],
        "learning_rate": [0.05, 0.1, 0.3]}
GRID_SQL = """
grid AS (SELECT (di * 9 + ni * 3 + li)::INT AS ordinal, d::INT AS max_depth, n::INT AS n_estimators, l::DOUBLE AS learning_rate
  FROM (VALUES (0, 4), (1, 5), (2, 6), (3, 8)) AS a(di, d), (VALUES (0, 100), (1, 200), (2, 300)) AS b(ni, n),
       (VALUES (0, 0.05), (1, 0.1), (2, 0.3)) AS c(li, l)),
buckets AS (SELECT p_type AS bucket, count(*) AS n_rows FROM part GROUP BY 1)"""


@query("J12_parameter_grid", f"""
WITH {GRID_SQL} SELECT bucket, n_rows, grid.* FROM buckets, grid""")
def j12(t):
    buckets = t.part.groupBy(F.col("p_type").alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))
    return with_grid(buckets, GRID)


@query("J13_remaining_work", f"""
WITH {GRID_SQL} SELECT bucket, max_depth || '|' || n_estimators || '|' || learning_rate AS param_key
FROM buckets, grid WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_type = bucket AND p_size = max_depth
  AND n_estimators = 100 AND p_retailprice > 950)""")
def j13(t):
    buckets = t.part.groupBy(F.col("p_type").alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"))
    grid = with_grid(buckets, GRID)
    done = t.part.where(F.col("p_retailprice") > 950).select(
        F.col("p_type").alias("bucket"), F.col("p_size").alias("max_depth"),
        F.lit(100).alias("n_estimators"))
    left = remaining(grid, done, ["bucket", "max_depth", "n_estimators"])
    return left.select("bucket", parameter_key(list(GRID)).alias("param_key"))


@query("J3_keyed_digest", """
SELECT s_nationkey, count(DISTINCT md5('7|' || s_suppkey)) AS n_keys FROM supplier GROUP BY 1""")
def j3_digest(t):
    return t.supplier.groupBy("s_nationkey").agg(
        F.countDistinct(digest(7, F.col("s_suppkey"))).alias("n_keys"))


@query("A1_grouped_sums", """
SELECT NAME_0, NAME_1, round(sum(l_extendedprice), 2) AS l_extendedprice,
       round(coalesce(sum(CASE WHEN NAME_2 = 'none' THEN l_tax END), 0), 6) AS empty_sum
FROM {sales} WHERE NAME_0 IS NOT NULL AND NAME_1 IS NOT NULL GROUP BY 1, 2""")
def a1(t):
    rows = t.role("sales").withColumn("empty_sum", F.when(F.col("NAME_2") == "none", F.col("l_tax")))
    return rounded(grouped_sums(rows, ["NAME_0", "NAME_1"], ["l_extendedprice", "empty_sum"]), 2)
