"""Validation against reference factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import population_bucket
from ..functions.emissions import CH4_DEFAULTS, N2O_DEFAULTS
from ..operators.clean import reference_factors
from ..operators.draws import distribution
from ..operators.proba import to_arrays
from ..operators.validate import (best_sets, coverage_summary, few_plants, fold_metrics, gas_rows,
                                  group_sizes,
                                  interval_summary, joint_score, metric_summary, reference_mean)
from ..plans.validation import (fold_report, group_intervals, holdout_report, plant_results,
                                with_strata)
from ..session import materialize
from .aggregates import query_pools
from .draws import FIXED_SQL, N_SIM, POOL, SEED, pools_sql
from .helpers import rounded
from .registry import query, u
from .roles import CLASS_ROWS, CLASSES

ROWS_SQL = """
rows AS (SELECT o_orderkey, o_orderstatus AS fold, CASE WHEN o_orderpriority = '5-LOW' THEN 'small' ELSE 'large' END AS bucket,
    CASE WHEN c_acctbal > 0 THEN c_acctbal END AS size, o_totalprice / 1000 AS t1,
    CASE WHEN c_acctbal < 9000 THEN c_acctbal / 10 + 200 END AS p1, c_acctbal / 100 AS t2, o_totalprice / 5000 AS p2
  FROM orders JOIN customer ON o_custkey = c_custkey),
gas AS (SELECT o_orderkey, fold, bucket, size, 'N2O' AS gas, t1 AS t, p1 AS p FROM rows
  UNION ALL SELECT o_orderkey, fold, bucket, size, 'CH4', t2, p2 FROM rows),
m AS (SELECT gas, fold, bucket, count(*) AS n, avg(t) AS tm, avg(p) AS pm, sum(t * coalesce(size, 1)) / sum(coalesce(size, 1)) AS tw,
    sum(p * coalesce(size, 1)) / sum(coalesce(size, 1)) AS pw, sqrt(avg((p - t) * (p - t))) AS rmse, avg(abs(p - t)) AS mae
  FROM gas WHERE t IS NOT NULL AND p IS NOT NULL GROUP BY 1, 2, 3)"""


def metric_rows(t):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey", F.col("o_orderstatus").alias("fold"),
        F.when(F.col("o_orderpriority") == "5-LOW", "small").otherwise("large").alias("bucket"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("size"),
        (F.col("o_totalprice") / 1000).alias("N2O_true"),
        F.when(F.col("c_acctbal") < 9000, F.col("c_acctbal") / 10 + 200).alias("N2O_pred"),
        (F.col("c_acctbal") / 100).alias("CH4_true"), (F.col("o_totalprice") / 5000).alias("CH4_pred"))
    return gas_rows(rows, ["fold", "bucket", "size"])


@query("A20_fold_metrics", f"""
WITH {ROWS_SQL}
SELECT gas, fold, bucket, n AS n_samples, round(tm, 6) AS true_mean, round(pm, 6) AS pred_mean, round(tw, 6) AS true_wtd, round(pw, 6) AS pred_wtd,
  round(rmse, 6) AS rmse, round(mae, 6) AS mae, round((pm - tm) / tm * 100, 6) AS rel_error_pct, round((pw - tw) / tw * 100, 6) AS rel_error_wtd_pct FROM m""")
def a20(t):
    return rounded(fold_metrics(metric_rows(t), ["gas", "fold", "bucket"], "size", None), 6)


@query("A21_metric_summary", f"""
WITH {ROWS_SQL}
SELECT gas, 'rmse' AS metric, round(avg(rmse), 6) AS mean, round(min(rmse), 6) AS min, round(max(rmse), 6) AS max, round(stddev_samp(rmse), 6) AS std FROM m GROUP BY 1
UNION ALL SELECT gas, 'mae', round(avg(mae), 6), round(min(mae), 6), round(max(mae), 6), round(stddev_samp(mae), 6) FROM m GROUP BY 1""")
def a21(t):
    folds = fold_metrics(metric_rows(t), ["gas", "fold", "bucket"], "size", None)
    return rounded(metric_summary(folds, ["gas"], ["rmse", "mae"]), 6)


@query("A22_joint_score", f"""
WITH {ROWS_SQL}, s AS (SELECT bucket, fold, CASE WHEN fold = 'P' AND gas = 'CH4' THEN NULL ELSE gas END AS gas, rmse FROM m)
SELECT bucket, fold, CASE WHEN count(*) FILTER (WHERE gas = 'N2O') > 0 AND count(*) FILTER (WHERE gas = 'CH4') > 0
  THEN round(avg(rmse) FILTER (WHERE gas = 'N2O') + avg(rmse) FILTER (WHERE gas = 'CH4'), 6) ELSE 'inf'::DOUBLE END AS score FROM s GROUP BY 1, 2""")
def a22(t):
    folds = fold_metrics(metric_rows(t), ["gas", "fold", "bucket"], "size", None)
    kept = folds.where(~((F.col("fold") == "P") & (F.col("gas") == "CH4")))
    scores = joint_score(kept, ["bucket", "fold"])
    return scores.select("bucket", "fold", F.when(F.col("score") == float("inf"), F.col("score"))
                         .otherwise(F.round("score", 6)).alias("score"))


@query("W2_best_scored_sets", f"""
WITH {ROWS_SQL}, s AS (SELECT bucket, fold, sum(rmse) AS score FROM m GROUP BY 1, 2)
SELECT bucket, 1 AS rank, arg_min(fold, score) AS fold, round(min(score), 6) AS score FROM s GROUP BY 1""")
def w2_scored(t):
    folds = fold_metrics(metric_rows(t), ["gas", "fold", "bucket"], "size", None)
    scores = joint_score(folds, ["bucket", "fold"])
    return rounded(best_sets(scores, "bucket", "fold").select("bucket", "rank", "fold", "score"), 6)


@query("A24_distribution", """
SELECT o_custkey, round(avg(o_totalprice), 6) AS price_Mean, round(quantile_cont(o_totalprice, 0.025), 6) AS price_P2_5,
  round(quantile_cont(o_totalprice, 0.5), 6) AS price_Median, round(quantile_cont(o_totalprice, 0.975), 6) AS price_P97_5,
  count(*) FILTER (WHERE o_totalprice IS NULL) AS price_Missing
FROM (SELECT o_custkey, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS o_totalprice FROM orders) GROUP BY 1""")
def a24(t):
    rows = t.orders.select("o_custkey", F.when(F.col("o_orderpriority") != "5-LOW",
                                               F.col("o_totalprice")).alias("price"))
    return rounded(distribution(rows, ["o_custkey"], ["price"], bounded=False), 6)


@query("A19_reference_mean", """
WITH m AS (SELECT class, avg(N2OEF) AS reference FROM {n2o} WHERE class <> 'OD' GROUP BY 1),
p AS (SELECT q.plant_id, q.class, NAME_0, CASE WHEN s_acctbal > 1000 THEN served END AS served
  FROM {predicted} q JOIN {plant} pl ON pl.plant_id = q.plant_id JOIN supplier ON s_suppkey = q.plant_id)
SELECT NAME_0, round(sum(CASE WHEN m.class IS NOT NULL THEN reference * coalesce(served, 1) END) / sum(CASE WHEN m.class IS NOT NULL THEN coalesce(served, 1) END), 9) AS true_value
FROM p LEFT JOIN m ON m.class = p.class GROUP BY 1""")
def a19(t):
    reference = (t.role("n2o").where(F.col("class") != "OD").groupBy("class")
                 .agg(F.avg("N2OEF").alias("reference")))
    plants = (t.role("predicted").select("plant_id", "class").join(t.role("plant"), "plant_id")
              .join(t.supplier, F.col("s_suppkey") == F.col("plant_id"))
              .select("NAME_0", "class", F.when(F.col("s_acctbal") > 1000, F.col("served")).alias("served")))
    return rounded(reference_mean(plants, ["NAME_0"], "class", "served", reference, "class", "reference"), 9)


INTERVAL_SQL = """
iv AS (SELECT o_custkey AS g, o_orderpriority AS gas, avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.025) AS lo,
    quantile_cont(o_totalprice, 0.5) AS md, quantile_cont(o_totalprice, 0.975) AS hi, stddev_pop(o_totalprice) AS sd
  FROM orders GROUP BY 1, 2),
tv AS (SELECT o_custkey AS g, avg(o_totalprice) AS tv FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)"""


def order_intervals(t):
    draws = t.orders.select(F.col("o_custkey").alias("g"), F.col("o_orderpriority").alias("gas"),
                            F.col("o_totalprice").alias("v"))
    groups = draws.select("g", "gas").distinct()
    means = (t.orders.where(F.col("o_orderstatus") != "P").groupBy(F.col("o_custkey").alias("g"))
             .agg(F.avg("o_totalprice").alias("true_value")))
    return interval_summary(draws, ["g", "gas"], "v", groups.join(means, "g", "left"), digits=False,
                            bounded=False)


@query("A25_interval_summary", f"""
WITH {INTERVAL_SQL}
SELECT iv.g, gas, round(tv, 6) AS true_value, round(mean, 6) AS pred_mean, round(md, 6) AS pred_median, round(sd, 6) AS pred_std,
  round(lo, 6) AS pred_p2_5, round(hi, 6) AS pred_p97_5, round(hi - lo, 6) AS pi_width, round((hi - lo) / mean * 100, 6) AS pi_width_rel_pct,
  round((mean - tv) / tv * 100, 6) AS rel_diff_pct, (lo <= tv AND tv <= hi)::INT AS in_pi FROM iv LEFT JOIN tv ON tv.g = iv.g""")
def a25(t):
    return rounded(order_intervals(t), 6)


@query("A23_coverage_summary", f"""
WITH {INTERVAL_SQL}, x AS (SELECT gas, round(tv, 4) AS tv, (mean - tv) / tv * 100 AS d, (hi - lo) / mean * 100 AS w, (lo <= tv AND tv <= hi)::INT AS c
  FROM iv LEFT JOIN tv ON tv.g = iv.g)
SELECT gas, count(*) AS n_groups, round_even(avg(d), 2) AS rel_diff_mean_pct, round_even(stddev_samp(d), 2) AS rel_diff_std_pct,
  round_even(min(d), 2) AS rel_diff_min_pct, round_even(max(d), 2) AS rel_diff_max_pct, round_even(quantile_cont(abs(d), 0.5), 2) AS med_abs_rel_diff_pct,
  round_even(avg(w), 1) AS pi_width_rel_mean_pct, round_even(avg(c) * 100, 1) AS pi_coverage_pct, sum(c) || '/' || count(*) AS n_covered FROM x GROUP BY 1""")
def a23(t):
    return coverage_summary(order_intervals(t), ["gas"])


def references(t):
    n2o = reference_factors(t.role("n2o"), "class", "N2OEF", N2O_DEFAULTS)
    ch4 = reference_factors(t.role("ch4"), "class", "CH4EF", CH4_DEFAULTS)
    return {"N2O": n2o, "CH4": ch4}


TRUTH_SQL = """
refs AS (SELECT 'N2O' AS gas, class, avg(N2OEF) AS ref FROM n2o WHERE class <> 'Anaerobic' GROUP BY 2
  UNION ALL SELECT 'N2O', 'Anaerobic', 0.0 UNION ALL SELECT 'CH4', class, avg(CH4EF) FROM ch4 WHERE class IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'CH4', * FROM (VALUES ('Pond', 0.102::DOUBLE), ('Lagoon', 0.102), ('Anaerobic', 0.408)))"""


def validation_plants(t):
    """Suppliers with predicted probabilities; the true class by the size of the balance."""
    arrays = to_arrays(t.role("predicted"), "plant_id", CLASSES)
    plants = t.role("plant").select("plant_id", "NAME_0", "served", F.when(
        F.col("served") > 3000, "CAS").when(F.col("served") > 1000, "Pond").otherwise("OD").alias("true_class"),
        population_bucket(F.col("served"), (1000.0, 3000.0), ("small", "medium", "large")).alias("bucket"))
    return arrays.join(plants, "plant_id")


STRATA_SQL = """
vp AS (SELECT DISTINCT q.plant_id, NAME_0, served, CASE WHEN served > 3000 THEN 'CAS' WHEN served > 1000 THEN 'Pond' ELSE 'OD' END AS true_class,
    CASE WHEN served <= 1000 THEN 'small' WHEN served <= 3000 THEN 'medium' ELSE 'large' END AS bucket
  FROM predicted q JOIN plant p ON p.plant_id = q.plant_id),
st AS (SELECT *, 'Pool' AS stratum FROM vp UNION ALL SELECT *, bucket FROM vp),
s AS (SELECT NAME_0, stratum, sim, 'N2O' AS gas, CASE WHEN sum(served) > 0 THEN sum(CASE WHEN n2o_ef IS NOT NULL THEN served * n2o_ef END) / nullif(sum(CASE WHEN n2o_ef IS NOT NULL THEN served END), 0) ELSE avg(n2o_ef) END AS v
    FROM st JOIN efs ON efs.plant_id = st.plant_id GROUP BY 1, 2, 3
  UNION ALL SELECT NAME_0, stratum, sim, 'CH4', CASE WHEN sum(served) > 0 THEN sum(CASE WHEN ch4_ef IS NOT NULL THEN served * ch4_ef END) / nullif(sum(CASE WHEN ch4_ef IS NOT NULL THEN served END), 0) ELSE avg(ch4_ef) END
    FROM st JOIN efs ON efs.plant_id = st.plant_id GROUP BY 1, 2, 3),
tr AS (SELECT NAME_0, stratum, r.gas, CASE WHEN sum(served) > 0 THEN sum(ref * served) / sum(served) ELSE avg(ref) END AS tv FROM st JOIN refs r ON r.class = st.true_class GROUP BY 1, 2, 3)"""


@query("D15_fold_intervals", f"""
WITH {pools_sql()}, {FIXED_SQL}, {TRUTH_SQL}, {STRATA_SQL}
SELECT s.NAME_0, s.stratum, s.gas, round(max(tv), 9) AS true_value, round(avg(v), 9) AS pred_mean, round(quantile_cont(v, 0.5), 9) AS pred_median,
  round(stddev_pop(v), 9) AS pred_std, round(quantile_cont(v, 0.025), 9) AS pred_p2_5, round(quantile_cont(v, 0.975), 9) AS pred_p97_5,
  (quantile_cont(v, 0.025) <= max(tv) AND max(tv) <= quantile_cont(v, 0.975))::INT AS in_pi
FROM s LEFT JOIN tr ON tr.NAME_0 = s.NAME_0 AND tr.stratum = s.stratum AND tr.gas = s.gas WHERE v IS NOT NULL GROUP BY 1, 2, 3 /* {{n2o}} {{fb}} {{ch4}} {{predicted}} {{plant}} */""")
def d15(t):
    plants = materialize(with_strata(validation_plants(t), "bucket", "all"), "strata")
    out = group_intervals(plants, materialize(query_pools(t, POOL), "pools"), ["NAME_0", "stratum"],
                          "plant_id", "true_class", "served", references(t), CLASSES, N_SIM, POOL, SEED,
                          False, False)
    return rounded(out.drop("pi_width", "pi_width_rel_pct", "rel_diff_pct"), 9)


@query("D15_stratum_sizes", f"""
WITH vp AS (SELECT DISTINCT q.plant_id, NAME_0, served, CASE WHEN served > 3000 THEN 'CAS' WHEN served > 1000 THEN 'Pond' ELSE 'OD' END AS true_class,
    CASE WHEN served <= 1000 THEN 'small' WHEN served <= 3000 THEN 'medium' ELSE 'large' END AS bucket
  FROM {{predicted}} q JOIN {{plant}} p ON p.plant_id = q.plant_id),
st AS (SELECT *, 'Pool' AS stratum FROM vp UNION ALL SELECT *, bucket FROM vp)
SELECT NAME_0, stratum, count(*) AS n_plants, round(sum(served), 2) AS pop_total, count(DISTINCT true_class) AS n_true_types,
  round_even(sum(served) * 100 / (SELECT sum(served) FROM vp WHERE vp.NAME_0 = st.NAME_0), 2) AS pop_share_pct FROM st GROUP BY 1, 2""")
def d15_sizes(t):
    plants = with_strata(validation_plants(t), "bucket", "all")
    return rounded(group_sizes(plants, ["NAME_0", "stratum"], "served", "true_class", ["NAME_0"]), 2)


@query("D16_holdout_intervals")
def d16(t):
    plants = materialize(validation_plants(t).withColumn("holdout", F.lit("50")), "plants")
    intervals = materialize(group_intervals(
        plants, materialize(query_pools(t, POOL), "pools"), ["NAME_0", "holdout"], "plant_id", "true_class",
        "served", references(t), CLASSES, N_SIM, POOL, SEED), "intervals")
    return holdout_report(intervals, "holdout")


@query("D16_holdout_fixed", f"""
WITH {pools_sql()}, {FIXED_SQL}, {TRUTH_SQL}, {STRATA_SQL},
iv AS (SELECT s.NAME_0, s.gas, avg(v) AS mean, max(tv) AS tv, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi
  FROM s LEFT JOIN tr ON tr.NAME_0 = s.NAME_0 AND tr.stratum = s.stratum AND tr.gas = s.gas
  WHERE v IS NOT NULL AND s.stratum = 'Pool' GROUP BY 1, 2),
x AS (SELECT gas, round_even((mean - tv) / tv * 100, 2) AS d, round_even((hi - lo) / mean * 100, 1) AS w, (lo <= tv AND tv <= hi)::INT AS c FROM iv)
SELECT '50' AS holdout, gas, count(*) AS n_groups, round_even(avg(d), 2) AS rel_diff_mean_pct, round_even(stddev_samp(d), 2) AS rel_diff_std_pct,
  round_even(min(d), 2) AS rel_diff_min_pct, round_even(max(d), 2) AS rel_diff_max_pct, round_even(quantile_cont(abs(d), 0.5), 2) AS med_abs_rel_diff_pct,
  round_even(avg(w), 1) AS pi_width_rel_mean_pct, round_even(avg(c) * 100, 1) AS pi_coverage_pct, sum(c) || '/' || count(*) AS n_covered
FROM x GROUP BY 2 /* {{n2o}} {{fb}} {{ch4}} {{predicted}} {{plant}} */""")
def d16_fixed(t):
    plants = materialize(validation_plants(t).withColumn("holdout", F.lit("50")), "plants")
    intervals = materialize(group_intervals(
        plants, materialize(query_pools(t, POOL), "pools"), ["NAME_0", "holdout"], "plant_id", "true_class",
        "served", references(t), CLASSES, N_SIM, POOL, SEED, False), "intervals")
    return holdout_report(intervals, "holdout")


MIX_KEY = f"'{SEED}|' || s.sim || '|' || w.plant_id || '|' || w.i"
MIX_ROWS_SQL = f"""
w AS (SELECT p.plant_id, c.i, p.mean / sum(p.mean) OVER (PARTITION BY p.plant_id) AS share FROM predicted p
  JOIN (VALUES {CLASS_ROWS}) AS c(i, class) ON c.class = p.class),
sims AS (SELECT unnest(range({N_SIM})) AS sim),
mx AS (SELECT w.plant_id, s.sim, sum(w.share * coalesce(a.ch4_ef, 0)) AS ch4, sum(w.share * coalesce(b.n2o_ef, 0)) AS n2o
  FROM w CROSS JOIN sims s
  LEFT JOIN pool a ON a.class_idx = w.i AND a.slot = floor({u(MIX_KEY, 1)} * {POOL})
  LEFT JOIN pool b ON b.class_idx = w.i AND b.slot = floor({u(MIX_KEY, 2)} * {POOL}) GROUP BY 1, 2),
pp AS (SELECT plant_id, avg(ch4) AS ch4, avg(n2o) AS n2o FROM mx GROUP BY 1)"""


@query("D17_validation_fixed", f"""
WITH {pools_sql()}, {MIX_ROWS_SQL}, {TRUTH_SQL},
vp AS (SELECT p.plant_id, served, CASE WHEN served > 3000 THEN 'CAS' WHEN served > 1000 THEN 'Pond' ELSE 'OD' END AS true_class,
    CASE WHEN served <= 1000 THEN 'small' WHEN served <= 3000 THEN 'medium' ELSE 'large' END AS fold FROM plant p),
g AS (SELECT 'CH4' AS gas, fold, r.ref AS t, pp.ch4 AS p FROM vp JOIN pp ON pp.plant_id = vp.plant_id JOIN refs r ON r.gas = 'CH4' AND r.class = true_class
  UNION ALL SELECT 'N2O', fold, r.ref, pp.n2o FROM vp JOIN pp ON pp.plant_id = vp.plant_id JOIN refs r ON r.gas = 'N2O' AND r.class = true_class),
f AS (SELECT gas, fold, round_even(sqrt(avg((p - t) * (p - t))), 6) AS rmse, round_even(avg(abs(p - t)), 6) AS mae FROM g GROUP BY 1, 2)
SELECT gas, 'rmse' AS metric, round(avg(rmse), 6) AS mean, min(rmse) AS min, max(rmse) AS max, round(stddev_samp(rmse), 6) AS std FROM f GROUP BY 1
UNION ALL SELECT gas, 'mae', round(avg(mae), 6), min(mae), max(mae), round(stddev_samp(mae), 6) FROM f GROUP BY 1 /* {{n2o}} {{fb}} {{ch4}} {{predicted}} {{plant}} */""")
def d17_fixed(t):
    plants = validation_plants(t).withColumnRenamed("bucket", "fold")
    scored = materialize(plant_results(
        plants, materialize(query_pools(t, POOL), "pools"), "plant_id", "true_class", references(t),
        CLASSES, N_SIM, POOL, SEED, False), "scored")
    _, summary = fold_report(scored, "served")
    return rounded(summary.where(F.col("metric").isin("rmse", "mae")), 6)


@query("D17_validation_report")
def d17(t):
    plants = validation_plants(t).withColumnRenamed("bucket", "fold")
    scored = materialize(plant_results(
        plants, materialize(query_pools(t, POOL), "pools"), "plant_id", "true_class", references(t),
        CLASSES, N_SIM, POOL, SEED), "scored")
    _, summary = fold_report(scored, "served")
    return summary


@query("D18_few_plants", """
SELECT NAME_0, Region, count(*) AS n FROM {plant} GROUP BY 1, 2 HAVING count(*) < 5""")
def d18(t):
    sizes = t.role("plant").groupBy("NAME_0", "Region").agg(F.count(F.lit(1)).alias("n"))
    return few_plants(sizes, "n", 5)
