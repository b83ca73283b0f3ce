"""Training tables, bootstrap, class probabilities and classifiers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import population_bucket
from ..functions.emissions import ADVANCED_CLASSES
from ..functions.reference import bucket_settings
from ..operators.clean import balanced_weights, column_medians, dense_codes, encode, impute_medians
from ..operators.jobstate import changed_settings, fingerprint
from ..operators.models import (BoostedSettings, BoosterSettings, ForestSettings,
                                bagged_probabilities, bucket_probabilities, class_probabilities,
                                feature_importance, fold_probabilities, holdout_probabilities, skipped_buckets,
                                predict_binary, stopping_round, train_binary)
from ..operators.proba import (bootstrap_multiplicity, full_matrix, predicted_class,
                               replicate_stats, restrict_advanced, to_wide)
from ..operators.validate import binary_report, roc_auc
from ..plans.search import search
from .aggregates import query_pools
from ..session import materialize, scratch_path
from ..sources.buckets import BucketedParts
from .helpers import rounded
from .joins import MATRIX_SQL
from .registry import query, u
from .roles import CLASS_OF_TYPE, CLASS_ROWS, CLASSES


@query("I1_median_impute", """
WITH tr AS (SELECT * FROM {sewered} WHERE Region <> 'BUILDING')
SELECT plant_id, coalesce(served, (SELECT quantile_cont(served, 0.5) FROM tr)) AS served,
  coalesce(temperature, (SELECT quantile_cont(temperature, 0.5) FROM tr)) AS temperature FROM {sewered}""")
def i1(t):
    rows = t.role("sewered").select("plant_id", "Region", "served", "temperature")
    medians = column_medians(rows.where(F.col("Region") != "BUILDING"), ["served", "temperature"])
    return impute_medians(rows, medians, ["served", "temperature"]).drop("Region")


@query("I1_median_by_group", """
SELECT NAME_0, 'served' AS feature, quantile_cont(served, 0.5) AS median FROM {sewered} GROUP BY 1
UNION ALL SELECT NAME_0, 'temperature', quantile_cont(temperature, 0.5) FROM {sewered} GROUP BY 1""")
def i1_groups(t):
    return column_medians(t.role("sewered"), ["served", "temperature"], ["NAME_0"])


@query("I2_categorical_codes", """
WITH v AS (SELECT NAME_3 AS c FROM {city} UNION SELECT Region FROM {plant}),
k AS (SELECT c, dense_rank() OVER (ORDER BY c) - 1 AS code FROM v WHERE c IS NOT NULL)
SELECT row_id, coalesce(code, -1) AS code FROM {city} LEFT JOIN k ON k.c = NAME_3""")
def i2(t):
    train = t.role("city").select("row_id", F.col("NAME_3").alias("c"))
    codes = dense_codes([train, t.role("plant").select(F.col("Region").alias("c"))], "c")
    return encode(train, codes, "c", "code").select("row_id", "code")


@query("I3_label_index", """
WITH k AS (SELECT class, dense_rank() OVER (ORDER BY class) - 1 AS y FROM (SELECT DISTINCT class FROM {n2o}))
SELECT rec_id, c.class, y FROM {ch4} c JOIN k ON k.class = c.class""")
def i3(t):
    labels = dense_codes([t.role("n2o")], "class")
    known = t.role("ch4").join(labels, "class", "left_semi")
    return encode(known, labels, "class", "y", missing=None).select("rec_id", "class", "y")


@query("I4_balanced_weights", """
SELECT doc_id, round((SELECT count(*) FROM labels) / (2.0 * count(*) OVER (PARTITION BY quality)), 9) AS weight
FROM labels""")
def i4(t):
    return rounded(balanced_weights(t.labels, "quality").select("doc_id", "weight"), 9)


@query("I5_bootstrap_multiplicity", f"""
WITH n AS (SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42|' || c_custkey), c_custkey) AS pos,
    count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
d AS (SELECT c_mktsegment, b, CAST(floor({u("'42|' || b || '|' || c_custkey || '|boot'")} * n) AS BIGINT) + 1 AS pos
  FROM n, (SELECT unnest(range(5)) AS b))
SELECT n.c_mktsegment, d.b::INT AS replicate, n.c_custkey, count(*) AS multiplicity
FROM d JOIN n ON n.c_mktsegment = d.c_mktsegment AND n.pos = d.pos GROUP BY ALL""")
def i5(t):
    return bootstrap_multiplicity(t.customer, "c_custkey", 5, 42, ["c_mktsegment"])


@query("I7_advanced_mask", """
WITH x AS (SELECT q.plant_id, q.class, q.mean, p.treatment_level AS lv, q.class IN ('AO', 'OD') AS ok
  FROM {predicted} q JOIN {plant} p ON p.plant_id = q.plant_id WHERE NOT (q.plant_id < 50 AND q.class IN ('AO'))),
s AS (SELECT plant_id, sum(mean) AS s, count(*) AS k FROM x WHERE ok GROUP BY 1)
SELECT x.plant_id, x.class, round(CASE WHEN lv = 'Advanced' AND k IS NOT NULL THEN
  CASE WHEN NOT ok THEN 0 WHEN s > 0 THEN mean / s ELSE 1.0 / k END ELSE mean END, 9) AS proba
FROM x LEFT JOIN s ON s.plant_id = x.plant_id""")
def i7(t):
    levels = t.role("plant").select("plant_id", "treatment_level")
    rows = (t.role("predicted").join(levels, "plant_id")
            .where(~((F.col("plant_id") < 50) & (F.col("class") == "AO")))
            .withColumnRenamed("mean", "proba"))
    out = restrict_advanced(rows, ["plant_id"], "treatment_level", ["AO", "OD"])
    return rounded(out.select("plant_id", "class", "proba"), 9)


CUBE_SQL = f"""
cube AS (SELECT x.plant_id, x.class, x.n * 1.0E0 / t.n AS proba FROM
  (SELECT l_suppkey AS plant_id, l_returnflag || l_linestatus AS b, {CLASS_OF_TYPE} AS class, count(*) AS n
   FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3) x
  JOIN (SELECT l_suppkey AS plant_id, l_returnflag || l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2) t
  ON x.plant_id = t.plant_id AND x.b = t.b)"""


def supplier_cube(t):
    """Class shares per supplier and return status, as six replicates."""
    lines = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("plant_id"), F.concat("l_returnflag", "l_linestatus").alias("b"),
        F.expr(CLASS_OF_TYPE).alias("class"))
    cells = lines.groupBy("plant_id", "b", "class").agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("plant_id", "b").agg(F.sum("n").alias("total"))
    return cells.join(totals, ["plant_id", "b"]).select(
        "plant_id", "b", "class", (F.col("n") * F.lit(1.0) / F.col("total")).alias("proba"))


@query("I8_replicate_stats", f"""
WITH {CUBE_SQL} SELECT plant_id, class, round(avg(proba), 9) AS mean, round(stddev_pop(proba), 9) AS std,
  round(quantile_cont(proba, 0.025), 9) AS ci_lower, round(quantile_cont(proba, 0.5), 9) AS median,
  round(quantile_cont(proba, 0.975), 9) AS ci_upper FROM cube GROUP BY 1, 2""")
def i8(t):
    return rounded(replicate_stats(supplier_cube(t), "plant_id"), 9)


@query("I8_stored_cube", f"""
WITH {CUBE_SQL} SELECT plant_id, class, round(avg(proba), 9) AS mean, round(stddev_pop(proba), 9) AS std,
  round(quantile_cont(proba, 0.025), 9) AS ci_lower, round(quantile_cont(proba, 0.5), 9) AS median,
  round(quantile_cont(proba, 0.975), 9) AS ci_upper FROM cube GROUP BY 1, 2""")
def i8_stored(t):
    """The same statistics over a cube in buckets, one part for each return status."""
    cube = materialize(supplier_cube(t), "cells")
    parts = BucketedParts(t.spark, "plant_id")
    for b, name in enumerate(r[0] for r in cube.select("b").distinct().orderBy("b").collect()):
        parts.write(b, cube.where(F.col("b") == name).drop("b"), deal=True)
    return rounded(replicate_stats(parts.read(), "plant_id"), 9)


@query("I8_predicted_class", f"""
SELECT plant_id, arg_min(q.class, (-mean, i)) AS predicted, max(mean) AS confidence,
  round(-sum(least(greatest(mean, 1e-10), 1 - 1e-10) * ln(least(greatest(mean, 1e-10), 1 - 1e-10))), 9) AS entropy
FROM {{predicted}} q JOIN (VALUES {CLASS_ROWS}) AS c(i, class) ON c.class = q.class GROUP BY 1""")
def i8_predicted(t):
    return rounded(predicted_class(t.role("predicted"), "plant_id", CLASSES), 9, ["entropy"])


WIDE_CELLS = ", ".join(f"""round(max(CASE WHEN class = '{c}' THEN {m} END), 9) AS "{c}_{m}\""""
                       for c in CLASSES for m in ("mean", "std"))


@query("I9_full_matrix", f"WITH {MATRIX_SQL} SELECT plant_id, {WIDE_CELLS} FROM matrix GROUP BY 1 /* {{plant}} {{predicted}} */")
def i9(t):
    long = full_matrix(t.role("plant"), t.role("predicted"), "plant_id", "label", CLASSES)
    return rounded(to_wide(long, "plant_id", CLASSES), 9)


# --- models on parts and documents ----------------------------------------

FOREST = ForestSettings(num_trees=5, max_depth=4)
FEATURES = ["p_size", "p_retailprice"]
BUCKETS = ("low", "mid", "high")
PER_BUCKET = {b: FOREST for b in BUCKETS}


def part_rows(t):
    """Parts with a price bucket; large ones carry no label."""
    return t.part.select(
        "p_partkey", "p_size", "p_retailprice", "p_brand", F.expr(CLASS_OF_TYPE).alias("true_class"),
        F.when(F.col("p_size") <= 40, F.expr(CLASS_OF_TYPE)).alias("label"),
        F.when(F.col("p_size") % 2 == 0, "Advanced").alias("level"),
        population_bucket(F.col("p_retailprice"), (930.0, 960.0), BUCKETS).alias("bucket"))


@query("I6_bagged_forest")
def i6(t):
    rows = part_rows(t)
    cube, _ = bagged_probabilities(rows.where(F.col("label").isNotNull()),
                                   rows.where(F.col("label").isNull()), "p_partkey", "label",
                                   FEATURES, FOREST, 2, 42)
    return cube


@query("I6_bagged_boosters")
def i6_boosted(t):
    rows = part_rows(t)
    cube, _ = bagged_probabilities(rows.where(F.col("label").isNotNull()),
                                   rows.where(F.col("label").isNull()), "p_partkey", "label",
                                   FEATURES, BoostedSettings(n_estimators=2, max_depth=3), 1, 42)
    return cube


@query("I10_bucket_probabilities")
def i10(t):
    rows = part_rows(t)
    stats = bucket_probabilities(
        rows.where(F.col("label").isNotNull()), rows.where(F.col("label").isNull()), "p_partkey",
        "label", FEATURES, "bucket", PER_BUCKET, 2, 42, ADVANCED_CLASSES, "level", ["p_brand"])
    return class_probabilities(stats, "p_partkey", CLASSES)


@query("I6_cube_facts", f"""
WITH p AS (SELECT p_partkey, p_size, {CLASS_OF_TYPE} AS class FROM part)
SELECT p_partkey, replicate::INT AS replicate,
  (SELECT count(DISTINCT class) FROM p WHERE p_size <= 40) AS n_classes, TRUE AS adds_up
FROM p, (SELECT unnest(range(3)) AS replicate) WHERE p_size > 40""")
def i6_facts(t):
    """What is certain about a cube: every class once per row and replicate, adding up to 1."""
    rows = part_rows(t)
    cube, _ = bagged_probabilities(rows.where(F.col("label").isNotNull()),
                                   rows.where(F.col("label").isNull()), "p_partkey", "label",
                                   FEATURES, FOREST, 3, 7)
    return cube.groupBy("p_partkey", "replicate").agg(
        F.countDistinct("class").alias("n_classes"),
        ((F.abs(F.sum("proba") - 1) < 1e-9) & (F.min("proba") >= 0)).alias("adds_up"))


@query("I10_skipped_buckets", """
SELECT p_brand, count(*) FILTER (WHERE p_size <= 40) AS n_train, count(*) FILTER (WHERE p_size > 40) AS n_predict
FROM part GROUP BY 1 HAVING n_train < 65 AND n_predict > 0""")
def i10_skipped(t):
    rows = part_rows(t)
    return skipped_buckets(rows.where(F.col("label").isNotNull()), rows.where(F.col("label").isNull()),
                           "p_brand", 65)


@query("I11_fold_probabilities")
def i11(t):
    rows = part_rows(t).where(F.col("label").isNotNull())
    return fold_probabilities(rows, "p_partkey", "label", FEATURES, "bucket", PER_BUCKET, 2, 1, 42)


@query("I12_holdout_probabilities")
def i12(t):
    rows = part_rows(t).where(F.col("label").isNotNull())
    return holdout_probabilities(rows, "p_partkey", "label", FEATURES, "bucket", PER_BUCKET,
                                 "p_brand", "Brand#2", 0.5, 1, 42)


DOC_FEATURES = ["n_chars", "n_lines", "n_upper"]


def documents(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id", "n_chars", F.regexp_count(text, F.lit("\n")).alias("n_lines"),
        F.regexp_count(text, F.lit("[A-Z]")).alias("n_upper"))


def digestion_model(t):
    observed = documents(t).join(t.labels, "doc_id")
    return train_binary(observed, "doc_id", "quality", DOC_FEATURES, BoosterSettings(max_iter=20, patience=5), 42)


@query("I13_binary_model")
def i13(t):
    _, _, scored = digestion_model(t)
    return scored


@query("I13_stopping_round", """
WITH c AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r, o_totalprice AS l FROM orders),
p AS (SELECT x.o_custkey, x.r, min(y.l) AS m FROM c x JOIN c y ON y.o_custkey = x.o_custkey AND y.r <= x.r GROUP BY 1, 2),
q AS (SELECT p.o_custkey, p.r, m, min(c.r) AS b FROM p JOIN c ON c.o_custkey = p.o_custkey AND l = m AND c.r <= p.r GROUP BY 1, 2, 3),
s AS (SELECT o_custkey, min(r) FILTER (r - b >= 4) AS stop, max(r) AS last FROM q GROUP BY 1)
SELECT q.o_custkey, b::INT AS best_round, m AS best_loss, r::INT AS last_round, stop IS NOT NULL AS stopped
FROM q JOIN s ON s.o_custkey = q.o_custkey WHERE r = coalesce(stop, last)""")
def i13_stop(t):
    """Order values of a customer as a curve of losses, read with a patience of 4."""
    turn = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    curves = t.orders.select("o_custkey", turn.alias("round"), "o_totalprice")
    return stopping_round(curves, ["o_custkey"], "round", "o_totalprice", 4)


@query("I14_binary_prediction")
def i14(t):
    model, medians, _ = digestion_model(t)
    return predict_binary(model, medians, documents(t), DOC_FEATURES, "Anaerobic", "Non-Anaerobic")


@query("I16_feature_importance")
def i16(t):
    model, _, _ = digestion_model(t)
    return feature_importance(model, documents(t), DOC_FEATURES)


@query("I15_binary_report", """
WITH x AS (SELECT quality AS y, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p FROM labels JOIN documents ON labels.doc_id = documents.doc_id),
c AS (SELECT k AS class, count(*) FILTER (WHERE y = k) AS support, count(*) FILTER (WHERE p = k) AS predicted,
  count(*) FILTER (WHERE y = k AND p = k) AS hits FROM x, (VALUES (0), (1)) AS v(k) GROUP BY 1)
SELECT class, round(hits * 1.0 / predicted, 9) AS precision, round(hits * 1.0 / support, 9) AS recall,
  round(2.0 * hits / (support + predicted), 9) AS f1, support::BIGINT AS support FROM c""")
def i15(t):
    rows = t.documents.join(t.labels, "doc_id").withColumn(
        "p", F.when(F.col("n_chars") > 1500, 1).otherwise(0))
    return rounded(binary_report(rows, "quality", "p"), 9)


@query("I15_roc_auc", """
WITH x AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents ON labels.doc_id = documents.doc_id),
r AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS rk FROM x)
SELECT round((sum(rk) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2.0)
  / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)), 9)::DOUBLE AS auc FROM r""")
def i15_auc(t):
    return rounded(roc_auc(t.documents.join(t.labels, "doc_id"), "quality", "n_chars"), 9)


def parameter_search(t, keys, **options):
    rows = part_rows(t).where(F.col("label").isNotNull()).withColumn(
        "size", F.col("p_retailprice"))
    sets = {"5|3": ForestSettings(5, 3), "5|5": ForestSettings(5, 5)}
    reference = t.role("n2o").groupBy("class").agg(F.avg("N2OEF").alias("reference"))
    ch4 = t.role("ch4").where(F.col("class").isNotNull()).groupBy("class").agg(
        F.avg("CH4EF").alias("reference"))
    return search(rows, "p_partkey", "label", FEATURES, "bucket", "size", {k: sets[k] for k in keys}, 2, 1,
                  42, query_pools(t, 50), {"N2O": reference, "CH4": ch4}, CLASSES, 10, 50, **options)


@query("I17_parameter_search")
def i17(t):
    return parameter_search(t, ["5|3", "5|5"])


@query("I17_resumed_search")
def i17_resumed(t):
    """A search that stopped after its first set, and goes on where it was."""
    folder = scratch_path(t.spark, "progress")
    parameter_search(t, ["5|3"], progress=folder)
    return parameter_search(t, ["5|3", "5|5"], progress=folder)


SETTINGS_SQL = "SELECT o_orderstatus AS run, o_orderpriority AS k, count(*) AS v FROM orders GROUP BY 1, 2"


def settings_rows(t):
    return t.orders.groupBy(F.col("o_orderstatus").alias("run"), F.col("o_orderpriority").alias("k")).agg(
        F.count(F.lit(1)).alias("v"))


@query("I18_config_fingerprint", f"""
SELECT run, md5(string_agg(k || '=' || v, chr(10) ORDER BY k || '=' || v)) AS fingerprint FROM ({SETTINGS_SQL}) GROUP BY 1""")
def i18(t):
    return fingerprint(settings_rows(t), "k", "v", ["run"])


@query("I18_changed_settings", f"""
WITH s AS ({SETTINGS_SQL}), a AS (SELECT k, v FROM s WHERE run = 'F' AND k <> '5-LOW'), b AS (SELECT k, v FROM s WHERE run = 'O')
SELECT coalesce(a.k, b.k) AS k, a.v AS old_value, b.v AS new_value FROM a FULL JOIN b ON a.k = b.k
WHERE a.v IS DISTINCT FROM b.v""")
def i18_changed(t):
    rows = settings_rows(t)
    old = rows.where((F.col("run") == "F") & (F.col("k") != "5-LOW"))
    return changed_settings(old, rows.where(F.col("run") == "O"), ["k"], "v")


@query("I19_bucket_settings", """
SELECT CASE WHEN o_totalprice <= 2000 THEN 'small: 0-2000' WHEN o_totalprice <= 10000 THEN 'medium: 2000-10000' ELSE 'large: 10000+' END AS population_bucket,
  CASE WHEN o_totalprice <= 2000 THEN 8 WHEN o_totalprice <= 10000 THEN 5 ELSE 6 END::INT AS max_depth, count(*) AS n FROM orders GROUP BY 1, 2""")
def i19(t):
    rows = t.orders.select(population_bucket(F.col("o_totalprice")).alias("population_bucket"))
    return (rows.join(bucket_settings(t.spark), "population_bucket")
            .groupBy("population_bucket", "max_depth").agg(F.count(F.lit(1)).alias("n")))
