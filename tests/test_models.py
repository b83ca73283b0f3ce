import math
import random

from pyspark.sql import functions as F

from catchment.operators.models import (BoostedSettings, BoosterSettings, ForestSettings,
                                        bagged_probabilities, feature_importance, fold_probabilities,
                                        predict_binary, stopping_round, train_binary, train_until)
from catchment.operators.proba import bootstrap_multiplicity, predicted_class, replicate_stats
from catchment.operators.validate import binary_report, roc_auc


def plants(spark, n=240):
    base = spark.range(n).select(F.col("id"), (F.col("id") % 3).alias("k"))
    return base.select("id", F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("k") + 1).cast("int"))
                       .alias("label"), (F.col("k") * 10 + F.rand(1)).alias("x"), F.rand(2).alias("y"),
                       F.lit("all").alias("bucket"))


def test_bootstrap_draws_n_rows(spark):
    out = bootstrap_multiplicity(plants(spark), "id", 4, 1)
    sums = {r.replicate: (r.n, r.m) for r in out.groupBy("replicate").agg(
        F.sum("multiplicity").alias("n"), F.max("multiplicity").alias("m")).collect()}
    assert set(sums) == {0, 1, 2, 3} and all(n == 240 and m >= 2 for n, m in sums.values())


def test_bagged_probabilities_add_up_and_separate(spark):
    rows = plants(spark)
    for settings in (ForestSettings(5, 3), BoostedSettings(3, 2)):
        cube, classes = bagged_probabilities(rows.where("id < 180"), rows.where("id >= 180"), "id", "label",
                                             ["x", "y"], settings, 2, 5)
        assert classes == ["A", "B", "C"]
        cube = cube.cache()
        sums = cube.groupBy("replicate", "id").agg(F.sum("proba").alias("s")).collect()
        assert len(sums) == 2 * 60 and all(math.isclose(r.s, 1.0, abs_tol=1e-9) for r in sums)
        best = predicted_class(replicate_stats(cube, "id"), "id", classes).join(rows, "id")
        assert best.where("predicted = label").count() >= 57


def test_folds_predict_every_row_once(spark):
    rows = plants(spark, 90)
    out = fold_probabilities(rows, "id", "label", ["x", "y"], "bucket", {"all": ForestSettings(3, 3)}, 3, 1, 2)
    per_row = out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fold").alias("f")).collect()
    assert len(per_row) == 90 and {(r.n, r.f) for r in per_row} == {(3, 1)}


def test_binary_model(spark):
    rows = plants(spark).select("id", F.when(F.col("label") == "A", 1).otherwise(0).alias("target"),
                                F.when(F.col("id") % 17 != 0, F.col("x")).alias("x"), "y")
    model, medians, scored = train_binary(rows, "id", "target", ["x", "y"], BoosterSettings(5, 2), 3)
    assert scored.count() == 48
    assert roc_auc(scored, "label", "score").first().auc > 0.9
    out = predict_binary(model, medians, rows, ["x", "y"], "yes", "no")
    assert out.where((F.col("target") == 1) == (F.col("Predicted_Anaerobic") == "yes")).count() >= 220
    ranked = [r.feature for r in feature_importance(model, rows, ["x", "y"]).collect()]
    assert ranked == ["x", "y"]


def test_report_counts(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0), (1, 1)], "y int, p int")
    got = {r["class"]: (r.precision, r.recall, r.support) for r in binary_report(rows, "y", "p").collect()}
    assert got == {1: (1.0, 2 / 3, 3), 0: (2 / 3, 1.0, 2)}


def read_curve(curve, patience):
    best = None
    for r, x in curve:
        if x is not None and not math.isnan(x) and (best is None or x < best[1]):
            best = (r, x)
        if best and r - best[0] >= patience:
            return (*best, r, True)
    return (*(best or (None, None)), curve[-1][0], False)


def test_stopping_round_equals_a_loop(frame):
    rng = random.Random(3)
    curves = {k: [(r, rng.choice((0.5, 1.0, 2.0, rng.random(), None, math.nan))) for r in range(1, rng.randint(2, 30))]
              for k in range(60)} | {99: [(1, None), (2, math.nan)], 100: [(1, 1.0)] + [(r, 1.0) for r in range(2, 9)]}
    rows = [(k, r, x) for k, c in curves.items() for r, x in c]
    for patience in (1, 4, 100):
        out = stopping_round(frame(rows, "k int, r int, x double"), ["k"], "r", "x", patience).collect()
        assert {r.k: tuple(r)[1:] for r in out} == {k: read_curve(c, patience) for k, c in curves.items()}


def test_training_stops_at_the_smallest_loss(spark):
    """Labels that the feature does not explain: more rounds only learn the noise."""
    from pyspark.ml.feature import VectorAssembler
    rows = spark.range(160).select("id", (F.xxhash64("id") % 2 == 0).cast("double").alias("label"),
                                   F.lit(1.0).alias("weight"), F.rand(4).alias("x"))
    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(rows).cache()
    train, valid = rows.where("id < 100"), rows.where("id >= 100")
    model, losses, choice = train_until(train, valid, BoosterSettings(40, 3, patience=3), 5)
    curve = [(r["round"], r.loss) for r in losses.orderBy("round").collect()]
    assert choice.stopped and len(curve) < 40
    assert tuple(choice) == read_curve(curve, 3) and model.getNumTrees == choice.best_round
    again = model.evaluateEachIteration(valid)
    assert all(math.isclose(a, x, rel_tol=1e-9) for a, (_, x) in zip(again, curve))
