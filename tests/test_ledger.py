import pytest
from pyspark.sql import functions as F
from test_models import plants

from catchment.operators import models
from catchment.operators.jobstate import SettingsChanged
from catchment.operators.ledger import Ledger, content
from catchment.operators.models import ForestSettings, fold_probabilities
from catchment.session import materialize, scratch_path

SETTINGS = {"all": ForestSettings(4, 3)}


def table(rows):
    return sorted(tuple(str(x) for x in r) for r in rows.collect())


def folds(rows, ledger=None, settings=SETTINGS):
    return fold_probabilities(rows, "id", "label", ["x", "y"], "bucket", settings, 3, 2, 5, ledger)


def test_an_interrupted_run_goes_on(spark, monkeypatch):
    rows = materialize(plants(spark, 90), "rows")
    want = table(folds(rows))
    folder = scratch_path(spark, "ledger")
    real, calls = models.bucket_probabilities, []

    def fails(*args):
        calls.append(args)
        if len(calls) > 2:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(models, "bucket_probabilities", fails)
    monkeypatch.setattr(models, "run_together", lambda spark, tasks: [t() for t in tasks])
    with pytest.raises(RuntimeError, match="lost"):
        folds(rows, Ledger(spark, folder))
    monkeypatch.setattr(models, "bucket_probabilities", real)
    ledger = Ledger(spark, folder)
    assert table(folds(rows, ledger)) == want
    assert ledger.reused == [("fold", "1"), ("fold", "2")] and ledger.computed == [("fold", "3")]
    assert [(r.stage, r.key) for r in ledger.entries().collect()] == [("fold", "1"), ("fold", "2"), ("fold", "3")]

    # Other rows or other settings are never taken for the same run.
    with pytest.raises(SettingsChanged):
        folds(rows.withColumn("x", F.when(F.col("id") == 7, -1.0).otherwise(F.col("x"))), Ledger(spark, folder))
    with pytest.raises(SettingsChanged):
        folds(rows, Ledger(spark, folder), {"all": ForestSettings(4, 2)})
    redo = Ledger(spark, folder, "redo")
    folds(rows, redo, {"all": ForestSettings(4, 2)}).count()
    assert len(redo.computed) == 3 and redo.entries().count() == 6


def test_two_runs_that_finish_one_stage(spark):
    first, second = (Ledger(spark, scratch) for scratch in [scratch_path(spark, "ledger")] * 2)

    def slow():
        first.stage("a", "k/1 %", {"x": 1}, lambda: spark.range(3))  # finishes meanwhile
        return spark.range(5)

    out = second.stage("a", "k/1 %", {"x": 1}, slow)
    assert out.count() == 3  # both read the one that came first
    assert second.stage("a", "k/1 %", {"x": 1}, slow).count() == 3 and second.reused == [("a", "k/1 %")]
    assert [r.key for r in second.entries().collect()] == ["k/1 %"]


def test_fingerprints(spark):
    one = Ledger.fingerprint({"a": 1, "b": [1, 2]}, ["x"])
    assert one == Ledger.fingerprint({"b": [1, 2], "a": 1}, ["x"])
    assert len({one, Ledger.fingerprint({"a": "1", "b": [1, 2]}, ["x"]), Ledger.fingerprint({"a": 1, "b": [2, 1]}, ["x"]),
                Ledger.fingerprint({"a": 1, "b": [1, 2]}, ["y"]), Ledger.fingerprint({"a": 1, "b": [1, 2]})}) == 5
    rows = spark.range(50).withColumn("v", F.col("id") * 2)
    assert content(rows) == content(rows.repartition(7).orderBy(F.desc("id"))) != content(rows.limit(49))
    assert content(rows.where("id < 0")).startswith("0:0:")
    with pytest.raises(ValueError):
        Ledger(spark, "/x", "ignore")
