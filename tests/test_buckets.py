import pytest
from pyspark.sql import functions as F

from catchment.operators.models import ForestSettings, bagged_probabilities
from catchment.operators.proba import replicate_stats, restrict_advanced
from catchment.session import materialize
from catchment.sources.buckets import BucketedParts, bucketed, drop_tables


def moves(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def cells(spark, n=200):
    return spark.range(n).select("id", F.explode(F.array(*[F.lit(c) for c in "ABC"])).alias("class"),
                                 F.rand(5).alias("proba"))


def test_statistics_of_a_cube_move_nothing(spark):
    rows = cells(spark).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(9))))
    value = F.abs(F.sin(F.xxhash64("id", "class", "replicate").cast("double")))
    rows = materialize(rows.withColumn("proba", value))
    parts = BucketedParts(spark, "id", 4)
    for b in range(10):
        parts.write(b, rows.where(F.col("replicate") == b).drop("replicate"), deal=True)
    cube = parts.read()
    stats = replicate_stats(cube, "id")
    assert moves(stats) == 0 and moves(replicate_stats(rows, "id")) > 0
    assert cube.select(*rows.columns).exceptAll(rows).count() == 0 and cube.count() == rows.count()
    def near(df):
        return {(r.id, r["class"]): [round(x, 12) for x in r[2:]] for r in df.collect()}
    assert near(stats) == near(replicate_stats(rows, "id"))


def test_masked_cube_moves_nothing(spark):
    parts = BucketedParts(spark, "id", 4)
    level = F.when(F.col("id") % 2 == 0, "Advanced").otherwise("Basic")
    for b in range(2):
        parts.write(b, cells(spark).withColumn("level", level), deal=True)
    out = replicate_stats(restrict_advanced(parts.read(), ["replicate", "id"], "level", ["A", "C"]), "id")
    assert moves(out) == 0
    sums = out.groupBy("id").agg(F.sum(F.when(F.col("class") == "B", F.col("mean"))).alias("b"),
                                 F.sum("mean").alias("s")).collect()
    assert all((r.b == 0 and abs(r.s - 1) < 1e-9) if r.id % 2 == 0 else r.b > 0 for r in sums)


def test_trained_cube_lies_in_buckets(spark):
    rows = spark.range(120).select("id", F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("label"),
                                   (F.col("id") % 2 * 10 + F.rand(1)).alias("x"))
    cube, _ = bagged_probabilities(rows.where("id < 90"), rows.where("id >= 90"), "id", "label", ["x"],
                                   ForestSettings(3, 2), 3, 5)
    stats = replicate_stats(cube, "id")
    assert moves(stats) == 0 and stats.count() == 60
    assert {r[0] for r in cube.select("replicate").distinct().collect()} == {0, 1, 2}


def test_empty_parts_and_tables(spark, frame):
    empty = frame([], "id long, class string, proba double")
    assert bucketed(empty, "id", 3).count() == 0
    parts = BucketedParts(spark, "id", 3)
    with pytest.raises(ValueError):
        parts.read()
    parts.write(0, empty, deal=True)
    parts.write(1, cells(spark, 5), deal=True)
    assert parts.read().count() == 15
    assert drop_tables(spark) and not drop_tables(spark)
