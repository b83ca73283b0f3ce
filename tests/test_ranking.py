import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catchment.functions.uniform import digest
from catchment.operators.ranking import (exact_quantiles, hash_bucket, in_ranges, value_ranks,
                                         with_rank, with_row_number)


def skewed(n=4000):
    """One key holds a third of the rows; values repeat, cross zero and span many sizes."""
    rng = random.Random(5)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.34 else f"k{rng.randrange(40)}"
        value = rng.choice([0.0, 1.0, -1.5, rng.gauss(0, 1), 10 ** rng.uniform(-9, 9), None])
        rows.append((i, key, value))
    return rows


@pytest.mark.parametrize("draw", [
    lambda rng: 1.6e15 + rng.randrange(10**9),  # times as numbers
    lambda rng: rng.choice([0.0, 1e300, 1e9 + rng.random()]),  # a narrow hill between outliers
    lambda rng: f"same start {rng.random()}",
])
def test_no_range_holds_much_more_than_the_mean(spark, frame, draw):
    rng = random.Random(3)
    values = sorted({draw(rng) for _ in range(6000)})
    kind = "string" if isinstance(values[0], str) else "double"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = in_ranges(frame([(v,) for v in values], f"v {kind}").repartition(6), ["v"])
        sizes = [r["count"] for r in cut.groupBy("__b").count().collect()]
        bounds = sorted((r.b, r.low, r.high) for r in cut.groupBy(F.col("__b").alias("b")).agg(
            F.min("v").alias("low"), F.max("v").alias("high")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) > 2 and max(sizes) < 3 * sum(sizes) / len(sizes)
    assert all(a[2] < b[1] for a, b in zip(bounds, bounds[1:]))


def test_row_numbers_over_sampled_ranges(frame):
    df = frame([(i, f"name {i * 7919 % 500:04d}") for i in range(1500)], "id int, name string")
    got = with_row_number(df, [], [F.col("name").desc(), F.col("id").asc()], None, "pos").collect()
    want = sorted(got, key=lambda r: r.id)
    want.sort(key=lambda r: r.name, reverse=True)
    assert [r.pos for r in want] == list(range(1, 1501))


def test_quantiles_match_numpy(frame):
    rows = skewed()
    probs = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.75, "e": 1.0}
    got = {r.key: r for r in exact_quantiles(
        frame(rows, "id int, key string, v double"), ["key"], "v", probs).collect()}
    groups = {}
    for _, key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append(value)
    assert set(got) == set(groups)
    for key, values in groups.items():
        assert got[key].n == len(values)
        for name, p in probs.items():
            assert np.isclose(got[key][name], np.quantile(values, p), rtol=1e-12, atol=1e-15)


def test_quantiles_without_keys(frame):
    rows = skewed(500)
    got = exact_quantiles(frame(rows, "id int, key string, v double"), [], "v", {"m": 0.5}).first()
    assert np.isclose(got.m, np.median([r[2] for r in rows if r[2] is not None]))


def test_rank_rules(frame):
    df = frame([(1, 5.0), (2, 7.0), (3, 5.0), (4, None), (5, 1.0), (6, 7.0)], "id int, v double")
    low = {r.id: r["r"] for r in with_rank(df, "v", "r").collect()}
    assert low == {2: 1, 6: 1, 1: 3, 3: 3, 5: 5, 4: None}
    mean = {r.id: r["r"] for r in with_rank(df, "v", "r", descending=False, ties="average").collect()}
    assert mean == {5: 1.0, 1: 2.5, 3: 2.5, 2: 4.5, 6: 4.5, 4: None}


def test_value_ranks_count_below(frame):
    rows = skewed(1500)
    got = value_ranks(frame(rows, "id int, key string, v double"), ["key"], "v").collect()
    for r in got:
        values = [v for _, k, v in rows if k == r.key and v is not None]
        assert (r.below, r.n, r.total) == (sum(v < r.v for v in values), values.count(r.v), len(values))
        assert r.dense == len({v for v in values if v < r.v})


def test_row_numbers_are_complete_in_a_hot_group(frame):
    df = frame(skewed(), "id int, key string, v double").withColumn("h", digest(1, F.col("id")))
    got = with_row_number(df, ["key"], [F.col("h")], hash_bucket(F.col("h")), "pos").collect()
    groups = {}
    for r in got:
        groups.setdefault(r.key, []).append((r.h, r.pos, r.pos_total))
    for rows in groups.values():
        rows.sort()
        assert [p for _, p, _ in rows] == list(range(1, len(rows) + 1))
        assert {t for _, _, t in rows} == {len(rows)}
