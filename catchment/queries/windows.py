"""Ranks, splits and cumulative sums."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.draws import with_class_cdf
from ..operators.jobstate import keep_last
from ..operators.proba import (stratified_folds, stratified_holdout, stratified_split, to_arrays)
from ..operators.ranking import (exact_quantiles, running_sum, value_ranks, with_rank,
                                 with_row_number)
from ..operators.validate import best_sets
from .helpers import rounded
from .registry import query
from .roles import CLASS_ROWS, CLASSES


@query("W1_rank_descending", """
SELECT plant_id, CASE WHEN served IS NOT NULL THEN rank() OVER (ORDER BY served DESC NULLS LAST) END AS pos,
  rank() OVER (PARTITION BY NAME_0 ORDER BY precipitation DESC) AS pos_in_country FROM {sewered}""")
def w1(t):
    base = t.role("sewered")
    ranked = with_rank(base, "served", "pos")
    ranked = with_rank(ranked, "precipitation", "pos_in_country", ["NAME_0"], source=base)
    return ranked.select("plant_id", "pos", "pos_in_country")


@query("W2_best_sets", """
SELECT p_type, 1 AS rank, min(p_retailprice) AS score, arg_min(p_partkey, (p_retailprice, p_partkey)) AS p_partkey
FROM part GROUP BY 1""")
def w2(t):
    scores = t.part.select("p_type", F.col("p_retailprice").alias("score"), "p_partkey")
    return best_sets(scores, "p_type", "p_partkey")


STRATA_SQL = """SELECT o_orderkey, o_orderstatus, o_orderpriority,
  row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY md5('{seed}|' || o_orderkey), o_orderkey) AS pos,
  count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders"""


@query("W3_stratified_holdout", f"""
SELECT o_orderkey, pos <= round_even(n * 0.5, 0) AS is_test FROM ({STRATA_SQL.format(seed=42)})""")
def w3(t):
    out = stratified_holdout(t.orders, "o_orderkey", ["o_orderstatus", "o_orderpriority"], 0.5, 42)
    return out.select("o_orderkey", "is_test")


@query("W4_stratified_folds", f"""
SELECT o_orderkey, ((pos - 1) % 10 + 1)::INT AS fold FROM ({STRATA_SQL.format(seed=42)})""")
def w4(t):
    out = stratified_folds(t.orders, "o_orderkey", ["o_orderstatus", "o_orderpriority"], 10, 42)
    return out.select("o_orderkey", "fold")


@query("W5_stratified_split", f"""
SELECT o_orderkey, CASE WHEN pos <= round_even(n * 0.2::DOUBLE, 0) THEN 'test'
  WHEN pos <= round_even(n * 0.2::DOUBLE, 0) * 2 THEN 'valid' ELSE 'train' END AS split
FROM ({STRATA_SQL.format(seed=7)})""")
def w5(t):
    out = stratified_split(t.orders, "o_orderkey", ["o_orderstatus", "o_orderpriority"], 7)
    return out.select("o_orderkey", "split")


@query("W6_cumulative_class", f"""
WITH p AS (SELECT q.plant_id, c.i, coalesce(max(CASE WHEN q.class = c.class THEN q.mean END), 0.0) AS mean
  FROM {{predicted}} q, (VALUES {CLASS_ROWS}) AS c(i, class) GROUP BY 1, 2)
SELECT plant_id, i::INT AS class_idx, round(sum(mean) OVER (PARTITION BY plant_id ORDER BY i)
  / sum(mean) OVER (PARTITION BY plant_id), 9) AS cum FROM p""")
def w6(t):
    arrays = with_class_cdf(to_arrays(t.role("predicted"), "plant_id", CLASSES), len(CLASSES))
    return rounded(arrays.select("plant_id", F.posexplode("cdf").alias("class_idx", "cum")), 9)


@query("W6_cumulative_long", """
SELECT plant_id, class, round(sum(mean) OVER (PARTITION BY plant_id ORDER BY class), 9) AS cum FROM {predicted}""")
def w6_long(t):
    return rounded(running_sum(t.role("predicted"), ["plant_id"], F.col("class"), F.col("mean"), "cum")
                   .select("plant_id", "class", "cum"), 9)


@query("W7_keep_last", """
SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value
FROM events GROUP BY 1, 2""")
def w7(t):
    return keep_last(t.events.select("user_id", "event_type", "event_id", "value"),
                     ["user_id", "event_type"], "event_id")


@query("A24_exact_quantiles", """
SELECT o_orderstatus, count(o_totalprice) AS n, round(quantile_cont(o_totalprice, 0.025), 6) AS p2_5,
  round(quantile_cont(o_totalprice, 0.5), 6) AS median, round(quantile_cont(o_totalprice, 0.975), 6) AS p97_5
FROM orders GROUP BY 1""")
def a24_quantiles(t):
    return rounded(exact_quantiles(t.orders, ["o_orderstatus"], "o_totalprice",
                                   {"p2_5": 0.025, "median": 0.5, "p97_5": 0.975}), 6)


@query("W1_row_number", """
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) AS pos,
  count(*) OVER (PARTITION BY p_brand) AS pos_total FROM part""")
def w1_row_number(t):
    out = with_row_number(t.part, ["p_brand"], [F.col("p_name"), F.col("p_partkey")],
                          None, "pos")
    return out.select("p_partkey", "pos", "pos_total")


@query("W1_offset_ranks", """
SELECT ts, count(*) AS n, CAST(sum(count(*)) OVER (ORDER BY ts) - count(*) AS BIGINT) AS below,
  row_number() OVER (ORDER BY ts) - 1 AS dense
FROM (SELECT CAST(epoch_us(ts) AS DOUBLE) AS ts FROM events) GROUP BY 1""")
def w1_offset_ranks(t):
    """Times as numbers lie close together, far from zero."""
    rows = t.events.select(F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("ts"))
    return value_ranks(rows, [], "ts").select("ts", "n", "below", "dense")


@query("A24_offset_quantiles", """
SELECT event_type, count(*) AS n, round(quantile_cont(ts, 0.25), 3) AS q1, round(quantile_cont(ts, 0.5), 3) AS median,
  round(quantile_cont(ts, 0.975), 3) AS p97_5
FROM (SELECT event_type, CAST(epoch_us(ts) AS DOUBLE) / 1e6 AS ts FROM events) GROUP BY 1""")
def a24_offset(t):
    rows = t.events.select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6).alias("ts"))
    return rounded(exact_quantiles(rows, ["event_type"], "ts",
                                   {"q1": 0.25, "median": 0.5, "p97_5": 0.975}), 3)
