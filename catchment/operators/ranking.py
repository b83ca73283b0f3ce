"""Exact ranks, row numbers and quantiles for groups of any size.

A plain window puts a whole group into one task, and ``percentile`` holds a
group's distinct values in one buffer. Here equal values are combined first, then
the keys and the value together are cut into ranges of about equal size, which the
engine samples. Counts per range give each its offset within the group, and only
the values of one range are ever sorted together. That holds for any distribution
of numbers or texts, and results stay exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .frames import join_null_safe, small_side

def hash_bucket(digest: Column) -> Column:
    """Order-preserving, evenly filled bucket of a hex digest: 65,536 values a group."""
    return F.substring(digest, 1, 4)


def in_ranges(df: DataFrame, order: Sequence[str | Column]) -> DataFrame:
    """``df`` with ``__b``, the number of its range in ``order``.

    Ranges come from a sample, so the numbers are written with the rows.
    """
    return materialize(df.repartitionByRange(*order).withColumn("__b", F.spark_partition_id()), "ranges")


def _with_offsets(buckets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before each bucket and in the whole group, from (keys, __b, __in)."""
    ordered = Window.partitionBy(*keys).orderBy("__b")
    return buckets.select(
        *keys, "__b", "__in",
        (F.sum("__in").over(ordered) - F.col("__in")).alias("__before"),
        F.sum("__in").over(Window.partitionBy(*keys)).alias("__total"))


def _value_counts(df: DataFrame, keys: Sequence[str], value: str, text: bool = False) -> DataFrame:
    typed = F.col(value) if text else F.col(value).cast("double")
    counts = (df.where(F.col(value).isNotNull())
              .select(*keys, typed.alias("__v"))
              .groupBy(*keys, "__v").agg(F.count(F.lit(1)).alias("__n")))
    return in_ranges(counts, [*keys, "__v"])


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str,
                    probs: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated quantiles per group: keys, ``n`` and one column per name.

    Only ranges that hold a wanted rank are sorted. NULL values are skipped.
    """
    keys = list(keys)
    counts = _value_counts(df, keys, value)
    offsets = _with_offsets(counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__in")), keys)

    position = {name: F.lit(float(p)) * (F.col("__total") - 1) for name, p in probs.items()}
    ranks = [edge(pos) for pos in position.values() for edge in (F.floor, F.ceil)]
    wanted = reduce(lambda a, b: a | b, [
        (r >= F.col("__before")) & (r < F.col("__before") + F.col("__in")) for r in ranks])

    candidates = join_null_safe(counts, small_side(offsets.where(wanted).drop("__in")), [*keys, "__b"])
    inside = Window.partitionBy(*keys, "__b").orderBy("__v")
    placed = (candidates
              .withColumn("__end", F.col("__before") + F.sum("__n").over(inside))
              .withColumn("__start", F.col("__end") - F.col("__n")))

    def at(rank: Column) -> Column:
        here = (rank >= F.col("__start")) & (rank < F.col("__end"))
        return F.max(F.when(here, F.col("__v")))

    picked = placed.groupBy(*keys).agg(
        F.max("__total").alias("n"),
        *[at(F.floor(pos)).alias(f"__lo_{name}") for name, pos in position.items()],
        *[at(F.ceil(pos)).alias(f"__hi_{name}") for name, pos in position.items()])

    def interpolate(name: str, p: float) -> Column:
        pos = F.lit(float(p)) * (F.col("n") - 1)
        low, high = F.col(f"__lo_{name}"), F.col(f"__hi_{name}")
        return (low + (high - low) * (pos - F.floor(pos))).alias(name)

    return picked.select(*keys, "n", *[interpolate(name, p) for name, p in probs.items()])


def column_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str],
                     probs: Mapping[str, float]) -> DataFrame:
    """Quantiles of several columns, as ``{column}_{name}``, for groups of any size."""
    keys = list(keys)
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        keys, list(columns), "__column", "__value")
    cells = exact_quantiles(long, [*keys, "__column"], "__value", probs)
    return cells.groupBy(*keys).agg(*[
        F.max(F.when(F.col("__column") == c, F.col(name))).alias(f"{c}_{name}")
        for c in columns for name in probs])


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, text: bool = False) -> DataFrame:
    """One row per distinct value: ``n`` equal rows, ``below`` smaller ones, ``total`` in the
    group, and ``dense``, the zero-based position among the distinct values."""
    keys = list(keys)
    counts = _value_counts(df, keys, value, text)
    ordered = Window.partitionBy(*keys).orderBy("__b")
    per_bucket = counts.groupBy(*keys, "__b").agg(
        F.sum("__n").alias("__in"), F.count(F.lit(1)).alias("__distinct"))
    offsets = per_bucket.select(
        *keys, "__b",
        (F.sum("__in").over(ordered) - F.col("__in")).alias("__before"),
        (F.sum("__distinct").over(ordered) - F.col("__distinct")).alias("__dense"),
        F.sum("__in").over(Window.partitionBy(*keys)).alias("__total"))
    placed = join_null_safe(counts, offsets, [*keys, "__b"])
    inside = Window.partitionBy(*keys, "__b").orderBy("__v")
    return placed.select(
        *keys, F.col("__v").alias(value), F.col("__n").alias("n"),
        (F.col("__before") + F.sum("__n").over(inside) - F.col("__n")).alias("below"),
        F.col("__total").alias("total"),
        (F.col("__dense") + F.row_number().over(inside) - 1).cast("long").alias("dense"))


def with_rank(df: DataFrame, value: str, out: str, keys: Sequence[str] = (),
              descending: bool = True, ties: str = "min",
              source: DataFrame | None = None) -> DataFrame:
    """Rank of a column; ties share the lowest or the average rank, NULL has none.

    ``source`` is the plain table the ranks are counted on when ``df`` already
    carries other derived columns; counting there keeps their plan from running twice.
    """
    ranks = value_ranks(df if source is None else source, keys, value)
    before = (F.col("total") - F.col("below") - F.col("n")) if descending else F.col("below")
    if ties == "min":
        rank = (before + 1).cast("long")
    elif ties == "average":
        rank = before + (F.col("n") + 1) / 2
    else:
        raise ValueError(f"unknown tie rule {ties!r}")
    side = ranks.select(*keys, F.col(value).alias("__v"), rank.alias(out))
    keyed = df.withColumn("__v", F.col(value).cast("double"))
    return join_null_safe(keyed, side, [*keys, "__v"], "left").drop("__v")


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column],
                    bucket: Column | None, out: str) -> DataFrame:
    """One-based row number in a total order; ``bucket`` must not decrease along it.

    Without a bucket the rows are cut into sampled ranges. Also adds ``{out}_total``, the
    group size.
    """
    keys = list(keys)
    cut = in_ranges(df, [*keys, *order]) if bucket is None else df.withColumn("__b", bucket)
    offsets = _with_offsets(
        cut.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__in")), keys)
    placed = join_null_safe(cut, offsets, [*keys, "__b"])
    inside = Window.partitionBy(*keys, "__b").orderBy(*order)
    return (placed
            .withColumn(out, F.col("__before") + F.row_number().over(inside))
            .withColumnRenamed("__total", f"{out}_total")
            .drop("__b", "__in", "__before"))


def running_sum(df: DataFrame, keys: Sequence[str], order: Column, value: Column,
                out: str) -> DataFrame:
    """Cumulative sum within small groups, e.g. the classes of one row."""
    window = (Window.partitionBy(*keys).orderBy(order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return df.withColumn(out, F.sum(value).over(window))
