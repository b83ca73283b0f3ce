"""Mixing of sources to target weights by systematic sampling.

Every document of a source is expected to be taken ``target / size`` times. The expected
copies are summed in a fixed order within the source, one random offset is added, and a
document is emitted once for each integer that its stretch of the running sum crosses.

The order goes by size class and then by the hash of the id, so that documents of all sizes
are taken evenly. The running sum is cut into parts of that order: counts per part come from
partial aggregation, their running sums are offsets, and only a part is ever sorted.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix, as a multiple of all words
CAP = 2.0  # a source's target, as a multiple of its words
PART_ROWS = 20_000
BROADCAST_ROWS = 100_000  # (source, size class) rows of about 50 bytes


def n_words(column: str) -> Column:
    """Runs of characters other than blank and the controls 9 to 13; null has none."""
    return F.regexp_count(whole_text(column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(key: Column) -> Column:
    """A number in [0, 1) from the digest of a text."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn. They share ``share`` of
    all words by weight; who would get more than ``cap`` of its own words gets just that, and
    the rest is shared again. That ends with one level: every target is the lower of cap and
    weight x level. Sources sorted by cap over weight, the level is the first at which the
    words left, divided by the weights left, lift the next source to no more than its cap.
    One row per source goes through one task.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                        (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", pick).withColumn("most", F.lit(cap) * F.col("source_size"))
    level = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    rows = rows.select(
        "*",
        F.coalesce(F.sum("most").over(level.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0.0)).alias("below"),
        F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
        (F.lit(share) * F.sum("source_size").over(everything)).alias("all"),
    ).withColumn("level", (F.col("all") - F.col("below")) / F.col("left"))
    free = F.col("weight") * F.col("level") <= F.col("most")
    rows = rows.withColumn("level", F.min(F.when(free, F.struct(
        (F.col("most") / F.col("weight")).alias("at"), F.col("level").alias("level")))).over(everything)["level"])
    capped = F.col("level").isNull() | (F.col("weight") * F.col("level") > F.col("most"))
    return rows.select("source", "source_size", F.when(capped, F.col("most"))
                       .otherwise(F.col("weight") * F.col("level")).alias("target"))


def with_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                source_col: str = "source", weights: tuple[float, ...] = WEIGHTS,
                share: float = SHARE, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """``docs`` with, last, ``__mix``: struct of size, source_size, target and copies.

    Where ``docs`` has such a column, underscores are put behind the name. All other columns are carried along, whatever their names. Null texts have size 0, null
    sources are a source of their own. A source of size 0 has target 0 and no copies, nor has
    any document of size 0. Repeated rows are separate documents next to each other in the
    order. An empty table stays empty. The same rows and seed give the same copies in any run;
    a document is never taken more than ``ceil(cap)`` times.
    """
    own = [f"__c{i}" for i in range(len(docs.columns))]
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own)])
    at = dict(zip(docs.columns, own))
    size = n_words(at[text_col])
    rows = rows.select(
        *own, F.col(at[source_col]).cast("string").alias("source"), size.alias("size"),
        F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(at[id_col]).cast("string"), F.lit("")),
                       F.lit("|"), F.md5(whole_text(at[text_col])))).alias("key"))
    rows = rows.withColumn("band", F.floor(F.log2(F.col("size") + 1) * 8).cast("int"))

    # Counts by (source, size class): how many parts each needs, and each source's words.
    narrow = materialize(rows.select("source", "band", "size", "key"), "mix-rows")
    bands = narrow.groupBy("source", "band").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    wanted = targets(bands.groupBy("source").agg(F.sum("words").alias("source_size")),
                     weights, share, cap)
    bands = materialize(
        bands.join(wanted.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
        .select("of", F.col("band").alias("of_band"), "source_size", "target",
                F.greatest(F.ceil(F.col("n") / PART_ROWS), F.lit(1)).alias("parts")), "mix-bands")
    if bands.count() <= BROADCAST_ROWS:
        bands = F.broadcast(bands)

    counted = _with_part(narrow, bands).groupBy("source", "band", "part").agg(F.count("*").alias("n"))
    before = (Window.partitionBy("source").orderBy("band", "part")
              .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counted.select(F.col("source").alias("of"), F.col("band").alias("of_band"),
                             F.col("part").alias("of_part"), F.coalesce(
        F.sum("n").over(before), F.lit(0)).alias("before"))

    inside = Window.partitionBy("source", "band", "part").orderBy("key")
    placed = _with_part(rows, bands).withColumn("place", F.row_number().over(inside))
    hit = (F.col("source").eqNullSafe(F.col("of")) & (F.col("band") == F.col("of_band"))
           & (F.col("part") == F.col("of_part")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    offset = uniform(F.concat(F.lit(f"{seed}|offset|"), F.coalesce(F.col("source"), F.lit("null|"))))
    rank = F.col("before") + F.col("place")
    copies = F.floor(rank * rate + offset) - F.floor((rank - 1) * rate + offset)
    return placed.join(offsets, hit).select(
        *[F.col(n).alias(c) for c, n in zip(docs.columns, own)],
        F.struct("size", "source_size", "target",
                 F.when(F.col("size") > 0, F.least(copies, F.lit(math.ceil(cap)))).otherwise(0)
                 .cast("int").alias("copies")).alias(free_name(docs.columns, "__mix")))


def _with_part(rows: DataFrame, bands: DataFrame) -> DataFrame:
    """The part of the order that a row lies in, with its source's sizes."""
    spread = F.conv(F.substring(F.col("key"), 1, 6), 16, 10).cast("long")
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("band") == F.col("of_band"))
    return rows.join(bands, same).select(
        *rows.columns, "source_size", "target",
        F.floor(spread * F.col("parts") / F.lit(1 << 24)).alias("part"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken."""
    rows = with_copies(docs, **options)
    names = [f"`{c}`" for c in docs.columns]
    copies = F.col(f"`{rows.columns[-1]}`.copies")
    return rows.filter(copies > 0).select(
        *names, F.explode(F.sequence(F.lit(1), copies)).alias(free_name(docs.columns, "__copy"))).select(*names)
