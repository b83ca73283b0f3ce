"""Exact duplicates through an extendible-hash index on shared files.

Texts are hashed to 64 bits. A directory over the leading bits doubles until no bucket holds
more than its capacity: buckets that stay small keep a short prefix, overfull ones are split
by one more bit. The directory sends every text to the owner of its bucket: an owner task holds
a range of whole buckets, puts equal texts of a key together by comparing their bytes, chains
the different ones and writes its buckets as one file of the shared folder. Rows look their text
up by bucket, key and digest. The index has one entry per distinct text.

Copies of a text are combined where they are read, in a few shares, before the directory routes
them, so a text that makes up a third of the corpus arrives at its owner as a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, scratch_path
from .common import whole_text

CAPACITY = 20_000  # texts in a bucket
MAX_DEPTH = 18  # bits of the largest directory: 2^18 rows of 16 bytes can be broadcast
SHARES = 8  # rows in which all copies of a text reach its owner
WHITE = " \t\n\x0b\f\r"  # the characters [\x20\x09-\x0D]


def number(digits: int) -> Column:
    """A whole number beyond the range of a long."""
    return F.lit(str(digits)).cast("decimal(21,0)")


def stripped(text: Column) -> Column:
    """The text without blanks and the controls 9 to 13."""
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def slot(key: Column, depth: int) -> Column:
    """The leading ``depth`` bits of a key, as a number."""
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) for every slot of the global depth that has keys, and that depth.

    Doubling starts from one bucket of depth 0. The counts of all prefixes come from one pass
    over ``keys`` (column ``key``): a bucket is the longest prefix needed to hold no more than
    ``capacity`` keys. The capacity doubles where ``max_depth`` bits would not do, which keeps
    the directory at 2^max_depth rows at most, however large the corpus.
    """
    n = keys.count()
    depth = min(max_depth, max(1, (2 * n // capacity).bit_length() + 1))
    while n / 2 ** (depth - 1) > capacity:
        capacity *= 2
    finest = materialize(keys.groupBy(slot(F.col("key"), depth).alias("slot"))
                         .agg(F.count("*").alias("n")), "hash-slots")
    # Counts of every prefix length, in one grouping of at most 2^max_depth rows each.
    levels = F.explode(F.sequence(F.lit(0), F.lit(depth)))
    prefix = finest.select("slot", "n", levels.alias("depth"))
    prefix = prefix.withColumn("bucket", F.expr(f"shiftrightunsigned(slot, {depth} - depth)"))
    sizes = prefix.groupBy("depth", "bucket").agg(F.sum("n").alias("size"))
    fits = (prefix.join(sizes, ["depth", "bucket"])
            .filter((F.col("size") <= capacity) | (F.col("depth") == depth)))
    found = fits.groupBy("slot").agg(F.min(F.struct("depth", "bucket")).alias("at"))
    return materialize(found.select("slot", F.col("at.bucket").alias("bucket"),
                                    F.col("at.depth").alias("depth")), "hash-directory"), depth


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The index and the keyed rows.

    Index: first (slot), bucket, depth, key, sha, group_size, keep_id, chain (number within the key);
    written below ``path`` by owners of whole buckets, each file ordered by bucket and key. Rows: id,
    key, sha and the bucket that the directory gives, of every row of ``docs``.
    """
    spark = docs.sparkSession
    raw = whole_text(text_col)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.length(raw).alias("points"),
                       stripped(raw).alias("norm"))
    rows = rows.withColumn("key", F.xxhash64("norm"))
    keyed = materialize(rows.select("id", "key", F.unhex(F.sha2("norm", 256)).alias("sha")), "hash-rows")
    slots, depth = directory(keyed.select("key", "sha").distinct(), capacity)
    keyed = routed(keyed, slots, depth)

    # The row that stays: most code points, then smallest id; a null id comes last. One number
    # holds both, so that copies are combined by hashing before the shuffle.
    scale, highest = number(10**20), number(2**63)
    rank = F.col("points").cast("decimal(11,0)") * scale + F.coalesce(
        highest - F.col("id").cast("decimal(20,0)"), F.lit(0).cast("decimal(21,0)"))
    share = F.pmod(F.xxhash64("id", "points"), F.lit(SHARES)).alias("share")
    copies = (rows.select("key", "norm", rank.cast("decimal(38,0)").alias("rank"), share)
              .groupBy("key", "norm", "share").agg(F.count("*").alias("n"), F.max("rank").alias("rank")))
    # All of a bucket has the same first slot, so a range of first slots is a range of whole buckets.
    owned = routed(copies, slots, depth).repartitionByRange("first")
    texts = (owned.groupBy("first", "bucket", "depth", "key", "norm")
             .agg(F.sum("n").alias("group_size"), F.max("rank").alias("rank")))
    low = F.col("rank") % scale
    entries = texts.select(
        "first", "bucket", "depth", "key", F.unhex(F.sha2("norm", 256)).alias("sha"), "group_size",
        F.when(low > 0, highest - low).cast("long").alias("keep_id"))
    chain = Window.partitionBy("first", "key").orderBy("sha")
    entries = entries.withColumn("chain", F.row_number().over(chain)).withColumn("twin", F.lag("sha").over(chain))
    entries = entries.withColumn("sha", F.when(
        F.col("sha") == F.col("twin"),
        F.raise_error(F.lit("two texts share a key and a SHA-256"))).otherwise(F.col("sha"))).drop("twin")
    path = path or scratch_path(spark, "hash-index")
    entries.sortWithinPartitions("first", "key", "chain").write.parquet(path)
    return spark.read.schema(entries.schema).parquet(path), keyed


def routed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """Rows with their bucket, its depth and its first slot, looked up in the directory by ``key``."""
    first = F.expr(f"shiftleft(bucket, {depth} - depth)").alias("first")
    return (rows.withColumn("slot", slot(F.col("key"), depth))
            .join(F.broadcast(slots.select("slot", "bucket", "depth", first)), "slot").drop("slot"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     capacity: int = CAPACITY) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row, dropped ones too.

    Texts are equal when identical without ``[\\x20\\x09-\\x0D]``; null counts as empty, and all
    empty texts are one group. Of a group the row with the most code points, then the smallest
    id stays; rows repeated with that id and length are all marked kept, since nothing tells
    them apart. A null id is kept only where all ids of its group's longest texts are null.
    Other columns are ignored. An empty table gives no rows.
    """
    index, keyed = build_index(docs, id_col, text_col, capacity)
    shared = index.filter(F.col("group_size") > 1).select("first", "key", "sha", "keep_id", "group_size")
    out = keyed.join(shared, ["first", "key", "sha"], "left")
    single = F.col("group_size").isNull()
    return out.select(
        F.col("id").alias(id_col), F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))
