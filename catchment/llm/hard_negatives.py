"""Hard negatives by Four-Russians scoring of integer vectors.

A score is the integer inner product of an anchor and a row. Rows are packed to blocks of
bit planes: byte g of plane k holds bit k of the eight components of group g, in two's
complement. For an anchor all 256 subset sums of each group of its components are computed
once; a row's share of a plane is then one lookup for each group, and planes are shifted to
their weight and added. The sums are the full exact scores, nothing is estimated.

Anchors meet rows in a grid: columns of anchors, stripes of blocks. A task holds the anchors of
one column and reads the blocks of one stripe one by one, keeping short lists only, so neither
side is ever gathered and no pair is emitted.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_pandas

GROUP = 8  # components of one table
BLOCK = 4096  # rows packed together
STRIPE = 32  # blocks of a task, about
COLUMN = 8192  # anchors of a task, about
AT_ONCE = 64  # anchors whose tables are held together
SCALE = 256
KEYS = ["column", "stripe"]


def packed(vectors: np.ndarray) -> np.ndarray:
    """Bit planes of integer vectors, (planes x groups x rows) bytes; the last plane is the sign."""
    rows, dims = vectors.shape
    groups = -(-dims // GROUP)
    wide = np.zeros((rows, groups * GROUP), dtype=np.int64)
    wide[:, :dims] = vectors
    largest = int(np.maximum(wide, ~wide).max(initial=0))
    planes = np.empty((largest.bit_length() + 1, groups, rows), dtype=np.uint8)
    for k in range(len(planes)):
        bits = ((wide >> k) & 1).astype(np.uint8)
        planes[k] = np.packbits(bits, axis=1, bitorder="little").T
    return planes


def subset_sums(anchors: np.ndarray, groups: int) -> np.ndarray:
    """For each group and byte the sum of the anchors' components it names, (groups x 256 x anchors)."""
    wide = np.zeros((len(anchors), groups * GROUP), dtype=np.int64)
    shared = min(wide.shape[1], anchors.shape[1])
    wide[:, :shared] = anchors[:, :shared]
    tables = np.zeros((groups, 256, len(anchors)), dtype=np.int64)
    for bit in range(GROUP):
        # All subsets of the lower components, again with this one.
        half = 1 << bit
        tables[:, half:2 * half] = tables[:, :half] + wide.T.reshape(groups, GROUP, 1, -1)[:, bit]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Exact inner products by lookups, (rows x anchors)."""
    total = np.zeros((planes.shape[2], tables.shape[2]), dtype=np.int64)
    for k, plane in enumerate(planes):
        share = tables[0][plane[0]] if len(plane) else np.zeros_like(total)
        for table, index in zip(tables[1:], plane[1:]):
            share += table[index]
        share <<= k
        total = total - share if k == len(planes) - 1 else total + share
    return total


def first(ids: np.ndarray, found: np.ndarray, at: np.ndarray, k: int):
    """(ids, scores) of the first ``k`` of the rows ``at``: highest score, then smallest id."""
    if len(at) > k:
        own = found[at]
        at = at[own >= np.partition(own, len(own) - k)[len(own) - k]]
    order = at[np.lexsort((ids[at], -found[at]))[:k]]
    return ids[order], found[order]


def _longs(rows: list) -> np.ndarray:
    """Integer vectors as a matrix; shorter ones end in zeros."""
    out = np.zeros((len(rows), max(map(len, rows), default=0)), dtype=np.int64)
    for own, row in zip(out, rows):
        own[:len(row)] = row
    return out


def _pack(batches):
    """Blocks of rows that come sorted by label and id."""
    for batch in batches:
        for at in range(0, len(batch), BLOCK):
            part = batch.iloc[at:at + BLOCK]
            labels = part["label"].to_numpy(dtype=np.int64)
            planes = packed(_longs(part["vector"].tolist()))
            yield pd.DataFrame({
                "name": [int(part["id"].iloc[0])], "low": [labels.min()], "high": [labels.max()],
                "ids": [part["id"].to_numpy(dtype=np.int64).tobytes()], "labels": [labels.tobytes()],
                "shape": [list(planes.shape)], "planes": [planes.tobytes()]})


def _grid(fresh, score_block, listed):
    """Cells of the grid: the anchors of a column come first, then the blocks of a stripe."""
    def run(batches):
        key, anchors, state = None, [], None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.column, row.stripe) != key:
                    if state is not None:
                        yield from listed(state)
                    key, anchors, state = (row.column, row.stripe), [], None
                if row.planes is None:
                    anchors.append(row)
                    continue
                if not anchors:
                    continue
                if state is None:
                    state = fresh(anchors)
                planes = np.frombuffer(row.planes, dtype=np.uint8).reshape(row.shape)
                score_block(state, row, np.frombuffer(row.ids, dtype=np.int64),
                            np.frombuffer(row.labels, dtype=np.int64), planes)
        if state is not None:
            yield from listed(state)
    return run


def _fresh(anchors):
    return {"id": np.array([a.id for a in anchors], dtype=np.int64),
            "label": np.array([a.label for a in anchors], dtype=np.int64),
            "vector": _longs([a.vector for a in anchors]),
            "asked": [np.unique(a.scores) if a.scores is not None else () for a in anchors], "best": {}}


def _keep(state, key, found, k):
    if key in state["best"]:
        found = tuple(np.concatenate(x) for x in zip(state["best"][key], found))
        found = first(*found, np.arange(len(found[0])), k)
    state["best"][key] = found


def _parts(state, wanted, planes):
    """(number, scores) of each anchor of ``wanted``, a few tables at a time."""
    for at in range(0, len(wanted), AT_ONCE):
        part = wanted[at:at + AT_ONCE]
        found = np.ascontiguousarray(scores(subset_sums(state["vector"][part], planes.shape[1]), planes).T)
        yield from zip(part.tolist(), found)


def _positives(k):
    def score_block(state, row, ids, labels, planes):
        wanted = np.flatnonzero((state["label"] >= row.low) & (state["label"] <= row.high))
        for a, found in _parts(state, wanted, planes):
            at = np.flatnonzero((labels == state["label"][a]) & (ids != state["id"][a]))
            if len(at):
                _keep(state, a, first(ids, found, at, k), k)
    return score_block


def _negatives(k, low):
    def score_block(state, row, ids, labels, planes):
        wanted = np.array([a for a, asked in enumerate(state["asked"]) if len(asked)], dtype=np.int64)
        for a, found in _parts(state, wanted, planes):
            other = labels != state["label"][a]
            for asked in state["asked"][a].tolist():
                at = np.flatnonzero(other & (100 * found >= low * asked) & (found <= asked))
                if len(at):
                    _keep(state, (a, asked), first(ids, found, at, k), k)
    return score_block


def _listed(state):
    keys = list(state["best"])
    if not keys:
        return
    number = [k[0] if isinstance(k, tuple) else k for k in keys]
    yield pd.DataFrame({
        "id": state["id"][number], "asked": [k[1] if isinstance(k, tuple) else 0 for k in keys],
        "found": [state["best"][k][0].tolist() for k in keys],
        "score": [state["best"][k][1].tolist() for k in keys]})


def _meet(anchors: DataFrame, blocks: DataFrame, columns: int, stripes: int, score_block) -> DataFrame:
    """(id, asked, found, score): what each anchor keeps of each stripe."""
    none = "CAST(NULL AS {}) AS {}"
    own = anchors.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1)))).selectExpr(
        *KEYS, "id", "label", "vector", "scores", *[none.format(t, c) for t, c in (
            ("bigint", "low"), ("bigint", "high"), ("binary", "ids"), ("binary", "labels"),
            ("array<int>", "shape"), ("binary", "planes"))])
    met = blocks.withColumn("column", F.explode(F.sequence(F.lit(0), F.lit(columns - 1)))).selectExpr(
        *KEYS, none.format("bigint", "id"), none.format("bigint", "label"), none.format("array<bigint>", "vector"),
        none.format("array<bigint>", "scores"), "low", "high", "ids", "labels", "shape", "planes")
    dealt = own.unionByName(met).repartition(*KEYS).sortWithinPartitions(*KEYS, F.col("planes").isNotNull())
    return map_pandas(dealt, _grid(_fresh, score_block, _listed),
                      "id long, asked long, found array<long>, score array<long>")


def _ranked(lists: DataFrame, k: int) -> DataFrame:
    """(id, asked, rank, found, score): the first ``k`` of all stripes."""
    order = Window.partitionBy("id", "asked").orderBy(F.desc("score"), "found")
    return (lists.select("id", "asked", F.explode(F.arrays_zip("found", "score")).alias("c"))
            .select("id", "asked", "c.found", "c.score").withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k))


def usable(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, vector) of the rows that take part, components as integers, floor(256 c).

    Left out are null ids, null labels and vectors that are null or hold a null, NaN or infinite
    component. Of rows that repeat an id the one with the smallest label, then vector counts.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"),
                        F.col(f"`{label_col}`").cast("long").alias("label"), vector.alias("vector"))
    rows = rows.dropna(subset=["id", "label", "vector"]).filter(~bad).withColumn(
        "vector", F.transform("vector", lambda x: F.floor(x * SCALE).cast("long")))
    return (rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("own"))
            .select("id", "own.label", "own.vector"))


def mine(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``. An anchor's positives are its first
    ``positives`` other rows of the same label; for each of them the first ``negatives`` rows of
    another label with low percent of its score <= score <= its score are returned. First means
    highest score, ties go to the smaller id. A negative positive score has no such rows.

    See ``usable`` for the rows that take part. Vectors of different lengths are compared over
    the components that both have. Empty tables, and anchors without positives or negatives,
    give no rows. Other columns are ignored. Sums have to fit into 64 bits, which is checked.
    """
    spark = table.sparkSession
    rows = materialize(usable(table, id_col, vector_col, label_col), "vectors")
    n, asked, top, dims = rows.select(
        F.count("*"), F.count(F.when(F.col("id") % every == 0, 1)),
        F.max(F.array_max(F.transform("vector", lambda x: F.greatest(x, -x)))), F.max(F.size("vector"))).first()
    schema = ("anchor_id long, positive_id long, rank int, negative_id long, "
              "positive_score long, negative_score long")
    if not asked or not dims:
        return spark.createDataFrame([], schema)
    if 100 * top * top * dims >= 1 << 63:
        raise ValueError("components are too large for exact 64-bit scores")
    blocks = materialize(map_pandas(
        rows.repartitionByRange("label", "id").sortWithinPartitions("label", "id"), _pack,
        "name long, low long, high long, ids binary, labels binary, shape array<int>, planes binary"), "planes")
    stripes = max(1, -(-blocks.count() // STRIPE), spark.sparkContext.defaultParallelism)
    columns = max(1, -(-asked // COLUMN))
    blocks = blocks.withColumn("stripe", F.pmod(F.xxhash64("name"), F.lit(stripes)).cast("int")).drop("name")
    anchors = rows.filter(F.col("id") % every == 0).withColumn(
        "column", F.pmod(F.xxhash64("id", F.lit("column")), F.lit(columns)).cast("int"))

    plain = anchors.withColumn("scores", F.lit(None).cast("array<bigint>"))
    best = _ranked(_meet(plain, blocks, columns, stripes, _positives(positives)), positives)
    best = materialize(best.select("id", F.col("found").alias("positive_id"), F.col("score").alias("positive_score")),
                       "positives")
    wanted = best.groupBy("id").agg(F.collect_list("positive_score").alias("scores"))  # a few an anchor
    found = _ranked(_meet(anchors.join(wanted, "id"), blocks, columns, stripes, _negatives(negatives, low)), negatives)
    return best.join(found.withColumnRenamed("asked", "positive_score"), ["id", "positive_score"]).select(
        F.col("id").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"),
        F.col("found").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
