"""Near-duplicates by a chosen-path set similarity join over word shingles.

A document's set is known by the minwise tokens of 128 hash functions. In each of several
independent trees a node chooses some of these coordinates, and every document in it goes on
to one child for each, named by its token there. Similar sets share many tokens and meet in
some node; nodes that are still large branch again. Nodes of bounded size are compared
exhaustively on the sketches, larger ones at the last depth in blocks, each against each.

What the sketches call similar within a wide margin is only a candidate. Candidates are
gathered to components, and within these all pairs are decided on the full sets.

Two sets with similarity s meet in one tree with depth 3 and two choices a node with
probability 0.970 at s = 0.85 and 0.941 at 0.80 (x -> 1 - (1 - s x)^2 from x = 1). The number
of trees and the margin of the sketches follow from the similarity asked for: each may lose 5
in 100,000 of the links that are just as similar, by the number of equal tokens being binomial.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import group_starts, map_pandas, merge_labels, whole_groups, whole_text
from .components import components
from .shingles import COORDINATES, forget, mixed, shingle_set, sketches

SIMILARITY = 85  # percent
LOSS = 5e-5  # of the links at the similarity asked for, by the trees and by the margin each
BRANCHES = 2
DEPTH = 3  # levels that all documents pass
MAX_DEPTH = 8
SMALL = 4096  # a node up to this size is compared, a larger one branches
BLOCK = 512  # documents of a block of comparisons
EXACT_BLOCK = 256
BATCH = 1024


def tree_count(percent: int) -> int:
    """Trees that lose no more than ``LOSS`` of the links at ``percent``."""
    meet = 1.0
    for _ in range(DEPTH):
        meet = 1 - (1 - percent / 100 * meet) ** BRANCHES
    return 1 if meet >= 1 else max(1, math.ceil(math.log(LOSS) / math.log(1 - meet)))


def margin(percent: int) -> int:
    """Equal bytes of the sketches that make a candidate; fewer are found in ``LOSS`` of the links.

    One byte of a token is compared: different tokens agree in it once in 256.
    """
    p = percent / 100 + (1 - percent / 100) / 256
    lost = 0.0
    for equal in range(COORDINATES + 1):
        lost += math.comb(COORDINATES, equal) * p ** equal * (1 - p) ** (COORDINATES - equal)
        if lost > LOSS:
            return equal
    return COORDINATES


def _signatures(batches):
    """(id, n, set_key, sketch) of every text."""
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            part = batch.iloc[at:at + BATCH]
            sets = [shingle_set(t) for t in part["text"]]
            found = sketches(sets)
            yield pd.DataFrame({
                "id": part["id"], "text_key": part["text_key"], "n": [len(s) for s in sets],
                "set_key": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets],
                "sketch": [row.tobytes() for row in found]})
    forget()


def _tokens(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(-1, COORDINATES)


def _children(path: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Paths of the chosen children of each row's node, (rows x branches).

    The node chooses coordinates by its own path, so all its documents branch alike.
    """
    out = np.empty((len(path), BRANCHES), dtype=np.uint64)
    first = None
    for branch in range(BRANCHES):
        chosen = mixed(path + np.uint64(branch + 1)) % np.uint64(COORDINATES - branch)
        if branch:  # another coordinate than the first
            chosen = (chosen + first + np.uint64(1)) % np.uint64(COORDINATES)
        else:
            first = chosen
        token = tokens[np.arange(len(path)), chosen.astype(int)].astype(np.uint64)
        out[:, branch] = mixed(mixed(path * np.uint64(31) + chosen) ^ token)
    return out


def _plant(trees: int, depth: int):
    """Each document's nodes at ``depth``, in every tree."""
    def run(batches):
        for batch in batches:
            tokens, ids = _tokens(batch["sketch"]), batch["id"].to_numpy()
            rows, paths = [], []
            for tree in range(trees):
                path = np.full((len(ids), 1), 1000003 * (tree + 1), dtype=np.uint64)
                for _ in range(depth):
                    path = np.concatenate([_children(p, tokens) for p in path.T], axis=1)
                for p in path.T:
                    rows.append(ids)
                    paths.append(p)
            yield pd.DataFrame({"id": np.concatenate(rows), "path": np.concatenate(paths).view(np.int64)})
    return run


def _grow(batches):
    """The children of documents in nodes that are too large."""
    for batch in batches:
        if not len(batch):
            continue
        children = _children(batch["path"].to_numpy().view(np.uint64), _tokens(batch["sketch"]))
        for branch in range(BRANCHES):
            yield pd.DataFrame({"id": batch["id"], "path": children[:, branch].copy().view(np.int64)})


KEYS = ["path", "first", "second"]


def _compare(percent: int):
    """Links that span the candidates of each block: every row with the first of its component."""
    enough = margin(percent)

    def run(batches):
        for frame in whole_groups(batches, KEYS):
            n = frame["n"].to_numpy()
            small = np.frombuffer(b"".join(frame["bytes"]), dtype=np.uint8).reshape(-1, COORDINATES)
            starts = group_starts(frame, KEYS)
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            longest = int(np.diff(starts).max())
            left, right = [], []
            everyone = np.arange(len(frame))
            for step in range(1, longest):
                a = everyone[:-step][group[:-step] == group[step:]]
                if len(a) == 0:
                    break
                b = a + step
                fits = 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
                a, b = a[fits], b[fits]
                for at in range(0, len(a), 1 << 14):
                    x, y = a[at:at + (1 << 14)], b[at:at + (1 << 14)]
                    near = (small[x] == small[y]).sum(1, dtype=np.int16) >= enough
                    left.append(x[near])
                    right.append(y[near])
            if not left:
                continue
            label = merge_labels(len(frame), np.concatenate(left), np.concatenate(right))
            ids = frame["id"].to_numpy()
            linked = np.flatnonzero(label != everyone)
            yield pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})
    return run


def in_blocks(rows: DataFrame, size: int, block: int, key: str) -> DataFrame:
    """Rows of large groups dealt to blocks, each copied to its pairs with all blocks.

    ``size`` names the column of the group's count. Columns first and second number the pair.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    rows = rows.withColumn("__blocks", blocks).withColumn(
        "__own", F.pmod(F.xxhash64("id", F.lit("block")), F.col("__blocks")).cast("int"))
    rows = rows.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    # A block meets itself only within its pairs with others, where there are others.
    rows = rows.filter((F.col("__blocks") == 1) | (F.col("__other") != F.col("__own")))
    return (rows.withColumn("first", F.least("__own", "__other"))
            .withColumn("second", F.greatest("__own", "__other"))
            .drop("__blocks", "__own", "__other", size))


def candidates(sets: DataFrame, percent: int, trees: int) -> DataFrame:
    """Links (a, b) that span the candidate components of ``sets`` (id, n, sketch)."""
    rows = materialize(map_pandas(sets.select("id", "sketch"), _plant(trees, DEPTH), "id long, path long"),
                       "paths")
    compact = F.expr("unhex(regexp_replace(hex(sketch), '(..)......', '$1'))")
    short = sets.select("id", "n", compact.alias("bytes"))
    found = None
    for depth in range(DEPTH, MAX_DEPTH + 1):
        sizes = rows.groupBy("path").agg(F.count("*").alias("size")).filter("size > 1")
        shared = materialize(rows.join(sizes, "path"), "nodes")
        last = depth == MAX_DEPTH or not shared.filter(F.col("size") > SMALL).head(1)
        ready = shared if last else shared.filter(F.col("size") <= SMALL)
        blocks = in_blocks(ready.join(short, "id"), "size", BLOCK, "path")
        blocks = blocks.repartition(*KEYS).sortWithinPartitions(*KEYS)
        links = materialize(map_pandas(blocks.select(*KEYS, "id", "n", "bytes"), _compare(percent),
                                       "a long, b long"), "candidates")
        found = links if found is None else found.unionByName(links)
        if last:
            return found
        large = shared.filter(F.col("size") > SMALL).select("id", "path").join(sets.select("id", "sketch"), "id")
        rows = materialize(map_pandas(large.select("id", "path", "sketch"), _grow, "id long, path long")
                           .distinct(), "paths")
    return found


EXACT_KEYS = ["root", "first", "second"]


def _confirm(percent: int):
    """Spanning links of each group under the exact rule, all pairs decided on full sets."""
    def run(batches):
        for frame in whole_groups(batches, EXACT_KEYS):
            starts = group_starts(frame, EXACT_KEYS)
            ids, texts = frame["id"].to_numpy(), frame["text"].tolist()
            for s, e in zip(starts, starts[1:]):
                if e - s < 2:
                    continue
                a, b = exact_links([shingle_set(t) for t in texts[s:e]], percent)
                label = merge_labels(e - s, a, b)
                linked = np.flatnonzero(label != np.arange(e - s))
                yield pd.DataFrame({"a": ids[s:e][linked], "b": ids[s:e][label[linked]]})
        forget()
    return run


def exact_links(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs with 100 x intersection >= percent x union.

    Intersections are products of the incidence matrix of the shingles that at least two sets
    hold, some thousands of shingles at a time.
    """
    n = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    count = np.bincount(column, minlength=len(values))
    number = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(len(sets)), n)
    shared = count[column] > 1
    row, column = row[shared], number[column[shared]]
    common = np.zeros((len(sets), len(sets)), dtype=np.float64)
    width = max(256, (1 << 22) // len(sets))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((len(sets), width), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - at] = 1
        common += part @ part.T
    union = n[:, None] + n[None, :] - common
    a, b = np.nonzero(np.triu((100 * common >= percent * union) & (n[:, None] > 0) & (n[None, :] > 0), 1))
    return a, b


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    percent: int = SIMILARITY, trees: int | None = None) -> DataFrame:
    """(id, n_shingles, component_id, text_key, kept) of every row.

    Null and empty texts have an empty set, are linked with nothing and kept. Rows with equal
    sets are one node, named by their smallest id; rows that repeat an id are one node where
    they are named by it. A null id cannot be named: such a row is linked with nothing, its
    component_id is null and it is kept. ``text_key``, a hash of the text, tells rows with one
    id apart. Other columns are ignored. Empty tables give no rows.
    Texts are read whole, whatever their length.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_text(text_col).alias("text"))
    signed = materialize(map_pandas(
        rows.withColumn("text_key", F.xxhash64("text")), _signatures,
        "id long, text_key long, n long, set_key binary, sketch binary"), "signatures")
    usable = signed.filter("n > 0 AND id IS NOT NULL")
    classes = materialize(usable.groupBy("set_key").agg(
        F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sets")

    wide = components(candidates(classes, percent, trees or tree_count(percent)))
    wide = materialize(wide.withColumnRenamed("node", "id"), "wide")
    sizes = wide.groupBy("root").agg(F.count("*").alias("size"))
    # The members grow with the corpus: they are dealt out with the texts, never broadcast.
    members = rows.hint("merge").join(wide.join(sizes, "root"), "id")
    blocks = in_blocks(members, "size", EXACT_BLOCK, "root")
    blocks = blocks.repartition(*EXACT_KEYS).sortWithinPartitions(*EXACT_KEYS)
    links = map_pandas(blocks.select(*EXACT_KEYS, "id", "text"), _confirm(percent), "a long, b long")
    joined = components(materialize(links, "links"))

    named = classes.select("set_key", "id").join(joined.withColumnRenamed("node", "id"), "id", "left")
    named = materialize(named.select("set_key", F.coalesce("root", "id").alias("root")), "named")
    out = signed.select("id", "text_key", "n", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("root"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
                      component.alias("component_id"), "text_key",
                      (component.isNull() | component.eqNullSafe(F.col("id"))).alias("kept"))
