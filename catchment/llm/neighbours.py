"""Approximate nearest neighbours by inner product with a forest of random-projection trees.

Every level of a tree cuts its nodes at the median of a random projection. The directions and
medians are fitted on a bounded sample; every row is then indexed in every tree. A query
descends all trees at once through one priority queue, the branch with the smallest distance
to the cuts passed first, until enough leaves are found. Candidates and queries meet leaf by
leaf, where all inner products are computed, in double precision on the original vectors.

Inner products become angles by one more coordinate that lifts all rows to the longest norm.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import HASH_SPACE, group_starts, map_pandas, whole_groups

K = 20
TREES = 10
LEAF = 512
SAMPLE = 16_384  # rows the cuts are fitted on, about
SEARCH = 1.3  # leaves a query visits, as a share of one tree's
MEMBER_BLOCK = 4096
QUERY_BLOCK = 2048


@dataclass
class Forest:
    directions: np.ndarray  # trees x levels x dimensions
    cuts: np.ndarray  # trees x inner nodes, a node's children are 2i + 1 and 2i + 2
    longest: float

    @property
    def levels(self) -> int:
        return self.directions.shape[1]

    @property
    def leaves(self) -> int:
        return 1 << self.levels


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def plant(sample: np.ndarray, rows: int, longest: float, trees: int = TREES, leaf: int = LEAF,
          seed: int = 11) -> Forest:
    """Cuts at the medians of the sample; a sample leaf keeps 8 rows at least."""
    levels = 0
    while rows / 2 ** levels > leaf and len(sample) / 2 ** (levels + 1) >= 8:
        levels += 1
    trees = trees if levels else 1
    dims = sample.shape[1] + 1 if sample.size else 1
    directions = np.random.default_rng(seed).standard_normal((trees, levels, dims))
    points = lifted(sample, longest) if sample.size else np.zeros((0, 1))
    cuts = np.zeros((trees, (1 << levels) - 1))
    for t in range(trees):
        node = np.zeros(len(points), dtype=int)
        for level in range(levels):
            p = points @ directions[t, level]
            for i in range((1 << level) - 1, (1 << (level + 1)) - 1):
                if (node == i).any():
                    cuts[t, i] = np.median(p[node == i])
            node = 2 * node + 1 + (p > cuts[t, node])
    return Forest(directions, cuts, longest)


def leaves_of(forest: Forest, vectors: np.ndarray) -> np.ndarray:
    """The leaf of every row in every tree, numbered through the forest, (rows x trees)."""
    points = lifted(vectors, forest.longest)
    out = np.empty((len(vectors), len(forest.cuts)), dtype=np.int64)
    for t in range(len(forest.cuts)):
        node = np.zeros(len(points), dtype=int)
        for level in range(forest.levels):
            node = 2 * node + 1 + (points @ forest.directions[t, level] > forest.cuts[t, node])
        out[:, t] = t * forest.leaves + node - (forest.leaves - 1)
    return out


def search(forest: Forest, vectors: np.ndarray, share: float):
    """The leaves that each query visits, by one queue over all trees."""
    size = np.sqrt((vectors**2).sum(1, keepdims=True))
    points = np.concatenate([vectors / size, np.zeros((len(vectors), 1))], axis=1) * forest.longest
    wanted = min(max(len(forest.cuts), int(np.ceil(share * forest.leaves))),
                 len(forest.cuts) * forest.leaves)
    inner = forest.leaves - 1
    scale = np.sqrt((forest.directions**2).sum(2))
    for point in points:
        place = forest.directions @ point
        queue = [(0.0, t, 0, 0) for t in range(len(forest.cuts))]
        found = []
        while queue and len(found) < wanted:
            far, t, level, node = heapq.heappop(queue)
            if node >= inner:
                found.append(t * forest.leaves + node - inner)
                continue
            margin = (place[t, level] - forest.cuts[t, node]) / scale[t, level]
            near = 2 * node + 1 + int(margin > 0)
            heapq.heappush(queue, (far, t, level + 1, near))
            heapq.heappush(queue, (max(far, abs(margin)), t, level + 1, 4 * node + 3 - near))
        yield found


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column])


def _index(forest: Forest):
    def run(batches):
        for batch in batches:
            if len(batch):
                leaves = leaves_of(forest, _matrix(batch["vector"]))
                yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), leaves.shape[1]),
                                    "leaf": leaves.ravel()})
    return run


def _visit(forest: Forest, share: float):
    def run(batches):
        for batch in batches:
            if len(batch):
                found = list(search(forest, _matrix(batch["vector"]), share))
                yield pd.DataFrame({"id": np.repeat(batch["id"].to_numpy(), [len(f) for f in found]),
                                    "leaf": np.concatenate(found).astype(np.int64)})
    return run


KEYS = ["leaf", "left", "right"]


def best(queries: np.ndarray, members: np.ndarray, ids: np.ndarray, k: int):
    """Each query's ``k`` best members: (ids, scores), by score and then smaller id.

    The product of matrices finds them, with whatever is within its rounding of the last;
    scores are then summed in one order for every pair, so that equal vectors tie.
    """
    rough = queries @ members.T
    take = min(k, len(ids))
    last = np.partition(rough, len(ids) - take, axis=1)[:, len(ids) - take]
    slack = 1e-9 * (1 + np.abs(rough).max(1))
    for q, row, low in zip(queries, rough, last - slack):
        near = np.flatnonzero(row >= low)
        score = (members[near] * q).sum(1)
        order = np.lexsort((ids[near], -score))[:k]
        yield ids[near][order], score[order]


def _meet(k: int):
    """One list of best candidates for every query of a task."""
    def run(batches):
        lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            frame = pd.DataFrame({"id": list(lists), "found": [f.tolist() for f, _ in lists.values()],
                                  "score": [s.tolist() for _, s in lists.values()]})
            lists.clear()
            return frame

        for frame in whole_groups(batches, KEYS):
            starts = group_starts(frame, KEYS)
            asks, ids = frame["asks"].to_numpy(), frame["id"].to_numpy()
            for s, e in zip(starts, starts[1:]):
                query = np.flatnonzero(asks[s:e]) + s
                member = np.flatnonzero(~asks[s:e]) + s
                if not len(query) or not len(member):
                    continue
                found = best(_matrix(frame["vector"].iloc[query]), _matrix(frame["vector"].iloc[member]),
                             ids[member], k)
                for who, (near, score) in zip(ids[query].tolist(), found):
                    if who in lists:
                        near = np.concatenate([lists[who][0], near])
                        score = np.concatenate([lists[who][1], score])
                        near, first = np.unique(near, return_index=True)
                        score = score[first]
                        order = np.lexsort((near, -score))[:k]
                        near, score = near[order], score[order]
                    lists[who] = (near, score)
                if len(lists) > 50_000:
                    yield out()
        if lists:
            yield out()
    return run


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part, one for each id.

    Left out are null ids and vectors that are null, empty, zero or hold a null, NaN or infinite
    component. Of rows that repeat an id the smallest vector counts. Where lengths differ, only
    vectors of the commonest length (the shorter on a tie) take part.
    """
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), vector.alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(
        ~bad & F.exists("vector", lambda x: x != 0))
    rows = materialize(rows.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").head(1)
    return rows.filter(F.size("vector") == lengths[0]["n"]) if lengths else rows


def nearest(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K,
            every: int = 20, trees: int = TREES, share: float = SEARCH) -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` nearest other rows that were found.

    Queries are the rows whose id is divisible by ``every``. Nearest means largest inner
    product, ties go to the smaller id. See ``usable`` for the rows that take part. Fewer
    than ``k`` candidates are all returned; an empty table gives no rows.

    Rows with one vector always tie: behind the ``k + 1`` smallest ids of a vector none can be
    among the nearest, so only these are indexed, and equal queries are searched once.
    """
    spark = table.sparkSession
    schema = "query_id long, rank int, " + f"`{id_col}` long, score double"
    rows = usable(table, id_col, vector_col)
    twin = Window.partitionBy("vector").orderBy("id")
    members = materialize(rows.withColumn("__n", F.row_number().over(twin))
                          .filter(F.col("__n") <= k + 1).drop("__n"), "members")
    n, longest = members.select(F.count("*"), F.max(F.sqrt(F.aggregate(
        "vector", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        return spark.createDataFrame([], schema)
    chosen = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(HASH_SPACE)) < int(HASH_SPACE * min(1.0, SAMPLE / n))
    sample = members.filter(chosen).limit(2 * SAMPLE).orderBy("id").select("vector").collect()
    forest = plant(_matrix([r.vector for r in sample]) if sample else np.zeros((0, 0)), n, longest, trees)

    # Equal queries are one, named by its smallest id.
    queries = rows.filter(F.col("id") % every == 0)
    asked = materialize(queries.groupBy("vector").agg(F.min("id").alias("id")), "queries")
    indexed = map_pandas(members, _index(forest), "id long, leaf long")
    visits = map_pandas(asked, _visit(forest, share), "id long, leaf long")
    pairs = materialize(indexed.withColumn("asks", F.lit(False))
                        .unionByName(visits.withColumn("asks", F.lit(True))), "leaves")
    sizes = pairs.groupBy("leaf").agg(
        F.greatest(F.ceil(F.count(F.when(~F.col("asks"), 1)) / MEMBER_BLOCK), F.lit(1)).alias("lefts"),
        F.greatest(F.ceil(F.count(F.when(F.col("asks"), 1)) / QUERY_BLOCK), F.lit(1)).alias("rights"))
    dealt = pairs.join(sizes, "leaf")

    def spread(rows, own, other):
        """Each row to its own block, with all blocks of the other side."""
        sides = {own: F.pmod(F.xxhash64("id", F.lit("deal")), F.col(own + "s")),
                 other: F.explode(F.sequence(F.lit(0).cast("long"), F.col(other + "s") - 1))}
        return rows.select("leaf", "id", "asks", "vector", sides[own].alias(own), sides[other].alias(other))

    left = spread(dealt.filter(~F.col("asks")).join(members, "id"), "left", "right")
    right = spread(dealt.filter("asks").join(asked, "id"), "right", "left")
    met = left.unionByName(right).select(*KEYS, "id", "asks", "vector")
    met = met.repartition(*KEYS).sortWithinPartitions(*KEYS)
    lists = map_pandas(met, _meet(k + 1), "id long, found array<long>, score array<double>")
    merged = (lists.select("id", F.explode(F.arrays_zip("found", "score")).alias("c"))
              .groupBy("id", F.col("c.found").alias("found")).agg(F.max("c.score").alias("score")))
    order = Window.partitionBy("id").orderBy(F.desc("score"), "found")
    top = (merged.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k + 1)
           .groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "found", "score"))).alias("top")))
    named = asked.join(top, "id").select("vector", "top")
    kept = F.slice(F.filter("top", lambda t: t["found"] != F.col("id")), 1, k)
    return (queries.join(named, "vector").select("id", F.posexplode(kept).alias("p", "t"))
            .select(F.col("id").alias("query_id"), (F.col("p") + 1).cast("int").alias("rank"),
                    F.col("t.found").alias(id_col), F.col("t.score").alias("score")))
