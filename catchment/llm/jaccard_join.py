"""Exact Jaccard join of word shingles in size-banded tiles with bitmap signatures.

Two sets can only be similar enough if their sizes are, and if they share one of the first
shingles of each in some common order (the first n - need + 1, where need is the share of its
own shingles that a set must have in common). So sets meet in tiles: a tile is named by such a
shingle and a band of sizes, and holds the sets of its band and those of the band below. The
order puts shingles that many texts share last, so that they hardly name tiles.

Within a tile pairs are compared by bitmaps. A shingle flips one bit, hence two sets differ in at
least as many shingles as their bitmaps do in bits, which bounds their overlap from above. Pairs
that pass are decided by intersecting the sorted arrays of the sets.

Tiles with the same sets are one. Large tiles are settled first: all sets are compared with a few
of their tile, and only where links still leave it in several components are these compared
with each other, in blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import group_starts, map_pandas, whole_groups, whole_text
from .components import components
from .near_dedup import in_blocks
from .shingles import forget, mixed, shingle_set

PERCENT = 80
LOCAL = 4  # texts of a batch that make a shingle a candidate for the end of the order
OFTEN = 32  # texts that put a shingle there
COMMON = 200_000  # shingles there at most: the commonest; the order changes no result
SMALL = 64  # sets of a tile that are all compared; larger ones are settled first
BLOCK = 512
STARS = 3  # sets of a large tile that all others are compared with first
NAMED = 32  # tiles of a set by which pairs are told once
TILE = ["tile", "band"]
LEAST_BITS = 64


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of ``n`` has in common with any set it links with."""
    return -(-percent * n // 100)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parities of the shingles that fall on each bit; two to four bits a shingle."""
    bits = LEAST_BITS
    while bits < 2 * len(shingles):
        bits *= 2
    flips = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def folded(maps: list[bytes], words: int) -> np.ndarray:
    """Bitmaps as rows of so many 64-bit words, longer ones folded."""
    sizes = np.array([len(m) // 8 for m in maps])
    out = np.empty((len(maps), words), dtype=np.uint64)
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        flat = np.frombuffer(b"".join([maps[i] for i in at]), dtype=np.uint64)
        out[at] = np.bitwise_xor.reduce(flat.reshape(len(at), size // words, words), axis=1)
    return out


def _facts(batches):
    """A row for each text, and one for each shingle that several texts of a batch hold."""
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        yield pd.DataFrame({
            "id": batch["id"], "text_key": batch["text_key"], "n": [len(s) for s in sets], "set_key": keys,
            "bitmap": [bitmap(s) for s in sets], "shingle": None, "texts": None})
        distinct = list(dict(zip(keys, sets)).values())
        values, texts = np.unique(np.concatenate(distinct), return_counts=True)
        often = texts >= LOCAL
        yield pd.DataFrame({
            "id": None, "text_key": None, "n": None, "set_key": None, "bitmap": None,
            "shingle": values[often].view(np.int64), "texts": texts[often]})
    forget()


def _heads(percent: int, common: np.ndarray):
    """The first shingles of every set: rare ones as ``deal``, common ones by name and dealt at random."""
    def run(batches):
        for batch in batches:
            seen, parts = set(), []
            for text in batch["text"]:
                s = shingle_set(text)
                key = xxhash.xxh3_128_digest(s.tobytes())[:8]
                if not len(s) or key in seen:
                    continue
                seen.add(key)
                count = len(s) - int(need(len(s), percent)) + 1
                last = np.zeros(len(s), dtype=bool)
                if len(common):
                    last = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                first = np.flatnonzero(~last)[:count]
                rest = np.flatnonzero(last)[:count - len(first)]
                parts.append((s[np.append(first, rest)], key, len(s), len(rest)))
            if not parts:
                continue
            sizes = [len(p[0]) for p in parts]
            shingle = np.concatenate([p[0] for p in parts])
            key = np.repeat(np.frombuffer(b"".join(p[1] for p in parts), dtype=np.int64), sizes)
            often = np.concatenate([np.arange(c) >= c - p[3] for p, c in zip(parts, sizes)])
            deal = np.where(often, mixed(shingle ^ mixed(key.view(np.uint64))), shingle).view(np.int64)
            yield pd.DataFrame({
                "deal": deal, "key": key, "n": np.repeat(np.array([p[2] for p in parts], dtype=np.int32), sizes),
                "common": pd.array(shingle.view(np.int64), dtype="Int64")}).assign(
                    common=lambda f: f["common"].mask(~often))
        forget()
    return run


def _runs(percent: int):
    """Sets that share a shingle and may be alike in size; tiles are named by their sets.

    Frames hold whole shingles, sorted by size. A stretch ends where the next size is out of
    reach; equal lists of sets have equal names, whatever their shingle. Common shingles are
    dealt out evenly in place of by name: they name tiles themselves.
    """
    def run(batches):
        for frame in whole_groups(batches, ["deal"]):
            common = frame["common"].notna()
            if common.any():
                shared = frame.loc[common, ["common", "key", "n"]].rename(columns={"common": "tile"})
                yield shared.astype({"tile": np.int64}).drop_duplicates()
                frame = frame[~common]
            if not len(frame):
                continue
            shingle, key, n = (frame[c].to_numpy() for c in ("deal", "key", "n"))
            new = np.append(True, (shingle[1:] != shingle[:-1]) | (key[1:] != key[:-1]))
            shingle, key, n = shingle[new], key[new], n[new]
            cut = np.append(True, (shingle[1:] != shingle[:-1]) | (100 * n[:-1] < percent * n[1:]))
            starts = np.flatnonzero(cut)
            sizes = np.diff(np.append(starts, len(n)))
            name = mixed(np.add.reduceat(mixed(key.view(np.uint64)), starts))
            kept = np.repeat(sizes > 1, sizes)
            if kept.any():
                yield pd.DataFrame({"tile": np.repeat(name, sizes)[kept].view(np.int64), "key": key[kept],
                                    "n": n[kept]}).drop_duplicates()
    return run


def band(n: Column, percent: int) -> Column:
    """Bands a little wider than the reach of a size: sets that link lie in one band or two neighbours."""
    return F.floor(F.log(n) / F.lit(math.log(100 / percent) * 1.0001 + 1e-9)).cast("int")


def _pairs(percent: int, keys: list[str], labelled: bool):
    """Pairs (a, b) of the sets of a tile that their bitmaps allow."""
    def run(batches):
        for frame in whole_groups(batches, keys):
            starts = group_starts(frame, keys)
            tile = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            # Bitmaps of a tile are compared at the length of its shortest.
            sizes = np.array([len(m) // 8 for m in frame["bitmap"]])
            words = np.minimum.reduceat(sizes, starts[:-1])[tile]
            for length in np.unique(words).tolist():
                part = frame[words == length]
                label = part["label" if labelled else "node"].to_numpy()
                shared = (part["tile"].tolist(), [frozenset(x) for x in part["tiles"]]) if labelled else None
                yield from _allowed(percent, tile[words == length], part["node"].to_numpy(), part["n"].to_numpy(),
                                    part["home"].to_numpy(), label, folded(part["bitmap"].tolist(), length), shared)
    return run


def _allowed(percent, tile, node, n, home, label, maps, shared):
    """Compares every row with the next of its tile, then with the one after that, and so on.

    With ``shared``, the tiles' names and some tiles of each row, a pair is told in the first of
    those that both have; a pair without any is told wherever it is found.
    """
    everyone, left, right = np.arange(len(tile)), [], []
    for step in range(1, len(tile)):
        a = everyone[:-step][tile[:-step] == tile[step:]]
        if not len(a):
            break
        b = a + step
        # Visitors among each other meet in their own band.
        fits = (home[a] | home[b]) & (label[a] != label[b])
        fits &= 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
        a, b = a[fits], b[fits]
        for at in range(0, len(a), max(1, (1 << 20) // maps.shape[1])):
            x, y = (v[at:at + max(1, (1 << 20) // maps.shape[1])] for v in (a, b))
            differ = np.bitwise_count(maps[x] ^ maps[y]).sum(1, dtype=np.int64)
            total = n[x] + n[y]
            near = (100 + percent) * (total - differ) >= 2 * percent * total
            x, y = x[near], y[near]
            if shared:
                name, known = shared
                told = [name[i] == min(known[i] & known[j], default=name[i]) for i, j in zip(x.tolist(), y.tolist())]
                x, y = x[np.array(told, dtype=bool)], y[np.array(told, dtype=bool)]
            left.append(node[x])
            right.append(node[y])
        if sum(map(len, left)) > 1 << 18:
            yield _ordered(left, right)
            left, right = [], []
    if left:
        yield _ordered(left, right)


def _ordered(left, right) -> pd.DataFrame:
    a, b = np.concatenate(left), np.concatenate(right)
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _sets(batches):
    for batch in batches:
        sets = [shingle_set(t) for t in batch["text"]]
        same = np.array([xxhash.xxh3_128_digest(s.tobytes()) == k for s, k in zip(sets, batch["set_key"])])
        yield pd.DataFrame({"node": batch["node"][same], "shingles": [s.tobytes() for s, k in zip(sets, same) if k]})
    forget()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _linked(percent: int):
    """Pairs whose sets are similar enough, decided exactly."""
    def run(batches):
        for batch in batches:
            links = []
            for a, b, left, right in zip(batch["a"], batch["b"], batch["left"], batch["right"]):
                x, y = np.frombuffer(left, dtype=np.uint64), np.frombuffer(right, dtype=np.uint64)
                common = overlap(x, y)
                if 100 * common >= percent * (len(x) + len(y) - common):
                    links.append((a, b, common))
            yield pd.DataFrame(links, columns=["a", "b", "common"])
    return run


def classes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts of every text, shingles counted in batches), from rows of id, text and text_key."""
    told = materialize(map_pandas(rows, _facts, "id long, text_key long, n long, set_key binary, bitmap binary, "
                                                "shingle long, texts long"), "facts")
    return told.filter("n IS NOT NULL").drop("shingle", "texts"), told.filter("shingle IS NOT NULL").select("shingle", "texts")


def linked_sets(rows: DataFrame, classes: DataFrame, counted: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, common) between classes that leave out only what other links already join.

    ``rows`` has id and text, ``classes`` node, key, set_key, n and bitmap; see the module.
    """
    often = (counted.groupBy("shingle").agg(F.sum("texts").alias("texts")).filter(F.col("texts") >= OFTEN)
             .orderBy(F.desc("texts"), "shingle").limit(COMMON).select("shingle").collect())
    common = np.sort(np.array([r[0] for r in often], dtype=np.int64).view(np.uint64))

    heads = map_pandas(rows.select("text"), _heads(percent, common), "deal long, key long, n int, common long")
    heads = heads.repartition("deal").sortWithinPartitions("deal", "n", "key")
    tiles = map_pandas(heads, _runs(percent), "tile long, key long, n long")
    tiles = tiles.distinct().join(classes.select("key", "node", "n"), ["key", "n"]).drop("key")

    # Every set lies in its own band and visits the one above.
    places = F.explode(F.array(F.struct(F.lit(True).alias("home"), band(F.col("n"), percent).alias("band")),
                               F.struct(F.lit(False).alias("home"), (band(F.col("n"), percent) + 1).alias("band"))))
    placed = materialize(tiles.withColumn("place", places).select("tile", "place.band", "place.home", "node", "n"), "tiles")
    sizes = placed.groupBy(*TILE).agg(
        F.count("*").alias("size"), F.count(F.when(F.col("home"), 1)).alias("own"),
        *[F.min(F.when(F.col("home"), F.struct(F.xxhash64("node", F.lit(r)).alias("h"), "node"))).alias(f"s{r}")
          for r in range(STARS)]).filter("own > 0 AND size > 1")
    sizes = materialize(sizes.select(*TILE, "size", *[F.col(f"s{r}.node").alias(f"s{r}") for r in range(STARS)]), "sizes")
    small = sizes.filter(F.col("size") <= SMALL).select(*TILE)
    large = sizes.filter(F.col("size") > SMALL)
    signed = classes.select("node", "bitmap")

    met = placed.join(small, TILE).join(signed, "node")
    met = met.repartition(*TILE).sortWithinPartitions(*TILE)
    pairs = map_pandas(met.select(*TILE, "home", "node", "n", "bitmap"), _pairs(percent, TILE, False), "a long, b long")
    crowded = materialize(placed.join(large, TILE), "crowded")
    stars = crowded.select("node", F.explode(F.array(*[f"s{r}" for r in range(STARS)])).alias("star"))
    stars = stars.filter("node <> star").select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b"))
    pairs = materialize(pairs.unionByName(stars).distinct(), "pairs")

    nodes = (pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
             .unionByName(crowded.select("node")).distinct())
    texts = rows.join(classes.select("node", "set_key").join(nodes, "node"), F.col("id") == F.col("node"))
    sets = materialize(map_pandas(texts.select("node", "set_key", "text"), _sets, "node long, shingles binary"), "sets")
    if sets.count() > nodes.count():  # rows that repeat
        sets = materialize(sets.dropDuplicates(["node"]), "sets")

    def decide(some: DataFrame) -> DataFrame:
        left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
        right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
        return materialize(map_pandas(some.join(left, "a").join(right, "b").select("a", "b", "left", "right"),
                                      _linked(percent), "a long, b long, common long"), "links")

    links = decide(pairs)
    if not crowded.head(1):
        return links
    # Large tiles that are not yet one component: what is apart meets in blocks.
    roots = components(links).withColumnRenamed("root", "label")
    open_ = crowded.drop("size", *[f"s{r}" for r in range(STARS)]).join(roots, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    unsettled = open_.groupBy(*TILE).agg(F.min("label").alias("low"), F.max("label").alias("high"),
                                         F.count("*").alias("size")).filter("low < high").select(*TILE, "size")
    open_ = materialize(open_.join(unsettled, TILE).withColumn("id", F.col("node")), "unsettled")
    # Sets that meet in one tile of a band meet in all tiles that both have there.
    names = open_.groupBy("node", "band").agg(F.slice(F.sort_array(F.collect_set("tile")), 1, NAMED).alias("tiles"))
    open_ = open_.join(names, ["node", "band"]).join(signed, "node")
    keys = [*TILE, "first", "second"]
    dealt = in_blocks(open_, "size", BLOCK, "tile").repartition(*keys).sortWithinPartitions(*keys)
    rest = map_pandas(dealt.select(*keys, "home", "node", "n", "bitmap", "label", "tiles"), _pairs(percent, keys, True),
                      "a long, b long").distinct()
    return links.unionByName(decide(materialize(rest, "pairs")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, text_key) of every row.

    Two rows link when 100 x intersection >= percent x union of their sets of five-word shingles;
    ``component_id`` is the smallest id that links reach. Null and empty texts have an empty set
    and are linked with nothing, as are rows with a null id, whose component_id is null. Rows
    with equal sets are one node, named by their smallest id; rows that repeat an id are one node
    where they are named by it. ``text_key``, a hash of the text, tells rows with one id apart.
    Other columns are ignored, empty tables give no rows, texts are read whole.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), whole_text(text_col).alias("text"))
    facts, counted = classes_of(rows.withColumn("text_key", F.xxhash64("text")))
    classes = facts.filter("n > 0 AND id IS NOT NULL").groupBy("set_key").agg(
        F.min("id").alias("node"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    classes = materialize(classes.withColumn("key", little_endian("set_key")), "classes")
    joined = components(linked_sets(rows, classes, counted, percent).select("a", "b"))
    named = classes.select("set_key", "node").join(joined, "node", "left")
    named = materialize(named.select("set_key", F.coalesce("root", "node").alias("root")), "named")
    out = facts.select("id", "text_key", "n", "set_key").join(named, "set_key", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("root"))).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), "text_key")


def little_endian(column: str) -> Column:
    """The first eight bytes of a binary column as a 64-bit integer, as NumPy reads them."""
    digits = F.hex(F.substring(column, 1, 8))
    turned = F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(8)])
    return F.conv(turned, 16, -10).cast("long")
