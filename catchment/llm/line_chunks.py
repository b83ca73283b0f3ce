"""Removal of passages that repeat across the corpus, by content-defined line chunks.

Line hashes, and a rolling hash over pairs of them, choose where a text is cut, so that a
passage is cut alike wherever it stands, whatever lines come before it. Chunks are counted
over the whole corpus; of those that repeat, the bytes are compared. A passage is a sequence
of repeated chunks with enough words. It is named by a 128-bit digest of its chunks and goes
wherever the same sequence stands earlier; its first copy stays.
Blank lines are no chunks: a passage goes on over them,
and those inside it go with it.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_name, map_pandas, whole_groups, whole_text

MIN_WORDS = 50  # of a passage
KEEP = 8  # one in so many lines does not end (or begin) a chunk by its own hash
ROLL = np.uint64(0x9E3779B97F4A7C15)
BATCH = 2000
COLUMNS = ("place", "hash", "a", "b", "words")


def cuts(hashes: np.ndarray) -> list[int]:
    """First lines of the chunks, and the number of lines.

    Between two lines there is a boundary if the line before ends a chunk by its hash, or the
    line behind begins one, or the rolling hash over both says so: the first two depend on one
    line alone, hence the edges of a passage are found whatever surrounds it.
    """
    if len(hashes) < 2:
        return [0, len(hashes)]
    before, behind = hashes[:-1], hashes[1:]
    rolled = before * ROLL + behind
    keep = np.uint64(KEEP)
    cut = ((before >> np.uint64(40)) % keep != 0) | ((behind >> np.uint64(20)) % keep != 0) | (
        (rolled >> np.uint64(30)) % np.uint64(2) == 0)
    return [0, *(np.flatnonzero(cut) + 1).tolist(), len(hashes)]


def chunks(text: str) -> list[tuple[int, int, int, str]]:
    """(first line, end, hash, text) of the chunks of a text.

    Lines of white space belong to no chunk: the others are cut as if these were not there.
    """
    lines = [(n, x) for n, x in enumerate(text.split("\n")) if x and not x.isspace()]
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for _, x in lines),
                         dtype=np.uint64, count=len(lines))
    at = cuts(hashes) if lines else []
    out = []
    for a, b in zip(at, at[1:]):
        content = lines[a][1] if b == a + 1 else "\n".join(x for _, x in lines[a:b])
        out.append((lines[a][0], lines[b - 1][0] + 1,
                    xxhash.xxh3_64_intdigest(content.encode("utf-8", "surrogatepass"), seed=1), content))
    return out


def _rows(with_text: bool):
    """Chunks, with their text or with their places."""
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), BATCH):
                part = batch.iloc[at:at + BATCH]
                out, content, source = [], [], []
                for k, text in enumerate(part["text"].tolist()):
                    for n, (a, b, h, words) in enumerate(chunks(text)):
                        out.append((n, h, a, b, 0 if with_text else len(words.split())))
                        content.append(words)
                        source.append(k)
                columns = list(zip(*out)) if out else [()] * len(COLUMNS)
                kinds = (np.int32, np.uint64, np.int32, np.int32, np.int32)
                frame = {c: np.array(v, dtype=k) for c, v, k in zip(COLUMNS, columns, kinds)}
                frame["hash"] = frame["hash"].view(np.int64)
                if with_text:
                    frame = {"hash": frame["hash"], "content": content}
                else:
                    frame |= {c: part[c].to_numpy()[np.array(source, dtype=int)] for c in ("none", "id", "row")}
                yield pd.DataFrame(frame)
    return run


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(hash) of the chunks found twice or more in ``docs`` (row, text).

    Copies of a chunk are combined before the shuffle. Chunks with one hash but different
    bytes do not count as repeated.
    """
    rows = map_pandas(docs.select("row", "text"), _rows(True), "hash long, content string")
    groups = rows.groupBy("hash").agg(
        F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    return groups.filter("n > 1 AND low <=> high").select("hash")


def shortest(words: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """The shortest sequences (first, end) of ``min_words`` or more from each first and to each last chunk.

    Any sequence of so many words is covered by those that lie within it.
    """
    total = np.concatenate([[0], np.cumsum(words)])
    every = np.arange(len(words))
    end = np.searchsorted(total, total[:-1] + min_words)
    first = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    out = {*zip(every[end <= len(words)].tolist(), end[end <= len(words)].tolist())}
    out.update(zip(first[first >= 0].tolist(), (every[first >= 0] + 1).tolist()))
    return sorted(out)


def _passages(min_words: int):
    """Passages of each row's repeated chunks: the shortest sequences, named by a digest.

    ``before`` is the end of the chunk in front; ``again`` says that the row has had the passage.
    """
    def run(batches):
        for frame in whole_groups(batches, ["row"]):
            place, hashes = frame["place"].to_numpy(), frame["hash"].to_numpy()
            a, b, words = frame["a"].to_numpy(), frame["b"].to_numpy(), frame["words"].to_numpy()
            cut = np.append(True, (place[1:] != place[:-1] + 1)
                            | (frame["row"].to_numpy()[1:] != frame["row"].to_numpy()[:-1]))
            at = np.append(np.flatnonzero(cut), len(frame))
            out, had, row = [], set(), None
            rows = frame["row"].to_numpy()
            for s, e in zip(at, at[1:]):
                if rows[s] != row:
                    row, had = rows[s], set()
                if words[s:e].sum() < min_words:
                    continue
                for x, y in shortest(words[s:e], min_words):
                    x, y = s + x, s + y
                    name = hashlib.blake2b(hashes[x:y].tobytes(), digest_size=16).digest()
                    out.append((name, x, y - 1, name in had))
                    had.add(name)
            if not out:
                continue
            names, first, last, again = (list(v) for v in zip(*out))
            first, last = np.array(first), np.array(last)
            front = np.where(place == 0, 0, np.append(0, b[:-1]))
            front = np.where(cut & (place > 0), a, front)  # the chunk in front does not repeat
            yield pd.DataFrame({
                "digest": names, "none": frame["none"].to_numpy()[first], "id": frame["id"].to_numpy()[first],
                "row": rows[first], "a": a[first], "before": front[first], "b": b[last],
                "again": again})
    return run


PASSAGES = "digest binary, none boolean, id long, row long, a int, before int, b int, again boolean"


def removable(docs: DataFrame, min_words: int) -> DataFrame:
    """(row, ranges): the ranges of lines that each row of ``docs`` (id, row, text) loses.

    A passage goes unless its row is the first in the order to hold it; there only its repeats
    further down go. Of a text that repeats within fewer words than a passage has, the first
    period stays.
    """
    found = materialize(repeated_chunks(docs), "chunks")
    named = docs.select(F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), "row", "text")
    places = map_pandas(named, _rows(False), "none boolean, id long, row long, place int, hash long, a int, b int, "
                                             "words int")
    # What repeats grows with the corpus, hence none of it is broadcast.
    hits = places.hint("merge").join(found, "hash").distinct()
    hits = hits.repartition("row").sortWithinPartitions("row", "place")
    passages = materialize(map_pandas(hits, _passages(min_words), PASSAGES), "passages")

    first = (passages.groupBy("digest").agg(F.min(F.struct("none", "id", "row")).alias("first"))
             .select("digest", "first.row", F.lit(True).alias("is_first")))
    gone = passages.hint("merge").join(first, ["digest", "row"], "left").filter("is_first IS NULL OR again")
    gone = gone.groupBy("row", "a", "before").agg(F.max("b").alias("b"))
    # Passages that overlap, or with nothing but blank lines between them, are one range.
    line = Window.partitionBy("row").orderBy("a")
    reached = F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1))
    part = F.sum(F.when(reached >= F.col("before"), 0).otherwise(1)).over(line)
    ranges = gone.withColumn("part", part).groupBy("row", "part").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return ranges.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("ranges"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, and last ``__lines``: n_lines, n_removed, removed.

    Where ``docs`` has such a column, underscores are put behind the name.

    ``removed`` lists the removed ranges of lines, ``first:end``, comma joined. The first of a
    repeated passage is the one with the smallest id, then the smallest hash of its row, then the
    first in the text; a null id comes last. Rows that repeat both id and text are one row to
    this operator and are rewritten alike. Null texts stay null, empty ones empty, both with no
    lines. All other columns are carried along, whatever their names. Repeats inside one text
    count. An empty table stays empty.
    """
    own = [f"__c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, own))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, own)])
    keyed = rows.select("*", F.col(at[id_col]).cast("long").alias("id"), whole_text(at[text_col]).alias("text"))
    keyed = keyed.withColumn("row", F.xxhash64("id", "text"))

    ranges = materialize(removable(keyed.select("id", "row", "text"), min_words), "ranges")
    out = keyed.hint("merge").join(ranges, "row", "left")
    lines = F.split("text", "\n", -1)
    left = F.filter(lines, lambda x, i: ~F.exists("ranges", lambda r: (r["a"] <= i) & (i < r["b"])))
    text = F.when(F.col("ranges").isNull(), F.col(at[text_col])).otherwise(F.array_join(left, "\n"))
    n_lines = F.when(F.length("text") == 0, 0).otherwise(F.regexp_count("text", F.lit("\n")) + 1)
    n_removed = F.aggregate(F.coalesce("ranges", F.array()), F.lit(0), lambda n, r: n + r["b"] - r["a"])
    removed = F.array_join(F.transform("ranges", lambda r: F.concat_ws(":", r["a"], r["b"])), ",")
    return out.select(
        *[(text if n == at[text_col] else F.col(n)).alias(c) for c, n in zip(docs.columns, own)],
        F.struct(n_lines.cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"),
                 F.coalesce(removed, F.lit("")).alias("removed")).alias(free_name(docs.columns, "__lines")))
