"""Token counts through a digest cache.

A text is known by the digest of its content, a tokenizer by the digest of its file and its
library's version. Counts already stored for both are joined; only the distinct texts left
are encoded, and their counts are appended to the cache for later runs.
"""

from __future__ import annotations

import hashlib
import json
import os
import re

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import map_pandas, pieces, whole_text

CACHE_SCHEMA = "content string, version string, n_tokens long"
# Texts are cut only between a character that no engine calls white space and a blank
# followed by another such character: no pre-token of a byte-level pattern crosses that.
_EDGE = re.compile(r"(?<=[^\s\u180e\u200b\ufeff])(?= [^\s\u180e\u200b\ufeff])")
_ODD = re.compile(r"[\s\u180e\u200b\ufeff] | [\s\u180e\u200b\ufeff]|\A[\s\u180e\u200b\ufeff]|[\s\u180e\u200b\ufeff]\Z")
UNIT_CACHE = 400_000
BATCH_CHARS = 4_000_000


def tokenizer_version(path: str) -> str:
    """Digest of the vocabulary file and the library that reads it."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as file:
        content = file.read()
    name = f"{library.__name__} {library.__version__}"
    return hashlib.sha256(name.encode() + b"\0" + content).hexdigest()


class Counter:
    """Counts the tokens of texts; one per Python worker.

    Where the tokenizer is byte-level without a normaliser, a text is a sequence of units (a
    blank and what follows it) that are encoded independently, and the count of a unit is
    kept. The kept units are bounded by ``UNIT_CACHE``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.units: dict[str, int] = {}
        self.by_unit = False
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
            return
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        self.lengths = lambda texts: [
            len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        before = spec.get("pre_tokenizer") or {}
        self.by_unit = (
            spec.get("normalizer") is None and before.get("type") == "ByteLevel"
            and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not any(t.get("lstrip") or t.get("rstrip") or re.search(r"\s", t["content"])
                        for t in spec.get("added_tokens", [])))

    def units_of(self, text: str) -> list[str]:
        if _ODD.search(text):
            return _EDGE.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + r for r in rest]]

    def count(self, texts: list[str]) -> list[int]:
        if not self.by_unit:
            return self.lengths(texts)
        if len(self.units) > UNIT_CACHE:
            self.units = {}
        known = self.units
        split = [self.units_of(t) for t in texts]
        new = list({u for units in split for u in units if u not in known})
        for at in range(0, len(new), 20_000):
            part = new[at:at + 20_000]
            known.update(zip(part, self.lengths(part)))
        return [sum(map(known.__getitem__, units)) for units in split]


_COUNTERS: dict[str, Counter] = {}


def _encode(path: str, version: str):
    def run(batches):
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path)
        counter = _COUNTERS[path]
        for batch in batches:
            texts = batch["text"].tolist()
            counts: list[int] = []
            for part in pieces(texts, BATCH_CHARS):
                counts += counter.count(texts[part])
            yield pd.DataFrame({"content": batch["content"], "version": version,
                                "n_tokens": counts})
    return run


def read_cache(spark, cache: str) -> DataFrame | None:
    """The stored counts, or None before the first append."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def count_tokens(docs: DataFrame, cache: str, tokenizer: str, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row of ``docs``; new counts are appended to ``cache``.

    Normalised content is the text with null as empty: any other change would alter the
    count. Repeated rows each get their row; equal texts are encoded once. An empty table
    appends nothing. Columns other than the two named are ignored, whatever their names.
    ``cache`` is a folder all nodes share; two runs that append the same digest at a time
    store equal rows, of which a reader takes one.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), whole_text(text_col).alias("text"))
    keyed = keyed.withColumn("content", F.sha2("text", 256))

    distinct = keyed.groupBy("content").agg(F.first("text").alias("text"))
    stored = read_cache(spark, cache)
    if stored is not None:
        stored = (stored.filter(F.col("version") == version)
                  .groupBy("content").agg(F.first("n_tokens").alias("n_tokens")))
        distinct = distinct.join(stored, "content", "left_anti")
    new = materialize(map_pandas(distinct.select("content", "text"), _encode(tokenizer, version),
                                 CACHE_SCHEMA), "token-misses")
    new.write.mode("append").parquet(cache)

    counts = new.select("content", "n_tokens")
    if stored is not None:
        wanted = keyed.select("content").distinct()
        counts = materialize(
            counts.unionByName(stored.join(wanted, "content", "left_semi")), "token-counts")
    rows = keyed.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "content")
    return (rows.join(counts, "content")
            .select(F.col("id").alias(id_col), "n_bytes", "n_tokens"))
