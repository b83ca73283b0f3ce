"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
HASH_SPACE = 1 << 31
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
STRUCT_CHARS = 2_000_000  # of the texts whose results go back together


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(f"`{column}`").cast("string"), F.lit(""))


def id_crc(column: str) -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(f"`{column}`").cast("string"), F.lit("")))


def reachable(spark: SparkSession) -> None:
    """Python workers can import this package wherever the driver was started.

    What goes to them in one batch is bounded in bytes where the session sets no bound itself, so
    that long texts come a few at a time.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, known) if p)


def release() -> None:
    """Give back to the system what a task has freed.

    One worker serves all stages of a run; else its allocators keep the most that any of them took.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def map_pandas(df: DataFrame, fn: Callable[[Iterator[pd.DataFrame]], Iterable[pd.DataFrame]],
               schema: str) -> DataFrame:
    """``mapInPandas`` without empty frames, whose columns would have no type.

    What the task has freed is given back at its end.
    """
    reachable(df.sparkSession)

    def run(batches):
        try:
            for frame in fn(batches):
                if len(frame):
                    yield frame
        finally:
            frame = None
            release()

    return df.mapInPandas(run, schema)


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with as many underscores behind as it takes to clash with no column."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_struct(df: DataFrame, name: str, fn: Callable[[list[str]], pd.DataFrame], text_col: str,
                schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """``df`` with a struct of what ``fn`` gives for batches of whole texts, as its last column.

    The struct has the first free of the names ``name``, ``name_`` and so on. All other columns stay; only the text goes to the Python workers. ``done``
    runs at the end of a task, to free what a worker would carry on to its next one.
    """
    reachable(df.sparkSession)

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        try:
            for batch in batches:
                texts = batch.tolist()
                for part in pieces(texts, STRUCT_CHARS):
                    yield fn(texts[part])
        finally:
            if done:
                done()
            batch = texts = None
            release()

    # A filter on the struct would else be evaluated apart, with a second Python worker for each task.
    return df.select("*", run.asNondeterministic()(whole_text(text_col)).alias(free_name(df.columns, name)))


def pieces(texts: Iterable[str], limit: int) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` characters; a longer text stands alone."""
    start = total = 0
    end = 0
    for end, text in enumerate(texts):
        if total and total + len(text) > limit:
            yield slice(start, end)
            start, total = end, 0
        total += len(text)
    if total or end >= start:
        yield slice(start, end + 1)


def bounded_sample(df: DataFrame, key: Column, bound: int) -> DataFrame:
    """About ``bound`` rows, chosen by the hash of ``key``: the same rows in any run.

    The share is the bound over the counted rows. Only classifiers are fitted on this.
    """
    n = df.count()
    if n <= bound:
        return df
    chosen = F.pmod(F.xxhash64(key), F.lit(HASH_SPACE)) < int(HASH_SPACE * bound / n)
    return at_most(df.filter(chosen), 2 * bound)


def at_most(df: DataFrame, bound: int) -> DataFrame:
    """``df``, or of more than ``bound`` rows the first by their hash: the same in any run.

    Samples by the hash of an id are longer than expected only where one id has many rows.
    """
    return df.orderBy(F.xxhash64(*df.columns), *df.columns).limit(bound)


def whole_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold only whole groups, from batches sorted by ``keys``.

    A group that runs over the end of a batch waits for the next one; its size is bounded by
    whoever formed the groups.
    """
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = batch[keys].iloc[-1]
        same = (batch[keys] == last).all(axis=1).to_numpy()
        if same.all() and (not rest or (rest[0][keys].iloc[0] == last).all()):
            rest.append(batch)
            continue
        cut = int(same.argmax())
        head = pd.concat([*rest, batch.iloc[:cut]], ignore_index=True) if rest else batch.iloc[:cut]
        if len(head):
            yield head
        rest = [batch.iloc[cut:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def group_starts(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group begins, and the number of rows."""
    changed = np.zeros(len(frame), dtype=bool)
    changed[:1] = True
    for key in keys:
        column = frame[key].to_numpy()
        changed[1:] |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(changed), len(frame))


def merge_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row number of the component of each of ``n`` rows under the links a - b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        label = new
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label
