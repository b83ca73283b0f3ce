"""A ledger of finished stages, so that a run that was interrupted goes on where it was.

A stage is known by its name, its key and a fingerprint of its settings and of all it is based on:
rows of tables, or the fingerprints of earlier stages. Its result is written aside and takes its
place by one rename, which is what makes it finished: half-written results are never found, and of
two runs that finish the same stage one takes the place and both read it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .jobstate import SettingsChanged


def content(rows: DataFrame) -> str:
    """Number of rows and sum of their hashes: equal for equal rows in any order."""
    n, total = rows.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*rows.columns).cast("decimal(38,0)"))).first()
    return f"{n}:{total or 0}:{','.join(rows.columns)}"


class Ledger:
    """Stages below ``folder``, which all nodes share.

    ``on_change`` says what happens where a stage is finished under another fingerprint: "refuse"
    stops with ``SettingsChanged``, "redo" computes it beside the old one. ``reused`` and
    ``computed`` list (stage, key) of this object's calls.
    """

    def __init__(self, spark: SparkSession, folder: str, on_change: str = "refuse"):
        if on_change not in ("refuse", "redo"):
            raise ValueError(f"on_change is refuse or redo, not {on_change}")
        self.spark, self.folder, self.on_change = spark, folder.rstrip("/"), on_change
        self.reused: list[tuple[str, str]] = []
        self.computed: list[tuple[str, str]] = []

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _listed(self, pattern: str) -> list[str]:
        files, path = self._path(pattern)
        return [s.getPath().toString() for s in files.globStatus(path) or []]

    @staticmethod
    def fingerprint(settings: Mapping[str, object], based_on: Sequence[str] = ()) -> str:
        """Digest of settings, whose values keep their types, and of what comes before."""
        text = json.dumps([settings, list(based_on)], default=repr, sort_keys=True)
        return hashlib.sha256(text.encode()).hexdigest()

    def stage(self, stage: str, key: str, settings: Mapping[str, object], compute: Callable[[], DataFrame],
              based_on: Sequence[str] = ()) -> DataFrame:
        """The result of a stage: read if it is finished, else computed and written."""
        mark = self.fingerprint(settings, based_on)
        place = f"{self.folder}/{quote(stage, safe='')}/{quote(key, safe='')}"
        done = {p.rsplit("/", 1)[1] for p in self._listed(f"{place.replace('%', '[%]')}/*")}
        if mark in done:
            self.reused.append((stage, key))
            return self.spark.read.parquet(f"{place}/{mark}")
        if done and self.on_change == "refuse":
            raise SettingsChanged(f"{stage}, {key}: finished with other settings or other rows")
        rows = compute()
        aside = f"{self.folder}/_open/{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        files, target = self._path(f"{place}/{mark}")
        files.mkdirs(target.getParent())
        source = self._path(aside)[1]
        if files.exists(target) or not files.rename(source, target):
            files.delete(source, True)  # another run was first
        self.computed.append((stage, key))
        return self.spark.read.schema(rows.schema).parquet(f"{place}/{mark}")

    def entries(self) -> DataFrame:
        """(stage, key, fingerprint) of all finished stages: a driver-sized list of runs."""
        parts = [p.rsplit("/", 3)[1:] for p in self._listed(f"{self.folder}/*/*/*")]
        rows = sorted((unquote(s), unquote(k), m) for s, k, m in parts if s != "_open")
        return self.spark.createDataFrame(rows, "stage string, key string, fingerprint string")
