"""Tables of buckets under a log of versions: only touched buckets are rewritten.

A version is a small manifest that names, for every bucket, the folder of its live rows. Writers
prepare their folders beside those of others and take the next version by putting the manifest in
its place, which succeeds for one of them only. Readers see a whole version or the one before.
Folders of older versions stay readable until they are deleted by hand.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.jobstate import keep_last
from .readers import union_all

WRITE, BUCKET = "__write", "__bucket"


class Conflict(RuntimeError):
    """Another writer changed the same buckets first."""


@dataclass(frozen=True)
class Change:
    """Written rows that no version names yet: touched buckets with their folders, None for an emptied one."""

    log: BucketLog
    base: int | None
    folders: Mapping[str, str | None]
    by: tuple[str, ...]
    schema: StructType
    whole: bool = False

    def publish(self) -> int:
        """Take the next version, or raise ``Conflict``.

        Versions that came up since ``base`` are kept if they touched other buckets only; a change
        of the whole table gives way to any of them.
        """
        seen = self.log.manifest(self.base)
        version = self.base
        while True:
            now = self.log.manifest(version)
            if version != self.base:
                if self.whole or now["by"] != list(self.by) or any(
                        now["folders"].get(b) != seen["folders"].get(b) for b in self.folders):
                    raise Conflict(f"{self.log.path}: version {version} changed the same buckets")
            folders = {} if self.whole else dict(now["folders"])
            folders.update(self.folders)
            known = StructType.fromJson(now["schema"]) if now["schema"] and not self.whole else StructType([])
            names = {f.name for f in self.schema}
            schema = StructType([*self.schema, *[f for f in known if f.name not in names]])
            text = json.dumps({"by": list(self.by), "schema": schema.jsonValue(),
                               "folders": {b: f for b, f in folders.items() if f}})
            following = 0 if version is None else version + 1
            if self.log.place(following, text):
                return following
            version = self.log.version()


class BucketLog:
    """A table below ``path``: rows in ``data``, one manifest a version in ``log``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _files(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _listed(self, pattern: str) -> list[str]:
        files, path = self._files(pattern)
        return [s.getPath().toString() for s in files.globStatus(path) or []]

    def version(self) -> int | None:
        """The newest version, None before the first."""
        return max((int(p.rsplit("/", 1)[1][:-5]) for p in self._listed(f"{self.path}/log/*.json")), default=None)

    def manifest(self, version: int | None) -> dict:
        if version is None:
            return {"by": [], "schema": None, "folders": {}}
        return json.loads(self.spark.read.text(f"{self.path}/log/{version:012d}.json", wholetext=True).first()[0])

    def place(self, version: int, text: str) -> bool:
        """Put a manifest in its place unless one is there; it is complete once it has its name.

        A rename to a name that exists is refused by distributed file systems; a local one would
        overwrite, so there the name is made by a link.
        """
        files, aside = self._files(f"{self.path}/log/_open-{uuid.uuid4().hex}")
        target = self._files(f"{self.path}/log/{version:012d}.json")[1]
        stream = files.create(aside, False)
        stream.write(text.encode())
        stream.close()
        if files.getScheme() != "file":
            done = files.rename(aside, target)
        else:
            paths = self.spark._jvm.java.nio.file.Paths
            here, there = (paths.get(p.toUri().getPath(), self.spark.sparkContext._gateway.new_array(
                self.spark._jvm.java.lang.String, 0)) for p in (aside, target))
            try:
                self.spark._jvm.java.nio.file.Files.createLink(there, here)
                done = True
            except Py4JJavaError as e:
                if "FileAlreadyExistsException" not in str(e):
                    raise
                done = False
        files.delete(aside, False)
        return done

    def read(self, version: int | None = None, buckets: Sequence[str] | None = None) -> DataFrame | None:
        """The rows of a version, the newest by default, or of some of its buckets; None if there is none."""
        version = self.version() if version is None else version
        if version is None:
            return None
        found = self.manifest(version)
        schema = StructType.fromJson(found["schema"])
        folders = [f for b, f in found["folders"].items() if buckets is None or b in buckets]
        hidden = [WRITE, *[c for c in found["by"] if c not in schema.names]]
        if not folders:
            return self.spark.createDataFrame([], schema)
        full = StructType(list(schema))
        for c in hidden:
            full = full.add(c, "string" if c == WRITE else "integer")
        return (self.spark.read.schema(full).option("basePath", f"{self.path}/data")
                .parquet(*[f"{self.path}/data/{f}" for f in folders]).select(*schema.names))

    def _write(self, rows: DataFrame, by: Sequence[str]) -> dict[str, str]:
        """Rows by buckets in a new folder: (bucket, its folder)."""
        write = f"{WRITE}={uuid.uuid4().hex}"
        rows.write.partitionBy(*by).parquet(f"{self.path}/data/{write}")
        root = f"/data/{write}/"
        found = self._listed(f"{self.path}/data/{write}/" + "/".join(["*=*"] * len(by)))
        return {p.split(root, 1)[1]: f"{write}/{p.split(root, 1)[1]}" for p in found}

    def prepare_upsert(self, new: DataFrame, keys: Sequence[str], order: str, buckets: int = 64) -> Change:
        """Add rows and keep the last one per key, in the buckets of the new keys only.

        The number of buckets is that of the first version; later calls ask for the same. A bucket
        is one task's work: choose as many as make it fit.
        """
        base = self.version()
        had = self.manifest(base)
        label = f"{BUCKET}{buckets}"
        if base is not None and had["by"] != [label]:
            raise ValueError(f"{self.path} lies in {had['by']}, not in {label}")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias(label)
        last = keep_last(new, keys, order)
        touched = [f"{label}={r[0]}" for r in last.select(bucket).distinct().collect()]
        old = None if base is None else self.read(base, touched)
        rows = last if old is None else keep_last(union_all([old, last]), keys, order)
        folders = self._write(rows.select("*", bucket).repartition(label), [label]) if touched else {}
        return Change(self, base, folders, (label,), rows.schema)

    def prepare_replace(self, rows: DataFrame, by: Sequence[str], whole: bool = False) -> Change:
        """The buckets that ``rows`` have, by the values of ``by``, in place of the old ones; with
        ``whole`` all other buckets go."""
        base = self.version()
        by_before = self.manifest(base)["by"]
        if base is not None and not whole and by_before != list(by):
            raise ValueError(f"{self.path} lies in {by_before}, not in {list(by)}")
        return Change(self, base, self._write(rows, by), tuple(by), rows.schema, whole)
