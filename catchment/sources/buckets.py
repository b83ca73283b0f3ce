"""Tables bucketed by a key, in parts that are written one by one and read as one table.

All parts deal the key to the same number of buckets, so what groups or joins by that key reads
bucket after bucket and moves no rows, however many parts there are.
"""

from __future__ import annotations

import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

_tables: dict[str, list[str]] = {}
_lock = threading.Lock()


def _new_name(spark: SparkSession, name: str) -> str:
    """A name for the catalog that no other run has; see ``drop_tables``."""
    table = f"catchment_{name}_{uuid.uuid4().hex}"
    with _lock:
        _tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    return table


def drop_tables(spark: SparkSession) -> list[str]:
    """Forget the bucketed tables of this application; their files are the folder's."""
    with _lock:
        names = _tables.pop(spark.sparkContext.applicationId, [])
    for name in names:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    return names


def default_buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _save(df: DataFrame, key: str, buckets: int, table: str, path: str) -> None:
    (df.write.bucketBy(buckets, key).sortBy(key).format("parquet").option("path", path)
     .saveAsTable(table))


def bucketed(df: DataFrame, key: str, buckets: int | None = None, name: str = "rows") -> DataFrame:
    """``df`` written once, one file a bucket, and read back by buckets."""
    spark = df.sparkSession
    buckets = buckets or default_buckets(spark)
    table = _new_name(spark, name)
    _save(df.repartition(buckets, key), key, buckets, table, scratch_path(spark, name))
    return spark.table(table)


class BucketedParts:
    """A table of numbered parts with the same columns, each bucketed by ``key``.

    Parts may be written by several threads at once. Rows that come from a table bucketed alike
    are written where they lie, others are dealt to the buckets first (``deal``).
    """

    def __init__(self, spark: SparkSession, key: str, buckets: int | None = None,
                 part: str = "replicate", name: str = "cube"):
        self.spark, self.key, self.part, self.name = spark, key, part, name
        self.buckets = buckets or default_buckets(spark)
        self.path = scratch_path(spark, name)
        self._schema = None

    def write(self, number: int, rows: DataFrame, deal: bool = False) -> None:
        """Store the rows of one part. The column of the part's number is not among them."""
        rows = rows.repartition(self.buckets, self.key) if deal else rows
        table = _new_name(self.spark, f"{self.name}_part")
        _save(rows, self.key, self.buckets, table, f"{self.path}/{self.part}={number}")
        self.spark.sql(f"DROP TABLE {table}")  # the files stay
        self._schema = rows.schema

    def read(self) -> DataFrame:
        """All parts, with the part's number as the last column."""
        if self._schema is None:
            raise ValueError(f"no part of {self.name} was written")
        table = _new_name(self.spark, self.name)
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self._schema)
        self.spark.sql(
            f"CREATE TABLE {table} ({columns}, `{self.part}` INT) USING parquet "
            f"PARTITIONED BY (`{self.part}`) CLUSTERED BY (`{self.key}`) SORTED BY (`{self.key}`) "
            f"INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        self.spark.catalog.recoverPartitions(table)
        return self.spark.table(table)
