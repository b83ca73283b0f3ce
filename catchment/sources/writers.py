"""Sinks: tables, sets of tables, CSV, bucketed output, upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from .commitlog import BucketLog


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> str:
    df.write.mode("overwrite").format(fmt).save(path)
    return path


def write_tables(tables: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> str:
    """Several named tables below one folder."""
    for name, df in tables.items():
        write_table(df, f"{folder}/{name}.{fmt}", fmt)
    return folder


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_buckets(df: DataFrame, path: str, by: Sequence[str], replace_all: bool = True) -> str:
    """One directory per bucket; stale buckets go, or only the written ones are replaced."""
    mode = "static" if replace_all else "dynamic"
    (df.write.mode("overwrite").option("partitionOverwriteMode", mode)
     .partitionBy(*by).parquet(path))
    return path


def latest_version(spark: SparkSession, path: str) -> int | None:
    """The newest version of a table that ``upsert`` or ``replace_buckets`` wrote."""
    return BucketLog(spark, path).version()


def read_versioned(spark: SparkSession, path: str) -> DataFrame | None:
    return BucketLog(spark, path).read()


def upsert(new: DataFrame, path: str, keys: Sequence[str], order: str, buckets: int = 64) -> int:
    """Add rows, keep the last one per key, and publish the result as a new version.

    Only buckets that hold new keys are rewritten. A job that dies half-way leaves the previous
    version in place; of two that change the same buckets at once, one gets ``Conflict``.
    """
    return BucketLog(new.sparkSession, path).prepare_upsert(new, keys, order, buckets).publish()


def replace_buckets(df: DataFrame, path: str, by: Sequence[str], replace_all: bool = True) -> int:
    """``write_buckets`` for readers and writers at the same time: a new version by the values of ``by``."""
    return BucketLog(df.sparkSession, path).prepare_replace(df, by, replace_all).publish()
