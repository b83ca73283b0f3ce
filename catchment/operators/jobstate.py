"""Configuration fingerprints and job-state tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(settings: DataFrame, key: str, value: str,
                group: Sequence[str] = ()) -> DataFrame:
    """MD5 of the sorted ``key=value`` lines of a configuration.

    A configuration is a driver-sized settings table, a few dozen rows.
    """
    line = F.concat_ws("=", F.col(key), F.coalesce(F.col(value).cast("string"), F.lit("null")))
    return settings.groupBy(*group).agg(
        F.md5(F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("fingerprint"))


def changed_settings(old: DataFrame, new: DataFrame, keys: Sequence[str],
                     value: str) -> DataFrame:
    """Keys whose value differs, with both values; absent counts as NULL."""
    left = old.select(*keys, F.col(value).alias("old_value"))
    right = new.select(*keys, F.col(value).alias("new_value"))
    return (left.join(right, list(keys), "full")
            .where(~F.col("old_value").eqNullSafe(F.col("new_value"))))


def keep_last(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row per key; one running maximum per key, no sort.

    Rows with the same order value are told apart by their other columns, the largest wins.
    """
    others = [c for c in rows.columns if c not in keys and c != order]
    last = rows.groupBy(*keys).agg(F.max(F.struct(order, *others)).alias("__last"))
    return last.select(*keys, "__last.*").select(*rows.columns)


class SettingsChanged(RuntimeError):
    """A run was resumed with other settings than it began with."""


def finished(spark: SparkSession, path: str) -> DataFrame | None:
    """What a job has stored so far, None before its first append."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def same_settings(settings: DataFrame, path: str) -> None:
    """Store the settings (key, value) of a run, or stop if others are stored there."""
    old = finished(settings.sparkSession, path)
    if old is None:
        settings.write.parquet(path)
        return
    changed = changed_settings(old, settings, ["key"], "value").orderBy("key").collect()
    if changed:
        raise SettingsChanged("; ".join(f"{r.key}: {r.old_value} -> {r.new_value}" for r in changed))
