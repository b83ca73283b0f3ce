"""Column checks, key checks and joins shared by the other operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

SMALL_ROWS = 100_000


class MissingColumns(ValueError):
    pass


def missing_columns(df: DataFrame, required: Iterable[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    """Return ``df`` or fail while the plan is built, before any job runs."""
    missing = missing_columns(df, required)
    if missing:
        raise MissingColumns(f"{what} is missing columns {missing}")
    return df


def available(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; empty means the key is unique."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def nulls_for_nans(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, once, right after reading."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    return df.select(*[F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in floating
                       else F.col(c) for c in df.columns])


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str],
                   how: str = "inner") -> DataFrame:
    """Equi join in which NULL keys match each other; the keys appear once."""
    if not keys:
        raise ValueError("a join needs at least one key")
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c)
                             for c in right.columns])
    condition = [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys]
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in keys])


def small_side(groups: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """A table of one row per group, broadcast if it was counted to be small.

    It is written first, so the rows it sums up are not read again. Beyond ``limit`` rows the
    join is left to adaptive execution, which splits hot groups.
    """
    stored = materialize(groups, "groups")
    return F.broadcast(stored) if stored.count() <= limit else stored


def lookup(df: DataFrame, table: DataFrame, key: str, table_key: str,
           values: Sequence[str], default: str | None = None) -> DataFrame:
    """Left join of values by key, with a default where the key is unknown."""
    side = table.select(F.col(table_key).alias("__k"), *[F.col(v).alias(f"__v_{v}") for v in values])
    joined = df.join(side, F.col(key) == F.col("__k"), "left")
    out = [F.coalesce(F.col(f"__v_{v}"), F.lit(default)) if default is not None
           else F.col(f"__v_{v}") for v in values]
    return joined.select(*[F.col(c) for c in df.columns],
                         *[c.alias(v) for c, v in zip(out, values)])


def unmatched(df: DataFrame, table: DataFrame, key: str, table_key: str) -> DataFrame:
    """Distinct keys of ``df`` absent from the table."""
    return (df.select(F.col(key)).where(F.col(key).isNotNull()).distinct()
            .join(table, F.col(key) == F.col(table_key), "left_anti"))


def replace_names(df: DataFrame, aliases: DataFrame, column: str,
                  alias: str = "alias", name: str = "name") -> DataFrame:
    """Harmonise spellings; names without an alias pass through."""
    side = aliases.select(F.col(alias).alias("__a"), F.col(name).alias("__n"))
    joined = df.join(side, F.col(column) == F.col("__a"), "left")
    return joined.select(*[F.coalesce(F.col("__n"), F.col(column)).alias(column)
                           if c == column else F.col(c) for c in df.columns])
