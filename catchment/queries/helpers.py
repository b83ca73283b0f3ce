"""Shaping of query results."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: int, columns: Iterable[str] | None = None) -> DataFrame:
    """Round floating columns, so that the order of summation does not show."""
    floats = {n for n, t in df.dtypes if t == "double"}
    chosen = floats if columns is None else set(columns) & floats
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if c in chosen else F.col(f"`{c}`")
                       for c in df.columns])
