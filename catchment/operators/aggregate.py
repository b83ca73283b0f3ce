"""Grouped sums, weighted means, roll-ups and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..session import materialize
from .frames import all_of


def sum_or_zero(value: Column) -> Column:
    return F.coalesce(F.sum(value), F.lit(0.0))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean over rows with a value and a positive weight; NULL when there are none."""
    usable = value.isNotNull() & (weight > 0)
    return F.try_divide(F.sum(F.when(usable, value * weight)), F.sum(F.when(usable, weight)))


def normalised_weight_mean(value: Column, weight: Column) -> Column:
    """Mean weighted by size; falls to the plain mean where the sizes add up to nothing."""
    size = F.coalesce(weight, F.lit(1.0))
    usable = value.isNotNull()
    total = F.sum(size)
    kept = F.sum(F.when(usable, size))
    return (F.when((total > 0) & (kept > 0),
                   F.try_divide(F.sum(F.when(usable, value * size)), kept))
            .when(total <= 0, F.avg(value)))


def first_value(column: str, order: str) -> Column:
    """First non-null value in row order, independent of partitioning."""
    return F.min(F.when(F.col(column).isNotNull(),
                        F.struct(F.col(order).alias("o"), F.col(column).alias("v"))))["v"]


def grouped_sums(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums per group; an all-missing group is 0 and rows with a missing key are dropped."""
    return (df.where(all_of(F.col(k).isNotNull() for k in keys))
            .groupBy(*keys).agg(*[sum_or_zero(F.col(c)).alias(c) for c in sums]))


def rollup(df: DataFrame, keys: Sequence[str], sums: Sequence[str], means: Sequence[str] = (),
           weight: str | None = None, attributes: Sequence[str] = (),
           order: str | None = None) -> DataFrame:
    """One level: sums, weighted means and first attributes in a single aggregation."""
    return (df.where(all_of(F.col(k).isNotNull() for k in keys))
            .groupBy(*keys).agg(
                *[sum_or_zero(F.col(c)).alias(c) for c in sums],
                *[weighted_mean(F.col(c), F.col(weight)).alias(c) for c in means],
                *[first_value(c, order).alias(c) for c in attributes if c not in keys]))


def rollup_levels(df: DataFrame, levels: Mapping[str, Sequence[str]], sums: Sequence[str],
                  means: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """Every level at once.

    The input is reduced to the finest keys first; grouping sets then run on that
    small table, so the big one is shuffled once and never expanded.
    """
    finest = list(dict.fromkeys(k for keys in levels.values() for k in keys))
    usable = {c: F.col(c).isNotNull() & (F.col(weight) > 0) for c in means}
    parts = df.groupBy(*finest).agg(
        *[F.sum(c).alias(c) for c in sums],
        *[F.sum(F.when(usable[c], F.col(c) * F.col(weight))).alias(f"__num_{c}") for c in means],
        *[F.sum(F.when(usable[c], F.col(weight))).alias(f"__den_{c}") for c in means])

    grouped = parts.groupingSets([[F.col(k) for k in keys] for keys in levels.values()],
                                 *[F.col(k) for k in finest])
    rolled = grouped.agg(
        *[sum_or_zero(F.col(c)).alias(c) for c in sums],
        *[F.try_divide(F.sum(f"__num_{c}"), F.sum(f"__den_{c}")).alias(c) for c in means],
        *[F.grouping(k).alias(f"__g_{k}") for k in finest])

    def is_level(keys: Sequence[str]) -> Column:
        return all_of(F.col(f"__g_{k}") == (0 if k in keys else 1) for k in finest)

    name = reduce(lambda acc, item: acc.when(is_level(item[1]), F.lit(item[0])),
                  list(levels.items())[1:],
                  F.when(is_level(next(iter(levels.values()))), F.lit(next(iter(levels)))))
    present = all_of((F.col(f"__g_{k}") == 1) | F.col(k).isNotNull() for k in finest)
    return rolled.where(present).select(name.alias("level"), *finest, *sums, *means)


def add_global_share(df: DataFrame, columns: Sequence[str], suffix: str = "_GlobalShare_pct",
                     stored: bool = False) -> DataFrame:
    """Percentage of the overall total; NULL when the total is not positive.

    The totals are a scalar subquery, so no window pulls all rows into one task. The
    table, normally a roll-up, is written once unless it is ``stored`` already:
    otherwise the totals would run the whole roll-up a second time.
    """
    df = df if stored else materialize(df, "shares")
    totals = df.agg(F.struct(*[F.sum(c).alias(c) for c in columns]).alias("t")).scalar()
    shares = df.withColumn("__t", totals)
    return shares.select(*df.columns, *[
        ratio(F.col(c) * 100, F.col(f"__t.{c}")).alias(f"{c}{suffix}") for c in columns])


def scale_columns(df: DataFrame, columns: Sequence[str], divisor: float) -> DataFrame:
    """Unit conversion of the listed columns that exist."""
    return df.select(*[(F.col(c) / divisor).alias(c) if c in columns else F.col(c)
                       for c in df.columns])


def lead_columns(df: DataFrame, lead: Sequence[str]) -> DataFrame:
    """Listed columns first where present, the others after them in their order."""
    return df.select(*[c for c in lead if c in df.columns],
                     *[c for c in df.columns if c not in lead])


def several_values(df: DataFrame, key: str, attributes: Sequence[str]) -> DataFrame:
    """Keys for which an attribute takes more than one value."""
    distinct = df.groupBy(key).agg(*[F.countDistinct(c).alias(c) for c in attributes])
    return distinct.where(reduce(lambda a, b: a | b, [F.col(c) > 1 for c in attributes]))


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: missing rows, rows, share filled (percent)."""
    counted = df.agg(F.count(F.lit(1)).alias("n"),
                     *[F.count(F.col(c)).alias(c) for c in columns])
    return (counted.unpivot(["n"], list(columns), "column_name", "filled")
            .select("column_name", (F.col("n") - F.col("filled")).alias("n_missing"),
                    F.col("n").alias("n_rows"),
                    ratio(F.col("filled") * 100.0, F.col("n")).alias("filled_pct")))


def pivot_sums(df: DataFrame, key: str, column: str, values: Sequence[str], measure: str,
               total: str) -> DataFrame:
    """Sums by a fixed list of column values, and their total.

    A combination without rows is NULL, one with only missing values is 0; the
    total needs at least one non-null part.
    """
    cells = [F.when(F.count(F.when(F.col(column) == v, 1)) > 0,
                    sum_or_zero(F.when(F.col(column) == v, F.col(measure)))).alias(v)
             for v in values]
    table = (df.where(F.col(key).isNotNull() & F.col(column).isNotNull())
             .groupBy(key).agg(*cells))
    any_part = reduce(lambda a, b: a | b, [F.col(v).isNotNull() for v in values])
    parts = reduce(lambda a, b: a + b, [F.coalesce(F.col(v), F.lit(0.0)) for v in values])
    return table.withColumn(total, F.when(any_part, parts))


def positive_share(df: DataFrame, keys: Sequence[str], label: str, positive: str,
                   weight: str, out: str, weight_out: str) -> DataFrame:
    """Share of the weight that carries the positive label; 0 without any weight."""
    size = F.coalesce(F.col(weight).try_cast("double"), F.lit(0.0))
    return (df.where(all_of(F.col(k).isNotNull() & (F.col(k) != "nan") for k in keys))
            .groupBy(*keys).agg(
                ratio(F.sum(F.when(F.col(label) == positive, size).otherwise(0.0)),
                      F.sum(size), 0.0).alias(out),
                F.sum(size).alias(weight_out)))


def intensity(df: DataFrame, keys: Sequence[str], measure: str, weight: str, out: str,
              weight_out: str) -> DataFrame:
    """Measure per unit of weight; 0 without any weight."""
    size = F.coalesce(F.col(weight).try_cast("double"), F.lit(0.0))
    amount = F.coalesce(F.col(measure).try_cast("double"), F.lit(0.0))
    return (df.where(all_of(F.col(k).isNotNull() & (F.col(k) != "nan") for k in keys))
            .groupBy(*keys).agg(ratio(F.sum(amount), F.sum(size), 0.0).alias(out),
                                F.sum(size).alias(weight_out)))


def merge_regions(left: DataFrame, right: DataFrame, keys: Sequence[str],
                  weight: str) -> DataFrame:
    """Full outer join in which the shared measure becomes the larger of the two."""
    joined = (left.withColumnRenamed(weight, "__l")
              .join(right.withColumnRenamed(weight, "__r"), list(keys), "full"))
    return joined.withColumn(weight, F.greatest("__l", "__r")).drop("__l", "__r")


def class_summary(df: DataFrame, key: str, label: str, positive: str,
                  population: str) -> DataFrame:
    """Facilities, positive ones and both rates per country, rounded half-even.

    Sums are rounded to four digits first, so that the order of summation cannot
    decide a tie.
    """
    is_positive = F.col(label) == positive
    counted = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("Total_Facilities"),
        F.count(F.when(is_positive, 1)).alias("Positive_Count"),
        sum_or_zero(F.col(population)).alias("__pop"),
        sum_or_zero(F.when(is_positive, F.col(population))).alias("__pos"))
    return counted.select(
        key, "Total_Facilities", "Positive_Count",
        F.bround(F.col("Positive_Count") * 100.0 / F.col("Total_Facilities"), 1)
        .alias("Rate_Count_pct"),
        F.bround(F.round("__pop", 4), 0).alias("Total_Pop"),
        F.bround(F.round("__pos", 4), 0).alias("Positive_Pop"),
        F.bround(ratio(F.col("__pos") * 100, F.col("__pop"), 0.0), 1).alias("Rate_Pop_pct"))


def weighted_rate(df: DataFrame, keys: Sequence[str],
                  rates: Mapping[str, str]) -> DataFrame:
    """Load-weighted rate per group for ``{rate: load}``; 0 where the load is not positive."""
    loads = list(dict.fromkeys(rates.values()))
    return df.groupBy(*keys).agg(
        *[ratio(F.sum(F.col(r) * F.col(w)), F.sum(F.col(w)), 0.0).alias(r)
          for r, w in rates.items()],
        *[sum_or_zero(F.col(w)).alias(f"{w}_Total") for w in loads])
