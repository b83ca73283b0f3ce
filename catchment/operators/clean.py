"""Outlier cleaning, ratio normalisation and training-table preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_f_scale
from .frames import join_null_safe, small_side
from .ranking import exact_quantiles, value_ranks

# IQR rule and the lower bound of normalising ratios.
IQR_K = 1.5
MIN_GROUP = 4
RATIO_FLOOR = 0.10


def iqr_bounds(df: DataFrame, group: str, value: str, k: float = IQR_K,
               min_n: int = MIN_GROUP) -> DataFrame:
    """Method, quartiles and bounds per group; bounds are NULL where nothing is removed."""
    quartiles = exact_quantiles(df.where(F.col(group).isNotNull()), [group], value,
                                {"q1": 0.25, "q3": 0.75})
    spread = F.col("q3") - F.col("q1")
    # The names of the methods are part of the audit.
    method = (F.when(F.col("n") < min_n, "insufficient_data")
              .when(spread == 0, "iqr_zero_skipped").otherwise("IQR"))
    enough, active = F.col("method") != "insufficient_data", F.col("method") == "IQR"
    return (quartiles.withColumn("method", method).withColumn("iqr", spread)
            .select(group, "method",
                    F.when(enough, F.col("q1")).alias("q1"),
                    F.when(enough, F.col("q3")).alias("q3"),
                    F.when(enough, F.col("iqr")).alias("iqr"),
                    F.when(active, F.col("q1") - k * F.col("iqr")).alias("lower"),
                    F.when(active, F.col("q3") + k * F.col("iqr")).alias("upper")))


def _flagged(df: DataFrame, group: str, value: str, bounds: DataFrame) -> DataFrame:
    outside = (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))
    return (df.where(F.col(value).isNotNull()).join(small_side(bounds), group)
            .withColumn("__out", F.coalesce(outside, F.lit(False))))


def iqr_clean(df: DataFrame, group: str, value: str, k: float = IQR_K,
              min_n: int = MIN_GROUP) -> DataFrame:
    """Rows inside their group's bounds; missing groups and values are dropped."""
    bounds = iqr_bounds(df, group, value, k, min_n)
    return _flagged(df, group, value, bounds).where(~F.col("__out")).select(*df.columns)


def iqr_audit(df: DataFrame, group: str, value: str, k: float = IQR_K,
              min_n: int = MIN_GROUP) -> DataFrame:
    """One row per group: method, bounds, removed rows, means before and after."""
    bounds = iqr_bounds(df, group, value, k, min_n)
    facts = ["method", "q1", "q3", "iqr", "lower", "upper"]
    return (_flagged(df, group, value, bounds)
            .groupBy(group, *facts).agg(
                F.count(F.lit(1)).alias("n_eligible"),
                F.count(F.when(F.col("__out"), 1)).alias("n_removed"),
                F.avg(value).alias("mean_before"),
                F.stddev_samp(value).alias("std_before"),
                F.avg(F.when(~F.col("__out"), F.col(value))).alias("mean_after"))
            .withColumn("n_kept", F.col("n_eligible") - F.col("n_removed"))
            .withColumn("pct_removed", F.col("n_removed") * 100.0 / F.col("n_eligible")))


def floored(value: Column, floor: float | None = RATIO_FLOOR) -> Column:
    return value if floor is None else F.when(value.isNotNull(), F.greatest(value, F.lit(floor)))


def ratio_means(ratios: DataFrame, group: str, value: str,
                floor: float | None = RATIO_FLOOR, positive_only: bool = False) -> DataFrame:
    """Normalising ratio per group, and the overall one in the row with a NULL group."""
    kept = ratios.where(F.col(value) > 0) if positive_only else ratios
    parts = (kept.where(F.col(group).isNotNull())
             .groupBy(group).agg(F.sum(floored(F.col(value), floor)).alias("__s"),
                                 F.count(value).alias("__n")))
    return (parts.groupingSets([[F.col(group)], []], F.col(group))
            .agg(F.try_divide(F.sum("__s"), F.sum("__n")).alias("ratio_mean")))


def overall_ratio(means: DataFrame, group: str) -> Column:
    """The overall ratio as a scalar subquery; 1 without any ratios."""
    return F.coalesce(means.where(F.col(group).isNull())
                      .agg(F.max("ratio_mean").alias("r")).scalar(), F.lit(1.0))


def with_type_ratio(records: DataFrame, means: DataFrame, group: str,
                    out: str = "type_ratio") -> DataFrame:
    """The group's ratio, the overall one where it is unknown or zero."""
    per_group = means.where(F.col(group).isNotNull())
    joined = records.join(small_side(per_group), group, "left")
    return (joined.withColumn(out, F.coalesce(F.nullif(F.col("ratio_mean"), F.lit(0.0)),
                                              overall_ratio(means, group)))
            .drop("ratio_mean"))


def screening_value(records: DataFrame, means: DataFrame, group: str, value: str, mark: str,
                    out: str = "screen", trim: bool = True) -> DataFrame:
    """Values on the common scale: F rows as they are, others divided by the ratio."""
    joined = with_type_ratio(records, means, group, "__ratio")
    return (joined.withColumn(out, F.when(is_f_scale(F.col(mark), trim), F.col(value))
                              .otherwise(F.col(value) / F.col("__ratio")))
            .drop("__ratio"))


def mixed_groups(records: DataFrame, group: str, mark: str) -> DataFrame:
    """Groups that hold both F and other records."""
    on_scale = is_f_scale(F.col(mark))
    return (records.where(F.col(group).isNotNull()).groupBy(group)
            .agg(F.count(F.when(on_scale, 1)).alias("n_f"),
                 F.count(F.when(~on_scale, 1)).alias("n_other"))
            .where((F.col("n_f") > 0) & (F.col("n_other") > 0)))


def reference_factors(records: DataFrame, group: str, value: str,
                      defaults: Mapping[str, float], spark=None) -> DataFrame:
    """Mean factor per group; defaults replace groups of the same name."""
    spark = records.sparkSession
    means = (records.where(F.col(group).isNotNull() & ~F.col(group).isin(list(defaults)))
             .groupBy(group).agg(F.avg(value).alias("reference")))
    fixed = spark.createDataFrame([(k, float(v)) for k, v in defaults.items()],
                                  f"`{group}` string, reference double")
    return means.unionByName(fixed)


# --- training tables ------------------------------------------------------

def column_medians(df: DataFrame, columns: Sequence[str],
                   keys: Sequence[str] = ()) -> DataFrame:
    """Exact medians in long form: keys, feature, median."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(keys), list(columns), "feature", "value")
    return (exact_quantiles(long, [*keys, "feature"], "value", {"median": 0.5})
            .select(*keys, "feature", "median"))


def impute_medians(df: DataFrame, medians: DataFrame, columns: Sequence[str],
                   keys: Sequence[str] = ()) -> DataFrame:
    """Fill missing features with the training medians (wide, one row per key)."""
    cells = [F.max(F.when(F.col("feature") == c, F.col("median"))).alias(f"__m_{c}")
             for c in columns]
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"__m_{c}")).alias(c) for c in columns}
    if keys:
        joined = join_null_safe(df, medians.groupBy(*keys).agg(*cells), keys, "left")
    else:
        facts = medians.agg(F.struct(*cells).alias("m")).scalar()
        joined = df.withColumn("__m", facts)
        filled = {c: F.coalesce(F.col(c).cast("double"), F.col("__m")[f"__m_{c}"]).alias(c)
                  for c in columns}
    return joined.select(*[filled[c] if c in filled else F.col(c) for c in df.columns])


def dense_codes(frames: Sequence[DataFrame], column: str, keys: Sequence[str] = ()) -> DataFrame:
    """Zero-based codes of the sorted distinct values over several tables."""
    values = frames[0].select(*keys, column)
    for other in frames[1:]:
        values = values.unionByName(other.select(*keys, column))
    return value_ranks(values, keys, column, text=True).select(
        *keys, column, F.col("dense").alias("code"))


def encode(df: DataFrame, codes: DataFrame, column: str, out: str,
           keys: Sequence[str] = (), missing: int | None = -1) -> DataFrame:
    """Attach codes; missing values get the given code."""
    side = codes.select(*keys, F.col(column), F.col("code").alias("__code"))
    joined = join_null_safe(df, side, [*keys, column], "left")
    code = F.col("__code") if missing is None else F.coalesce(F.col("__code"), F.lit(missing))
    return joined.withColumn(out, code.cast("long")).drop("__code")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Row weight n / (k · n_class), so that every class has the same total weight."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    totals = counts.agg(F.struct(F.sum("__n").alias("n"), F.count(F.lit(1)).alias("k"))
                        .alias("t")).scalar()
    weights = counts.withColumn("__t", totals).select(
        label, (F.col("__t.n") / (F.col("__t.k") * F.col("__n"))).alias(out))
    return join_null_safe(df, small_side(weights), [label])
