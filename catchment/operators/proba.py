"""Class-probability tables in long form: (id, class, mean, std)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.uniform import pick, uniform
from .ranking import hash_bucket, with_row_number
from ..functions.uniform import digest


def class_array(classes: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in classes])


def one_hot(rows: DataFrame, id_col: str, label: str, classes: Sequence[str]) -> DataFrame:
    """Known rows: probability 1 for their class. Labels outside the list are unknown."""
    known = rows.where(F.col(label).isin(list(classes)))
    return known.select(id_col, F.explode(class_array(classes)).alias("class"),
                        F.col(label).alias("__label")).select(
        id_col, "class",
        F.when(F.col("class") == F.col("__label"), 1.0).otherwise(0.0).alias("mean"),
        F.lit(0.0).alias("std"))


def full_matrix(rows: DataFrame, predicted: DataFrame, id_col: str, label: str,
                classes: Sequence[str]) -> DataFrame:
    """(id, class, mean, std, is_known) for every row; unmatched unknown rows are all zero."""
    known = F.coalesce(F.col(label).isin(list(classes)), F.lit(False))
    grid = rows.select(id_col, known.alias("is_known"), F.col(label).alias("__label"),
                       F.explode(class_array(classes)).alias("class"))
    side = predicted.select(id_col, "class", F.col("mean").alias("__m"),
                            F.col("std").alias("__s"))
    joined = grid.join(side, [id_col, "class"], "left")
    hot = F.when(F.col("class") == F.col("__label"), 1.0).otherwise(0.0)
    return joined.select(
        id_col, "class",
        F.when(F.col("is_known"), hot).otherwise(F.coalesce("__m", F.lit(0.0))).alias("mean"),
        F.when(F.col("is_known"), 0.0).otherwise(F.coalesce("__s", F.lit(0.0))).alias("std"),
        "is_known")


def to_wide(long: DataFrame, id_col: str, classes: Sequence[str]) -> DataFrame:
    """``{class}_mean`` and ``{class}_std`` columns, one row per id."""
    return long.groupBy(id_col).agg(*[
        F.max(F.when(F.col("class") == c, F.col(m))).alias(f"{c}_{m}")
        for c in classes for m in ("mean", "std")])


def wide_classes(columns: Sequence[str]) -> list[str]:
    """Classes that have both a ``_mean`` and a ``_std`` column."""
    return sorted(c[:-5] for c in columns if c.endswith("_mean") and f"{c[:-5]}_std" in columns)


def to_long(wide: DataFrame, id_cols: Sequence[str], classes: Sequence[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("class"),
                               F.col(f"{c}_mean").cast("double").alias("mean"),
                               F.col(f"{c}_std").cast("double").alias("std")) for c in classes])
    return wide.select(*id_cols, F.explode(cells).alias("__c")).select(*id_cols, "__c.*")


def to_arrays(long: DataFrame, id_col: str, classes: Sequence[str],
              carry: Sequence[str] = ()) -> DataFrame:
    """``means`` and ``stds`` arrays in class order; absent classes are 0."""
    def cells(measure: str) -> Column:
        return F.array(*[F.coalesce(F.max(F.when(F.col("class") == c, F.col(measure))),
                                    F.lit(0.0)) for c in classes])
    return long.groupBy(id_col, *carry).agg(cells("mean").alias("means"),
                                            cells("std").alias("stds"))


def restrict_advanced(long: DataFrame, keys: Sequence[str], level: str,
                      allowed: Sequence[str], proba: str = "proba") -> DataFrame:
    """For advanced rows: disallowed classes to zero, renormalised, uniform if nothing is left."""
    ok = F.col("class").isin(list(allowed))
    advanced = F.coalesce(F.trim(F.col(level)) == "Advanced", F.lit(False))
    row = Window.partitionBy(*keys)  # the classes of one row: a cube that lies in buckets stays there
    usable = F.when(advanced & ok, F.col(proba))
    marked = long.select("*", F.sum(usable).over(row).alias("__s"), F.count(F.when(advanced & ok, 1)).over(row).alias("__k"))
    inside = (F.when(F.col("__s") > 0, F.col(proba) / F.col("__s"))
              .otherwise(1.0 / F.col("__k")))
    value = (F.when(~advanced | (F.col("__k") == 0), F.col(proba))
             .when(ok, inside).otherwise(0.0))
    return marked.select(*[value.alias(proba) if c == proba else F.col(c) for c in long.columns])


def replicate_stats(cube: DataFrame, id_col: str, proba: str = "proba") -> DataFrame:
    """Per (id, class) over the replicates: mean, population std, median and 95 % bounds."""
    q = F.percentile(F.col(proba), F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return (cube.groupBy(id_col, "class")
            .agg(F.avg(proba).alias("mean"), F.stddev_pop(proba).alias("std"), q.alias("__q"))
            .select(id_col, "class", "mean", "std", F.col("__q")[0].alias("ci_lower"),
                    F.col("__q")[1].alias("median"), F.col("__q")[2].alias("ci_upper")))


def predicted_class(stats: DataFrame, id_col: str, classes: Sequence[str]) -> DataFrame:
    """First class with the highest mean, its probability, and the entropy."""
    position = F.array_position(class_array(classes), F.col("class"))
    safe = F.least(F.greatest(F.col("mean"), F.lit(1e-10)), F.lit(1 - 1e-10))
    return stats.groupBy(id_col).agg(
        F.min_by("class", F.struct(-F.col("mean"), position)).alias("predicted"),
        F.max("mean").alias("confidence"),
        (-F.sum(safe * F.ln(safe))).alias("entropy"))


def bootstrap_multiplicity(rows: DataFrame, id_col: str, replicates: int,
                           seed: int, stratum: Sequence[str] = ()) -> DataFrame:
    """(stratum, replicate, id, multiplicity) of n draws with replacement per replicate.

    Every row makes one draw per replicate; equal draws are combined before the
    shuffle, and the drawn positions are joined back to the rows.
    """
    stratum = list(stratum)
    key = digest(seed, F.col(id_col))
    numbered = with_row_number(rows.select(*stratum, id_col, key.alias("__h")), stratum,
                               [F.col("__h"), F.col(id_col)], hash_bucket(F.col("__h")), "__pos")
    draws = numbered.select(*stratum, id_col, "__pos_total",
                            F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
                            .alias("replicate"))
    u = uniform(seed, F.col("replicate"), F.col(id_col), F.lit("boot"))
    hits = (draws.withColumn("__pos", pick(u, F.col("__pos_total")) + 1)
            .groupBy(*stratum, "replicate", "__pos")
            .agg(F.count(F.lit(1)).alias("multiplicity")))
    return (hits.join(numbered.select(*stratum, id_col, "__pos"), [*stratum, "__pos"])
            .select(*stratum, "replicate", id_col, "multiplicity"))


def stratified_holdout(rows: DataFrame, id_col: str, strata: Sequence[str], fraction: float,
                       seed: int, out: str = "is_test") -> DataFrame:
    """Marks half-even round(n · fraction) rows of every stratum, without replacement."""
    keyed = rows.withColumn("__h", digest(seed, F.col(id_col)))
    numbered = with_row_number(keyed, strata, [F.col("__h"), F.col(id_col)],
                               hash_bucket(F.col("__h")), "__pos")
    size = F.bround(F.col("__pos_total") * F.lit(float(fraction)), 0)
    return numbered.withColumn(out, F.col("__pos") <= size).drop("__h", "__pos", "__pos_total")


def stratified_folds(rows: DataFrame, id_col: str, strata: Sequence[str], folds: int,
                     seed: int, out: str = "fold") -> DataFrame:
    """Folds 1…k; per stratum the fold sizes differ by at most one."""
    keyed = rows.withColumn("__h", digest(seed, F.col(id_col)))
    numbered = with_row_number(keyed, strata, [F.col("__h"), F.col(id_col)],
                               hash_bucket(F.col("__h")), "__pos")
    return (numbered.withColumn(out, ((F.col("__pos") - 1) % folds + 1).cast("int"))
            .drop("__h", "__pos", "__pos_total"))


def stratified_split(rows: DataFrame, id_col: str, strata: Sequence[str], seed: int,
                     train: float = 0.6, valid: float = 0.2, out: str = "split") -> DataFrame:
    """Train, validation and test parts with the same class shares."""
    keyed = rows.withColumn("__h", digest(seed, F.col(id_col)))
    numbered = with_row_number(keyed, strata, [F.col("__h"), F.col(id_col)],
                               hash_bucket(F.col("__h")), "__pos")
    n = F.col("__pos_total")
    test_n = F.bround(n * (1.0 - train - valid), 0)
    valid_n = F.bround(n * valid, 0)
    part = (F.when(F.col("__pos") <= test_n, "test")
            .when(F.col("__pos") <= test_n + valid_n, "valid").otherwise("train"))
    return numbered.withColumn(out, part).drop("__h", "__pos", "__pos_total")
