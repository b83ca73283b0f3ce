"""Validation metrics, interval summaries and job lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregate import normalised_weight_mean
from .frames import join_null_safe
from .ranking import exact_quantiles, value_ranks

# Thresholds and fractions of the country holdout.
LARGE_COUNTRY_MIN, SMALL_COUNTRY_MIN = 1000, 20
LARGE_FRACTION, SMALL_FRACTION = 0.2, 0.5
MIN_PLANTS_WARN = 50


def relative_pct(value: Column, reference: Column) -> Column:
    return F.when(reference != 0, (value - reference) / reference * 100)


def gas_rows(plants: DataFrame, carry: Sequence[str], gases: Sequence[str] = ("N2O", "CH4"),
             complete: bool = False) -> DataFrame:
    """Long form (carry, gas, true, pred) from ``{gas}_true`` and ``{gas}_pred`` columns.

    ``complete`` keeps only rows that have all values of all gases.
    """
    if complete:
        plants = plants.dropna(subset=[f"{g}_{side}" for g in gases for side in ("true", "pred")])
    cells = F.array(*[F.struct(F.lit(g).alias("gas"), F.col(f"{g}_true").alias("true"),
                               F.col(f"{g}_pred").alias("pred")) for g in gases])
    return plants.select(*carry, F.explode(cells).alias("__c")).select(*carry, "__c.*")


def fold_metrics(rows: DataFrame, keys: Sequence[str], population: str,
                 digits: tuple[int, int] | None = (6, 2)) -> DataFrame:
    """RMSE, MAE and relative errors of the means, plain and size-weighted."""
    complete = rows.where(F.col("true").isNotNull() & F.col("pred").isNotNull())
    error = F.col("pred") - F.col("true")
    size = F.col(population)
    m = complete.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg("true").alias("true_mean"), F.avg("pred").alias("pred_mean"),
        normalised_weight_mean(F.col("true"), size).alias("true_wtd"),
        normalised_weight_mean(F.col("pred"), size).alias("pred_wtd"),
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"))
    out = (m.withColumn("rel_error_pct", relative_pct(F.col("pred_mean"), F.col("true_mean")))
           .withColumn("rel_error_wtd_pct", relative_pct(F.col("pred_wtd"), F.col("true_wtd"))))
    if digits is None:
        return out
    fine, coarse = digits
    rounded = {**{c: fine for c in ("true_mean", "pred_mean", "true_wtd", "pred_wtd", "rmse", "mae")},
               **{c: coarse for c in ("rel_error_pct", "rel_error_wtd_pct")}}
    return out.select(*[F.bround(c, rounded[c]).alias(c) if c in rounded else F.col(c)
                        for c in out.columns])


def metric_summary(folds: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Mean, minimum, maximum and sample std of every metric across folds, in long form."""
    long = folds.select(*keys, *metrics).unpivot(list(keys), list(metrics), "metric", "value")
    return long.groupBy(*keys, "metric").agg(
        F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.stddev_samp("value").alias("std"))


def joint_score(folds: DataFrame, keys: Sequence[str], metric: str = "rmse",
                gases: Sequence[str] = ("N2O", "CH4")) -> DataFrame:
    """Sum of the per-gas means of a metric; infinite when a gas has none."""
    means = [F.avg(F.when(F.col("gas") == g, F.col(metric))) for g in gases]
    total = means[0]
    for m in means[1:]:
        total = total + m
    return folds.groupBy(*keys).agg(F.coalesce(total, F.lit(float("inf"))).alias("score"))


def best_sets(scores: DataFrame, key: str, order: str, n: int = 1) -> DataFrame:
    """The n best sets per key by (score, evaluation order), with their rank.

    For one set a running minimum suffices; for several, the rank filter lets every task
    keep only n rows per key before the shuffle.
    """
    entry = F.struct("score", order, *[c for c in scores.columns if c not in (key, "score", order)])
    if n == 1:
        best = scores.groupBy(key).agg(F.min(entry).alias("__e"))
        return best.select(key, F.lit(1).alias("rank"), "__e.*")
    w = Window.partitionBy(key).orderBy("score", order)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def interval_summary(draws: DataFrame, keys: Sequence[str], value: str,
                     truth: DataFrame, true_value: str = "true_value",
                     digits: bool = True, bounded: bool = False) -> DataFrame:
    """Mean, median, std and 95 % interval of the iterations, against the reference value.

    ``bounded`` groups hold one value per iteration; others are cut into ranges.
    """
    rows = draws.where(F.col(value).isNotNull())
    simple = [F.avg(value).alias("pred_mean"), F.stddev_pop(value).alias("pred_std")]
    levels = {"__low": 0.025, "__mid": 0.5, "__high": 0.975}
    if bounded:
        probs = F.array(*[F.lit(p) for p in levels.values()])
        stats = rows.groupBy(*keys).agg(*simple, F.percentile(value, probs).alias("__q"))
        stats = stats.select("*", *[F.col("__q")[i].alias(n) for i, n in enumerate(levels)])
    else:
        stats = rows.groupBy(*keys).agg(*simple).join(
            exact_quantiles(rows, keys, value, levels).drop("n"), list(keys))
    joined = stats.join(truth.select(*keys, F.col(true_value).alias("true_value")),
                        list(keys), "left")
    low, high = F.col("__low"), F.col("__high")
    mean, true = F.col("pred_mean"), F.col("true_value")

    def r(c: Column, d: int) -> Column:
        return F.bround(c, d) if digits else c
    return joined.select(
        *keys, r(true, 6).alias("true_value"), r(mean, 6).alias("pred_mean"),
        r(F.col("__mid"), 6).alias("pred_median"), r(F.col("pred_std"), 6).alias("pred_std"),
        r(low, 6).alias("pred_p2_5"), r(high, 6).alias("pred_p97_5"),
        r(high - low, 6).alias("pi_width"),
        r(F.when(mean != 0, (high - low) / mean * 100), 1).alias("pi_width_rel_pct"),
        r(relative_pct(mean, true), 2).alias("rel_diff_pct"),
        ((low <= true) & (true <= high)).cast("int").alias("in_pi"))


def reference_mean(plants: DataFrame, keys: Sequence[str], label: str, population: str,
                   reference: DataFrame, ref_label: str, ref_value: str,
                   out: str = "true_value") -> DataFrame:
    """Weighted reference factor per group; types without one drop out of the weights."""
    side = reference.select(F.col(ref_label).alias("__t"), F.col(ref_value).alias("__r"))
    joined = plants.join(side, F.col(label) == F.col("__t"), "left")
    return joined.groupBy(*keys).agg(
        normalised_weight_mean(F.col("__r"), F.col(population)).alias(out))


def group_sizes(plants: DataFrame, keys: Sequence[str], population: str, label: str,
                within: Sequence[str] | None = None) -> DataFrame:
    """Plants, population and reference types per group.

    With ``within``, also the group's percentage of the population of those keys,
    taken over the rows of the stratum that holds everything.
    """
    size = F.coalesce(F.col(population).cast("double"), F.lit(1.0))
    sizes = plants.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_plants"),
                                      F.sum(size).alias("pop_total"),
                                      F.countDistinct(label).alias("n_true_types"))
    if within is None:
        return sizes
    totals = sizes.groupBy(*within).agg(F.max("pop_total").alias("__all"))
    return (join_null_safe(sizes, totals, within)
            .withColumn("pop_share_pct", F.when(F.col("__all") > 0,
                                                F.bround(F.col("pop_total") * 100 / F.col("__all"), 2)))
            .drop("__all"))


def coverage_summary(intervals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread of the relative differences and interval coverage per group."""
    diff = F.col("rel_diff_pct")
    medians = exact_quantiles(intervals.select(*keys, F.abs(diff).alias("__d")), keys, "__d",
                              {"__median": 0.5}).drop("n")
    spread = intervals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.bround(F.avg(diff), 2).alias("rel_diff_mean_pct"),
        F.bround(F.stddev_samp(diff), 2).alias("rel_diff_std_pct"),
        F.bround(F.min(diff), 2).alias("rel_diff_min_pct"),
        F.bround(F.max(diff), 2).alias("rel_diff_max_pct"),
        F.bround(F.avg("pi_width_rel_pct"), 1).alias("pi_width_rel_mean_pct"),
        F.bround(F.avg("in_pi") * 100, 1).alias("pi_coverage_pct"),
        F.concat_ws("/", F.sum("in_pi").cast("string"), F.count(F.lit(1)).cast("string"))
        .alias("n_covered"))
    return (join_null_safe(spread, medians, keys, "left")
            .withColumn("med_abs_rel_diff_pct", F.bround("__median", 2)).drop("__median"))


def holdout_jobs(rows: DataFrame, country: str, wanted: DataFrame,
                 large: int = LARGE_COUNTRY_MIN, small: int = SMALL_COUNTRY_MIN,
                 large_fractions: Sequence[float] = (LARGE_FRACTION,),
                 small_fractions: Sequence[float] = (SMALL_FRACTION,),
                 whole: bool = False, below: str = "skip") -> DataFrame:
    """(country, n, fraction, status): the holdouts of every wanted country, one row each.

    A NULL fraction of a job that runs leaves the whole country out; ``whole`` does so for
    all. Countries with fewer than ``small`` rows are left alone (``below="skip"``), left out
    whole (``"whole"``) or held out like small ones (``"small"``).
    """
    if below not in ("skip", "whole", "small"):
        raise ValueError(f"unknown choice {below!r} for small countries")

    def part(fractions: Sequence[float | None]) -> Column:
        return F.array(*[F.lit(f).cast("double") for f in fractions])

    counts = rows.groupBy(country).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    rest = part(small_fractions) if below == "small" else part([None])
    fractions = (F.when((n == 0) | F.lit(whole), part([None])).when(n > large, part(large_fractions))
                 .when(n >= small, part(small_fractions)).otherwise(rest))
    status = (F.when(n == 0, "name not found")
              .when((n < small) & F.lit(below == "skip" and not whole), "too few plants").otherwise("run"))
    return (wanted.select(country).join(counts, country, "left")
            .select(country, n.cast("long").alias("n"), F.explode(fractions).alias("fraction"),
                    status.alias("status")))


def few_plants(intervals: DataFrame, n: str, limit: int = MIN_PLANTS_WARN) -> DataFrame:
    return intervals.where(F.col(n) < limit)


def held_out(rows: DataFrame, id_col: str, test: DataFrame) -> DataFrame:
    """Everything that is not in the test set."""
    return rows.join(test.select(id_col), id_col, "left_anti")


def close_names(present: DataFrame, name: str, wanted: Sequence[str]) -> DataFrame:
    """(wanted, candidate): names that contain the first word of a wanted name.

    The wanted names are a driver-side list; each row is tested against all of them.
    """
    keys = F.array(*[F.struct(F.lit(w).alias("wanted"),
                              F.lit(w.split(",")[0].split()[0].lower()).alias("key"))
                     for w in wanted])
    hits = F.filter(keys, lambda k: F.contains(F.lower(F.col("candidate")), k["key"]))
    return (present.select(F.col(name).alias("candidate")).distinct()
            .select("candidate", F.explode(hits).alias("__k"))
            .select(F.col("__k.wanted").alias("wanted"), "candidate"))


def with_grid(rows: DataFrame, values: Mapping[str, Sequence]) -> DataFrame:
    """Every parameter combination for every row, numbered; the last key varies fastest.

    The lists are driver-side literals, expanded by a generator and not by a join.
    """
    types = {int: "int", float: "double", str: "string"}
    frame, position = rows, F.lit(0)
    for name, options in values.items():
        cells = F.array(*[F.lit(o).cast(types[type(options[0])]) for o in options])
        frame = frame.select("*", F.posexplode(cells).alias(f"__i_{name}", name))
        position = position * len(options) + F.col(f"__i_{name}")
    return frame.select(*rows.columns, position.cast("int").alias("ordinal"), *values)


def parameter_key(names: Sequence[str]) -> Column:
    """Stable text key of one parameter set."""
    return F.concat_ws("|", *[F.col(n).cast("string") for n in names])


def remaining(grid: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Work that is not in the done table yet."""
    return grid.join(done.select(*keys).distinct(), list(keys), "left_anti")


def binary_report(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per class."""
    counts = rows.groupBy(label, predicted).agg(F.count(F.lit(1)).alias("__n"))
    per_class = (counts.select(F.explode(F.array(
                    F.struct(F.col(label).alias("c"), F.col("__n").alias("t"),
                             F.lit(0).cast("long").alias("p"),
                             F.when(F.col(label) == F.col(predicted), F.col("__n"))
                             .otherwise(0).alias("h")),
                    F.struct(F.col(predicted).alias("c"), F.lit(0).cast("long").alias("t"),
                             F.col("__n").alias("p"), F.lit(0).cast("long").alias("h")))).alias("x"))
                 .groupBy(F.col("x.c").alias("class")).agg(
                     F.sum("x.t").alias("support"), F.sum("x.p").alias("predicted"),
                     F.sum("x.h").alias("hits")))
    precision = F.coalesce(F.try_divide(F.col("hits"), F.col("predicted")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits"), F.col("support")), F.lit(0.0))
    return per_class.select(
        "class", precision.alias("precision"), recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
        .alias("f1"), "support")


def roc_auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from tie-averaged ranks (one row)."""
    ranks = value_ranks(rows, [], score)
    positives = (rows.groupBy(F.col(score).cast("double").alias(score))
                 .agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("__p")))
    average = F.col("below") + (F.col("n") + 1) / 2
    sums = ranks.join(positives, score).agg(
        F.sum(average * F.col("__p")).alias("r"), F.sum("__p").alias("p"), F.sum("n").alias("n"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return sums.select(F.try_divide(F.col("r") - p * (p + 1) / 2, p * q).alias("auc"))
