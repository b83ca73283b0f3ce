"""Plant-level and region-level validation against reference factors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import population_bucket
from ..functions.reference import HOLDOUT_COUNTRIES
from ..operators.draws import (beta_classes, beta_probabilities, distribution, draw_factors,
                               expand_draws, group_factors, mixture_factors, pool_table,
                               with_blocks, with_class_cdf)
from ..operators.ledger import Ledger, content
from ..operators.models import holdout_probabilities, run_together
from ..operators.proba import to_arrays
from ..operators.validate import (coverage_summary, few_plants, fold_metrics, gas_rows, group_sizes,
                                  holdout_jobs, interval_summary, metric_summary, reference_mean)
from ..session import materialize
from ..sources.readers import union_all

GASES = {"N2O": "n2o_ef", "CH4": "ch4_ef"}


def group_intervals(plants: DataFrame, pools: DataFrame, keys: Sequence[str], id_col: str,
                    label: str, population: str, references: dict[str, DataFrame],
                    classes: Sequence[str], n_sim: int, pool_size: int, seed: int,
                    probability_uncertainty: bool = True, digits: bool = True,
                    fast: bool = False) -> DataFrame:
    """Interval and coverage per (group, gas): one class and factor per plant and iteration.

    ``plants`` carry ``means`` and ``stds``; ``references`` hold (class, reference) per gas.
    """
    n = len(classes)
    slim = plants if probability_uncertainty else with_class_cdf(plants, n).drop("means", "stds")
    columns = ["means", "stds"] if probability_uncertainty else ["cdf"]
    rows = with_blocks(slim.select(id_col, *keys, population, *columns), n_sim, id_col)
    if probability_uncertainty:
        rows = beta_classes(rows, id_col, seed, n - 1, fast).drop("means", "stds")
    draws = draw_factors(expand_draws(rows, id_col, n_sim, seed, n, None, None, fast),
                         pool_table(pools, classes), n, pool_size, fast)
    sampled = group_factors(draws, keys, population)
    long = sampled.select(*keys, "sim", F.explode(F.array(*[
        F.struct(F.lit(g).alias("gas"), F.col(c).alias("value")) for g, c in GASES.items()]))
        .alias("__c")).select(*keys, "sim", "__c.*")
    truth = None
    for gas, table in references.items():
        part = reference_mean(plants, keys, label, population, table, "class", "reference")
        part = part.withColumn("gas", F.lit(gas))
        truth = part if truth is None else truth.unionByName(part)
    return interval_summary(long, [*keys, "gas"], "value", truth, digits=digits, bounded=True)


def with_strata(plants: DataFrame, bucket: str, mode: str = "pool_only",
                out: str = "stratum") -> DataFrame:
    """Every row in the stratum ``Pool`` and, in mode ``all``, in its bucket as well."""
    labels = [F.lit("Pool")] + ([F.col(bucket)] if mode == "all" else [])
    return plants.select("*", F.explode(F.array_compact(F.array(*labels))).alias(out))


def plant_results(plants: DataFrame, pools: DataFrame, id_col: str, label: str,
                  references: dict[str, DataFrame], classes: Sequence[str], n_sim: int,
                  pool_size: int, seed: int, probability_uncertainty: bool = True) -> DataFrame:
    """Mean and interval of the mixture factor per plant beside its reference factors."""
    weights = (beta_probabilities(plants, id_col, n_sim, seed) if probability_uncertainty
               else plants.select(id_col, F.col("means").alias("probs")))
    mixed = mixture_factors(weights, pool_table(pools, classes), id_col, n_sim, pool_size, seed,
                            classes)
    stats = distribution(mixed, [id_col], list(GASES.values()), bounded=True)
    out = plants.drop("means", "stds").join(stats, id_col)
    for gas, table in references.items():
        side = table.select(F.col("class").alias(label), F.col("reference").alias(f"{gas}_true"))
        out = (out.join(side, label, "left")
               .withColumnRenamed(f"{GASES[gas]}_Mean", f"{gas}_pred"))
    return out


def fold_report(plants: DataFrame, population: str,
                fold: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(metrics per gas and fold, their spread across folds)."""
    folds = fold_metrics(gas_rows(plants, [fold, population]), ["gas", fold], population)
    summary = metric_summary(folds, ["gas"],
                             ["rel_error_pct", "rel_error_wtd_pct", "rmse", "mae"])
    return folds, summary


def holdout_run(labelled: DataFrame, id_col: str, label: str, country: str, population: str,
                features: Sequence[str], settings, pools: DataFrame,
                references: dict[str, DataFrame], classes: Sequence[str], n_sim: int, pool_size: int,
                replicates: int, seed: int, countries: Sequence[str] = HOLDOUT_COUNTRIES,
                bucket: str = "population_bucket", fast: bool = False, ledger: Ledger | None = None,
                **modes) -> dict[str, DataFrame]:
    """Country by country: train without the held-out rows, predict them, compare intervals.

    ``modes`` are those of ``holdout_jobs``. The holdout of a whole country is named LCO. Jobs
    are submitted together, and each one's probabilities are written when it is done. With a
    ``ledger`` those that an earlier run has finished, from the same rows and settings, are reused.
    """
    spark = labelled.sparkSession
    rows = labelled.where(F.col(label).isNotNull() & F.col(country).isNotNull()).withColumn(
        bucket, population_bucket(F.col(population)))
    wanted = spark.createDataFrame([(c,) for c in countries], f"`{country}` string")
    jobs = holdout_jobs(rows, country, wanted, **modes)
    # At most one entry per wanted country, a driver-side list to begin with.
    todo = [(r[country], r["fraction"]) for r in jobs.where("status = 'run'").collect()]
    if not todo:
        raise RuntimeError("no country has enough labelled rows")

    given = {"settings": settings, "features": list(features), "replicates": replicates, "seed": seed}
    based_on = [] if ledger is None else [content(rows.select(id_col, label, country, bucket, *features))]

    def one(name: str, fraction: float | None) -> DataFrame:
        mark = "LCO" if fraction is None else str(round(fraction * 100))

        def fit() -> DataFrame:
            return holdout_probabilities(rows, id_col, label, features, bucket, settings, country, name,
                                         fraction, replicates, seed).withColumn("holdout", F.lit(mark))

        return (ledger.stage("holdout", f"{name}#{mark}", given, fit, based_on) if ledger
                else materialize(fit(), "holdout"))

    probabilities = union_all(run_together(spark, [lambda j=j: one(*j) for j in todo]))
    # A row may be held out more than once, by several fractions.
    keyed = probabilities.withColumn("__run", F.concat_ws("#", "holdout", F.col(id_col)))
    plants = materialize(to_arrays(keyed, "__run", classes, ["holdout", id_col]).drop("__run").join(
        rows.select(id_col, country, label, population), id_col), "plants")
    intervals = materialize(group_intervals(
        plants, pools, [country, "holdout"], id_col, label, population, references, classes, n_sim,
        pool_size, seed, fast=fast), "intervals")
    sizes = group_sizes(plants, [country, "holdout"], population, label)
    return {"jobs": jobs, "probabilities": probabilities, "intervals": intervals, "sizes": sizes,
            "summary": holdout_report(intervals, "holdout"),
            "few": few_plants(sizes, "n_plants")}


def holdout_report(intervals: DataFrame, holdout: str) -> DataFrame:
    return coverage_summary(intervals, [holdout, "gas"])
