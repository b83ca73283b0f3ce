"""Parameter search: out-of-fold probabilities, factor errors, best set per bucket."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.frames import join_null_safe
from ..operators.jobstate import finished, same_settings
from ..operators.ledger import content
from ..operators.models import score_parameters
from ..operators.proba import to_arrays
from ..operators.validate import best_sets, fold_metrics, gas_rows, joint_score
from ..session import materialize, scratch_path
from .validation import plant_results


def fold_scores(probabilities: DataFrame, labelled: DataFrame, id_col: str, label: str,
                population: str, pools: DataFrame, references: Mapping[str, DataFrame],
                classes: Sequence[str], n_sim: int, pool_size: int, seed: int,
                probability_uncertainty: bool = True) -> DataFrame:
    """Fold metrics per (parameter set, bucket, gas, fold)."""
    keys = ["param_key", "bucket", "fold"]
    keyed = probabilities.withColumn("run_id", F.concat_ws("#", "param_key", F.col(id_col)))
    arrays = to_arrays(keyed, "run_id", classes, [*keys, id_col])
    plants = arrays.join(labelled.select(id_col, label, population), id_col)
    scored = plant_results(plants, pools, "run_id", label, dict(references), classes, n_sim,
                           pool_size, seed, probability_uncertainty)
    return fold_metrics(gas_rows(scored, [*keys, population]), [*keys, "gas"], population)


def search(labelled: DataFrame, id_col: str, label: str, features: Sequence[str], bucket: str,
           population: str, sets: Mapping[str, object], folds: int, replicates: int, seed: int,
           pools: DataFrame, references: Mapping[str, DataFrame], classes: Sequence[str],
           n_sim: int, pool_size: int, keep: int = 1, progress: str | None = None) -> DataFrame:
    """The retained parameter sets with their fold metrics, best first per bucket.

    With ``progress``, a folder that all nodes share, the fold metrics of every set are added
    to it when the set is done. A later run with the same settings leaves those sets out; one
    with other settings stops with ``SettingsChanged``.
    """
    spark = labelled.sparkSession
    folder = progress or scratch_path(spark, "search")
    settings = spark.createDataFrame(
        [(k, str(v)) for k, v in {
            "label": label, "features": sorted(features), "bucket": bucket, "population": population,
            "folds": folds, "replicates": replicates, "seed": seed, "n_sim": n_sim,
            "pool_size": pool_size, "classes": list(classes),
            "rows": content(labelled.select(id_col, label, population, bucket, *features))}.items()], "key string, value string")
    same_settings(settings, f"{folder}/settings")
    done = finished(spark, f"{folder}/scores")
    known = set() if done is None else {r[0] for r in done.select("param_key").distinct().collect()}
    wanting = [k for k in sets if k not in known]
    if wanting:  # every set draws from the same pools
        pools = materialize(pools, "pools")
        references = {gas: materialize(table, "reference") for gas, table in references.items()}
    for key in wanting:
        probabilities = materialize(
            score_parameters(labelled, id_col, label, features, bucket, {key: sets[key]}, folds,
                             replicates, seed).withColumnRenamed(bucket, "bucket"), "search")
        fold_scores(probabilities, labelled, id_col, label, population, pools, references, classes,
                    n_sim, pool_size, seed).write.mode("append").parquet(f"{folder}/scores")
    wanted = F.array(*[F.lit(k) for k in sets])
    rows = finished(spark, f"{folder}/scores").where(F.array_contains(wanted, F.col("param_key")))
    order = F.array_position(F.array(*[F.lit(k) for k in sets]), F.col("param_key"))
    scores = joint_score(rows, ["bucket", "param_key"]).withColumn("evaluated", order)
    best = best_sets(scores, "bucket", "evaluated", keep)
    return join_null_safe(best, rows, ["bucket", "param_key"])
