"""Classifiers on Spark ML: bagged class probabilities and the binary model."""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.buckets import BucketedParts, bucketed
from ..sources.readers import union_all
from .clean import balanced_weights, column_medians, dense_codes, encode, impute_medians
from .frames import available
from .ledger import Ledger, content
from .proba import (bootstrap_multiplicity, predicted_class, replicate_stats, restrict_advanced,
                    stratified_folds, stratified_holdout, stratified_split)

MIN_TRAIN = 10
MAX_CLASSES = 1000
PARALLEL_FITS = 4
T = TypeVar("T")


_inside = threading.local()


def run_together(spark: SparkSession, tasks: Sequence[Callable[[], T]]) -> list[T]:
    """Submit independent fits from several driver threads, as cross-validation does.

    There is one pool at a time: tasks that are themselves run by the pool run theirs in
    turn, so no more than ``PARALLEL_FITS`` fits are under way.
    """
    if len(tasks) < 2 or getattr(_inside, "pool", False):
        return [task() for task in tasks]

    def run(task: Callable[[], T]) -> T:
        _inside.pool = True
        try:
            return inheritable_thread_target(spark)(task)()
        finally:
            _inside.pool = False

    with ThreadPool(min(PARALLEL_FITS, len(tasks))) as pool:
        return pool.map(run, tasks)


@dataclass(frozen=True)
class ForestSettings:
    """One parameter set of the bagged classifier."""

    num_trees: int = 100
    max_depth: int = 5
    min_instances: int = 1
    features: str = "auto"

    def build(self, seed: int) -> RandomForestClassifier:
        return RandomForestClassifier(
            featuresCol="features", labelCol="__y", weightCol="multiplicity",
            numTrees=self.num_trees, maxDepth=self.max_depth,
            minInstancesPerNode=self.min_instances, featureSubsetStrategy=self.features,
            seed=seed, cacheNodeIds=False)

    def probabilities(self, train: DataFrame, wanted: DataFrame, carry: Sequence[str],
                      n_classes: int, seed: int) -> DataFrame:
        """``wanted`` scored: the carried columns and a probability array."""
        model = self.build(seed).fit(train)
        seen = F.slice(vector_to_array("probability"), 1, n_classes)
        # Classes that are missing in this table have probability 0.
        rest = F.array_repeat(F.lit(0.0), F.lit(n_classes) - F.size(seen))
        return model.transform(wanted).select(*carry, F.concat(seen, rest).alias("__p"))


@dataclass(frozen=True)
class BoostedSettings:
    """One parameter set of boosted trees: a binary booster per class, normalised."""

    n_estimators: int = 100
    max_depth: int = 5
    learning_rate: float = 0.1
    min_instances: int = 1
    subsample: float = 0.8

    def probabilities(self, train: DataFrame, wanted: DataFrame, carry: Sequence[str],
                      n_classes: int, seed: int) -> DataFrame:
        scored = wanted
        present = {int(r[0]) for r in train.select("__y").distinct().collect()}
        for c in present:
            booster = GBTClassifier(
                featuresCol="features", labelCol="__one", weightCol="multiplicity",
                maxIter=self.n_estimators, maxDepth=self.max_depth, stepSize=self.learning_rate,
                minInstancesPerNode=self.min_instances, subsamplingRate=self.subsample, seed=seed,
                predictionCol=f"__d{c}")
            booster = booster.setProbabilityCol(f"__q{c}").setRawPredictionCol(f"__r{c}")
            one = train.withColumn("__one", F.when(F.col("__y") == c, 1.0).otherwise(0.0))
            scored = booster.fit(one).transform(scored)
        each = [vector_to_array(f"__q{c}")[1] if c in present else F.lit(0.0) for c in range(n_classes)]
        cells = scored.select(*carry, F.array(*each).alias("__e"))
        total = F.aggregate("__e", F.lit(0.0), lambda a, x: a + x)
        return cells.select(*carry, F.transform("__e", lambda x: x / total).alias("__p"))


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df)


def prepare_features(train: DataFrame, predict: DataFrame, numeric: Sequence[str],
                     categorical: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Median imputation from the training rows and shared categorical codes."""
    medians = column_medians(train, numeric) if numeric else None
    out = []
    for df in (train, predict):
        out.append(impute_medians(df, medians, numeric) if numeric else df)
    for column in categorical:
        codes = dense_codes([train, predict], column)
        out = [encode(df, codes, column, f"{column}_code") for df in out]
    return out[0], out[1]


def bagged_probabilities(train: DataFrame, predict: DataFrame, id_col: str, label: str,
                         features: Sequence[str], settings: ForestSettings | BoostedSettings,
                         replicates: int, seed: int, carry: Sequence[str] = (),
                         classes: Sequence[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(replicate, id, class, proba) from one model per bootstrap replicate.

    Replicates are weights on one training table, so no copy of it is made: a row carries its
    number of draws for every replicate, and a replicate reads its own without a join. Rows to
    predict are bucketed by id, and each replicate's scores are written into the same buckets when
    it is done, so statistics per row over all replicates move nothing. The classes are those
    given, or else the sorted training labels.
    """
    classes = list(classes) if classes is not None else table_classes(train, label)
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    spark = train.sparkSession
    base = materialize(_assembled(train.withColumn("__y", position.cast("double")), features)
                       .select(id_col, "__y", "features"), "train")
    drawn = (bootstrap_multiplicity(base, id_col, replicates, seed).groupBy(id_col)
             .agg(F.map_from_entries(F.collect_list(F.struct("replicate", "multiplicity"))).alias("__m")))
    table = materialize(base.join(drawn, id_col), "drawn")  # a row that no replicate draws is not needed
    wanted = bucketed(_assembled(predict, features).select(id_col, *carry, "features"), id_col, name="predict")
    cube = BucketedParts(spark, id_col, part="replicate", name="cube")
    names = F.array(*[F.lit(c) for c in classes])

    def replicate(b: int) -> None:
        mine = table.withColumn("multiplicity", F.col("__m")[b]).where("multiplicity > 0").drop("__m")
        scored = settings.probabilities(mine, wanted, [id_col, *carry], len(classes), seed + b)
        cells = scored.select(id_col, *carry, F.posexplode("__p").alias("__c", "proba"))
        cube.write(b, cells.select(id_col, *carry, F.get(names, F.col("__c")).alias("class"), "proba"))

    run_together(spark, [lambda b=b: replicate(b) for b in range(replicates)])
    return cube.read().select("replicate", id_col, *carry, "class", "proba"), classes


def table_classes(rows: DataFrame, label: str, limit: int = MAX_CLASSES) -> list[str]:
    """The sorted labels of a table: a list of classes, not of rows, which is checked."""
    found = [r[0] for r in rows.where(F.col(label).isNotNull()).select(label).distinct()
             .limit(limit + 1).collect()]
    if len(found) > limit:
        raise ValueError(f"{label} has more than {limit} classes")
    return sorted(found)


def bucket_probabilities(train: DataFrame, predict: DataFrame, id_col: str, label: str,
                         numeric: Sequence[str], bucket: str,
                         settings: Mapping[str, ForestSettings], replicates: int, seed: int,
                         allowed: Sequence[str] | None = None, level: str | None = None,
                         categorical: Sequence[str] = (), min_train: int = MIN_TRAIN,
                         all_classes: bool = False) -> DataFrame:
    """(bucket, id, class, mean, std, …) for the rows to predict, bucket by bucket.

    Buckets with fewer than ``min_train`` training rows are left out; ``skipped_buckets`` lists
    them. The classes are those of the bucket or, with ``all_classes``, of the whole table.
    """
    classes = table_classes(train, label) if all_classes else None
    numeric = available(train, numeric)
    sizes = {r[bucket]: r["n"] for r in
             train.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).collect()}
    wanted = {r[0] for r in predict.select(bucket).distinct().collect()}

    def one(name: str) -> DataFrame:
        tr, pr = prepare_features(train.where(F.col(bucket) == name),
                                  predict.where(F.col(bucket) == name), numeric, categorical)
        carry = [level] if level else []
        cube, _ = bagged_probabilities(tr, pr, id_col, label,
                                       [*numeric, *[f"{c}_code" for c in categorical]],
                                       settings[name], replicates, seed, carry, classes)
        if level and allowed:
            cube = restrict_advanced(cube, ["replicate", id_col], level, allowed)
        return replicate_stats(cube, id_col).withColumn(bucket, F.lit(name))

    usable = [n for n in sorted(sizes) if sizes[n] >= min_train and n in wanted]
    if not usable:
        raise RuntimeError(f"none of the buckets {sorted(wanted)} has {min_train} rows to learn from")
    return union_all(run_together(train.sparkSession, [lambda n=n: one(n) for n in usable]))


def skipped_buckets(train: DataFrame, predict: DataFrame, bucket: str,
                    min_train: int = MIN_TRAIN) -> DataFrame:
    """(bucket, n_train, n_predict) of the buckets whose rows to predict get no probabilities."""
    known = train.groupBy(bucket).agg(F.count(F.lit(1)).alias("n_train"))
    return (predict.groupBy(bucket).agg(F.count(F.lit(1)).alias("n_predict"))
            .join(known, bucket, "left")
            .select(bucket, F.coalesce("n_train", F.lit(0)).alias("n_train"), "n_predict")
            .where(F.col("n_train") < min_train))


def fold_probabilities(labelled: DataFrame, id_col: str, label: str, numeric: Sequence[str],
                       bucket: str, settings: Mapping[str, ForestSettings], folds: int,
                       replicates: int, seed: int, ledger: Ledger | None = None) -> DataFrame:
    """Out-of-fold probabilities: every row predicted by models that did not see it.

    With a ``ledger`` the folds that an earlier run has finished, from the same rows and settings,
    are reused.
    """
    given = {"settings": dict(settings), "features": list(numeric), "folds": folds, "replicates": replicates, "seed": seed}
    based_on = [] if ledger is None else [content(labelled.select(id_col, label, bucket, *numeric))]
    assigned = materialize(stratified_folds(labelled, id_col, [label], folds, seed), "folds")

    def one(fold: int) -> DataFrame:
        train = assigned.where(F.col("fold") != fold)
        valid = assigned.where(F.col("fold") == fold)
        known = valid.join(train.select(bucket, label).distinct(), [bucket, label], "left_semi")
        return bucket_probabilities(train, known, id_col, label, numeric, bucket, settings,
                                    replicates, seed).withColumn("fold", F.lit(fold))

    def stage(fold: int) -> DataFrame:
        return ledger.stage("fold", str(fold), given, lambda: one(fold), based_on) if ledger else one(fold)

    return union_all(run_together(labelled.sparkSession,
                               [lambda f=f: stage(f) for f in range(1, folds + 1)]))


def holdout_probabilities(labelled: DataFrame, id_col: str, label: str, numeric: Sequence[str],
                          bucket: str, settings: Mapping[str, ForestSettings], country: str,
                          name: str, fraction: float | None, replicates: int,
                          seed: int) -> DataFrame:
    """Probabilities of one country's held-out rows, trained on all others and the retained."""
    inside = labelled.where(F.col(country) == name)
    if fraction is None:
        test = inside.withColumn("is_test", F.lit(True))
    else:
        test = stratified_holdout(inside, id_col, [bucket, label], fraction, seed)
    marks = materialize(test.where("is_test").select(id_col), "holdout")
    train = labelled.join(marks, id_col, "left_anti")
    held = labelled.join(marks, id_col, "left_semi")
    known = held.join(train.select(bucket, label).distinct(), [bucket, label], "left_semi")
    return bucket_probabilities(train, known, id_col, label, numeric, bucket, settings,
                                replicates, seed).withColumn(country, F.lit(name))


def score_parameters(labelled: DataFrame, id_col: str, label: str, numeric: Sequence[str],
                     bucket: str, sets: Mapping[str, ForestSettings], folds: int,
                     replicates: int, seed: int) -> DataFrame:
    """(param_key, bucket, id, class, mean, fold): out-of-fold probabilities per set."""
    names = [r[0] for r in labelled.select(bucket).distinct().collect()]

    def one(key: str) -> DataFrame:
        return fold_probabilities(labelled, id_col, label, numeric, bucket,
                                  {n: sets[key] for n in names}, folds, replicates,
                                  seed).withColumn("param_key", F.lit(key))

    return union_all(run_together(labelled.sparkSession, [lambda k=k: one(k) for k in sets]))


# --- binary model ---------------------------------------------------------

@dataclass(frozen=True)
class BoosterSettings:
    """``max_iter`` rounds at most; ``patience`` rounds without a smaller loss end the training."""

    max_iter: int = 2000
    max_depth: int = 6
    step: float = 0.1
    patience: int = 50
    subsample: float = 0.8


def _booster(settings: BoosterSettings, seed: int, max_iter: int) -> GBTClassifier:
    return GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight",
                         maxIter=max_iter, maxDepth=settings.max_depth,
                         stepSize=settings.step, subsamplingRate=settings.subsample, seed=seed)


def stopping_round(losses: DataFrame, keys: Sequence[str], round_col: str, loss: str,
                   patience: int) -> DataFrame:
    """(keys, best_round, best_loss, last_round, stopped) of every curve of losses.

    A curve is read in the order of its rounds up to ``last_round``, the first that comes ``patience``
    rounds after the smallest loss before it (the earliest of equal ones), or else its end; NULL
    and NaN are no losses. A curve has one row a round, so a group is as long as a training.
    """
    known = losses.select(*keys, F.col(round_col).alias("__r"), F.nanvl(F.col(loss).cast("double"), F.lit(None).cast("double")).alias("__l"))
    so_far = Window.partitionBy(*keys).orderBy("__r")
    whole = Window.partitionBy(*keys)
    at = known.withColumn("__best", F.min(F.when(F.col("__l").isNotNull(), F.struct("__l", "__r"))).over(so_far))
    over = F.col("__r") - F.col("__best.__r") >= patience
    ended = at.withColumn("__stop", F.min(F.when(over, F.col("__r"))).over(whole))
    read = ended.where(F.col("__stop").isNull() | (F.col("__r") <= F.col("__stop")))
    best = F.min("__best")  # the last prefix has the smallest loss, hence the least pair
    return read.groupBy(*keys).agg(best.alias("__b"), F.max("__r").alias("last_round"),
                                   F.max(F.col("__stop").isNotNull()).alias("stopped")).select(
        *keys, F.col("__b.__r").alias("best_round"), F.col("__b.__l").alias("best_loss"), "last_round", "stopped")


def train_until(train: DataFrame, valid: DataFrame, settings: BoosterSettings, seed: int):
    """(model of the best round, losses by round, the choice).

    The loss of every round on ``valid`` comes from one pass over it. Trainings double in length
    until the rule stops one, or ``max_iter`` is reached: the first rounds of a longer training
    with the same seed are those of the shorter one, so all of them cost twice the last at most.
    """
    spark = train.sparkSession
    rounds = min(settings.max_iter, 2 * settings.patience)
    while True:
        model = _booster(settings, seed, rounds).fit(train)
        curve = [float(x) for x in model.evaluateEachIteration(valid)]
        losses = materialize(spark.createDataFrame(  # as many rows as rounds
            list(enumerate(curve, 1)), "round int, loss double"), "losses")
        choice = stopping_round(losses, [], "round", "loss", settings.patience).first()
        if rounds >= settings.max_iter or choice.stopped:
            break
        rounds = min(settings.max_iter, 2 * rounds)
    best = choice.best_round or rounds  # without any loss all rounds count
    return (model if best == rounds else _booster(settings, seed, best).fit(train)), losses, choice


def train_binary(observed: DataFrame, id_col: str, label: str, features: Sequence[str],
                 settings: BoosterSettings, seed: int):
    """(model, medians, scored test rows).

    The rows are split; the round with the smallest loss on the validation rows is chosen, its
    model scores the test rows, and as many rounds are fitted on everything.
    """
    base = observed.select(id_col, F.col(label).cast("double").alias("label"), *features)
    split = materialize(stratified_split(base, id_col, ["label"], seed), "split")
    train = split.where(F.col("split") == "train")
    medians = column_medians(train, features)
    ready = _assembled(impute_medians(split, medians, features), features)
    fitted = balanced_weights(ready.where(F.col("split") != "test"), "label")
    staged = materialize(fitted.select(id_col, "label", "weight", "split", "features"), "fit")
    stopped, _, _ = train_until(staged.where(F.col("split") == "train"),
                                     staged.where(F.col("split") == "valid"), settings, seed)
    scored = (stopped.transform(ready.where(F.col("split") == "test"))
              .select(id_col, "label", F.col("prediction").alias("predicted"),
                      vector_to_array("probability")[1].alias("score")))

    all_medians = column_medians(base, features)
    everything = materialize(
        balanced_weights(_assembled(impute_medians(base, all_medians, features), features), "label")
        .select(id_col, "label", "weight", "features"), "refit")
    model = _booster(settings, seed, stopped.getNumTrees).fit(everything)
    return model, all_medians, scored


def predict_binary(model, medians: DataFrame, rows: DataFrame, features: Sequence[str],
                   positive: str, negative: str) -> DataFrame:
    """Label, probability (4 digits) and provenance of every row."""
    scored = model.transform(_assembled(impute_medians(rows, medians, features), features))
    return scored.select(
        *rows.columns,
        F.when(F.col("prediction") == 1, positive).otherwise(negative).alias("Predicted_Anaerobic"),
        F.bround(vector_to_array("probability")[1], 4).alias("Anaerobic_Prob"),
        F.lit("Predicted").alias("Digestion_Source"))


def feature_importance(model, rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, importance), with the number of rows that carry the feature."""
    values = [float(v) for v in model.featureImportances.toArray()]
    filled = rows.agg(*[F.count(f).alias(f) for f in features]).unpivot(
        [], list(features), "feature", "n_filled")
    weight = F.element_at(F.create_map(*[x for f, v in zip(features, values)
                                         for x in (F.lit(f), F.lit(v))]), F.col("feature"))
    return filled.withColumn("importance", weight).orderBy(F.col("importance").desc())


def class_probabilities(stats: DataFrame, id_col: str, classes: Sequence[str]) -> DataFrame:
    """Statistics with the predicted class, confidence and entropy attached."""
    return stats.join(predicted_class(stats, id_col, classes), id_col)
