"""Surrogate classifiers that explain cluster labels."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from particlelake.functions import scalar
from particlelake.operators.cluster.stacked import pack, row_hash
from particlelake.operators.forest import binned_rows, forests
from particlelake.operators.logistic import logistics
from particlelake.operators.order_stats import aggregate_with_percentiles
from particlelake.operators.records import with_row_position
from particlelake.runtime import quoted

FOLDS = 5
#: Training rows of a task: fewer than the first do not pay for a task of their own, more than the second make too large ones.
FEWEST_ROWS, MOST_ROWS = 512, 200_000
#: The deepest trees, as in Spark.
MAX_DEPTH = 30


def with_folds(df: DataFrame, label: str, key: str, seed: int, folds: int = FOLDS) -> DataFrame:
    """Stratified folds: rows are dealt out in the order of class and hashed key.

    Rows of a class follow one another, so each class is spread evenly. Positions
    come from ranges, whatever the size of a class.
    """
    mixed = df.withColumn("__h", F.xxhash64(quoted(key), F.lit(seed)))
    placed = with_row_position(mixed, [label, "__h", key], "__position")
    return placed.withColumn("fold", F.pmod(F.col("__position"), F.lit(folds)).cast("int")).drop("__h", "__position")


def class_weights(sizes: dict[float, int]) -> Column:
    """Weight n / (classes x class size) by ``label``, for a few classes of known sizes."""
    total = sum(sizes.values())
    return F.create_map(*[F.lit(x) for label, n in sorted(sizes.items()) for x in (label, total / (len(sizes) * n))])[F.col("label")]


def training_rows(vectors: DataFrame, key: str, seed: int) -> tuple[DataFrame, dict[int, dict[float, int]]]:
    """Rows with their folds, dealt to enough tasks for the cluster, and the class sizes of every fold.

    A few rows would otherwise share one task, and so would all levels of a forest.
    """
    placed = with_folds(vectors, "label", key, seed)
    sizes: dict[int, dict[float, int]] = {}
    for r in placed.groupBy("fold", "label").count().collect():
        sizes.setdefault(r["fold"], {})[r["label"]] = r["count"]
    rows = sum(n for found in sizes.values() for n in found.values())
    most = vectors.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(most, rows // FEWEST_ROWS), -(-rows // MOST_ROWS))
    # the order inside a task decides on the subsamples of trees; that of the folds is kept
    order = ["label", F.xxhash64(quoted(key), F.lit(seed)), quoted(key), "fold"]
    return placed.repartition(tasks, F.xxhash64(quoted(key))).sortWithinPartitions(*order), sizes


def _summed(sizes: dict[int, dict[float, int]], without: int | None = None) -> dict[float, int]:
    total: Counter = Counter()
    for fold, found in sizes.items():
        if fold != without:
            total.update(found)
    return dict(total)


def balanced_accuracy(predicted: DataFrame, label: str = "label") -> float:
    """Mean recall over the classes that occur."""
    recalls = predicted.groupBy(label).agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("recall"))
    return recalls.agg(F.avg("recall")).first()[0]


def _large_forests(
    placed: DataFrame, sizes: dict[int, dict[float, int]], trees: int, seed: int, max_depth: int
) -> tuple[list[float], np.ndarray]:
    """The forests of rows that no task can hold, by Spark's passes over all rows."""
    model = RandomForestClassifier(
        numTrees=trees, seed=seed, weightCol="weight", maxDepth=max_depth, featureSubsetStrategy="sqrt"
    )
    scores = []
    for fold in range(FOLDS):
        train = placed.where(F.col("fold") != fold).withColumn("weight", class_weights(_summed(sizes, without=fold)))
        scores.append(balanced_accuracy(model.fit(train).transform(placed.where(F.col("fold") == fold))))
    whole = model.fit(placed.withColumn("weight", class_weights(_summed(sizes))))
    return scores, whole.featureImportances.toArray()


def _evaluate(
    placed: DataFrame, sizes: dict[int, dict[float, int]], names: Sequence[str], key: str, trees: int, seed: int,
    max_iter: int, max_depth: int, scaled: bool,
) -> tuple[DataFrame, dict]:
    """Cross-validated accuracy of both models and their feature influence; ``sizes`` are those of the classes by fold.

    All folds of a model share their passes. With ``scaled`` the regression takes values in units of their spread.
    """
    whole = _summed(sizes)
    trained = [*[_summed(sizes, without=fold) for fold in range(FOLDS)], whole]
    classes = len(whole)
    weights = [np.array([sum(t.values()) / (len(t) * t[c]) if c in t else 0.0 for c in sorted(whole)]) for t in trained]
    rows = sum(whole.values())
    totals = [sum(t.values()) for t in trained]
    regs = [1.0 / (rows * (FOLDS - 1) / FOLDS)] * FOLDS + [1.0 / rows]
    points = placed.select(
        vector_to_array("features").alias("x"), F.array(F.lit(1.0)).alias("w"), row_hash(key).alias("h"),
        F.array(F.col("label").cast("int"), "fold").alias("labels"),
    )
    packed = pack(points)
    binned = binned_rows(points, packed, classes, FOLDS)
    if binned is None:
        forest, importance = _large_forests(placed, sizes, trees, seed, max_depth)
    else:
        forest, importance = forests(binned, weights, packed, trees, seed, max_depth)
    logistic, coefficients = logistics(packed, weights, totals, regs, scaled, max_iter)
    influence = np.abs(coefficients).mean(axis=0)
    table = placed.sparkSession.createDataFrame(
        [(n, float(importance[i]), float(influence[i])) for i, n in enumerate(names)],
        "feature string, random_forest_importance double, logistic_abs_mean_coefficient double",
    ).orderBy(F.col("random_forest_importance").desc(), F.col("logistic_abs_mean_coefficient").desc(), "feature")
    summary = {"status": "completed"}
    for name, values in (("random_forest", forest), ("logistic", logistic)):
        summary[f"{name}_balanced_accuracy_mean"] = float(np.mean(values))
        summary[f"{name}_balanced_accuracy_std"] = float(np.std(values))
    return table, summary


def _labelled(df: DataFrame, label: str) -> DataFrame | None:
    """Adds a 0..K-1 ``label`` column, or None with fewer than two classes."""
    known = sorted(r[0] for r in df.select(quoted(label)).distinct().collect())
    if len(known) < 2:
        return None
    mapping = F.create_map(*[F.lit(x) for i, old in enumerate(known) for x in (old, float(i))])
    return df.withColumn("label", mapping[quoted(label)])


def surrogate_models(
    df: DataFrame,
    features: Sequence[str],
    label: str = "cluster_label",
    key: str = "image_id",
    seed: int = 7,
    trees: int = 400,
    max_iter: int = 3000,
    max_depth: int = MAX_DEPTH,
) -> tuple[DataFrame | None, dict]:
    """Random forest and logistic regression on non-noise rows."""
    rows = _labelled(df.where(quoted(label) != -1), label)
    if rows is None:
        return None, {"status": "skipped", "reason": "fewer than two non-noise clusters are available"}
    vector = VectorAssembler(inputCols=list(features), outputCol="features").transform(rows)
    placed, sizes = training_rows(vector.select(key, "label", "features"), key, seed)
    ready = placed.persist()
    try:
        return _evaluate(ready, sizes, features, key, trees, seed, max_iter, max_depth, scaled=False)
    finally:
        ready.unpersist()


def context_models(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str = "cluster_label",
    key: str = "image_id",
    seed: int = 7,
    trees: int = 400,
    max_iter: int = 5000,
    exclude_noise: bool = False,
    max_depth: int = MAX_DEPTH,
) -> tuple[DataFrame | None, dict]:
    """Predict clusters from context: medians and ``missing`` fill the gaps."""
    if not numeric and not categorical:
        return None, {"status": "skipped", "reason": "no contextual predictor columns are available"}
    base = df.where(quoted(label) != -1) if exclude_noise else df
    rows = _labelled(base, label)
    if rows is None:
        return None, {"status": "skipped", "reason": "fewer than two clusters are available after preprocessing"}
    numbers = rows.select(*[scalar.finite(quoted(c)).alias(c) for c in numeric])
    medians = aggregate_with_percentiles(numbers, [], {c: {c: 0.5} for c in numeric}).first().asDict() if numeric else {}
    filled = rows.select(
        quoted(key), "label",
        *[F.coalesce(scalar.finite(quoted(c)), F.lit(medians[c] if medians[c] is not None else 0.0)).alias(c) for c in numeric],
        *[F.coalesce(scalar.non_blank(quoted(c).cast("string")), F.lit("missing")).alias(c) for c in categorical],
    )
    names, inputs = list(numeric), list(numeric)
    for c in categorical:
        indexer = StringIndexer(inputCol=c, outputCol=f"__i_{c}", stringOrderType="alphabetAsc").fit(filled)
        filled = OneHotEncoder(inputCol=f"__i_{c}", outputCol=f"__o_{c}", dropLast=False).fit(indexer.transform(filled)).transform(
            indexer.transform(filled)
        )
        names += [f"{c}={v}" for v in indexer.labels]
        inputs.append(f"__o_{c}")
    vector = VectorAssembler(inputCols=inputs, outputCol="features").transform(filled).select(key, "label", "features")
    placed, sizes = training_rows(vector, key, seed)
    ready = placed.persist()
    try:
        return _evaluate(ready, sizes, names, key, trees, seed, max_iter, max_depth, scaled=True)
    finally:
        ready.unpersist()
