"""Forests by tree and stacked regressions beside Spark's own fits."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from particlelake.operators import forest, models
from particlelake.operators.cluster.stacked import pack
from particlelake.operators.logistic import logistics
from particlelake.plans import cluster_queries


def _rows(codes, label, classes=3):
    return forest.BinnedRows(np.asarray(codes, np.uint8), np.asarray(label), np.zeros((len(label), 5), np.int32), classes)


def _spread(spark, rows=900):
    value = lambda i: (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(1_000)) / 1_000.0).alias(f"c{i}")
    df = spark.range(rows).select(F.col("id").alias("image_id"), *[value(i) for i in range(4)])
    noise = F.pmod(F.xxhash64("image_id", F.lit(99)), F.lit(10)) == 0
    label = F.when(noise, 2).when(F.col("c0") + 0.3 * F.col("c1") > 0.7, 0).otherwise(1)
    return df.withColumn("cluster_label", label), [f"c{i}" for i in range(4)]


def test_surrogate_query_runs_the_whole_models(spark, monkeypatch):
    """No parameter of the query makes the models smaller than the operator's."""
    asked = {}

    def kept(df, features, **options):
        asked.update(options, features=len(features))
        return spark.createDataFrame([("f0",)], "feature string"), {}

    monkeypatch.setattr(models, "surrogate_models", kept)
    cluster_queries.surrogate_models(spark, "/root/testdata/sf0.001")
    assert asked == {"features": 64}


@pytest.mark.parametrize("cells", [0, 1 << 30])
def test_splits_by_sorting_and_by_histogram_are_the_best(monkeypatch, cells):
    """A tree without bag or choice of features splits like a plain search over all cuts."""
    monkeypatch.setattr(forest, "CELLS", cells)
    rng = np.random.default_rng(4)
    codes, label = rng.integers(0, 9, (300, 1)), rng.integers(0, 3, 300)
    weight = np.array([1.0, 2.5, 0.5])
    tree = forest.grow(_rows(codes, label), np.ones(300, int), weight, rng, 30)
    w = weight[label]

    def purity(rows):
        shares = np.bincount(label[rows], w[rows], 3)
        return (shares**2).sum() / shares.sum()

    best = max(range(8), key=lambda c: purity(codes[:, 0] <= c) + purity(codes[:, 0] > c))
    assert tree.cut[0] == best
    whole = w.sum()
    gain = (purity(codes[:, 0] <= best) + purity(codes[:, 0] > best) - purity(np.ones(300, bool))) / whole
    assert tree.gain[0] == pytest.approx(gain)
    # every value has a leaf of its own or one with the same prediction
    votes = tree.votes(np.arange(9, dtype=np.uint8)[:, None])
    for c in range(9):
        if (codes[:, 0] == c).any():
            assert votes[c].argmax() == np.bincount(label[codes[:, 0] == c], w[codes[:, 0] == c], 3).argmax()


def test_both_score_routes_grow_the_same_tree(monkeypatch):
    rng = np.random.default_rng(6)
    rows = _rows(rng.integers(0, 32, (2_000, 9)), rng.integers(0, 3, 2_000))
    grown = []
    for cells in (0, 8, 1 << 30):
        monkeypatch.setattr(forest, "CELLS", cells)
        grown.append(forest.grow(rows, np.random.default_rng(1).poisson(1, 2_000), np.ones(3), np.random.default_rng(2), 30))
    for other in grown[1:]:
        assert (other.feature == grown[0].feature).all() and (other.left == grown[0].left).all() and (other.cut == grown[0].cut).all()


def test_trees_stop_at_their_depth_and_merge_equal_leaves():
    rng = np.random.default_rng(8)
    rows = _rows(rng.integers(0, 32, (500, 4)), rng.integers(0, 3, 500))
    stump = forest.grow(rows, np.ones(500, int), np.ones(3), rng, 1)
    assert len(stump.left) <= 3
    alike = _rows([[0]] * 10 + [[1]] * 10, [0] * 10 + [0] * 9 + [1])
    tree = forest.grow(alike, np.ones(20, int), np.ones(3), rng, 30)
    assert tree.left[0] == -1 and tree.importances(1).tolist() == [0.0]


def test_bins_take_all_cuts_or_equal_shares():
    assert forest.bin_edges(np.array([3.0, 1.0, 1.0, 2.0])).tolist() == [1.5, 2.5]
    assert forest.bin_edges(np.ones(5)).tolist() == []
    codes = np.searchsorted(forest.bin_edges(np.arange(3_200.0)), np.arange(3_200.0))
    assert len(set(codes)) == 32 and np.bincount(codes).max() <= 101


def test_forests_are_as_good_as_sparks(spark, monkeypatch):
    df, names = _spread(spark)
    table, summary = models.surrogate_models(df, names, trees=20, max_iter=20)
    again = models.surrogate_models(df.repartition(5), names, trees=20, max_iter=20)
    assert again[0].collect() == table.collect() and again[1]["random_forest_balanced_accuracy_mean"] == summary["random_forest_balanced_accuracy_mean"]
    monkeypatch.setattr(models, "binned_rows", lambda *_: None)
    spark_table, spark_summary = models.surrogate_models(df, names, trees=20, max_iter=20)
    name = "random_forest_balanced_accuracy_mean"
    assert summary[name] == pytest.approx(spark_summary[name], abs=0.05)
    mine, theirs = ({r["feature"]: r["random_forest_importance"] for r in t.collect()} for t in (table, spark_table))
    assert mine == pytest.approx(theirs, abs=0.06)


def test_binned_rows_count_equal_rows_and_know_their_bound(spark):
    points = spark.range(3_000).selectExpr("array(cast(id % 3 as double), 1.0D) as x", "array(1.0D) as w", "xxhash64(id) as h", "array(cast(id % 2 as int), cast(id % 5 as int)) as labels")
    packed = pack(points)
    found = forest.binned_rows(points, packed, 2, 5)
    assert found.codes.tolist() == [[c, 0] for c in (0, 1, 2) for _ in (0, 1)] and found.label.tolist() == [0, 1] * 3
    assert found.counts.tolist() == [[100] * 5] * 6
    assert forest.binned_rows(points, packed, 2, 5, most_bytes=100) is None


@pytest.mark.parametrize("scaled", [False, True])
def test_regressions_of_all_folds_are_sparks(spark, scaled):
    df, names = _spread(spark, 400)
    df = df.withColumn("c3", F.lit(5.0)).withColumn("fold", F.pmod("image_id", F.lit(5)).cast("int"))
    points = df.select(F.array(*names).alias("x"), F.array(F.lit(1.0)).alias("w"), F.xxhash64("image_id").alias("h"), F.array("cluster_label", "fold").alias("labels"))
    scores, found = logistics(pack(points), [np.array([1.0, 2.0, 0.5])] * 6, [300.0] * 6, [0.01] * 6, scaled, 200, tol=1e-10)
    assert len(scores) == 5 and all(0.2 < s <= 1 for s in scores)
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(df)
    if scaled:
        rows = StandardScaler(inputCol="features", outputCol="s", withMean=True).fit(rows).transform(rows).drop("features").withColumnRenamed("s", "features")
    rows = rows.withColumn("weight", F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(0.5)), F.col("cluster_label") + 1))
    weight = rows.agg(F.sum("weight")).first()[0]
    model = LogisticRegression(labelCol="cluster_label", weightCol="weight", family="multinomial", standardization=False, regParam=0.01 * 300.0 / weight, maxIter=500, tol=1e-12).fit(rows)
    np.testing.assert_allclose(found, model.coefficientMatrix.toArray(), atol=2e-4)
    assert RandomForestClassifier().getMaxBins() == forest.BINS


def test_jobs_of_context_models_do_not_grow_with_depth(spark):
    """Numbers and categories with gaps, labels without any pattern: trees go as deep as they may."""
    mixed = lambda i, n: F.pmod(F.xxhash64("id", F.lit(i)), F.lit(n))
    df = spark.range(600).select(
        F.col("id").alias("image_id"), mixed(0, 3).cast("int").alias("cluster_label"), mixed(1, 50).cast("double").alias("a"),
        F.when(mixed(2, 9) > 0, mixed(3, 1_000) / 7.0).alias("b"), F.when(mixed(4, 5) > 0, mixed(5, 4).cast("string")).alias("c"),
    )
    jobs = []
    for depth in (2, 14):
        spark.sparkContext.setJobGroup(f"depth-{depth}", "")
        table, summary = models.context_models(df, ["a", "b"], ["c"], trees=3, max_iter=3, max_depth=depth)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"depth-{depth}")))
        assert {r["feature"] for r in table.collect()} == {"a", "b", "c=0", "c=1", "c=2", "c=3", "c=missing"}
        assert summary["status"] == "completed" and 0.2 < summary["random_forest_balanced_accuracy_mean"] < 0.5
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]
