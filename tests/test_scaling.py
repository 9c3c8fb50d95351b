"""Work and moved rows grow no faster than the tables."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from particlelake.operators import aggregates, order_stats, preprocess, ranking, taxonomy, validity


def _plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_percentiles_of_many_columns_by_counters(spark):
    """Columns stay side by side in one row, and all of them share the passes."""
    key = F.col("id")
    value = lambda i: F.when(key % (i + 2) != 0, F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10 ** (i % 9 + 1))) * F.lit(10.0 ** (i - 20)) - i)
    names = [f"c{i}" for i in range(40)]
    df = spark.range(3_000).select(*[value(i).alias(c) for i, c in enumerate(names)])
    wanted = {c: {f"{c}_lo": 0.01, f"{c}_mid": 0.5, f"{c}_hi": 0.99} for c in names}
    found = order_stats.counted_percentiles(df, [], wanted).first().asDict()
    plain = df.agg(*[F.percentile(c, p).alias(label) for c, labels in wanted.items() for label, p in labels.items()]).first().asDict()
    assert found == pytest.approx(plain, rel=1e-12, abs=0.0)


def test_counters_are_passed_on_when_a_task_holds_too_many(spark, monkeypatch):
    df = spark.range(5_000, numPartitions=2).select((F.col("id") % 7).alias("g"), F.sqrt("id").alias("v"))
    wanted = {"v": {"lo": 0.1, "mid": 0.5}}
    expected = sorted(df.groupBy("g").agg(F.percentile("v", 0.1), F.percentile("v", 0.5)).collect())
    monkeypatch.setattr(order_stats, "DENSE_TARGETS", 0)
    assert sorted(order_stats.counted_percentiles(df, ["g"], wanted).collect()) == expected


def test_summaries_read_a_row_once_for_all_columns(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 3.0, float("nan")), ("b", None, 2.0), (None, 9.0, 9.0)], "g string, x double, y double")
    out = aggregates.numeric_summary(df, "g", ["x", "y"])
    assert "posexplode" not in _plan(out)
    assert sorted(map(tuple, out.collect())) == sorted(
        [("x", "a", 2, 2.0, 2.0, 1.0, 1.0), ("x", "b", 0, None, None, None, None), ("y", "a", 0, None, None, None, None), ("y", "b", 1, 2.0, 2.0, 0.0, 0.0)]
    )


@pytest.mark.parametrize("large", [False, True])
def test_adjusted_p_values_take_growing_frames_only(spark, large):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.02, 0.9, None, 0.03])], "id int, p double")
    out = ranking.benjamini_hochberg(df, "p", "q", large=large)
    assert "currentrow, unboundedfollowing" not in _plan(out).lower().replace("$()", "")
    found = [r["q"] for r in out.orderBy("id").collect()]
    assert found == pytest.approx([0.1 / 3 if i in (0, 1, 2) else q for i, q in enumerate([0, 0, 0, 0.9, None, 0.0375])])


def test_suggestions_move_no_entries_that_nobody_asks_for(spark):
    weights = {"p": {"x": 1.0}, "q": {"x": 0.25, "y": 1.0}, "mixed_unknown": {"y": -1.0}}
    profile = spark.createDataFrame([(1, 2.0, 0.0), (2, 0.1, 0.0), (3, 0.0, 1.0), (3, 4.0, None), (None, None, None)], "k int, x double, y double")
    out = taxonomy.taxonomy_suggestions(profile, weights, key="k")
    assert "contribution" not in _plan(out.drop("evidence_summary"))
    found = {r["k"]: r for r in out.collect()}
    assert [found[k]["primary_category"] for k in (1, 2, 3, None)] == ["p", "mixed_unknown", "p", "mixed_unknown"]
    # a repeated key takes its best places from all of its rows
    assert (found[3]["primary_score"], found[3]["secondary_score"], found[3]["secondary_category"]) == (4.0, 1.0, "q")
    assert found[1]["evidence_summary"].startswith("higher x") and found[1]["confidence"] == "high"


def test_only_candidates_are_ranked(spark):
    records = spark.createDataFrame([(1, "a", None), (2, "b", "done"), (3, "", None), (4, "c", None)], "id long, image string, taxonomy string")
    ranked = spark.range(1, 4).selectExpr(
        "id", "'ok' as status", "'p' as top_category", "'P' as top_category_label", "array('p') as ranked_categories",
        "1 as feature_count", "array('x') as used_formula_features",
    )
    updated, counts = taxonomy.backfill_taxonomy(records, ranked)
    assert "LeftSemi" in _plan(counts) and "LeftSemi" in _plan(updated)
    assert tuple(counts.first()) == (2, 1, 1, 0)
    assert {r["id"] for r in updated.where("taxonomy is not null").collect()} == {1, 2}


def test_silhouettes_are_summed_up_from_one_computation(spark):
    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    values = spark.range(100).selectExpr("cast(id % 3 as int) as cluster_label", "id / 100 as silhouette_value")
    out = validity.silhouette_summary(values.mapInArrow(counted, values.schema))
    assert sum(r["count"] for r in out.collect()) == 100 and met.value == 100


def test_distance_matrices_by_products():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(256, 64)) + 1000.0, rng.normal(size=(4_096, 64)) + 1000.0
    b[:50], b[60, 0], b[61, 0] = a[:50], np.inf, np.nan
    a[3] = a[2] + 1e-9
    began = time.perf_counter()
    total = np.zeros((len(a), len(b)))
    with np.errstate(invalid="ignore"):
        for j in range(a.shape[1]):
            gap = a[:, j][:, None] - b[:, j][None, :]
            total += gap * gap
    by_feature, began = time.perf_counter() - began, time.perf_counter()
    found = validity.distances(a, b)
    by_product = time.perf_counter() - began
    np.testing.assert_allclose(found, np.sqrt(total), rtol=1e-9, atol=0.0)
    assert by_product < by_feature / 2


@pytest.mark.parametrize("range_rows", [1_000_000, 700])
def test_rank_correlations_of_rows_without_a_key(spark, range_rows):
    """Rows may share a key; ties, nulls, both zeros and a frequent value get mean ranks in every range."""
    rng = np.random.default_rng(3)
    table = pd.DataFrame({"a": rng.normal(size=3_000), "b": rng.integers(0, 5, 3_000) / 2.0, "c": 1.0, "d": rng.integers(0, 500, 3_000) / 7.0})
    table["e"] = table["a"] + rng.normal(size=3_000)
    table.loc[::7, "e"] = None
    table.loc[::3, "d"], table.loc[::9, "d"] = 0.0, -0.0
    names = list(table.columns)
    wanted = table.fillna(-1e300).rank().corr().fillna(0.0).to_numpy()
    np.fill_diagonal(wanted, 1.0)
    df = spark.createDataFrame(table).withColumn("image_id", F.lit(1)).repartition(3)
    found = preprocess.spearman_matrix(df, names, hot_rows=range_rows).toPandas()
    np.testing.assert_allclose(found["rho"].to_numpy().reshape(5, 5), wanted, atol=1e-12)


def test_ranked_columns_travel_in_blocks(spark):
    df = spark.range(40_000).select(*[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(10 ** (i + 1))).cast("double").alias(f"c{i}") for i in range(4)])
    blocks = order_stats._value_blocks(df, df.columns).collect()
    assert sum(r["rows"] for r in blocks) == 4 * 40_000 and len(blocks) <= 4 * (40_000 // order_stats.BLOCK_ROWS + 8)


def test_final_features_read_their_source_once(spark):
    met = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            met.add(batch.num_rows)
            yield batch

    values = spark.range(600).selectExpr(
        "id as image_id", "true as roi_detected", "true as analysis_success", "true as segmentation_success",
        "cast(id % 17 as double) as num_particles", "cast(id % 23 as double) as area_median", "cast(id * id % 31 as double) as feret_p90",
    )
    final, report = preprocess.prepare_final(values.mapInArrow(counted, values.schema))
    assert final.count() == 600 and len(report["selected_columns"]) == 3 and met.value == 600
