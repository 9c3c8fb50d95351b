"""Queries over clusterers, stability, models, streams and images."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from particlelake.operators import models
from particlelake.operators.cluster import density, mixture, partition, reduction, stability
from particlelake.operators.pixels import image_pixel_stats
from particlelake.operators.ranking import top_loadings
from particlelake.operators.validity import adjusted_rand
from particlelake.plans import standins as st
from particlelake.plans.analysis_queries import image_context
from particlelake.plans.record_queries import VALIDATE_SQL, submitted_records
from particlelake.plans.registry import query, rounded
from particlelake.runtime import checkpoint_root
from particlelake.streaming import ingest

FEATURES = st.feature_names()


def _space(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.labelled_space(spark, sf_dir).select("image_id", *FEATURES)


def _sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster_label").agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("membership_strength"), 4).alias("mean_strength")
    )


@query("pca_scores")
def pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.pca(st.labelled_space(spark, sf_dir), st.feature_names(), 0.85).scores


@query("pca_variance")
def pca_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduction.pca(st.labelled_space(spark, sf_dir), st.feature_names(), 0.85).variance


@query("top_loadings")
def loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = reduction.pca(st.labelled_space(spark, sf_dir), st.feature_names(), 0.85)
    return top_loadings(result.loadings, ["PC1", "PC2", "PC3"], 5)


@query("kmeans")
def kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.kmeans(4)(_space(spark, sf_dir), FEATURES, 7)[0]


@query("ward_micro")
def ward_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.ward(4)(_space(spark, sf_dir), FEATURES, 7)[0]


@query("gmm_full")
def gmm_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.gmm(3, "full")(_space(spark, sf_dir), FEATURES, 7)[0]


@query("gmm_diag")
def gmm_diag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.gmm(3, "diag")(_space(spark, sf_dir), FEATURES, 7)[0]


@query("fuzzy_cmeans")
def fuzzy_cmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.fuzzy_cmeans(3)(_space(spark, sf_dir), FEATURES, 7)[0]


@query(
    "density_clusters",
    """WITH RECURSIVE p AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
size AS (SELECT greatest(10, ceil(0.02 * count(*)))::BIGINT AS m FROM embeddings),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.e, b.e) AS d FROM p a JOIN p b ON a.vec_id <> b.vec_id),
core AS (SELECT a AS vec_id, d AS core FROM d, size QUALIFY row_number() OVER (PARTITION BY a ORDER BY d) = m),
radius AS (SELECT quantile_cont(core, 0.5) AS eps FROM core),
dense AS (SELECT vec_id, core FROM core, radius WHERE core <= eps),
link AS (SELECT a, b FROM d, radius WHERE d <= eps AND a IN (SELECT vec_id FROM dense) AND b IN (SELECT vec_id FROM dense)),
reach AS (SELECT vec_id AS a, vec_id AS b FROM dense UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a AS vec_id, min(b) AS root FROM reach GROUP BY a),
sized AS (SELECT root, row_number() OVER (ORDER BY root) AS number FROM (SELECT root, count(*) AS n FROM root GROUP BY root), size WHERE n >= m),
scored AS (SELECT vec_id, number, CASE WHEN core > 0 THEN min(core) OVER (PARTITION BY number) / core ELSE 1 END AS strength FROM root JOIN sized USING (root) JOIN dense USING (vec_id))
SELECT vec_id AS image_id, coalesce(number, -1)::INTEGER AS cluster_label, round(coalesce(strength, 0), 6)::DOUBLE AS membership_strength
FROM embeddings LEFT JOIN scored USING (vec_id)""",
)
def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.density_clusters()(_space(spark, sf_dir), FEATURES, 7)[0])


@query(
    "core_distances",
    """WITH p AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
d AS (SELECT a.vec_id, list_distance(a.e, b.e) AS d FROM p a JOIN p b ON a.vec_id <> b.vec_id)
SELECT vec_id AS id, round(d, 6) AS core FROM d QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d) = 10""",
)
def core_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _space(spark, sf_dir).select(F.col("image_id").alias("id"), F.array(*FEATURES).alias("x"))
    return rounded(density.core_distances(points, 10))


@query("repeat_stability")
def repeat_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean, std = stability.repeat_stability(_space(spark, sf_dir), FEATURES, partition.kmeans(3), 10, 7)
    return spark.createDataFrame([(mean, std)], "repeat_mean_ari double, repeat_std_ari double")


@query("bootstrap_stability")
def bootstrap_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    space, fit = _space(spark, sf_dir), partition.kmeans(3)
    labels = fit(space, FEATURES, 7)[0]
    mean, std = stability.bootstrap_stability(space, FEATURES, fit, labels, 10, 7)
    return spark.createDataFrame([(mean, std)], "bootstrap_mean_ari double, bootstrap_std_ari double")


@query("benchmark_candidates")
def benchmark_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of both spaces with the operators' defaults."""
    space = _space(spark, sf_dir)
    spaces = {"selected_features": space, "pca_scores": reduction.pca(space, FEATURES, 0.85).scores}
    return stability.benchmark(spaces, stability.candidate_grid(spaces), silhouette_mode="exact")[0]


@query(
    "assignments",
    """SELECT vec_id AS image_id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster_label, 'pca_scores__gmm__k-9__covariance-diag' AS candidate_id,
       'pca_scores' AS feature_space, 'gmm' AS method, 'diag' AS method_variant, label = 9 AS noise_flag,
       CASE WHEN label <> 9 THEN round(1.0 / (label + 1), 6) END AS membership_strength FROM embeddings""",
)
def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = st.labelled_space(spark, sf_dir)
    strength = F.when(F.col("cluster_label") >= 0, 1.0 / (F.col("cluster_label") + 1)).otherwise(F.lit(float("inf")))
    labels = space.select("image_id", "cluster_label", strength.alias("membership_strength"))
    candidate = stability.Candidate("pca_scores", "gmm", 9, "diag")
    return rounded(stability.assignments(space.select("image_id"), labels, candidate))


@query("kmeans_against_labels")
def kmeans_against_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of a clustering of all dimensions with the given labels."""
    space = st.labelled_space(spark, sf_dir)
    labels = partition.kmeans(10)(space.drop("cluster_label"), st.feature_names(), 7)[0]
    score = adjusted_rand(space.select("image_id", "cluster_label"), labels)
    return spark.createDataFrame([(score,)], "adjusted_rand_index double")


def _with_accuracies(table: DataFrame, summary: dict) -> DataFrame:
    """Influence of every feature beside the cross-validated accuracies of both models."""
    numbers = {name: F.round(F.lit(value), 6) for name, value in summary.items() if isinstance(value, float)}
    return table.withColumns(numbers)


@query("surrogate_models")
def surrogate_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = st.labelled_space(spark, sf_dir).select("image_id", "cluster_label", *FEATURES)
    return _with_accuracies(*models.surrogate_models(space, FEATURES))


@query("context_models")
def context_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = image_context(spark, sf_dir).withColumn("cluster_label", (F.col("official_pm25") / 14).cast("int"))
    month = F.substring("capture_datetime", 6, 2)
    rows = rows.withColumn("capture_season", F.when(F.col("record_pm10").isNotNull(), month))
    return _with_accuracies(
        *models.context_models(rows, ["record_pm10", "record_pm25", "official_pm10"], ["capture_season"], trees=10, max_iter=30)
    )


# --- streams --------------------------------------------------------------------
def _work_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = st.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


@query("ingest_records_stream", VALIDATE_SQL)
def ingest_records_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream; good and rejected rows are read back."""
    base = _work_folder(spark, "ingest")
    stream = submitted_records(_event_stream(spark, sf_dir))
    ingest.ingest_records_stream(stream, f"{base}/good", f"{base}/bad", f"{base}/state").awaitTermination()
    good = spark.read.parquet(f"{base}/good").withColumn("rejection", F.lit(None).cast("string"))
    bad = spark.read.parquet(f"{base}/bad")
    columns = ("id", "rejection", "pm10", "contours")
    return rounded(good.select(*columns).unionByName(bad.select(*columns)))


@query(
    "upsert_values_stream",
    """WITH l AS (SELECT user_id, arg_max(value, event_id) AS v, max(event_id) AS latest FROM events GROUP BY user_id)
SELECT s_suppkey AS id, CASE WHEN l.user_id IS NOT NULL THEN CASE WHEN v > 2 THEN round(v, 6) END ELSE round(s_acctbal, 6) END AS pm10,
  coalesce(latest, -1) AS fetched_at
FROM supplier LEFT JOIN l ON s_suppkey = user_id""",
)
def upsert_values_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations, refreshed by the event stream."""
    base = _work_folder(spark, "refresh")
    stations = st.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("pm10"), F.lit(-1).cast("long").alias("fetched_at"))
    ingest.write_snapshot(stations, f"{base}/stations")
    updates = _event_stream(spark, sf_dir).select(
        F.col("user_id").alias("id"), F.when(F.col("value") > 2, F.col("value")).otherwise(F.lit(float("nan"))).alias("pm10"),
        F.col("event_id").alias("fetched_at"),
    )
    ingest.upsert_values_stream(updates, f"{base}/stations", "id", ["pm10", "fetched_at"], f"{base}/state").awaitTermination()
    return rounded(ingest.read_snapshot(spark, f"{base}/stations").select("id", "pm10", "fetched_at"))


# --- images ---------------------------------------------------------------------
def vector_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One 8 x 8 colour image and mask per embedding row."""
    e = st.table(spark, sf_dir, "embeddings")
    level = F.transform("embedding", lambda v: F.least(F.greatest(F.floor(v.cast("double") * 256 + 128), F.lit(0)), F.lit(255)).cast("int"))
    placed = e.select(F.col("vec_id").alias("origin"), level.alias("p"))
    byte = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    pixel = lambda i: F.concat(
        byte(F.get(F.col("p"), i)), byte(F.get(F.col("p"), F.lit(63) - i)), byte(F.get(F.col("p"), F.pmod(i + 16, F.lit(64))))
    )
    data = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(63)), pixel), "")
    mask = F.array_join(F.transform("p", lambda v: F.when(v > 128, F.lit("FF")).otherwise(F.lit("00"))), "")
    return placed.select(
        "origin", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("nChannels"),
        F.unhex(data).alias("data"), F.unhex(mask).alias("mask"),
    )


@query(
    "image_pixel_stats",
    """WITH p AS (SELECT vec_id AS origin, list_transform(embedding, lambda v: least(greatest(floor(v::DOUBLE * 256 + 128), 0), 255)) AS p FROM embeddings),
x AS (SELECT origin, p[i + 1] AS b, p[64 - i] AS g, p[(i + 16) % 64 + 1] AS r, p[i + 1] > 128 AS m FROM p, (SELECT unnest(range(64)) AS i)),
y AS (SELECT *, r - g AS rg, 0.5 * (r + g) - b AS yb, greatest(r, g, b) AS v,
        CASE WHEN greatest(r, g, b) > 0 THEN round_even(255.0 * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b), 0) ELSE 0 END AS s FROM x)
SELECT origin, round(avg(b), 6) AS roi_b_mean, round(stddev_pop(b), 6) AS roi_b_std, round(avg(g), 6) AS roi_g_mean, round(stddev_pop(r), 6) AS roi_r_std,
  round(avg(v), 6) AS roi_v_mean, round(avg(s), 6) AS roi_s_mean,
  round(sqrt(var_pop(rg) + var_pop(yb)) + 0.3 * sqrt(pow(avg(rg), 2) + pow(avg(yb), 2)), 6) AS colorfulness,
  round((abs(avg(b) FILTER (m) - avg(b) FILTER (NOT m)) + abs(avg(g) FILTER (m) - avg(g) FILTER (NOT m)) + abs(avg(r) FILTER (m) - avg(r) FILTER (NOT m))) / 3, 6) AS particle_mask_mean_rgb_contrast,
  round(abs(avg(v) FILTER (m) - avg(v) FILTER (NOT m)), 6) AS particle_mask_mean_v_contrast
FROM y GROUP BY origin""",
)
def pixel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = image_pixel_stats(vector_images(spark, sf_dir), mask="mask")
    return rounded(
        out.select(
            "origin", "roi_b_mean", "roi_b_std", "roi_g_mean", "roi_r_std", "roi_v_mean", "roi_s_mean", "colorfulness",
            "particle_mask_mean_rgb_contrast", "particle_mask_mean_v_contrast",
        )
    )
