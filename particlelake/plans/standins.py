"""Sensor tables derived from the given star-schema tables.

Each stand-in keeps every row of its source table and only renames or rescales
columns; the SQL twin below each function is used by the DuckDB oracles.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def raw_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured regions before the shape filter: one per line item."""
    li = table(spark, sf_dir, "lineitem")
    minor = (F.col("l_linenumber") - 1).cast("double")
    return li.select(
        F.col("l_orderkey").alias("image_id"),
        F.col("l_suppkey").alias("sensor_id"),
        F.col("l_quantity").alias("area_px"),
        (F.col("l_tax") * 500.0).alias("perimeter_px"),
        F.sqrt(F.col("l_quantity") * 4.0 / math.pi).alias("equivalent_diameter_px"),
        (F.col("l_quantity") / 4.0).alias("major_axis_length_px"),
        minor.alias("minor_axis_length_px"),
        (1.0 - F.col("l_discount")).alias("solidity"),
        (1.0 - F.col("l_tax") * 5.0).alias("eccentricity"),
        (F.col("l_extendedprice") / 1900.0).alias("feret_diameter_max_px"),
        ((F.col("l_discount") * 10.0 - 0.5) * math.pi).alias("orientation_rad"),
        (F.col("l_discount") * 1000.0 + F.col("l_tax") * 100.0).alias("mean_intensity"),
    )


RAW_PARTICLES_SQL = f"""
raw_particles AS (
  SELECT l_orderkey AS image_id, l_suppkey AS sensor_id, l_quantity AS area_px,
         l_tax * 500.0::DOUBLE AS perimeter_px,
         sqrt(l_quantity * 4.0::DOUBLE / {math.pi!r}::DOUBLE) AS equivalent_diameter_px,
         l_quantity / 4.0::DOUBLE AS major_axis_length_px,
         (l_linenumber - 1)::DOUBLE AS minor_axis_length_px,
         1.0::DOUBLE - l_discount AS solidity,
         1.0::DOUBLE - l_tax * 5.0::DOUBLE AS eccentricity,
         l_extendedprice / 1900.0::DOUBLE AS feret_diameter_max_px,
         (l_discount * 10.0::DOUBLE - 0.5::DOUBLE) * {math.pi!r}::DOUBLE AS orientation_rad,
         l_discount * 1000.0::DOUBLE + l_tax * 100.0::DOUBLE AS mean_intensity
  FROM lineitem)"""


def shaped_particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item with a mild aspect ratio, nothing filtered."""
    return raw_particles(spark, sf_dir).select(
        "image_id", "sensor_id", "area_px", "solidity",
        (1.0 + F.col("perimeter_px") / 25.0).alias("aspect_ratio"),
        "feret_diameter_max_px", "equivalent_diameter_px", "eccentricity",
        F.least(F.lit(1.0), F.col("area_px") / 50.0).alias("circularity"),
        "mean_intensity", "orientation_rad",
    )


SHAPED_PARTICLES_SQL = RAW_PARTICLES_SQL + """,
particles AS (
  SELECT image_id, sensor_id, area_px, solidity, 1.0::DOUBLE + perimeter_px / 25.0::DOUBLE AS aspect_ratio,
         feret_diameter_max_px, equivalent_diameter_px, eccentricity,
         least(1.0::DOUBLE, area_px / 50.0::DOUBLE) AS circularity, mean_intensity, orientation_rad
  FROM raw_particles)"""


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image metadata: one row per order, also for orders without any particle."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("image_id"),
        F.col("o_custkey").alias("sensor_id"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("capture_datetime"),
        F.lit(1000000.0).alias("roi_area_px"),
        (F.col("o_totalprice") / 2000.0).alias("mean_pixel_intensity"),
        (F.col("o_totalprice") % 97.0).alias("std_pixel_intensity"),
    )


IMAGES_SQL = """
images AS (
  SELECT o_orderkey AS image_id, o_custkey AS sensor_id, strftime(o_orderdate, '%Y-%m-%d') AS capture_datetime,
         1000000.0::DOUBLE AS roi_area_px, o_totalprice / 2000.0::DOUBLE AS mean_pixel_intensity,
         o_totalprice % 97.0::DOUBLE AS std_pixel_intensity
  FROM orders)"""


def sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors with a position; every fiftieth has none."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    placed = key % 50 != 49
    return c.select(
        key.alias("sensor_id"),
        F.col("c_name").alias("nombre"),
        F.when(placed, F.lit(36.0) + (key * 7919 % 8000) / 1000.0).alias("latitude"),
        F.when(placed, F.lit(-9.0) + (key * 104729 % 12000) / 1000.0).alias("longitude"),
        F.col("c_acctbal").alias("value"),
        F.col("c_mktsegment").alias("segment"),
    )


SENSORS_SQL = """
sensors AS (
  SELECT c_custkey AS sensor_id, c_name AS nombre,
         CASE WHEN c_custkey % 50 <> 49 THEN 36.0::DOUBLE + (c_custkey * 7919 % 8000)::DOUBLE / 1000.0::DOUBLE END AS latitude,
         CASE WHEN c_custkey % 50 <> 49 THEN -9.0::DOUBLE + (c_custkey * 104729 % 12000)::DOUBLE / 1000.0::DOUBLE END AS longitude,
         c_acctbal AS value, c_mktsegment AS segment
  FROM customer)"""


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    key = F.col("s_suppkey")
    return s.select(
        key.alias("id"),
        F.col("s_name").alias("name"),
        (F.lit(36.0) + (key * 6151 % 8000) / 1000.0).alias("lat"),
        (F.lit(-9.0) + (key * 86243 % 12000) / 1000.0).alias("long"),
        (F.col("s_acctbal") / 100.0).alias("pm10"),
        (F.col("s_acctbal") / 250.0).alias("pm25"),
        F.concat(F.lit("2024-01-"), F.lpad((key % 28 + 1).cast("string"), 2, "0")).alias("fetched_at"),
        key.alias("ord"),
    )


STATIONS_SQL = """
stations AS (
  SELECT s_suppkey AS id, s_name AS name,
         36.0::DOUBLE + (s_suppkey * 6151 % 8000)::DOUBLE / 1000.0::DOUBLE AS lat,
         -9.0::DOUBLE + (s_suppkey * 86243 % 12000)::DOUBLE / 1000.0::DOUBLE AS long,
         s_acctbal / 100.0::DOUBLE AS pm10, s_acctbal / 250.0::DOUBLE AS pm25,
         '2024-01-' || lpad((s_suppkey % 28 + 1)::VARCHAR, 2, '0') AS fetched_at, s_suppkey AS ord
  FROM supplier)"""

DIMENSIONS = 64


def feature_names(dims: int = DIMENSIONS) -> list[str]:
    return [f"f{i}" for i in range(dims)]


def labelled_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature matrix with cluster labels; label 9 plays the noise."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("image_id"),
        F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")).cast("int").alias("cluster_label"),
        *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(DIMENSIONS)],
    )


LABELLED_LONG_SQL = """
space AS (
  SELECT vec_id AS image_id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster_label, embedding
  FROM embeddings),
long AS (
  SELECT image_id, cluster_label, 'f' || (unnest(range(64)))::VARCHAR AS feature,
         unnest(embedding)::DOUBLE AS value
  FROM space)"""


def benchmark_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate metrics: one candidate per customer nation and market segment."""
    c = table(spark, sf_dir, "customer")
    count_of = lambda label: F.count_if(F.col("c_custkey") % 5 == label)
    g = c.groupBy("c_nationkey", "c_mktsegment").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("c_acctbal").alias("mean_bal"),
        F.min("c_acctbal").alias("min_bal"),
        F.max("c_acctbal").alias("max_bal"),
        *[count_of(i).alias(f"n{i}") for i in range(5)],
    )
    method = F.element_at(F.array(*[F.lit(m) for m in METHODS]), (F.col("c_nationkey") % 5 + 1).cast("int"))
    sizes = F.filter(
        F.array(
            *[F.struct(F.lit(i).cast("int").alias("label"), F.col(f"n{i}").alias("count")) for i in range(1, 5)],
            F.struct(F.lit(-1).cast("int").alias("label"), F.col("n0").alias("count")),
        ),
        lambda s: s["count"] > 0,
    )
    clusters = F.filter(sizes, lambda s: s["label"] != -1)
    return g.select(
        F.concat_ws("__", "c_mktsegment", method, F.concat(F.lit("k-"), F.col("c_nationkey"))).alias("candidate_id"),
        F.col("c_mktsegment").alias("feature_space"),
        method.alias("method"),
        F.lit("").alias("method_variant"),
        F.size(clusters).cast("long").alias("num_clusters"),
        (F.col("n0") / F.col("n")).alias("noise_fraction"),
        (F.array_min(F.transform(clusters, lambda s: s["count"])) / F.col("n")).alias("smallest_cluster_fraction"),
        F.when(F.col("n") % 7 != 0, F.col("mean_bal") / 20000.0).alias("silhouette_score"),
        F.when(F.col("n") % 3 != 0, F.col("max_bal")).alias("calinski_harabasz_score"),
        (F.col("min_bal") / -400.0).alias("davies_bouldin_score"),
        F.when(F.col("n") % 5 != 0, 1.0 - F.col("n") / 4000.0).alias("repeat_mean_ari"),
        F.when(F.col("n") % 4 != 0, 1.0 - F.col("n") / 3000.0).alias("bootstrap_mean_ari"),
        sizes.alias("cluster_size_distribution"),
    )


METHODS = ("kmeans", "ward", "gmm", "fuzzy", "hdbscan")

BENCHMARK_SQL = """
g AS (
  SELECT c_nationkey, c_mktsegment, count(*) AS n, avg(c_acctbal) AS mean_bal, min(c_acctbal) AS min_bal,
         max(c_acctbal) AS max_bal,
         count(*) FILTER (c_custkey % 5 = 0) AS n0, count(*) FILTER (c_custkey % 5 = 1) AS n1,
         count(*) FILTER (c_custkey % 5 = 2) AS n2, count(*) FILTER (c_custkey % 5 = 3) AS n3,
         count(*) FILTER (c_custkey % 5 = 4) AS n4
  FROM customer GROUP BY ALL),
results AS (
  SELECT c_mktsegment || '__' || method || '__k-' || c_nationkey AS candidate_id,
         c_mktsegment AS feature_space, method,
         list_filter([n1, n2, n3, n4], lambda x: x > 0) AS sizes,
         len(list_filter([n1, n2, n3, n4], lambda x: x > 0)) AS num_clusters,
         n0 / n AS noise_fraction,
         list_min(list_filter([n1, n2, n3, n4], lambda x: x > 0)) / n AS smallest_cluster_fraction,
         CASE WHEN n % 7 <> 0 THEN mean_bal / 20000.0::DOUBLE END AS silhouette_score,
         CASE WHEN n % 3 <> 0 THEN max_bal END AS calinski_harabasz_score,
         min_bal / -400.0::DOUBLE AS davies_bouldin_score,
         CASE WHEN n % 5 <> 0 THEN 1.0::DOUBLE - n / 4000.0::DOUBLE END AS repeat_mean_ari,
         CASE WHEN n % 4 <> 0 THEN 1.0::DOUBLE - n / 3000.0::DOUBLE END AS bootstrap_mean_ari
  FROM (SELECT *, ['kmeans', 'ward', 'gmm', 'fuzzy', 'hdbscan'][c_nationkey % 5 + 1] AS method FROM g))"""
