"""Queries over joins and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from particlelake.operators import joins as ops
from particlelake.plans import standins as st
from particlelake.plans.registry import query, rounded, with_ctes

_NEAREST_SQL = with_ctes(
    st.SENSORS_SQL,
    st.STATIONS_SQL,
    """d AS (SELECT s.sensor_id, t.*,
       2 * 6371.0088::DOUBLE * asin(sqrt(pow(sin(radians(t.lat - s.latitude) / 2), 2)
         + cos(radians(s.latitude)) * cos(radians(t.lat)) * pow(sin(radians(t.long - s.longitude) / 2), 2))) AS km
     FROM sensors s, stations t WHERE s.latitude IS NOT NULL)""",
    "b AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY sensor_id ORDER BY km, ord) = 1)",
    body="""SELECT s.sensor_id, b.id AS official_station_id, b.name AS official_station_name,
       round(b.km, 6) AS official_station_distance_km, round(b.pm10, 6) AS official_pm10,
       round(b.pm25, 6) AS official_pm25, b.fetched_at AS official_fetched_at
FROM sensors s LEFT JOIN b USING (sensor_id)""",
)


@query("nearest_station", _NEAREST_SQL)
def nearest_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    sensors = st.sensors(spark, sf_dir).select("sensor_id", "latitude", "longitude")
    return rounded(ops.nearest_station(sensors, st.stations(spark, sf_dir)).drop("latitude", "longitude"))


@query("nearest_station_by_cell", _NEAREST_SQL)
def nearest_station_by_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by the route taken when there are many stations."""
    sensors = st.sensors(spark, sf_dir).select("sensor_id", "latitude", "longitude")
    found = ops.nearest_station(sensors, st.stations(spark, sf_dir), array_rows=0)
    return rounded(found.drop("latitude", "longitude"))


def _place_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two place rows per even customer; the higher version must win."""
    c = st.table(spark, sf_dir, "customer").where(F.col("c_custkey") % 2 == 0)
    versions = c.select("c_custkey", "c_acctbal", "c_mktsegment", F.explode(F.array(F.lit(1), F.lit(2))).alias("version"))
    return versions.select(
        F.when(F.col("c_custkey") % 3 == 0, F.lit("")).otherwise(F.col("c_custkey").cast("string")).alias("sensor_id"),
        F.col("c_custkey").cast("string").alias("image_id"),
        (F.col("c_acctbal") * F.col("version")).alias("total"),
        F.when(F.col("c_acctbal") > 0, F.lit(1.5)).alias("place_diversity_entropy"),
        F.when(F.col("version") == 2, F.col("c_mktsegment")).alias("dominant_place_category"),
        "version",
    )


@query(
    "join_places",
    """SELECT o_orderkey AS image_id, c.c_custkey IS NOT NULL AS places_matched, round(c_acctbal * 2, 6) AS total,
       CASE WHEN c_acctbal > 0 THEN 1.5::DOUBLE END AS place_diversity_entropy, coalesce(c_mktsegment, '') AS dominant_place_category
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) c ON o_custkey = c.c_custkey""",
)
def join_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = st.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image_id"), F.col("o_custkey").alias("sensor_id"))
    out = ops.join_places(features, _place_rows(spark, sf_dir), "version")
    return rounded(out.select("image_id", "places_matched", "total", "place_diversity_entropy", "dominant_place_category"))


_RESOLVED_SQL = """WITH m AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'grid' WHEN quality = 1 THEN ' no_grid ' ELSE ' ' END AS hand FROM labels),
r AS (SELECT d.doc_id AS image_id, coalesce(trim(hand), '') AS hand,
        CASE WHEN lang = 'en' THEN 'grid' WHEN lang = 'fr' THEN 'uncertain' WHEN lang = 'de' THEN 'no_grid' ELSE '' END AS guess
      FROM documents d LEFT JOIN m USING (doc_id))
SELECT image_id, guess AS roi_grid_label, hand AS manual_grid_label,
       CASE WHEN hand <> '' THEN hand WHEN guess = 'grid' THEN 'grid' WHEN guess IN ('no_grid', 'uncertain') THEN 'no_grid' ELSE 'unknown' END AS final_grid_label,
       CASE WHEN hand <> '' THEN 'manual_label' WHEN guess = 'grid' THEN 'predicted_grid'
            WHEN guess IN ('no_grid', 'uncertain') THEN 'predicted_non_grid_rule' ELSE 'missing_prediction' END AS final_grid_label_source
FROM r"""


@query("resolve_labels", _RESOLVED_SQL)
def resolve_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = st.table(spark, sf_dir, "documents"), st.table(spark, sf_dir, "labels")
    rows = docs.select(F.col("doc_id").alias("image_id"))
    lang = F.col("lang")
    predicted = docs.select(
        F.col("doc_id").alias("image_id"),
        F.when(lang == "en", "grid").when(lang == "fr", "uncertain").when(lang == "de", "no_grid").otherwise("").alias("roi_grid_label"),
    )
    manual = labels.select(
        F.col("doc_id").alias("image_id"),
        F.when(F.col("toxic") == 1, "grid").when(F.col("quality") == 1, " no_grid ").otherwise(" ").alias("manual_grid_label"),
    )
    return ops.resolve_labels(rows, manual, predicted)


@query(
    "label_counts",
    f"""WITH f AS ({_RESOLVED_SQL})
SELECT 'final_grid_label' AS column, final_grid_label AS value, count(*) AS count FROM f GROUP BY ALL
UNION ALL SELECT 'final_grid_label_source', final_grid_label_source, count(*) FROM f GROUP BY ALL""",
)
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.label_counts(resolve_labels(spark, sf_dir))


@query(
    "keep_ids",
    """SELECT l_orderkey AS image_id, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')""",
)
def keep_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = st.table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select(F.col("o_orderkey").alias("image_id"))
    particles = st.table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "image_id")
    return ops.keep_ids(kept, {"particles": particles}, columns={"particles": ("image_id", "l_linenumber", "l_partkey")})["particles"]


@query(
    "align_feature_spaces",
    """SELECT vec_id AS image_id, embedding[1]::DOUBLE AS pc1, embedding[2]::DOUBLE AS pc2, embedding[3]::DOUBLE AS f2
FROM embeddings WHERE label <> 0""",
)
def align_feature_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = st.labelled_space(spark, sf_dir)
    scores = space.where("cluster_label <> 0").select("image_id", F.col("f0").alias("PC1"), F.col("f1").alias("PC2"))
    out = ops.align_feature_spaces({"selected_features": space.select("image_id", "f2", "f3"), "pca_scores": scores})
    return out.select(
        "image_id", F.col("`pca_scores.PC1`").alias("pc1"), F.col("`pca_scores.PC2`").alias("pc2"),
        F.col("`selected_features.f2`").alias("f2"),
    )


@query(
    "align_labels",
    """SELECT vec_id AS image_id, embedding[1]::DOUBLE AS PC1, embedding[2]::DOUBLE AS PC2, label % 4 AS cluster_label
FROM embeddings WHERE vec_id % 3 <> 0 AND vec_id % 7 <> 0""",
)
def align_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = st.table(spark, sf_dir, "embeddings")
    first = F.col("embedding")[0].cast("double")
    points = e.select(
        F.col("vec_id").alias("image_id"),
        F.when(F.col("vec_id") % 7 != 0, first).alias("PC1"),
        F.col("embedding")[1].cast("double").alias("PC2"),
    )
    labels = e.where(F.col("vec_id") % 3 != 0).select(F.col("vec_id").alias("image_id"), (F.col("label") % 4).alias("cluster_label"))
    return ops.align_labels(points, labels, projection=("PC1", "PC2")).select("image_id", "PC1", "PC2", "cluster_label")


@query(
    "lookup_join",
    """SELECT o_orderkey, o_custkey, coalesce(c_mktsegment, '') AS segment, round(c_acctbal, 6) AS balance
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 3) ON o_custkey = c_custkey""",
)
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = st.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lookup = st.table(spark, sf_dir, "customer").where("c_nationkey <> 3").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )
    return rounded(ops.lookup_join(orders, lookup, "o_custkey"))


def _merge_sql(second_wins: bool) -> str:
    pick = "coalesce(b.status, a.status)" if second_wins else "coalesce(a.status, b.status)"
    return f"""WITH a AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE o_orderkey % 3 <> 0),
b AS (SELECT o_orderkey AS id, o_orderpriority AS status FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(a.id, b.id) AS id, {pick} AS status FROM a FULL JOIN b ON a.id = b.id"""


def _collections(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    orders = st.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").alias("id")
    return [
        orders.where("o_orderkey % 3 <> 0").select(key, F.col("o_orderstatus").alias("status")),
        orders.where("o_orderkey % 2 = 0").select(key, F.col("o_orderpriority").alias("status")),
    ]


@query("merge_collections_last", _merge_sql(True))
def merge_collections_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.merge_collections(_collections(spark, sf_dir), prefer="last")


@query("merge_collections_first", _merge_sql(False))
def merge_collections_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.merge_collections(_collections(spark, sf_dir), prefer="first")


def _upsert_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = st.table(spark, sf_dir, "customer")
    target = c.where("c_custkey % 5 <> 0").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("pm10"),
        F.lit("2024").alias("fetched_at"),
    )
    updates = c.where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal")).alias("pm10"),
    )
    return target, updates


_UPSERT_SQL = """WITH t AS (SELECT c_custkey AS id, c_name AS name, c_acctbal AS pm10, '2024' AS fetched_at FROM customer WHERE c_custkey % 5 <> 0),
u AS (SELECT c_custkey AS id, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END AS pm10 FROM customer WHERE c_custkey % 2 = 0),
m AS (SELECT coalesce(t.id, u.id) AS id, coalesce(u.name, t.name) AS name,
        CASE WHEN u.id IS NOT NULL THEN u.pm10 ELSE t.pm10 END AS pm10, fetched_at,
        CASE WHEN u.id IS NOT NULL AND t.id IS NULL THEN 'inserted'
             WHEN u.id IS NOT NULL AND (u.pm10 IS DISTINCT FROM t.pm10) THEN 'modified'
             WHEN u.id IS NOT NULL THEN 'matched' ELSE 'kept' END AS action
      FROM t FULL JOIN u ON t.id = u.id)
"""


@query("upsert", _UPSERT_SQL + "SELECT * FROM m")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, updates = _upsert_inputs(spark, sf_dir)
    return ops.upsert(target, updates, "id", ["name", "pm10"])


@query(
    "upsert_report",
    _UPSERT_SQL + """SELECT count(*) FILTER (action IN ('matched', 'modified')) AS matched, count(*) FILTER (action = 'modified') AS modified,
       count(*) FILTER (action = 'inserted') AS inserted, count(*) AS total FROM m""",
)
def upsert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, updates = _upsert_inputs(spark, sf_dir)
    return ops.upsert_report(ops.upsert(target, updates, "id", ["name", "pm10"]))


@query(
    "upsert_known_only",
    """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN CASE WHEN c_custkey % 4 = 0 THEN c_acctbal END ELSE c_acctbal END AS pm10
FROM customer WHERE c_custkey % 5 <> 0""",
)
def upsert_known_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, updates = _upsert_inputs(spark, sf_dir)
    return ops.upsert(target, updates, "id", ["pm10"], insert=False).select("id", "pm10")


@query(
    "tag_and_union",
    """SELECT c_custkey AS id, c_name AS name, 'diy' AS type FROM customer
UNION ALL SELECT s_suppkey, s_name, 'official' FROM supplier""",
)
def tag_and_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    diy = st.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    official = st.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return ops.tag_and_union(diy, official)
