"""Queries over aggregations and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from particlelake.operators import aggregates as agg
from particlelake.operators import order_stats, ranking
from particlelake.plans import standins as st
from particlelake.plans.registry import query, rounded, with_ctes

_CATEGORY = "CASE WHEN {v} IS NULL THEN 'Sin datos' WHEN {v} >= 150 THEN 'Extremo' WHEN {v} >= 50 THEN 'Alto' WHEN {v} >= 20 THEN 'Moderado' WHEN {v} >= 10 THEN 'Bueno' ELSE 'Bajo' END"


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("station_id"), "ts",
        F.when(F.col("event_type") != "error", F.col("value")).alias("pm10"),
        F.when(F.col("event_type") == "click", F.col("value") / 2.0).alias("pm25"),
    )


_PERIOD_SQL = """e AS (SELECT user_id AS station_id, ts, CASE WHEN event_type <> 'error' THEN value END AS pm10,
                  CASE WHEN event_type = 'click' THEN value / 2.0::DOUBLE END AS pm25 FROM events)"""


@query(
    "period_average",
    with_ctes(
        _PERIOD_SQL,
        """a AS (SELECT station_id, avg(pm10) AS pm10, avg(pm25) AS pm25 FROM e
         WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' GROUP BY station_id)""",
        body=f"""SELECT station_id, round(pm10, 6) AS pm10, round(pm25, 6) AS pm25, round(coalesce(pm25, pm10), 6) AS concentration,
       {_CATEGORY.format(v='coalesce(pm25, pm10)')} AS pollution_category, pm10 IS NOT NULL AS has_pm10, pm25 IS NOT NULL AS has_pm25 FROM a""",
    ),
)
def period_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.period_average(_hourly(spark, sf_dir), "2024-01-05", "2024-01-20"))


@query(
    "sensor_period_average",
    with_ctes(
        _PERIOD_SQL,
        """s AS (SELECT c_custkey AS sensor_id, c_custkey % 50 AS station_id, DATE '2024-01-01' + (c_custkey % 20)::INT AS d0,
              DATE '2024-01-01' + (c_custkey % 20)::INT + (c_custkey % 4)::INT AS d1 FROM customer)""",
        body="""SELECT sensor_id, round(avg(pm10), 6) AS pm10, round(avg(pm25), 6) AS pm25
FROM s LEFT JOIN e ON s.station_id = e.station_id AND ts >= d0 AND ts < d1 + INTERVAL 1 DAY GROUP BY sensor_id""",
    ),
)
def sensor_period_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = st.table(spark, sf_dir, "customer")
    begin = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 20).cast("int"))
    sensors = c.select(
        F.col("c_custkey").alias("sensor_id"), (F.col("c_custkey") % 50).alias("station_id"), begin.alias("start_date"),
        F.date_add(begin, (F.col("c_custkey") % 4).cast("int")).alias("end_date"),
    )
    return rounded(agg.sensor_period_average(sensors, _hourly(spark, sf_dir)).select("sensor_id", "pm10", "pm25"))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = st.table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.cast("string").alias("image_id"),
        F.when(key % 9 == 0, F.lit("")).otherwise(F.concat(F.lit("s"), key % 400)).alias("sensor_id"),
        F.when(key % 31 != 0, F.lit(40.0) + (key * 7 % 90) / 1000.0).alias("latitude"),
        (F.lit(-3.0) + (key * 7 % 90) / 3000.0).alias("longitude"),
        key.alias("ord"),
    )


_LOCATED_SQL = """located AS (SELECT c_custkey AS ord, CASE WHEN c_custkey % 9 = 0 THEN c_custkey::VARCHAR ELSE 's' || c_custkey % 400 END AS owner,
   CASE WHEN c_custkey % 31 <> 0 THEN 40.0::DOUBLE + (c_custkey * 7 % 90)::DOUBLE / 1000.0::DOUBLE END AS latitude,
   -3.0::DOUBLE + (c_custkey * 7 % 90)::DOUBLE / 3000.0::DOUBLE AS longitude FROM customer)"""


@query(
    "unique_locations",
    with_ctes(
        _LOCATED_SQL,
        body="""SELECT printf('%.6f,%.6f', latitude, longitude) AS location_key, round(arg_max(latitude, ord), 9) AS latitude,
       round(arg_max(longitude, ord), 9) AS longitude, count(DISTINCT owner) AS sensor_count
FROM located WHERE latitude IS NOT NULL GROUP BY 1""",
    ),
)
def unique_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.unique_locations(_located(spark, sf_dir), "ord"), 9)


@query(
    "location_sensors",
    with_ctes(
        _LOCATED_SQL,
        body="SELECT DISTINCT printf('%.6f,%.6f', latitude, longitude) AS location_key, owner AS sensor_id FROM located WHERE latitude IS NOT NULL",
    ),
)
def location_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.location_sensors(_located(spark, sf_dir))


# fixed word map that turns part words into place types
PLACE_WORDS = {
    "red": "bus_station", "blue": "park", "green": "gas_station", "small": "parking", "large": "storage_depot",
    "bolt": "Highway_ramp", "ring": "train_station", "widget": "cafe",
}


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = st.table(spark, sf_dir, "part")
    words = F.split("p_name", " ")
    mapping = F.create_map(*[F.lit(x) for pair in PLACE_WORDS.items() for x in pair])
    types = F.transform(words, lambda w: F.coalesce(F.try_element_at(mapping, w), w))
    return part.select(
        F.col("p_brand").alias("location_key"), F.concat(types, F.array(F.lower("p_type"))).alias("types")
    )


_WORDS_SQL = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PLACE_WORDS.items()) + " ELSE w END"

_PLACES_SQL = f"""placed AS (SELECT p_partkey, p_brand AS location_key, unnest(string_split(p_name, ' ')) AS w FROM part),
types AS (SELECT p_partkey, location_key, {_WORDS_SQL} AS t FROM placed),
flags AS (SELECT p_partkey, location_key,
   bool_or(t IN ('transit_station', 'bus_station', 'train_station', 'subway_station', 'light_rail_station')) AS transit,
   bool_or(t = 'park') AS park, bool_or(t = 'gas_station') AS gas_station, bool_or(t = 'parking') AS parking,
   bool_or(lower(t) LIKE '%industrial%' OR lower(t) LIKE '%warehouse%' OR lower(t) LIKE '%storage%' OR lower(t) LIKE '%logistics%') AS industrial,
   bool_or(lower(t) LIKE '%route%' OR lower(t) LIKE '%intersection%' OR lower(t) LIKE '%highway%') AS major_road_proxy
   FROM types GROUP BY ALL),
counts AS (SELECT location_key,
   count(*) FILTER (transit OR park OR gas_station OR parking OR industrial OR major_road_proxy) AS total,
   count(*) FILTER (transit) AS transit, count(*) FILTER (park) AS park, count(*) FILTER (gas_station) AS gas_station,
   count(*) FILTER (parking) AS parking, count(*) FILTER (industrial) AS industrial,
   count(*) FILTER (major_road_proxy) AS major_road_proxy FROM flags GROUP BY ALL),
located AS (SELECT s_suppkey::VARCHAR AS sensor_id, 'Brand#' || (s_suppkey % 30) AS location_key FROM supplier),
joined AS (SELECT sensor_id, location_key, coalesce(total, 0) AS total, coalesce(transit, 0) AS transit, coalesce(park, 0) AS park,
   coalesce(gas_station, 0) AS gas_station, coalesce(parking, 0) AS parking, coalesce(industrial, 0) AS industrial,
   coalesce(major_road_proxy, 0) AS major_road_proxy FROM located LEFT JOIN counts USING (location_key)),
long AS (SELECT sensor_id, unnest([transit, park, gas_station, parking, industrial, major_road_proxy]) AS n,
   unnest(['transit', 'park', 'gas_station', 'parking', 'industrial', 'major_road_proxy']) AS category, unnest(range(6)) AS ord FROM joined),
summary AS (SELECT sensor_id, coalesce(arg_max(category, n * 10 - ord) FILTER (n > 0), '') AS dominant_place_category,
   -sum(n / t * log2(n / t)) FILTER (n > 0) AS entropy
   FROM (SELECT *, sum(n) OVER (PARTITION BY sensor_id) AS t FROM long) GROUP BY sensor_id)"""


@query(
    "place_features",
    with_ctes(
        _PLACES_SQL,
        body="""SELECT joined.*, dominant_place_category, round(abs(entropy), 6) AS place_diversity_entropy,
       round(CASE WHEN transit + gas_station + parking + major_road_proxy > 0 THEN park / (transit + gas_station + parking + major_road_proxy) END, 6) AS green_vs_traffic_ratio_500m
FROM joined JOIN summary USING (sensor_id)""",
    ),
)
def place_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = st.table(spark, sf_dir, "supplier")
    locations = s.select(
        F.col("s_suppkey").cast("string").alias("sensor_id"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 30).alias("location_key")
    )
    out = agg.place_features(locations, _places(spark, sf_dir))
    return rounded(out.withColumn("place_diversity_entropy", F.abs("place_diversity_entropy")))


@query(
    "processing_summary",
    """SELECT count(*) AS processed_records, count(*) FILTER (event_type = 'click') AS successful_analyses,
       count(*) FILTER (event_type = 'view') AS roi_failures, count(*) FILTER (event_type = 'error') AS missing_images,
       count(*) FILTER (event_type NOT IN ('click', 'view', 'error')) AS other_failures FROM events""",
)
def processing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "click", "success").when(kind == "view", "roi_not_detected")
        .when(kind == "error", "image_not_available").otherwise(kind)
    )
    return agg.processing_summary(st.table(spark, sf_dir, "events").select(status.alias("status")))


_LABELS_SQL = "a AS (SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster_label FROM embeddings)"


@query(
    "cluster_counts",
    with_ctes(
        _LABELS_SQL,
        body="""SELECT cluster_label, count(*) AS count, round(count(*) / (SELECT count(*) FROM a), 6) AS fraction,
       cluster_label = -1 AS is_noise FROM a GROUP BY cluster_label""",
    ),
)
def cluster_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.cluster_counts(st.labelled_space(spark, sf_dir).select("image_id", "cluster_label")))


@query(
    "cluster_distribution",
    with_ctes(
        _LABELS_SQL,
        body="""SELECT string_agg(cluster_label || ':' || n, ',' ORDER BY cluster_label = -1, cluster_label) AS distribution
FROM (SELECT cluster_label, count(*) AS n FROM a GROUP BY cluster_label)""",
    ),
)
def cluster_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.cluster_distribution(st.labelled_space(spark, sf_dir).select("image_id", "cluster_label"))
    pairs = F.transform("cluster_size_distribution", lambda s: F.concat(s["label"], F.lit(":"), s["count"]))
    return out.select(F.array_join(pairs, ",").alias("distribution"))


@query(
    "numeric_summary",
    """WITH long AS (SELECT l_returnflag, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS variable,
         unnest([CASE WHEN l_returnflag <> 'N' THEN l_quantity END, l_extendedprice, l_discount]) AS v FROM lineitem)
SELECT variable, l_returnflag, count(v) AS count, round(avg(v), 6) AS mean, round(median(v), 6) AS median,
       round(stddev_pop(v), 6) AS std, round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) AS iqr
FROM long GROUP BY ALL""",
)
def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = st.table(spark, sf_dir, "lineitem").select(
        "l_returnflag", F.when(F.col("l_returnflag") != "N", F.col("l_quantity")).alias("l_quantity"), "l_extendedprice", "l_discount"
    )
    return rounded(agg.numeric_summary(li, "l_returnflag", ["l_quantity", "l_extendedprice", "l_discount"]))


@query(
    "contingency",
    """WITH long AS (SELECT o_orderstatus, unnest(['priority', 'flag']) AS variable,
         unnest([o_orderpriority, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'P' THEN 'even' WHEN o_custkey % 3 = 0 THEN ' ' ELSE 'odd' END]) AS category FROM orders),
kept AS (SELECT * FROM long WHERE trim(category) <> ''),
cells AS (SELECT * FROM (SELECT DISTINCT variable, category FROM kept), (SELECT DISTINCT o_orderstatus FROM orders)),
n AS (SELECT variable, category, o_orderstatus, count(*) AS n FROM kept GROUP BY ALL)
SELECT variable, category, o_orderstatus, coalesce(n, 0) AS count,
       round(coalesce(n, 0) / sum(n) OVER (PARTITION BY variable, o_orderstatus), 6) AS fraction_within_cluster
FROM cells LEFT JOIN n USING (variable, category, o_orderstatus)""",
)
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.contingency(context_orders(spark, sf_dir), "o_orderstatus", ["priority", "flag"])
    return rounded(out.select("variable", "category", "o_orderstatus", "count", "fraction_within_cluster"))


def context_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = st.table(spark, sf_dir, "orders")
    flag = (
        F.when((F.col("o_custkey") % 2 == 0) & (F.col("o_orderstatus") != "P"), "even")
        .when(F.col("o_custkey") % 3 == 0, " ").otherwise("odd")
    )
    return o.select("o_orderkey", "o_orderstatus", F.col("o_orderpriority").alias("priority"), flag.alias("flag"))


def _supplier_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("SUP-"), F.col("l_suppkey")).alias("sensor_id"), F.col("l_orderkey").alias("image_id"),
        F.col("l_quantity").alias("area_median"), F.col("l_extendedprice").alias("feret_p90"),
    )


@query(
    "sensor_profile",
    """WITH m AS (SELECT 'SUP-' || l_suppkey AS s, l_quantity, l_extendedprice FROM lineitem WHERE 'SUP-' || l_suppkey LIKE '%P-3%')
SELECT 'ok' AS status, 'p-3' AS query, count(*) AS matched_rows,
       array_to_string(list_sort(list(DISTINCT s))[1:20], '|') AS matched_sensor_ids,
       round(median(l_quantity), 6) AS area_median, round(median(l_extendedprice), 6) AS feret_p90 FROM m""",
)
def sensor_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.sensor_profile(_supplier_features(spark, sf_dir), "p-3", ["area_median", "feret_p90"])
    return rounded(out.withColumn("matched_sensor_ids", F.array_join("matched_sensor_ids", "|")))


@query(
    "sensor_profiles",
    """SELECT 'SUP-' || l_suppkey AS sensor_id, count(*) AS matched_rows, round(median(l_quantity), 6) AS area_median,
       round(median(l_extendedprice), 6) AS feret_p90 FROM lineitem GROUP BY l_suppkey""",
)
def sensor_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agg.sensor_profiles(_supplier_features(spark, sf_dir), ["area_median", "feret_p90"]))


@query(
    "column_stats",
    """SELECT unnest(['l_quantity', 'l_discount', 'constant', 'missing']) AS feature,
       unnest([round(avg(l_quantity), 6), round(avg(l_discount), 6), 3.0, 0.0]) AS mean,
       unnest([round(stddev_pop(l_quantity), 6), round(stddev_pop(l_discount), 6), 1.0, 1.0]) AS std,
       unnest([count(*), count(*), count(*), 0]) AS values FROM lineitem""",
)
def column_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = st.table(spark, sf_dir, "lineitem").select(
        "l_quantity", F.col("l_discount").cast("string").alias("l_discount"), F.lit(3.0).alias("constant"), F.lit("pending").alias("missing")
    )
    return rounded(agg.column_stats(li, ["l_quantity", "l_discount", "constant", "missing"]))


_REVIEW_SQL = """WITH g AS (
  SELECT o_orderkey AS image_id, round(least(1.0, (o_totalprice % 1000) / 1000), 9) AS score, o_totalprice % 77 / 77.0::DOUBLE AS conf,
         CASE o_orderstatus WHEN 'F' THEN 'grid' WHEN 'O' THEN 'no_grid' ELSE 'uncertain' END AS label, o_custkey % 10 = 0 AS review FROM orders),
b AS (SELECT *, 1 AS bucket, score AS k FROM g WHERE label = 'no_grid' UNION ALL SELECT *, 2, -score FROM g WHERE label = 'grid'
      UNION ALL SELECT *, 3, abs(score - 0.42::DOUBLE) FROM g WHERE label = 'uncertain' OR review),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY k, conf DESC, image_id) AS rank_in_bucket FROM b)
SELECT image_id, bucket, rank_in_bucket FROM r WHERE rank_in_bucket <= 40
QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY bucket) = 1"""


@query("review_sample", _REVIEW_SQL)
def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = st.table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    rows = o.select(
        F.col("o_orderkey").alias("image_id"),
        F.round(F.least(F.lit(1.0), (F.col("o_totalprice") % 1000) / 1000), 9).alias("roi_grid_score"),
        (F.col("o_totalprice") % 77 / 77.0).alias("roi_grid_confidence"),
        F.when(status == "F", "grid").when(status == "O", "no_grid").otherwise("uncertain").alias("roi_grid_label"),
        (F.col("o_custkey") % 10 == 0).alias("roi_grid_needs_review"),
    )
    return ranking.review_sample(rows, 40).select("image_id", "bucket", "rank_in_bucket")


@query(
    "average_rank",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_quantity,
       rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS avg_rank
FROM lineitem""",
)
def average_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = st.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity")
    return order_stats.average_rank(li, "l_quantity", ["l_returnflag"])


@query(
    "benjamini_hochberg",
    """WITH p AS (SELECT l_partkey AS variable, CASE WHEN l_partkey % 10 <> 0 THEN round(exp(-sum(l_discount) * 8), 12) END AS p FROM lineitem GROUP BY l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY p IS NULL ORDER BY p) AS k, count(*) OVER (PARTITION BY p IS NULL) AS n FROM p)
SELECT variable, round(p, 9) AS p, CASE WHEN p IS NOT NULL THEN
   round(min(least(1.0, p * n / k)) OVER (PARTITION BY p IS NULL ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 9) END AS p_bh FROM r""",
)
def benjamini_hochberg(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (
        st.table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("variable"))
        .agg(F.round(F.exp(-F.sum("l_discount") * 8), 12).alias("p"))
        .withColumn("p", F.when(F.col("variable") % 10 != 0, F.col("p")))
    )
    return rounded(ranking.benjamini_hochberg(p, "p", "p_bh"), 9)


@query(
    "benchmark_rankings",
    with_ctes(
        st.BENCHMARK_SQL,
        """e AS (SELECT candidate_id, unnest(['top_by_silhouette', 'top_by_calinski_harabasz', 'top_by_davies_bouldin', 'top_by_repeat_stability', 'top_by_bootstrap_stability']) AS ranking,
              unnest([silhouette_score, calinski_harabasz_score, davies_bouldin_score, repeat_mean_ari, bootstrap_mean_ari]) AS value,
              unnest([-silhouette_score, -calinski_harabasz_score, davies_bouldin_score, -repeat_mean_ari, -bootstrap_mean_ari]) AS k
         FROM results WHERE num_clusters >= 2)""",
        body="""SELECT ranking, candidate_id, round(value, 6) AS value, row_number() OVER (PARTITION BY ranking ORDER BY k, candidate_id) AS rank
FROM e WHERE value IS NOT NULL QUALIFY rank <= 10""",
    ),
)
def benchmark_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.benchmark_rankings(st.benchmark_results(spark, sf_dir))
    return rounded(out.select("ranking", "candidate_id", "value", "rank"))


@query(
    "minmax_normalize",
    """SELECT p_partkey, round((p_retailprice - min(p_retailprice) OVER ()) / (max(p_retailprice) OVER () - min(p_retailprice) OVER ()), 6) AS normalized_p_retailprice,
       round((max(p_size) OVER () - p_size) / (max(p_size) OVER () - min(p_size) OVER ()), 6) AS normalized_p_size, 1.0::DOUBLE AS normalized_constant FROM part""",
)
def minmax_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = st.table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"), F.lit(2.0).alias("constant"))
    out = ranking.minmax_normalize(part, {"p_retailprice": True, "p_size": False, "constant": True})
    return rounded(out.select("p_partkey", "normalized_p_retailprice", "normalized_p_size", "normalized_constant"))
