"""Queries over records, scalar rules and filters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from particlelake import fixed_values as fv
from particlelake.functions import scalar
from particlelake.operators import records as ops
from particlelake.plans import standins as st
from particlelake.plans.registry import query, rounded, with_ctes
from particlelake.sources.files import normalize_extended_json


@query(
    "normalize_extended_json",
    """SELECT event_id, CASE WHEN k % 3 = 0 THEN 'id' || k ELSE k::VARCHAR END AS id,
       k::DOUBLE AS k, k * 2 AS big, (k / 4.0::DOUBLE) AS inner_value
FROM (SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events)""",
)
def normalize_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = st.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    text = F.concat(
        F.lit('{"id": '),
        F.when(k.cast("long") % 3 == 0, F.concat(F.lit('{"$oid": "id'), k, F.lit('"}'))).otherwise(k),
        F.lit(', "k": '),
        F.when(k.cast("long") % 2 == 0, F.concat(F.lit('{"$numberDouble": "'), k, F.lit('"}'))).otherwise(k),
        F.lit(', "big": {"$numberLong": "'), (k.cast("long") * 2).cast("string"),
        F.lit('"}, "inner": {"value": {"$numberDecimal": "'), (k.cast("long") / 4.0).cast("string"), F.lit('"}}}'),
    )
    docs = events.select("event_id", F.parse_json(text).alias("doc"))
    out = normalize_extended_json(
        docs, "doc", {"id": "string", "k": "double", "big": "bigint", "inner.value": "double"}
    )
    return out.withColumnRenamed("inner.value", "inner_value")


def _raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw records whose amounts use changing spellings."""
    o = st.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    amount = F.round(F.col("o_totalprice") / 3000.0, 2)
    return o.select(
        F.lpad(key.cast("string"), 24, "0").alias("_id"),
        F.when(key % 4 == 0, amount.cast("string")).alias("PM2.5"),
        F.when(key % 4 == 1, F.concat(amount.cast("string"), F.lit(" ug"))).alias("pm25"),
        F.when(key % 3 == 0, F.lit("")).when(key % 3 == 1, F.lit("7.5")).alias("PM10"),
        F.when(key % 5 != 0, F.lit("3.25")).alias("Concentracion estándar"),
        F.when(key % 7 != 0, (key % 90).cast("string")).alias("Localización latitud"),
        F.when(key % 11 != 0, (key % 180).cast("string")).alias("Localizacion longitud"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Fecha de inicio"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("Fecha de recogida"),
    )


def _label_sql(value: str) -> str:
    parts = [f"WHEN {value} IS NULL OR {value} < 0 THEN '{fv.NO_DATA_LABEL}'"]
    *bounded, (_, _, last) = fv.POLLUTION_LABELS
    parts += [f"WHEN {value} {'<=' if inc else '<'} {bound} THEN '{label}'" for bound, inc, label in bounded]
    return "CASE " + " ".join(parts) + f" ELSE '{last}' END"


@query(
    "sensor_view",
    f"""WITH r AS (
  SELECT *, CASE WHEN o_orderkey % 4 < 2 THEN round(o_totalprice / 3000.0::DOUBLE, 2) END AS p25,
         CASE WHEN o_orderkey % 3 = 1 THEN 7.5::DOUBLE END AS p10,
         CASE WHEN o_orderkey % 5 <> 0 THEN 3.25::DOUBLE END AS legacy FROM orders)
SELECT lpad(o_orderkey::VARCHAR, 24, '0') AS id,
       'Sensor ' || right(lpad(o_orderkey::VARCHAR, 24, '0'), 6) AS nombre,
       CASE WHEN o_orderkey % 7 <> 0 THEN (o_orderkey % 90)::DOUBLE ELSE -1000.0 END AS latitud,
       CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 180)::DOUBLE ELSE -1000.0 END AS longitud,
       coalesce(p25, p10, legacy, 0.0) AS concentracion, coalesce(p25, legacy) AS pm25, coalesce(p10, legacy) AS pm10,
       {_label_sql('coalesce(p25, p10, legacy)')} AS nivel,
       strftime(o_orderdate, '%Y-%m-%d') AS inicio
FROM r""",
)
def sensor_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = ops.sensor_view(_raw_records(spark, sf_dir))
    number = lambda c: F.when(F.isnan(c), F.lit(-1000.0)).otherwise(F.col(c))
    return view.select(
        "id", "nombre",
        number("ubicacion.latitud").alias("latitud"), number("ubicacion.longitud").alias("longitud"),
        "metricas.concentracion", "metricas.pm25", "metricas.pm10",
        F.col("nivelPolucion").alias("nivel"), F.col("fechaInicio").alias("inicio"),
    )


@query(
    "project_fields",
    """SELECT lpad(o_orderkey::VARCHAR, 24, '0') AS id,
       CASE WHEN o_orderkey % 3 = 1 THEN 7.5::DOUBLE WHEN o_orderkey % 5 <> 0 THEN 3.25::DOUBLE END AS pm10 FROM orders""",
)
def project_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = ops.sensor_view(_raw_records(spark, sf_dir))
    return ops.project_fields(view, ["id", "metricas.pm10", "metricas.unknown", "nothing"]).select("id", "metricas.pm10")


@query(
    "to_float",
    """SELECT p_partkey, CASE WHEN p_partkey % 6 = 0 THEN p_retailprice WHEN p_partkey % 6 = 1 THEN p_size::DOUBLE END AS strict_value,
       CASE WHEN p_partkey % 6 = 0 THEN p_retailprice WHEN p_partkey % 6 IN (1, 2) THEN p_size::DOUBLE END AS prefix_value,
       CASE WHEN p_partkey % 6 = 0 THEN p_retailprice WHEN p_partkey % 6 = 1 THEN p_size::DOUBLE END AS taxonomy_value
FROM part""",
)
def to_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = st.table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 6
    text = (
        F.when(kind == 0, F.col("p_retailprice").cast("string"))
        .when(kind == 1, F.concat(F.lit("  "), F.col("p_size").cast("string"), F.lit(" ")))
        .when(kind == 2, F.concat(F.col("p_size").cast("string"), F.col("p_name")))
        .when(kind == 3, F.lit("nan"))
        .when(kind == 4, F.lit("pending"))
    )
    return part.select(
        "p_partkey",
        scalar.to_float(text).alias("strict_value"),
        scalar.to_float(text, "prefix").alias("prefix_value"),
        scalar.to_float(text, "taxonomy").alias("taxonomy_value"),
    )


@query(
    "to_bool",
    """SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE quality = 1 END AS quality_flag, toxic <> 0 AS toxic_flag FROM labels""",
)
def to_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = st.table(spark, sf_dir, "labels")
    on = F.col("quality") == 1
    kind = F.col("doc_id") % 4
    text = (
        F.when(kind == 0, F.when(on, F.lit(" TRUE ")).otherwise(F.lit("False")))
        .when(kind == 1, F.when(on, F.lit("1")).otherwise(F.lit("0")))
        .when(kind == 2, F.when(on, F.lit("Yes")).otherwise(F.lit("no ")))
        .otherwise(F.lit("maybe"))
    )
    return labels.select("doc_id", scalar.to_bool(text).alias("quality_flag"), scalar.number_to_bool(F.col("toxic")).alias("toxic_flag"))


_CATEGORY_SQL = "CASE WHEN {v} >= 150 THEN 'Extremo' WHEN {v} >= 50 THEN 'Alto' WHEN {v} >= 20 THEN 'Moderado' WHEN {v} >= 10 THEN 'Bueno' ELSE 'Bajo' END"


@query(
    "pollution_category",
    f"""SELECT event_id, CASE WHEN v IS NULL THEN 'Sin datos' ELSE {_CATEGORY_SQL.format(v='v')} END AS station_category,
       m AS map_category,
       CASE WHEN lower(m) LIKE '%extremo%' THEN '#d73027' WHEN lower(m) LIKE '%alto%' THEN '#fc8d59'
            WHEN lower(m) LIKE '%moderado%' THEN '#fee08b' WHEN lower(m) LIKE '%bueno%' THEN '#91cf60'
            WHEN lower(m) LIKE '%bajo%' THEN '#1a9850' ELSE '#999' END AS color
FROM (SELECT event_id, v, CASE WHEN v > 0 THEN {_CATEGORY_SQL.format(v='v')}
                     WHEN event_type NOT IN ('error', 'view') THEN event_type ELSE 'SinDatos' END AS m
      FROM (SELECT *, CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'click' THEN value - 15 ELSE value * 3 END AS v FROM events))""",
)
def pollution_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = st.table(spark, sf_dir, "events")
    kind = F.col("event_type")
    value = F.when(kind == "click", F.col("value") - 15).when(kind != "error", F.col("value") * 3)
    label = F.when(kind == "error", F.lit("Sin datos")).when(kind != "view", kind).otherwise(F.lit(""))
    category = scalar.map_category(value, label)
    return events.select(
        "event_id",
        scalar.station_category(value).alias("station_category"),
        category.alias("map_category"),
        scalar.category_color(category).alias("color"),
    )


@query(
    "normalize_model_type",
    """SELECT p_partkey, CASE WHEN p_partkey % 4 IN (1, 2) THEN 'PM25' ELSE 'PM10' END AS model_type FROM part""",
)
def normalize_model_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = st.table(spark, sf_dir, "part")
    kind = F.col("p_partkey") % 4
    text = (
        F.when(kind == 0, F.lit(" pm_10 ")).when(kind == 1, F.lit("Pm 2,5")).when(kind == 2, F.lit("PM2.5"))
        .otherwise(F.col("p_type"))
    )
    return part.select("p_partkey", scalar.model_type(text).alias("model_type"))


@query(
    "spatiotemporal_filter",
    with_ctes(
        st.SENSORS_SQL,
        """d AS (SELECT o_orderkey AS id, s.sensor_id, latitude, longitude, o_orderdate AS d,
              pow(sin(radians(latitude - 40.4168) / 2), 2)
              + cos(radians(40.4168)) * cos(radians(latitude)) * pow(sin(radians(longitude + 3.7038) / 2), 2) AS a
            FROM orders JOIN sensors s ON o_custkey = s.sensor_id)""",
        body="""SELECT id, sensor_id FROM d
WHERE latitude IS NOT NULL AND 6371 * 2 * atan2(sqrt(a), sqrt(1 - a)) <= 250
  AND (id % 10 = 0 OR (d >= TIMESTAMP '1996-01-01' AND d + INTERVAL 10 DAY <= TIMESTAMP '1998-12-31 23:59:59.999'))
  AND id % 5 <> 0""",
    ),
)
def spatiotemporal_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, sensors = st.table(spark, sf_dir, "orders"), st.sensors(spark, sf_dir)
    key = F.col("o_orderkey")
    bad = key % 10 == 0
    shown = orders.join(sensors, orders["o_custkey"] == sensors["sensor_id"]).select(
        key.alias("id"), "sensor_id", "latitude", "longitude",
        F.when(bad, F.lit("no date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fechaInicio"),
        F.when(bad, F.lit("")).otherwise(F.date_format(F.date_add("o_orderdate", 10), "yyyy-MM-dd")).alias("fechaRecogida"),
        F.when(key % 5 == 0, F.lit("official")).otherwise(F.lit("diy")).alias("type"),
    )
    return ops.spatiotemporal_filter(
        shown, center=(40.4168, -3.7038), radius_km=250.0, start="1996-01-01", end="1998-12-31", types=("diy",)
    ).select("id", "sensor_id")


@query(
    "temporal_features",
    f"""WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 <> 0 THEN month(o_orderdate) END AS m FROM orders),
s AS (SELECT *, CASE WHEN m IN (12, 1, 2) THEN 'winter' WHEN m IN (3, 4, 5) THEN 'spring'
                 WHEN m IN (6, 7, 8) THEN 'summer' WHEN m IN (9, 10, 11) THEN 'autumn' ELSE '' END AS season FROM m)
SELECT o_orderkey, m AS capture_month, season AS capture_season,
       round(sin(2 * {math.pi!r}::DOUBLE * (m - 1) / 12), 6) AS capture_month_sin,
       round(cos(2 * {math.pi!r}::DOUBLE * (m - 1) / 12), 6) AS capture_month_cos,
       CASE WHEN m IS NOT NULL THEN (season = 'winter')::INT::DOUBLE END AS season_winter,
       CASE WHEN m IS NOT NULL THEN (season = 'spring')::INT::DOUBLE END AS season_spring,
       CASE WHEN m IS NOT NULL THEN (season = 'summer')::INT::DOUBLE END AS season_summer,
       CASE WHEN m IS NOT NULL THEN (season = 'autumn')::INT::DOUBLE END AS season_autumn
FROM s""",
)
def temporal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = st.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    text = (
        F.when(key % 17 == 0, F.lit("soon"))
        .when(key % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(key % 3 == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" about noon")))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    )
    out = ops.temporal_features(orders.select("o_orderkey", text.alias("capture_datetime"))).drop("capture_datetime")
    return rounded(out)


@query(
    "grid_decision",
    """WITH g AS (
  SELECT l_orderkey, l_partkey, l_linenumber, (l_quantity::BIGINT % 7) AS h, (l_partkey % 5) AS v,
         (l_suppkey % 4) AS rp, (l_linenumber - 1) AS cp, l_discount * 10 AS reg, l_tax * 12 AS hc, l_discount * 9 AS vc,
         l_tax AS dark FROM lineitem),
s AS (SELECT *, 0.40::DOUBLE * least(1.0::DOUBLE, (h + v) / 8.0::DOUBLE) + 0.20::DOUBLE * least(1.0::DOUBLE, (rp + cp) / 8.0::DOUBLE)
         + 0.20::DOUBLE * reg + 0.15::DOUBLE * least(1.0::DOUBLE, sqrt(greatest(0.0::DOUBLE, hc * vc)))
         + 0.05::DOUBLE * least(1.0::DOUBLE, dark / 0.08::DOUBLE) AS score FROM g),
c AS (SELECT *, CASE WHEN (h >= 2 AND v >= 2 AND reg >= 0.35::DOUBLE AND (rp >= 2 OR cp >= 2)) OR score >= 0.62::DOUBLE THEN 'grid'
                     WHEN (h = 0 AND v = 0 AND rp <= 1 AND cp <= 1 AND dark <= 0.015::DOUBLE) OR score <= 0.22::DOUBLE THEN 'no_grid'
                     ELSE 'uncertain' END AS label, least(1.0::DOUBLE, abs(score - 0.42::DOUBLE) / 0.42::DOUBLE) AS conf FROM s)
SELECT l_orderkey, l_partkey, l_linenumber, round(score, 6) AS roi_grid_score, label AS roi_grid_label,
       round(conf, 6) AS roi_grid_confidence, label = 'uncertain' OR conf < 0.45::DOUBLE AS roi_grid_needs_review FROM c""",
)
def grid_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ops.grid_decision(grid_measures(spark, sf_dir))
    return rounded(
        out.select(
            "l_orderkey", "l_partkey", "l_linenumber", "roi_grid_score", "roi_grid_label", "roi_grid_confidence",
            "roi_grid_needs_review",
        )
    )


def grid_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = st.table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_linenumber",
        (F.col("l_quantity").cast("long") % 7).alias("roi_grid_horizontal_line_count"),
        (F.col("l_partkey") % 5).alias("roi_grid_vertical_line_count"),
        (F.col("l_suppkey") % 4).alias("roi_grid_row_peak_count"),
        (F.col("l_linenumber") - 1).alias("roi_grid_col_peak_count"),
        (F.col("l_discount") * 10).alias("roi_grid_spacing_regularity"),
        (F.col("l_tax") * 12).alias("roi_grid_horizontal_coverage"),
        (F.col("l_discount") * 9).alias("roi_grid_vertical_coverage"),
        F.col("l_tax").alias("roi_grid_inner_dark_ratio"),
    )


def _flagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = st.table(spark, sf_dir, "documents"), st.table(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang", "source", "n_chars").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("image_id"),
        "lang", "source",
        F.col("quality").cast("string").alias("roi_detected"),
        F.when(F.col("toxic") == 0, F.lit("Yes")).otherwise(F.lit("no")).alias("analysis_success"),
        F.when(F.col("n_chars") > 200, F.lit("TRUE")).otherwise(F.lit("false")).alias("segmentation_success"),
        F.col("n_chars").cast("double").alias("record_pm10"),
    )


@query(
    "eligible_rows",
    """SELECT d.doc_id AS image_id, lang FROM documents d JOIN labels l USING (doc_id)
WHERE quality = 1 AND toxic = 0 AND n_chars > 200""",
)
def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.eligible_rows(_flagged_documents(spark, sf_dir)).select("image_id", "lang")


def _taxonomy_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = st.table(spark, sf_dir, "documents"), st.table(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("lang") == "en", F.col("source")).when(F.col("lang") == "fr", F.lit("")).otherwise(F.col("lang")).alias("image"),
        F.when(F.col("quality") == 1, F.lit("done")).alias("taxonomy"),
    )


@query(
    "backfill_candidates",
    """SELECT id, image FROM (
  SELECT d.doc_id AS id, CASE WHEN lang = 'en' THEN source WHEN lang = 'fr' THEN '' ELSE lang END AS image, quality
  FROM documents d LEFT JOIN labels l USING (doc_id))
WHERE image <> '' AND (quality IS NULL OR quality <> 1) ORDER BY id LIMIT 50 OFFSET 20""",
)
def backfill_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.backfill_candidates(_taxonomy_records(spark, sf_dir), skip=20, limit=50).select("id", "image")


@query(
    "slice_rows",
    "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate, o_orderkey OFFSET 100",
)
def slice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = st.table(spark, sf_dir, "orders")
    return ops.slice_rows(orders, ["o_orderdate", "o_orderkey"], offset=100).select("o_orderkey", "o_custkey")


@query("exact_sample")
def exact_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = st.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return ops.exact_sample(orders, "o_orderkey", size=1000, seed=7)


@query(
    "failure_rows",
    """SELECT d.doc_id AS image_id, quality IS NULL AS failed, CASE WHEN quality IS NULL THEN false ELSE true END AS roi_detected,
       CASE WHEN quality IS NULL THEN 'pending' ELSE 'ok' END AS manual_qc_flag,
       CASE WHEN quality IS NULL THEN 'roi_not_detected' END AS failure_reason,
       n_chars::DOUBLE AS record_pm10, CASE WHEN quality IS NOT NULL THEN n_chars / 10.0::DOUBLE END AS area_median,
       NULL::DOUBLE AS feret_p90
FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def failure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = st.table(spark, sf_dir, "documents"), st.table(spark, sf_dir, "labels")
    base = docs.select("doc_id", F.col("n_chars").cast("double").alias("record_pm10")).join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("image_id"), "record_pm10", "quality"
    )
    good = base.where(F.col("quality").isNotNull()).select(
        "image_id", F.lit(True).alias("roi_detected"), F.lit("ok").alias("manual_qc_flag"), "record_pm10",
        (F.col("record_pm10") / 10.0).alias("area_median"),
    )
    failed = ops.failure_rows(base.where(F.col("quality").isNull()), F.lit("roi_not_detected"))
    out = ops.add_failures(good, failed)
    return out.select(
        "image_id", F.col("failure_reason").isNotNull().alias("failed"), "roi_detected", "manual_qc_flag",
        "failure_reason", "record_pm10", "area_median", "feret_p90",
    )


@query(
    "image_manifest",
    """SELECT page_id AS image_id, url AS image_path FROM pages WHERE page_id % 9 <> 0 AND url <> ''""",
)
def image_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = st.table(spark, sf_dir, "pages")
    return ops.image_manifest(
        pages.select(F.col("page_id").alias("image_id"), F.when(F.col("page_id") % 9 != 0, F.col("url")).otherwise(F.lit("")).alias("image_path"))
    )


@query(
    "parse_object_url",
    """WITH p AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN url || '.PNG' WHEN page_id % 4 = 1 THEN 'file' || page_id || '.jpeg' ELSE url END AS u FROM pages),
s AS (SELECT *, list_filter(string_split(regexp_extract(u, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS parts FROM p),
o AS (SELECT page_id, CASE WHEN len(parts) >= 2 THEN parts[1] ELSE 'images' END AS bucket,
             CASE WHEN len(parts) >= 2 THEN array_to_string(parts[2:], '/') ELSE u END AS object FROM s)
SELECT *, CASE WHEN lower(object) LIKE '%.png' THEN 'image/png'
               WHEN lower(object) LIKE '%.jpg' OR lower(object) LIKE '%.jpeg' THEN 'image/jpeg'
               WHEN lower(object) LIKE '%.webp' THEN 'image/webp' ELSE 'application/octet-stream' END AS content_type FROM o""",
)
def parse_object_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = st.table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 4
    text = (
        F.when(kind == 0, F.concat("url", F.lit(".PNG")))
        .when(kind == 1, F.concat(F.lit("file"), F.col("page_id"), F.lit(".jpeg")))
        .otherwise(F.col("url"))
    )
    return ops.parse_object_url(pages.select("page_id", text.alias("u")), "u").drop("u")


@query(
    "estimate_image_bytes",
    """SELECT count(*) AS requested_ids, count(*) FILTER (page_id % 3 <> 0) AS valid_ids,
       count(*) FILTER (page_id % 3 <> 0 AND page_id % 5 <> 0) AS found_images,
       coalesce(sum(length(html)) FILTER (page_id % 3 <> 0 AND page_id % 5 <> 0), 0)::BIGINT AS estimated_bytes FROM pages""",
)
def estimate_image_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = st.table(spark, sf_dir, "pages")
    key = F.lpad(F.col("page_id").cast("string"), 24, "0")
    ids = pages.select(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("x"), key)).otherwise(key).alias("id"))
    manifest = pages.select(key.alias("id"), F.col("url").alias("object"), "page_id").select("id", F.concat("object", F.lit("#"), "page_id").alias("object"))
    files = pages.where(F.col("page_id") % 5 != 0).select(
        F.concat("url", F.lit("#"), "page_id").alias("object"), F.length("html").cast("long").alias("length")
    )
    return ops.estimate_image_bytes(ids, manifest, files)


@query(
    "migrate_records",
    """SELECT c_custkey AS id, c_acctbal AS pm10, c_acctbal AS pm25, c_mktsegment AS level10, c_mktsegment AS level25,
       CASE WHEN c_custkey % 6 <> 0 THEN length(c_name) END AS image_bytes,
       CASE WHEN c_custkey % 6 = 0 THEN 'image is not base64' END AS error FROM customer""",
)
def migrate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = st.table(spark, sf_dir, "customer")
    old = c.select(
        F.struct(F.col("c_custkey").alias("$oid")).alias("_id"),
        F.col("c_acctbal").alias(fv.LEGACY_CONCENTRATION_KEYS[0]),
        F.col("c_mktsegment").alias(fv.POLLUTION_LEVEL_KEY),
        F.when(F.col("c_custkey") % 6 == 0, F.lit("%%%")).otherwise(F.base64(F.col("c_name").cast("binary"))).alias(fv.IMAGE_KEY),
    )
    good, bad = ops.migrate_records(old)
    shape = lambda df, image, error: df.select(
        F.col("_id").alias("id"), F.col("`PM10`").alias("pm10"), F.col("`PM2.5`").alias("pm25"),
        F.col(f"`{fv.POLLUTION_LEVEL_KEY} PM10`").alias("level10"),
        F.col(f"`{fv.POLLUTION_LEVEL_KEY} PM2.5`").alias("level25"),
        image.cast("long").alias("image_bytes"), error.alias("error"),
    )
    return shape(good, F.length(F.col(f"`{fv.IMAGE_KEY}`")), F.lit(None).cast("string")).unionByName(
        shape(bad, F.lit(None), F.col("error"))
    )


@query(
    "export_sensor_csv",
    """SELECT o_orderkey::VARCHAR AS id, 'Sensor ' || o_custkey AS nombre,
       CASE WHEN o_orderkey % 4 = 0 THEN '–' WHEN o_orderkey % 4 = 1 THEN 'later' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS inicio,
       strftime(o_orderdate, '%d/%m/%Y') AS recogida,
       CASE WHEN o_orderkey % 5 = 0 THEN 'N/A' ELSE printf('%.1f', (o_custkey % 1000) / 4.0::DOUBLE + 0.01::DOUBLE) END AS pm10
FROM orders""",
)
def export_sensor_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = st.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    sensors = o.select(
        key.alias("id"), F.concat(F.lit("Sensor "), "o_custkey").alias("nombre"),
        F.lit(1.5).alias("latitud"), F.lit(2.5).alias("longitud"),
        F.when(key % 4 == 0, F.lit("")).when(key % 4 == 1, F.lit("later"))
        .when(key % 4 == 2, F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fechaInicio"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("fechaRecogida"),
        F.when(key % 5 != 0, (F.col("o_custkey") % 1000) / 4.0 + 0.01).alias("pm10"),
        F.lit(None).cast("double").alias("pm25"),
    )
    out = ops.export_sensor_csv(sensors)
    return out.select("id", "nombre", F.col("fechaInicio").alias("inicio"), F.col("fechaRecogida").alias("recogida"), F.col("PM10").alias("pm10"))


def submitted_records(events: DataFrame) -> DataFrame:
    """Events as submitted records with every kind of fault; batch and stream alike."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.col("event_id").alias("id"),
        F.when(k % 13 != 0, F.date_format("ts", "yyyy-MM-dd")).alias("start_date"),
        F.date_format("ts", "yyyy-MM-dd").alias("end_date"),
        F.when(k % 11 != 0, F.lit(36.0) + k / 100.0).alias("latitude"),
        F.when(k % 7 == 0, F.lit(float("nan"))).otherwise(F.lit(-3.0)).alias("longitude"),
        (F.col("value") - 5.0).cast("string").alias("pm10"),
        F.when(k % 5 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("pm25"),
        F.when(k % 3 == 0, F.lit("")).otherwise(F.col("event_type")).alias("context"),
        F.when(k % 2 == 0, k).alias("contours"),
        F.lit(None).cast("double").alias("area_percentage"),
    )


VALIDATE_SQL = """SELECT event_id AS id, CASE WHEN k % 13 = 0 THEN 'missing_dates'
            WHEN k % 11 = 0 OR k % 7 = 0 THEN 'bad_position'
            WHEN value < 5 OR k % 5 = 0 THEN 'bad_concentration'
            WHEN k % 3 = 0 THEN 'missing_context' END AS rejection,
       round(value - 5.0, 6) AS pm10, CASE WHEN k % 2 = 0 THEN k::DOUBLE ELSE 0.0 END AS contours
FROM (SELECT *, json_extract(props, '$.k')::BIGINT AS k FROM events)"""


@query("validate_records", VALIDATE_SQL)
def validate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = ops.validate_records(submitted_records(st.table(spark, sf_dir, "events")))
    return rounded(checked.select("id", "rejection", "pm10", "contours"))
