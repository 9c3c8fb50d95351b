"""Record-level operators: views, filters, migration, export and validation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from particlelake import fixed_values as fv
from particlelake.functions import dates, geo, scalar
from particlelake.operators.order_stats import key_join
from particlelake.runtime import cut_lineage, quoted


def _present(df: DataFrame, names: Sequence[str]) -> list[Column]:
    return [quoted(n) for n in names if n in df.columns]


def _first_number(df: DataFrame, names: Sequence[str]) -> Column:
    found = [scalar.to_float(c, "prefix") for c in _present(df, names)]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def _optional(df: DataFrame, name: str, kind: str = "string") -> Column:
    return quoted(name) if name in df.columns else F.lit(None).cast(kind)


def sensor_view(records: DataFrame, id_column: str = "_id") -> DataFrame:
    """Nested sensor view of raw records with all their spellings resolved."""
    staged = records.select(
        quoted(id_column).cast("string").alias("__id"),
        _first_number(records, fv.PM25_KEYS).alias("__pm25"),
        _first_number(records, fv.PM10_KEYS).alias("__pm10"),
        _first_number(records, fv.LEGACY_CONCENTRATION_KEYS).alias("__legacy"),
        _first_number(records, fv.LATITUDE_KEYS).alias("__lat"),
        _first_number(records, fv.LONGITUDE_KEYS).alias("__lon"),
        _optional(records, fv.START_KEY).alias("fechaInicio"),
        _optional(records, fv.END_KEY).alias("fechaRecogida"),
        _optional(records, fv.IMAGE_KEY).alias("imagen"),
        _optional(records, fv.TAXONOMY_KEY).alias("taxonomyModel"),
    ).withColumn("__effective", F.coalesce("__pm25", "__pm10", "__legacy"))
    nan = F.lit(float("nan"))
    return staged.select(
        F.col("__id").alias("id"),
        F.concat(F.lit("Sensor "), F.right("__id", F.lit(6))).alias("nombre"),
        F.struct(
            F.coalesce(F.col("__lat"), nan).alias("latitud"), F.coalesce(F.col("__lon"), nan).alias("longitud")
        ).alias("ubicacion"),
        scalar.pollution_label(F.col("__effective")).alias("nivelPolucion"),
        F.struct(
            F.coalesce(F.col("__effective"), F.lit(0.0)).alias("concentracion"),
            F.coalesce("__pm25", "__legacy").alias("pm25"),
            F.coalesce("__pm10", "__legacy").alias("pm10"),
        ).alias("metricas"),
        "fechaInicio", "fechaRecogida", "imagen", "taxonomyModel",
    )


def project_fields(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Keep the named top-level or dotted fields; unknown paths are ignored."""
    wanted: dict[str, list[list[str]]] = {}
    for field in fields:
        head, *rest = field.strip().split(".")
        wanted.setdefault(head, []).append(rest)

    def build(col: Column, kind: T.DataType, paths: list[list[str]]) -> Column | None:
        if any(not p for p in paths):
            return col
        if not isinstance(kind, T.StructType):
            return None
        inner: dict[str, list[list[str]]] = {}
        for head, *rest in paths:
            inner.setdefault(head, []).append(rest)
        parts = []
        for name, rests in inner.items():
            if name in kind.names:
                part = build(col[name], kind[name].dataType, rests)
                if part is not None:
                    parts.append(part.alias(name))
        return F.when(col.isNotNull(), F.struct(*parts)) if parts else None

    columns = []
    for name, paths in wanted.items():
        if name in df.columns:
            column = build(quoted(name), df.schema[name].dataType, paths)
            if column is not None:
                columns.append(column.alias(name))
    return df.select(*columns)


def spatiotemporal_filter(
    sensors: DataFrame,
    center: tuple[float, float] | None = None,
    radius_km: float | None = None,
    start: str | None = None,
    end: str | None = None,
    types: Sequence[str] = ("diy", "official"),
    latitude: str = "latitude",
    longitude: str = "longitude",
    started: str = "fechaInicio",
    ended: str = "fechaRecogida",
    kind: str = "type",
) -> DataFrame:
    """Map search: source toggles, radius around a centre, and a date range.

    The radius adds a latitude (and, away from poles and date line, longitude)
    box so that Parquet min/max statistics can skip row groups.
    """
    hidden = [t for t in ("diy", "official") if t not in types]
    out = sensors.where(~F.coalesce(quoted(kind).isin(hidden), F.lit(False))) if hidden else sensors
    if center is not None and radius_km:
        lat, lon = center
        degrees = math.degrees(radius_km / fv.EARTH_RADIUS_MAP_KM) * 1.000001
        out = out.where(quoted(latitude).between(lat - degrees, lat + degrees))
        if abs(lat) + degrees < 89.0:
            reach = math.degrees(
                math.asin(min(1.0, math.sin(math.radians(min(degrees, 90.0))) / math.cos(math.radians(lat))))
            ) * 1.000001
            if degrees < 89.0 and -180.0 <= lon - reach and lon + reach <= 180.0:
                out = out.where(quoted(longitude).between(lon - reach, lon + reach))
        distance = geo.map_distance_km(F.lit(lat), F.lit(lon), quoted(latitude), quoted(longitude))
        out = out.where(~F.isnan(distance) & (distance <= radius_km))
    if start:
        moment = dates.instant(quoted(started))
        out = out.where(moment.isNull() | (moment >= F.lit(f"{start}T00:00:00.000Z").cast("timestamp")))
    if end:
        moment = dates.instant(quoted(ended))
        out = out.where(moment.isNull() | (moment <= F.lit(f"{end}T23:59:59.999Z").cast("timestamp")))
    return out


def temporal_features(df: DataFrame, column: str = "capture_datetime") -> DataFrame:
    """Month, season, cyclic month and season flags of a capture time."""
    month = F.month(dates.capture_moment(quoted(column)))
    angle = dates.month_angle(month)
    season = dates.season(month)
    flags = {
        f"season_{name}": F.when(month.isNotNull(), (season == name).cast("double"))
        for name in ("winter", "spring", "summer", "autumn")
    }
    return df.withColumns(
        {
            "capture_month": month,
            "capture_season": season,
            "capture_month_sin": F.sin(angle),
            "capture_month_cos": F.cos(angle),
            **flags,
        }
    )


def grid_decision(df: DataFrame) -> DataFrame:
    """Grid label, score, confidence and review flag from measured grid columns."""
    h, v = F.col("roi_grid_horizontal_line_count"), F.col("roi_grid_vertical_line_count")
    rows, cols = F.col("roi_grid_row_peak_count"), F.col("roi_grid_col_peak_count")
    regularity = F.col("roi_grid_spacing_regularity")
    dark = F.col("roi_grid_inner_dark_ratio")
    coverage = F.col("roi_grid_horizontal_coverage") * F.col("roi_grid_vertical_coverage")
    capped = lambda c: F.least(F.lit(1.0), c)
    score = (
        0.40 * capped((h + v) / 8.0)
        + 0.20 * capped((rows + cols) / 8.0)
        + 0.20 * regularity
        + 0.15 * capped(F.sqrt(F.greatest(F.lit(0.0), coverage)))
        + 0.05 * capped(dark / 0.08)
    )
    clear_grid = (h >= 2) & (v >= 2) & (regularity >= 0.35) & ((rows >= 2) | (cols >= 2))
    clear_blank = (h == 0) & (v == 0) & (rows <= 1) & (cols <= 1) & (dark <= 0.015)
    scored = df.withColumn("roi_grid_score", score)
    value = F.col("roi_grid_score")
    labelled = scored.withColumn(
        "roi_grid_label",
        F.when(clear_grid | (value >= fv.GRID_ACCEPT_SCORE), F.lit("grid"))
        .when(clear_blank | (value <= fv.GRID_REJECT_SCORE), F.lit("no_grid"))
        .otherwise(F.lit("uncertain")),
    ).withColumn("roi_grid_confidence", capped(F.abs(value - fv.GRID_CENTRE_SCORE) / fv.GRID_CENTRE_SCORE))
    return labelled.withColumn(
        "roi_grid_needs_review",
        (F.col("roi_grid_label") == "uncertain") | (F.col("roi_grid_confidence") < fv.GRID_REVIEW_CONFIDENCE),
    )


def eligible_rows(features: DataFrame) -> DataFrame:
    """Rows whose three success flags are all true after parsing."""
    keep = F.lit(True)
    for name in ("roi_detected", "analysis_success", "segmentation_success"):
        keep = keep & F.coalesce(scalar.to_bool(quoted(name)), F.lit(False))
    return features.where(keep)


def with_row_position(df: DataFrame, order: Sequence[str], output: str = "row_position") -> DataFrame:
    """Zero-based position in a total order, without a single-task sort.

    Rows are range partitioned once (and checkpointed so that the ranges stay
    fixed); positions inside a range are shifted by the sizes of earlier ranges.
    """
    from pyspark.sql import Window

    ranged = cut_lineage(
        df.repartitionByRange(*[quoted(c) for c in order]).withColumn("__range", F.spark_partition_id())
    )
    sizes = ranged.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__range", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__range").orderBy(*order)
    local = ranged.withColumn("__local", F.row_number().over(inside) - 1)
    joined = key_join(local, offsets, ["__range"])
    return joined.withColumn(output, F.col("__offset") + F.col("__local")).drop("__range", "__offset", "__local")


def slice_rows(df: DataFrame, order: Sequence[str], offset: int = 0, limit: int = 0) -> DataFrame:
    """Offset and limit in a total order; a zero limit keeps everything after it.

    Rows are placed by ranges, so a limit of any size is no single task's work.
    """
    if offset <= 0 and limit <= 0:
        return df
    placed = with_row_position(df, order)
    keep = F.col("row_position") >= offset
    if limit > 0:
        keep = keep & (F.col("row_position") < offset + limit)
    return placed.where(keep).drop("row_position")


def exact_sample(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """Exactly ``size`` rows: those with the smallest hash of (key, seed).

    The same ids come out of every table that holds the key, whatever its
    partitioning. The cut-off hash is found by counting 12-bit prefixes, at most
    4096 counters per pass, so no task ever sorts or holds the sample.
    """
    hashed = F.xxhash64(quoted(key), F.lit(seed))
    keys = df.select(quoted(key).alias("__key"), hashed.alias("__hash"))
    if size <= 0:
        return df
    wanted, prefix, shift = size, F.lit(True), 64
    below = F.lit(False)
    while True:
        shift -= 12
        digit = F.shiftrightunsigned(F.col("__hash"), shift).bitwiseAND(F.lit(4095))
        counts = sorted(
            (r["d"], r["n"])
            for r in keys.where(prefix).groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()
        )
        seen = 0
        for value, n in counts:
            if seen + n >= wanted:
                break
            seen += n
        else:
            return df
        below = below | (prefix & (digit < value))
        prefix = prefix & (digit == value)
        wanted -= seen
        if n <= 10_000 or shift <= 4:
            break
    top = keys.where(prefix).orderBy("__hash", "__key").limit(wanted).agg(F.max(F.struct("__hash", "__key")).alias("last")).first()["last"]
    edge = prefix & (
        (F.col("__hash") < top["__hash"]) | ((F.col("__hash") == top["__hash"]) & (F.col("__key") <= F.lit(top["__key"])))
    )
    return (
        df.withColumns({"__hash": hashed, "__key": quoted(key)})
        .where(below | edge)
        .drop("__hash", "__key")
    )


def image_manifest(records: DataFrame, key: str = "image_id", path: str = "image_path") -> DataFrame:
    """Id and path of the records that have both."""
    return records.select(quoted(key), quoted(path)).where(
        scalar.non_blank(quoted(key).cast("string")).isNotNull() & scalar.non_blank(quoted(path)).isNotNull()
    )


def parse_object_url(df: DataFrame, column: str, default_bucket: str = "images") -> DataFrame:
    """Bucket, object name and content type of a stored object's URL."""
    value = quoted(column)
    tail = F.regexp_extract(value, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    segments = F.filter(F.split(tail, "/"), lambda s: s != "")
    is_object = value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+") & (F.size(segments) >= 2)
    out = df.withColumns(
        {
            "bucket": F.when(is_object, segments[0]).otherwise(F.lit(default_bucket)),
            "object": F.when(is_object, F.array_join(F.slice(segments, 2, 1_000_000), "/")).otherwise(value),
        }
    )
    lowered = F.lower("object")
    return out.withColumn(
        "content_type",
        F.when(lowered.endswith(".png"), F.lit("image/png"))
        .when(lowered.endswith(".jpg") | lowered.endswith(".jpeg"), F.lit("image/jpeg"))
        .when(lowered.endswith(".webp"), F.lit("image/webp"))
        .otherwise(F.lit("application/octet-stream")),
    )


def estimate_image_bytes(ids: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Requested and valid ids, objects found and their total size.

    ``ids(id)``, ``manifest(id, object)`` and ``files(object, length)``; with the
    binaryFile source only its path and length columns are read.
    """
    valid = F.col("id").rlike(r"^[0-9a-fA-F]{24}$")
    asked = ids.agg(
        F.count("id").alias("requested_ids"), F.count_if(valid).alias("valid_ids")
    )
    found = (
        ids.where(valid).select("id").distinct()
        .join(manifest, "id")
        .join(files, "object")
        .agg(
            F.count(F.lit(1)).alias("found_images"),
            F.coalesce(F.sum("length"), F.lit(0)).cast("long").alias("estimated_bytes"),
        )
    )
    totals = found.select(F.struct("*")).scalar()
    return asked.select(
        "requested_ids", "valid_ids",
        totals["found_images"].alias("found_images"), totals["estimated_bytes"].alias("estimated_bytes"),
    )


def migrate_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rename, split and decode old records; returns (good rows, bad rows).

    The standard concentration becomes PM10 and is copied to PM2.5, the pollution
    level is split in two, ``_id`` loses its wrapper and the image is decoded.
    """
    out = records
    old = fv.LEGACY_CONCENTRATION_KEYS[0]
    if old in out.columns:
        if "PM10" in out.columns:
            out = out.withColumn("PM10", F.coalesce(quoted(old), quoted("PM10"))).drop(old)
        else:
            out = out.withColumnRenamed(old, "PM10")
    if "PM10" in out.columns:
        out = out.withColumn("PM2.5", quoted("PM10"))
    if fv.POLLUTION_LEVEL_KEY in out.columns:
        level = quoted(fv.POLLUTION_LEVEL_KEY)
        out = out.withColumns(
            {f"{fv.POLLUTION_LEVEL_KEY} PM10": level, f"{fv.POLLUTION_LEVEL_KEY} PM2.5": level}
        ).drop(fv.POLLUTION_LEVEL_KEY)
    if "_id" in out.columns and isinstance(out.schema["_id"].dataType, T.StructType):
        out = out.withColumn("_id", F.col("_id")["$oid"])
    image = quoted(fv.IMAGE_KEY)
    if not isinstance(out.schema[fv.IMAGE_KEY].dataType, T.BinaryType):
        out = out.withColumn("__image", F.try_to_binary(image, F.lit("base64")))
    else:
        out = out.withColumn("__image", image)
    good = out.where(F.col("__image").isNotNull()).drop(fv.IMAGE_KEY).withColumnRenamed("__image", fv.IMAGE_KEY)
    bad = out.where(F.col("__image").isNull()).drop("__image").withColumn(
        "error",
        F.when(image.isNull(), F.lit("image missing")).otherwise(F.lit("image is not base64")),
    )
    return good, bad


def export_sensor_csv(sensors: DataFrame) -> DataFrame:
    """The eight text columns of the sensor download."""
    return sensors.select(
        F.col("id").cast("string").alias("id"),
        "nombre",
        F.col("latitud").cast("string").alias("latitud"),
        F.col("longitud").cast("string").alias("longitud"),
        dates.display_date(F.col("fechaInicio")).alias("fechaInicio"),
        dates.display_date(F.col("fechaRecogida")).alias("fechaRecogida"),
        scalar.fixed_point(F.col("pm10"), 1, "N/A").alias("PM10"),
        scalar.fixed_point(F.col("pm25"), 1, "N/A").alias("PM2.5"),
    )


def backfill_candidates(
    records: DataFrame,
    image: str = "image",
    taxonomy: str = "taxonomy",
    order: Sequence[str] = ("id",),
    force: bool = False,
    skip: int = 0,
    limit: int = 0,
) -> DataFrame:
    """Records with an image and (unless forced) no stored taxonomy yet."""
    keep = scalar.non_blank(quoted(image)).isNotNull()
    if not force:
        keep = keep & quoted(taxonomy).isNull()
    return slice_rows(records.where(keep), order, skip, limit)


def failure_rows(images: DataFrame, reason: Column, context: Sequence[str] = fv.CONTEXT_COLUMNS) -> DataFrame:
    """Feature rows of failed images: flags false, features null, context copied."""
    kinds = dict(images.dtypes)
    copied = []
    for name in context:
        if name not in images.columns:
            copied.append(F.lit(None).cast("string").alias(name))
        elif kinds[name].startswith(("struct", "array", "map")):
            copied.append(F.to_json(quoted(name)).alias(name))
        else:
            copied.append(quoted(name))
    settled = {
        "roi_detected": F.lit(False),
        "roi_width_px": F.lit(None).cast("int"),
        "roi_height_px": F.lit(None).cast("int"),
        "segmentation_method": F.lit(""),
        "analysis_success": F.lit(False),
        "segmentation_success": F.lit(False),
        "manual_qc_flag": F.lit("pending"),
        "failure_reason": reason,
    }
    metadata = [
        settled[n].alias(n) if n in settled else (quoted(n) if n in images.columns else F.lit(None).cast("string").alias(n))
        for n in fv.METADATA_COLUMNS
    ]
    numbers = dict.fromkeys(fv.IMAGE_NUMERIC_COLUMNS + fv.EXTENDED_FEATURES)
    return images.select(
        *metadata,
        *copied,
        *[F.lit(None).cast("double").alias(n) for n in numbers],
        F.lit(None).cast("boolean").alias("zero_particle_flag"),
    )


def add_failures(features: DataFrame, failures: DataFrame) -> DataFrame:
    """Successful and failed images in one table; missing columns become null."""
    return features.unionByName(failures, allowMissingColumns=True)


def rejection_reason() -> Column:
    """Name of the first broken rule of a submitted record, null if none."""
    blank = lambda c: scalar.non_blank(F.col(c).cast("string")).isNull()
    bad_amount = lambda c: F.coalesce(scalar.to_float(F.col(c), "prefix"), F.lit(-1.0)) < 0
    return (
        F.when(blank("start_date") | blank("end_date"), F.lit("missing_dates"))
        .when(scalar.finite(F.col("latitude")).isNull() | scalar.finite(F.col("longitude")).isNull(), F.lit("bad_position"))
        .when(bad_amount("pm10") | bad_amount("pm25"), F.lit("bad_concentration"))
        .when(blank("context"), F.lit("missing_context"))
    )


def validate_records(records: DataFrame) -> DataFrame:
    """Adds ``rejection`` (null for good rows) and zero defaults for the counts.

    Works unchanged on batch and streaming input.
    """
    return records.withColumns(
        {
            "rejection": rejection_reason(),
            "pm10": scalar.to_float(F.col("pm10"), "prefix"),
            "pm25": scalar.to_float(F.col("pm25"), "prefix"),
            "contours": F.coalesce(F.col("contours").cast("double"), F.lit(0.0)),
            "area_percentage": F.coalesce(F.col("area_percentage").cast("double"), F.lit(0.0)),
        }
    )
