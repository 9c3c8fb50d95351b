"""Aggregations over stations, places, statuses and categories."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from particlelake import fixed_values as fv
from particlelake.functions import scalar
from particlelake.operators.order_stats import aggregate_with_percentiles
from particlelake.runtime import HOT_GROUP_ROWS, melt, one_row, quoted


def accepted_period(start: str | None, end: str | None) -> tuple[str, str] | None:
    """Both bounds of a period; only yyyy-mm-dd counts and one bound fills the other."""
    ok = lambda v: v.strip() if isinstance(v, str) and re.fullmatch(r"\d{4}-\d{2}-\d{2}", v.strip()) else None
    first, last = ok(start), ok(end)
    first, last = first or last, last or first
    return None if first is None else (first, last)


def _period_outputs(pm10: Column, pm25: Column) -> dict[str, Column]:
    reference = F.coalesce(pm25, pm10)
    return {
        "concentration": reference,
        "pollution_category": scalar.station_category(reference),
        "has_pm10": pm10.isNotNull(),
        "has_pm25": pm25.isNotNull(),
    }


def _mean_of(col: str, null_as_zero: bool) -> Column:
    value = scalar.finite(quoted(col))
    if null_as_zero:
        value = F.when(quoted(col).isNull(), F.lit(0.0)).otherwise(value)
    return F.avg(value)


def period_average(
    hourly: DataFrame, start: str | None, end: str | None, station: str = "station_id", ts: str = "ts",
    null_as_zero: bool = False,
) -> DataFrame:
    """Mean pm10 and pm25 per station inside a date range, with its category."""
    period = accepted_period(start, end)
    if period is None:
        raise ValueError("at least one bound must be a yyyy-mm-dd date")
    inside = (quoted(ts) >= F.lit(f"{period[0]} 00:00:00").cast("timestamp_ntz")) & (
        quoted(ts) < F.lit(f"{period[1]} 00:00:00").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")
    )
    means = hourly.where(inside).groupBy(quoted(station)).agg(
        _mean_of("pm10", null_as_zero).alias("pm10"), _mean_of("pm25", null_as_zero).alias("pm25")
    )
    return means.withColumns(_period_outputs(F.col("pm10"), F.col("pm25")))


def sensor_period_average(
    sensors: DataFrame, hourly: DataFrame, sensor: str = "sensor_id", station: str = "station_id",
    start: str = "start_date", end: str = "end_date", ts: str = "ts",
) -> DataFrame:
    """Each sensor's own period averaged over its station's series.

    Hourly values become daily sums first, and each period lists its days, so the
    join is an equality on (station, day).
    """
    daily = hourly.groupBy(quoted(station).alias("__station"), F.to_date(quoted(ts)).alias("__day")).agg(
        *[f(scalar.finite(F.col(c))).alias(f"__{n}_{c}") for c in ("pm10", "pm25") for f, n in ((F.sum, "s"), (F.count, "n"))]
    )
    days = sensors.select(
        quoted(sensor), quoted(station).alias("__mine"),
        F.explode(F.sequence(F.to_date(quoted(start)), F.to_date(quoted(end)))).alias("__wanted"),
    )
    joined = days.join(daily, (F.col("__mine") == F.col("__station")) & (F.col("__wanted") == F.col("__day")), "left")
    means = joined.groupBy(quoted(sensor)).agg(
        *[
            F.when(F.sum(f"__n_{c}") > 0, F.sum(f"__s_{c}") / F.sum(f"__n_{c}")).alias(c)
            for c in ("pm10", "pm25")
        ]
    )
    return means.withColumns(_period_outputs(F.col("pm10"), F.col("pm25")))


def _located(metadata: DataFrame, latitude: str, longitude: str, *extra: Column) -> DataFrame:
    """Rows with a position and an owner, keyed by the six-decimal location."""
    names = [c for c in ("sensor_id", "image_id") if c in metadata.columns]
    owner = F.coalesce(*[scalar.non_blank(F.trim(quoted(c).cast("string"))) for c in names])
    placed = metadata.select(
        scalar.finite(quoted(latitude)).alias("latitude"), scalar.finite(quoted(longitude)).alias("longitude"),
        owner.alias("sensor_id"), *extra,
    ).where(F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & F.col("sensor_id").isNotNull())
    return placed.withColumn("location_key", F.format_string("%.6f,%.6f", "latitude", "longitude"))


def unique_locations(metadata: DataFrame, order: str, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Six-decimal locations with their number of sensors; the last row's coordinates stay.

    The sensors of each location are the pairs of ``location_sensors``: one place
    may hold most sensors, so they are never gathered into a list.
    """
    keyed = _located(metadata, latitude, longitude, quoted(order).alias("__order"))
    per_sensor = keyed.groupBy("location_key", "sensor_id").agg(
        F.max(F.struct("__order", "latitude", "longitude")).alias("last")
    )
    return per_sensor.groupBy("location_key").agg(
        F.max("last").alias("last"), F.count(F.lit(1)).alias("sensor_count")
    ).select("location_key", "last.latitude", "last.longitude", "sensor_count")


def location_sensors(metadata: DataFrame, latitude: str = "latitude", longitude: str = "longitude") -> DataFrame:
    """Distinct (location_key, sensor_id) pairs."""
    return _located(metadata, latitude, longitude).select("location_key", "sensor_id").distinct()


def place_categories(types: Column) -> dict[str, Column]:
    """One boolean per place category from the place's list of types."""
    clean = F.filter(F.transform(types, lambda t: F.trim(t)), lambda t: t != "")
    flags = {
        name: F.coalesce(F.arrays_overlap(clean, F.array(*[F.lit(m) for m in members])), F.lit(False))
        for name, members in fv.PLACE_TYPE_SETS.items()
    }
    for name, words in fv.PLACE_KEYWORDS.items():
        found = F.exists(clean, lambda t: F.lower(t).rlike("|".join(words)))
        flags[name] = F.coalesce(found, F.lit(False))
    return {name: flags[name] for name in fv.PLACE_CATEGORIES}


def place_counts(places: DataFrame, key: str = "location_key", types: str = "types") -> DataFrame:
    """Counts per category, relevant total, dominant category, entropy and ratio.

    ``places`` holds one row per place; the conditional counts combine map-side,
    so a location with very many places is no hot spot. A tie for the dominant
    category goes to the earlier one in the fixed order.
    """
    flags = place_categories(quoted(types))
    flagged = places.select(quoted(key), *[f.alias(f"__{n}") for n, f in flags.items()])
    relevant = F.lit(False)
    for name in flags:
        relevant = relevant | F.col(f"__{name}")
    counted = flagged.groupBy(key).agg(
        F.count_if(relevant).alias("total"), *[F.count_if(F.col(f"__{n}")).alias(n) for n in flags]
    )
    return with_place_ratios(counted)


def with_place_ratios(counted: DataFrame) -> DataFrame:
    counts = F.array(*[F.col(n) for n in fv.PLACE_CATEGORIES])
    highest = F.array_max(counts)
    names = F.array(*[F.lit(n) for n in fv.PLACE_CATEGORIES])
    dominant = F.when(highest > 0, F.element_at(names, F.array_position(counts, highest).cast("int"))).otherwise(F.lit(""))
    positive = F.filter(counts, lambda n: n > 0)
    everything = F.aggregate(positive, F.lit(0).cast("long"), lambda a, n: a + n)
    entropy = F.when(
        everything > 0,
        F.aggregate(positive, F.lit(0.0), lambda a, n: a - (n / everything) * F.log2(n / everything)),
    )
    traffic = sum((F.col(n) for n in fv.TRAFFIC_CATEGORIES[1:]), F.col(fv.TRAFFIC_CATEGORIES[0]))
    return counted.withColumns(
        {
            "dominant_place_category": dominant,
            "place_diversity_entropy": entropy,
            "green_vs_traffic_ratio_500m": F.when(traffic > 0, F.col("park") / traffic),
        }
    )


def place_features(locations: DataFrame, places: DataFrame, key: str = "location_key") -> DataFrame:
    """One row per sensor of each location; a location without places counts zero.

    ``locations`` has the key, the sensor id and the coordinates to carry along.
    """
    counted = place_counts(places, key)
    joined = locations.join(counted.select(key, "total", *fv.PLACE_CATEGORIES), key, "left")
    filled = joined.withColumns(
        {c: F.coalesce(F.col(c), F.lit(0).cast("long")) for c in ("total", *fv.PLACE_CATEGORIES)}
    )
    return with_place_ratios(filled)


def processing_summary(statuses: DataFrame, status: str = "status") -> DataFrame:
    """Record counts by outcome."""
    value = quoted(status)
    known = ("success", "image_not_available", "roi_not_detected")
    return statuses.agg(
        F.count(F.lit(1)).alias("processed_records"),
        F.count_if(value == "success").alias("successful_analyses"),
        F.count_if(value == "roi_not_detected").alias("roi_failures"),
        F.count_if(value == "image_not_available").alias("missing_images"),
        F.count_if(value.isNull() | ~value.isin(*known)).alias("other_failures"),
    )


def cluster_counts(assignments: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Rows and share of all rows per label; labels sorted with noise last."""
    counts = assignments.groupBy(quoted(label).alias("cluster_label")).agg(F.count(F.lit(1)).alias("count"))
    total = one_row(assignments.agg(F.count(F.lit(1)).alias("n")))["n"]
    return counts.withColumns(
        {"fraction": F.col("count") / total, "is_noise": F.col("cluster_label") == -1}
    )


def cluster_distribution(assignments: DataFrame, label: str = "cluster_label") -> DataFrame:
    """One row with the sorted array of label sizes, noise at the end."""
    counts = assignments.groupBy(quoted(label).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("count"))
    packed = F.sort_array(F.collect_list(F.struct((F.col("label") == -1).alias("last"), "label", "count")))
    return counts.agg(
        F.transform(packed, lambda s: F.struct(s["label"].alias("label"), s["count"].alias("count"))).alias(
            "cluster_size_distribution"
        )
    )


def group_values(df: DataFrame, group: str) -> Column:
    """Sorted array of the distinct non-null groups as a scalar subquery.

    Meant for cluster labels, whose number does not grow with the rows.
    """
    distinct = df.select(quoted(group).alias("g")).where(F.col("g").isNotNull()).distinct()
    return one_row(distinct.agg(F.sort_array(F.collect_list("g")).alias("all")))["all"]


def numeric_summary(
    df: DataFrame, group: str, columns: Sequence[str], hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Count, mean, median, population std and iqr per (variable, group).

    A group without any value of a variable keeps a row with count 0 and nulls.
    """
    # columns stay side by side, so rows are read, placed and counted once for all of them
    named = {f"__v{i}": c for i, c in enumerate(columns)}
    wide = df.where(quoted(group).isNotNull()).select(quoted(group), *[scalar.finite(quoted(c)).alias(v) for v, c in named.items()])
    stats = aggregate_with_percentiles(
        wide,
        [group],
        {v: {f"{v}_q25": 0.25, f"{v}_median": 0.5, f"{v}_q75": 0.75} for v in named},
        [f(v).alias(f"{v}_{output}") for v in named for f, output in ((F.count, "count"), (F.avg, "mean"), (F.stddev_pop, "std"))],
        hot_rows=hot_rows,
    )
    cells = [
        F.struct(
            F.lit(c).alias("variable"),
            *[F.col(f"{v}_{output}").alias(output) for output in ("count", "mean", "median", "std")],
            (F.col(f"{v}_q75") - F.col(f"{v}_q25")).alias("iqr"),
        )
        for v, c in named.items()
    ]
    return stats.select(quoted(group), F.inline(F.array(*cells))).select(
        "variable", quoted(group), "count", "mean", "median", "std", "iqr"
    )


def category_texts(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Long (variable, category, group) rows without blank categories."""
    texts = {c: F.trim(quoted(c).cast("string")) for c in columns}
    long = melt(df, [quoted(group).alias("__group")], texts, "variable", "category")
    return long.where(scalar.non_blank(F.col("category")).isNotNull() & F.col("__group").isNotNull())


def contingency(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Full group x category grid with zeros, totals and the share in the group.

    Counting combines map-side; each (variable, category) then keeps one small
    map of group counts that is laid out over the list of groups.
    """
    counts = category_texts(df, group, columns).groupBy("variable", "category", "__group").agg(
        F.count(F.lit(1)).alias("n")
    )
    per_category = counts.groupBy("variable", "category").agg(
        F.map_from_entries(F.collect_list(F.struct("__group", "n"))).alias("by_group"),
        F.sum("n").alias("category_total"),
    )
    per_group = counts.groupBy("variable", "__group").agg(F.sum("n").alias("n"))
    per_variable = per_group.groupBy("variable").agg(
        F.map_from_entries(F.collect_list(F.struct("__group", "n"))).alias("group_totals"),
        F.sum("n").alias("total"),
    )
    groups = group_values(df, group)
    grid = per_category.join(per_variable, "variable").select(
        "variable", "category", "by_group", "category_total", "group_totals", "total",
        F.explode(groups).alias(group),
    )
    zero = F.lit(0).cast("long")
    count = F.coalesce(F.try_element_at("by_group", quoted(group)), zero)
    own = F.coalesce(F.try_element_at("group_totals", quoted(group)), zero)
    return grid.select(
        "variable",
        quoted(group),
        "category",
        count.alias("count"),
        F.when(own > 0, count / own).alias("fraction_within_cluster"),
        own.alias("group_total"),
        "category_total",
        "total",
    )


def sensor_profile(
    features: DataFrame,
    query: str,
    columns: Sequence[str],
    metadata: Sequence[str] = (),
    order: str = "image_id",
    hot_rows: int = HOT_GROUP_ROWS,
) -> DataFrame:
    """Pooled medians of the sensors that match a query, as one row.

    An exact id match is used alone; otherwise any case-free substring matches.
    """
    text = query.strip()
    identifier = F.coalesce(quoted("sensor_id").cast("string"), F.lit(""))
    exact = features.where(identifier == text)
    matches = features.where(F.lit(False)) if not text else exact
    if text and matches.isEmpty():
        matches = features.where(F.contains(F.lower(identifier), F.lit(text.lower())))
    ids = matches.select(identifier.alias("id")).distinct().orderBy("id").limit(20)
    first_ids = one_row(ids.agg(F.sort_array(F.collect_list("id")).alias("all")))["all"]
    profile = aggregate_with_percentiles(
        matches.select(*[scalar.finite(quoted(c)).alias(c) for c in columns], *[quoted(c).alias(f"__m_{c}") for c in metadata], quoted(order).alias("__order")),
        [],
        {c: {f"{c}_profile": 0.5} for c in columns},
        [
            F.count(F.lit(1)).alias("matched_rows"),
            *[F.min_by(quoted(f"__m_{c}"), F.col("__order")).alias(f"first_{c}") for c in metadata],
        ],
        hot_rows=hot_rows,
    )
    return profile.select(
        F.when(F.col("matched_rows") > 0, F.lit("ok")).otherwise(F.lit("not_found")).alias("status"),
        F.lit(query).alias("query"),
        "matched_rows",
        first_ids.alias("matched_sensor_ids"),
        *[quoted(f"first_{c}").alias(c) for c in metadata],
        *[quoted(f"{c}_profile").alias(c) for c in columns],
    )


def sensor_profiles(
    features: DataFrame, columns: Sequence[str], key: str = "sensor_id", hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Median profile of every sensor."""
    return aggregate_with_percentiles(
        features.select(quoted(key), *[scalar.finite(quoted(c)).alias(c) for c in columns]),
        [key],
        {c: {f"{c}_median_of_rows": 0.5} for c in columns},
        [F.count(F.lit(1)).alias("matched_rows")],
        hot_rows=hot_rows,
    ).select(quoted(key), "matched_rows", *[quoted(f"{c}_median_of_rows").alias(c) for c in columns])


def column_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, mean, std, values): std 0 reads 1; a column without values is 0, 1."""
    value = {c: scalar.number(df, c, "taxonomy") for c in columns}
    wide = df.agg(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                F.coalesce(F.avg(value[c]), F.lit(0.0)).alias("mean"),
                F.coalesce(F.nullif(F.stddev_pop(value[c]), F.lit(0.0)), F.lit(1.0)).alias("std"),
                F.count(value[c]).alias("values"),
            ).alias(c)
            for c in columns
        ]
    )
    return wide.select(F.explode(F.array(*[quoted(c) for c in columns])).alias("s")).select("s.*")
