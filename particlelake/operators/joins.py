"""Joins and keyed merges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from particlelake import fixed_values as fv
from particlelake.functions import geo, scalar
from particlelake.operators.order_stats import key_join
from particlelake.runtime import any_row, cut_lineage, has_more_rows_than, quoted

# Stations up to this count travel to the tasks as one array.
STATION_ARRAY_ROWS = 128
# Beyond that, cells of the candidate tree halve from this size on until they keep few stations.
ROOT_DEGREES = 32.0
LEAF_STATIONS = 64
MAX_LEVELS = 26

_STATION_FIELDS = ("id", "name", "pm10", "pm25", "fetched_at")


def _nearest_outputs(best: Column) -> list[Column]:
    return [
        best["id"].alias("official_station_id"),
        best["name"].alias("official_station_name"),
        best["distance_km"].alias("official_station_distance_km"),
        best["pm10"].alias("official_pm10"),
        best["pm25"].alias("official_pm25"),
        best["fetched_at"].alias("official_fetched_at"),
    ]


def _usable(stations: DataFrame, order: str) -> DataFrame:
    """Stations with a finite position, one per position: the first in order.

    A later station at the same position can never win, so dropping it is exact.
    """
    placed = stations.select(
        scalar.finite(F.col("lat")).alias("lat"),
        scalar.finite(F.col("long")).alias("long"),
        *_STATION_FIELDS,
        quoted(order).alias("ord"),
    ).where(F.col("lat").isNotNull() & F.col("long").isNotNull())
    return (
        placed.groupBy("lat", "long")
        .agg(F.min_by(F.struct(*_STATION_FIELDS, "ord"), F.col("ord")).alias("first"))
        .select("lat", "long", "first.*")
    )


def nearest_station(
    sensors: DataFrame,
    stations: DataFrame,
    latitude: str = "latitude",
    longitude: str = "longitude",
    order: str = "ord",
    array_rows: int = STATION_ARRAY_ROWS,
    leaf_stations: int = LEAF_STATIONS,
) -> DataFrame:
    """Every sensor with its nearest station; ties go to the first station.

    Few stations travel as one constant array, so the sensors are not shuffled.
    Beyond ``array_rows`` the search runs once per distinct position: each occupied cell of a
    quadtree keeps the stations that can be nearest to any point in it and positions join
    on the cell; the triangle inequality makes that list complete. A cell splits
    while it keeps more than ``leaf_stations``, so a dense city is many small cells.
    """
    usable = _usable(stations, order)
    if not has_more_rows_than(usable, array_rows):
        return _nearest_from_array(sensors, usable, latitude, longitude)
    return _nearest_from_cells(sensors, usable, latitude, longitude, leaf_stations)


def _array_literal(rows: DataFrame) -> Column:
    """A table of checked size as one constant array, usable inside ``transform``."""
    schema = T.ArrayType(rows.schema)
    text = rows.agg(F.to_json(F.collect_list(F.struct("*"))).alias("all")).first()["all"]
    return F.from_json(F.lit(text), schema)


def _nearest_from_array(sensors: DataFrame, usable: DataFrame, latitude: str, longitude: str) -> DataFrame:
    everything = _array_literal(usable)
    lat, lon = scalar.finite(quoted(latitude)), scalar.finite(quoted(longitude))
    nearest = F.array_min(
        F.transform(
            everything,
            lambda s: F.struct(
                geo.station_distance_km(lat, lon, s["lat"], s["long"]).alias("distance_km"),
                s["ord"].alias("ord"),
                *[s[f].alias(f) for f in _STATION_FIELDS],
            ),
        )
    )
    best = F.when(lat.isNotNull() & lon.isNotNull(), nearest)
    return sensors.withColumn("__best", best).select(*sensors.columns, *_nearest_outputs(F.col("__best")))


def _cell(col: Column, level: int) -> Column:
    return F.floor(col / F.lit(ROOT_DEGREES / 2**level)).cast("long")


def _on_globe(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The same point with a latitude in [-90, 90] and a longitude in [-180, 180], as cells need it."""
    inside = (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    y, x = F.radians(lat), F.radians(lon)
    turned = F.degrees(F.atan2(F.cos(y) * F.sin(x), F.cos(y) * F.cos(x)))
    return F.when(inside, lat).otherwise(F.degrees(F.asin(F.sin(y)))).alias("__y"), F.when(inside, lon).otherwise(turned).alias("__x")


def _reach_km(level: int) -> Column:
    """Least radius around a cell's middle that holds all its points."""
    degrees = ROOT_DEGREES / 2**level
    middle, half = (F.col("cy") + 0.5) * degrees, degrees / 2.0
    # any point is reached along the meridian and then along its own parallel
    widest = F.cos(F.radians(F.greatest(F.lit(0.0), F.abs(middle) - half)))
    return F.lit(fv.EARTH_RADIUS_STATION_KM) * F.radians(F.lit(half)) * (1.0 + widest) * 1.000001


def _possible(met: DataFrame, level: int) -> DataFrame:
    """Those of ``met(cy, cx, lat, long, ...)``, cells with stations, that may be nearest to some point of the cell."""
    degrees = ROOT_DEGREES / 2**level
    centre = geo.station_distance_km((F.col("cy") + 0.5) * degrees, (F.col("cx") + 0.5) * degrees, F.col("lat"), F.col("long"))
    measured = met.withColumn("centre_km", centre)
    closest = measured.groupBy("cy", "cx").agg(F.min("centre_km").alias("closest_km"))
    near = F.col("centre_km") <= F.col("closest_km") + 2.0 * _reach_km(level)
    return measured.join(closest, ["cy", "cx"]).where(near).drop("centre_km", "closest_km")


def station_cells(positions: DataFrame, usable: DataFrame, leaf_stations: int = LEAF_STATIONS) -> DataFrame:
    """(level, cy, cx, stations) of the leaves over ``positions(__y, __x)``.

    Children of a cell take their stations from its list, so a level costs at most four
    times the rows that the one before has kept. Only at ``MAX_LEVELS``, where a cell
    measures less than a metre, may a leaf keep more than ``leaf_stations``.
    """
    occupied = lambda level: positions.select(
        _cell(F.col("__y"), level).alias("cy"), _cell(F.col("__x"), level).alias("cx"),
        *([] if level == 0 else [_cell(F.col("__y"), level - 1).alias("py"), _cell(F.col("__x"), level - 1).alias("px")]),
    ).distinct()
    # at most 7 x 13 root cells of 32 degrees
    roots = _array_literal(occupied(0))
    kept = cut_lineage(_possible(usable.select(F.explode(roots).alias("c"), "*").select("c.*", "lat", "long", "ord", *_STATION_FIELDS), 0))
    station = F.struct("lat", "long", "ord", *_STATION_FIELDS)
    leaves = None
    for level in range(MAX_LEVELS + 1):
        sizes = kept.groupBy("cy", "cx").agg(F.count(F.lit(1)).alias("n"))
        full = sizes.where(F.col("n") > (leaf_stations if level < MAX_LEVELS else 2**62)).select("cy", "cx")
        ready = kept.join(full, ["cy", "cx"], "left_anti").groupBy("cy", "cx").agg(F.collect_list(station).alias("stations"))
        ready = cut_lineage(ready.select(F.lit(level).alias("level"), "cy", "cx", "stations"))
        leaves = ready if leaves is None else leaves.unionByName(ready)
        split = kept.join(full, ["cy", "cx"], "left_semi")
        if not any_row(split):
            return leaves
        parents = split.withColumnsRenamed({"cy": "py", "cx": "px"})
        kept = cut_lineage(_possible(parents.join(occupied(level + 1), ["py", "px"]).drop("py", "px"), level + 1))
    return leaves


def _nearest_from_cells(
    sensors: DataFrame, usable: DataFrame, latitude: str, longitude: str, leaf_stations: int
) -> DataFrame:
    lat, lon = scalar.finite(quoted(latitude)), scalar.finite(quoted(longitude))
    placed = sensors.select(lat.alias("__lat"), lon.alias("__lon")).where(F.col("__lat").isNotNull() & F.col("__lon").isNotNull()).distinct()
    positions = cut_lineage(placed.select("*", *_on_globe(F.col("__lat"), F.col("__lon"))))
    leaves = station_cells(positions, cut_lineage(usable), leaf_stations)
    levels = sorted(r["level"] for r in leaves.select("level").distinct().collect())
    places = F.array(*[F.struct(F.lit(i).alias("level"), _cell(F.col("__y"), i).alias("cy"), _cell(F.col("__x"), i).alias("cx")) for i in levels])
    # a position lies in one leaf; the search inside it is one expression over its short list
    distance = lambda s: geo.station_distance_km(F.col("__lat"), F.col("__lon"), s["lat"], s["long"])
    nearest = F.array_min(
        F.transform("stations", lambda s: F.struct(distance(s).alias("distance_km"), s["ord"].alias("ord"), *[s[f].alias(f) for f in _STATION_FIELDS]))
    )
    best = (
        positions.select("__lat", "__lon", F.explode(places).alias("c")).select("__lat", "__lon", "c.*")
        .join(leaves, ["level", "cy", "cx"]).select("__lat", "__lon", nearest.alias("__best"))
    )
    keyed = sensors.withColumns({"__lat0": lat, "__lon0": lon})
    return keyed.join(
        best, (F.col("__lat0") == F.col("__lat")) & (F.col("__lon0") == F.col("__lon")), "left"
    ).select(*sensors.columns, *_nearest_outputs(F.col("__best")))


def _owner(df: DataFrame) -> Column:
    """Sensor id, or the image id when the sensor id is blank."""
    names = [c for c in ("sensor_id", "image_id") if c in df.columns]
    return F.coalesce(*[scalar.non_blank(F.trim(quoted(c).cast("string"))) for c in names])


def last_per_key(df: DataFrame, key: str, order: Column) -> DataFrame:
    """One row per key, the one with the greatest order; combines map-side."""
    return df.groupBy(quoted(key)).agg(F.max_by(F.struct("*"), order).alias("__row")).select("__row.*")


def join_places(features: DataFrame, places: DataFrame, order: str) -> DataFrame:
    """Left join of place features by owner; the last duplicate of a place wins.

    Adds ``places_matched``; unmatched rows get null numbers and an empty category.
    """
    numbers = [c for c in fv.PLACE_NUMERIC_FEATURES if c in places.columns]
    texts = [c for c in fv.PLACE_TEXT_FEATURES if c in places.columns]
    keyed = places.select(
        _owner(places).alias("__owner"),
        *[scalar.finite(quoted(c)).alias(c) for c in numbers],
        *[F.coalesce(quoted(c), F.lit("")).alias(c) for c in texts],
        quoted(order).alias("__order"),
    ).where(F.col("__owner").isNotNull())
    latest = last_per_key(keyed, "__owner", F.col("__order")).drop("__order").withColumn("__found", F.lit(True))
    base = features.drop(*[c for c in numbers + texts if c in features.columns]).withColumn("__mine", _owner(features))
    joined = base.join(latest, F.col("__mine") == F.col("__owner"), "left")
    return joined.select(
        *[quoted(c) for c in base.columns if c != "__mine"],
        *[quoted(c) for c in numbers],
        *[F.coalesce(quoted(c), F.lit("")).alias(c) for c in texts],
        F.col("__found").isNotNull().alias("places_matched"),
    )


def resolve_labels(
    rows: DataFrame,
    manual: DataFrame,
    predicted: DataFrame | None = None,
    key: str = "image_id",
    manual_label: str = "manual_grid_label",
    predicted_label: str = "roi_grid_label",
    order: str | None = None,
) -> DataFrame:
    """Final label and its source: a manual label wins over the predicted one."""

    def lookup(df: DataFrame, label: str) -> DataFrame:
        text = F.trim(quoted(label).cast("string"))
        ordinal = quoted(order) if order and order in df.columns else F.lit(0)
        return (
            df.select(quoted(key), text.alias(label), ordinal.alias("__o"))
            .where(F.col(label) != "")
            .groupBy(key)
            .agg(F.max_by(label, F.struct("__o", label)).alias(label))
        )

    out = rows
    if predicted is not None:
        out = out.drop(predicted_label).join(lookup(predicted, predicted_label), key, "left")
    out = out.drop(manual_label).join(lookup(manual, manual_label), key, "left")
    hand = F.coalesce(quoted(manual_label), F.lit(""))
    guess = F.trim(F.coalesce(quoted(predicted_label).cast("string"), F.lit("")))
    return out.withColumns(
        {
            manual_label: hand,
            predicted_label: guess,
            "final_grid_label": F.when(hand != "", hand)
            .when(guess == "grid", F.lit("grid"))
            .when(guess.isin("no_grid", "uncertain"), F.lit("no_grid"))
            .otherwise(F.lit("unknown")),
            "final_grid_label_source": F.when(hand != "", F.lit("manual_label"))
            .when(guess == "grid", F.lit("predicted_grid"))
            .when(guess.isin("no_grid", "uncertain"), F.lit("predicted_non_grid_rule"))
            .otherwise(F.lit("missing_prediction")),
        }
    )


def label_counts(resolved: DataFrame) -> DataFrame:
    """(column, value, count) of the final labels and of their sources."""
    columns = ("final_grid_label", "final_grid_label_source")
    entries = F.array(*[F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in columns])
    return (
        resolved.select(F.explode(entries).alias("e")).groupBy("e.column", "e.value").agg(F.count(F.lit(1)).alias("count"))
    )


def keep_ids(
    kept: DataFrame,
    tables: Mapping[str, DataFrame],
    key: str = "image_id",
    by_owner: Sequence[str] = ("places",),
    columns: Mapping[str, Sequence[str]] | None = None,
) -> dict[str, DataFrame]:
    """Every table restricted to the kept ids, optionally to some of its columns."""
    ids = kept.select(quoted(key).alias("__kept"))
    result = {}
    for name, table in tables.items():
        if name in by_owner:
            match = _owner(table) == F.col("__kept").cast("string")
        elif dict(table.dtypes)[key] == "string":
            match = F.trim(quoted(key)) == F.col("__kept")
        else:
            match = quoted(key) == F.col("__kept")
        filtered = table.join(ids, match, "left_semi")
        if columns and name in columns:
            filtered = filtered.select(*[quoted(c) for c in columns[name] if c in filtered.columns])
        result[name] = filtered
    return result


def check_unique(df: DataFrame, key: str, what: str) -> None:
    """Raise when a key is blank or appears twice."""
    if any_row(df.where(scalar.non_blank(quoted(key).cast("string")).isNull())):
        raise ValueError(f"{what}: blank {key}")
    repeated = df.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if repeated is not None:
        raise ValueError(f"{what}: duplicate {key} {repeated[0]!r}")


def align_feature_spaces(
    spaces: Mapping[str, DataFrame], key: str = "image_id", reference: str = "pca_scores"
) -> DataFrame:
    """All spaces side by side for the ids of the reference space.

    Feature columns of a space are prefixed with its name when several spaces
    are given; a duplicate, blank or missing id raises.
    """
    names = list(spaces)
    if not names:
        raise ValueError("no feature space given")
    if len(names) == 1:
        return spaces[names[0]]
    first = reference if reference in spaces else names[0]
    for name in names:
        check_unique(spaces[name], key, name)

    def named(name: str) -> DataFrame:
        df = spaces[name]
        return df.select(quoted(key), *[quoted(c).alias(f"{name}.{c}") for c in df.columns if c != key])

    out = named(first)
    for name in names:
        if name == first:
            continue
        missing = spaces[first].select(quoted(key)).join(spaces[name].select(quoted(key)), key, "left_anti").first()
        if missing is not None:
            raise ValueError(f"{key} {missing[0]!r} is missing from {name}")
        out = out.join(named(name), key)
    return out


def align_labels(
    dataset: DataFrame, assignments: DataFrame, key: str = "image_id", label: str = "cluster_label",
    projection: Sequence[str] = (),
) -> DataFrame:
    """Rows that have a label; with a projection also rows whose axes are present."""
    joined = dataset.drop(label).join(assignments.select(quoted(key), quoted(label)), key)
    for axis in projection:
        joined = joined.where(scalar.finite(quoted(axis)).isNotNull())
    if not any_row(joined):
        raise ValueError("no overlapping ids between the dataset and the assignments")
    return joined


def lookup_join(rows: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Left join that raises on duplicate lookup keys; missing text is empty."""
    usable = lookup.where(scalar.non_blank(quoted(key).cast("string")).isNotNull())
    check_unique(usable, key, "lookup")
    joined = key_join(rows, usable, [key], "left")
    texts = {n for n, kind in usable.dtypes if kind == "string" and n != key}
    return joined.select(*[F.coalesce(quoted(c), F.lit("")).alias(c) if c in texts else quoted(c) for c in joined.columns])


def merge_collections(tables: Sequence[DataFrame], key: str = "id", prefer: str = "last") -> DataFrame:
    """One document per id from several collections; the last or the first wins."""
    tagged = [t.withColumn("__source", F.lit(i)) for i, t in enumerate(tables)]
    union = tagged[0]
    for other in tagged[1:]:
        union = union.unionByName(other, allowMissingColumns=True)
    pick = F.max_by if prefer == "last" else F.min_by
    return (
        union.groupBy(quoted(key))
        .agg(pick(F.struct(*[quoted(c) for c in union.columns]), F.col("__source")).alias("__row"))
        .select("__row.*")
        .drop("__source")
    )


def _unique(updates: DataFrame, key: str) -> DataFrame:
    """One row per key; a second one fails the job, since no order chooses between them."""
    others = [c for c in updates.columns if c != key]
    once = updates.groupBy(quoted(key)).agg(F.count(F.lit(1)).alias("__n"), *[F.first(quoted(c)).alias(c) for c in others])
    told = F.raise_error(F.concat(F.lit(f"more than one update without an order for {key} "), quoted(key).cast("string")))
    counted = F.when(F.col("__n") > 1, told).otherwise(F.lit(True))
    return once.where(counted.cast("boolean")).select(quoted(key), *[quoted(c) for c in others])


def upsert(
    target: DataFrame,
    updates: DataFrame,
    key: str,
    set_columns: Sequence[str],
    insert: bool = True,
    order: str | None = None,
    resets: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Target after a keyed set; adds ``action`` (inserted, modified, matched, kept).

    ``resets`` are constant columns also set by every update. With
    ``insert=False`` unknown keys are ignored. Per key the update with the
    greatest ``order`` wins, also when its value is null. Without ``order`` a key
    that is updated twice is an error, raised when the result is computed.
    """
    resets = dict(resets or {})
    changed = [*set_columns, *resets]
    chosen = updates.select(
        quoted(key), *[quoted(c) for c in set_columns], *([quoted(order).alias("__order")] if order else [])
    )
    chosen = last_per_key(chosen, key, F.col("__order")).drop("__order") if order else _unique(chosen, key)
    incoming = chosen.select(
        quoted(key).alias("__key"),
        *[quoted(c).alias(f"__new_{c}") for c in set_columns],
        *[value.alias(f"__new_{c}") for c, value in resets.items()],
        F.lit(True).alias("__update"),
    )
    current = target.withColumn("__present", F.lit(True))
    joined = current.join(incoming, quoted(key) == F.col("__key"), "full_outer" if insert else "left")
    updated, present = F.col("__update").isNotNull(), F.col("__present").isNotNull()
    same = F.lit(True)
    for c in changed:
        same = same & quoted(c).eqNullSafe(quoted(f"__new_{c}"))
    action = (
        F.when(updated & ~present, F.lit("inserted"))
        .when(updated & ~same, F.lit("modified"))
        .when(updated, F.lit("matched"))
        .otherwise(F.lit("kept"))
    )
    columns = []
    for c in target.columns:
        if c == key:
            columns.append(F.coalesce(quoted(c), F.col("__key")).alias(c))
        elif c in changed:
            columns.append(F.when(updated, quoted(f"__new_{c}")).otherwise(quoted(c)).alias(c))
        else:
            columns.append(quoted(c))
    return joined.select(*columns, action.alias("action"))


def upsert_report(merged: DataFrame) -> DataFrame:
    """Matched, modified and inserted counts of an upsert."""
    return merged.agg(
        F.count_if(F.col("action").isin("matched", "modified")).alias("matched"),
        F.count_if(F.col("action") == "modified").alias("modified"),
        F.count_if(F.col("action") == "inserted").alias("inserted"),
        F.count(F.lit(1)).alias("total"),
    )


def tag_and_union(diy: DataFrame | None, official: DataFrame | None) -> DataFrame:
    """Both sensor sources with a ``type``; a missing source counts as empty."""
    sources = [(s, name) for s, name in ((diy, "diy"), (official, "official")) if s is not None]
    if not sources:
        raise ValueError("both sources are missing")
    tagged = [s.withColumn("type", F.lit(name)) for s, name in sources]
    return tagged[0] if len(tagged) == 1 else tagged[0].unionByName(tagged[1], allowMissingColumns=True)
