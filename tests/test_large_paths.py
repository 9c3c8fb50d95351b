"""The routes taken for very large groups give the same results as the small ones."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from particlelake.operators import aggregates, context, joins, order_stats, ranking, validity
from particlelake.operators.cluster import density
from particlelake.operators.particles import particle_summaries
from particlelake.operators.preprocess import FeaturePreprocessor, spearman_matrix
from particlelake.operators.records import exact_sample, slice_rows
from particlelake.plans import decision_queries, standins as st
from particlelake.runtime import cut_lineage
from tests.conftest import SMALL


def _rows(df, *order):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def lineitem(spark):
    # one supplier holds a third of all rows
    li = st.table(spark, SMALL, "lineitem")
    hot = F.when(F.col("l_partkey") % 3 == 0, F.lit(0)).otherwise(F.col("l_suppkey") + 1)
    return li.withColumn("sensor_id", hot)


@pytest.mark.parametrize("hot_rows", [1_500, 1])
def test_percentiles_of_hot_groups(lineitem, hot_rows):
    small = aggregates.sensor_profiles(lineitem, ["l_quantity", "l_extendedprice"])
    large = aggregates.sensor_profiles(lineitem, ["l_quantity", "l_extendedprice"], hot_rows=hot_rows)
    assert _rows(small, "sensor_id") == _rows(large, "sensor_id")


def test_global_percentiles_of_a_hot_table(lineitem):
    args = ([], {"l_extendedprice": {"p1": 0.01, "mid": 0.5, "p99": 0.99}}, [F.count(F.lit(1)).alias("n")])
    small = order_stats.aggregate_with_percentiles(lineitem, *args).first()
    large = order_stats.aggregate_with_percentiles(lineitem, *args, hot_rows=1).first()
    assert tuple(small) == pytest.approx(tuple(large), rel=1e-12)


def test_image_summaries_of_hot_images(spark):
    particles = st.shaped_particles(spark, SMALL).withColumn("image_id", F.col("image_id") % 3)
    small, large = particle_summaries(particles), particle_summaries(particles, hot_rows=10)
    for a, b in zip(small.orderBy("image_id").collect(), large.orderBy("image_id").collect()):
        assert tuple(a) == pytest.approx(tuple(b), rel=1e-9)


def test_ranks_of_hot_groups(lineitem):
    slim = lineitem.select("sensor_id", "l_quantity", "l_orderkey", "l_linenumber", "l_partkey")
    small = order_stats.average_rank(slim, "l_quantity", ["sensor_id"])
    large = order_stats.average_rank(slim, "l_quantity", ["sensor_id"], hot_rows=1)
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "sensor_id")
    assert _rows(small, *keys) == _rows(large, *keys)


@pytest.mark.parametrize("within", [(), ("g",)])
def test_adjusted_p_values_of_a_large_table(spark, within):
    p = F.when(F.col("id") % 11 != 0, F.pmod(F.xxhash64("id"), F.lit(700)) / 1000.0)
    df = spark.range(2_000).select("id", p.alias("p"), (F.col("id") % 3).alias("g"))
    small = ranking.benjamini_hochberg(df, "p", "q", within, large=False)
    large = ranking.benjamini_hochberg(df, "p", "q", within, large=True)
    assert _rows(small, "id") == _rows(large.select(*small.columns), "id")


def test_kruskal_and_spearman_on_large_tables(lineitem):
    columns = ["l_quantity", "l_discount"]
    small = context.kruskal_wallis(lineitem, "l_returnflag", columns)
    large = context.kruskal_wallis(lineitem, "l_returnflag", columns, hot_rows=1)
    assert _rows(small, "variable") == _rows(large, "variable")
    keyed = cut_lineage(lineitem.withColumn("row", F.monotonically_increasing_id()))
    small = spearman_matrix(keyed, columns, "row")
    assert _rows(small, "feature_a", "feature_b") == _rows(spearman_matrix(keyed, columns, "row", hot_rows=1), "feature_a", "feature_b")


def test_cleaning_on_large_tables(spark):
    wide = decision_queries.cleaning_input(spark, SMALL)
    small = FeaturePreprocessor(decision_queries.CLEAN_COLUMNS).fit(wide)
    large = FeaturePreprocessor(decision_queries.CLEAN_COLUMNS, hot_rows=1).fit(wide)
    assert small.report() == large.report()
    for name, plan in small.columns.items():
        assert plan.centre == pytest.approx(large.columns[name].centre) and plan.scale == pytest.approx(large.columns[name].scale)


@pytest.mark.parametrize("leaf", [1, 5, 64])
def test_station_cells_agree_with_the_array(spark, leaf):
    sensors = st.sensors(spark, SMALL).select("sensor_id", "latitude", "longitude")
    stations = st.stations(spark, SMALL)
    small = joins.nearest_station(sensors, stations)
    large = joins.nearest_station(sensors, stations, array_rows=0, leaf_stations=leaf)
    assert _rows(small, "sensor_id") == _rows(large, "sensor_id")


def test_station_cells_across_the_globe(spark):
    key = F.col("id")
    sensors = spark.range(400).select(
        key.alias("sensor_id"), ((key * 37) % 179 - 89.5).alias("latitude"), ((key * 101) % 360 - 180.0).alias("longitude")
    )
    stations = spark.range(60).select(
        key, F.concat(F.lit("s"), key).alias("name"), ((key * 29) % 178 - 89.0).alias("lat"), ((key * 83) % 359 - 179.5).alias("long"),
        F.lit(1.0).alias("pm10"), F.lit(2.0).alias("pm25"), F.lit("").alias("fetched_at"), key.alias("ord"),
    )
    small = joins.nearest_station(sensors, stations)
    large = joins.nearest_station(sensors, stations, array_rows=0)
    assert _rows(small, "sensor_id") == _rows(large, "sensor_id")


def _grid_stations(spark, n, lat, long):
    key = F.col("id")
    return spark.range(n).select(
        key, F.concat(F.lit("s"), key).alias("name"), lat.alias("lat"), long.alias("long"),
        F.lit(1.0).alias("pm10"), F.lit(2.0).alias("pm25"), F.lit("").alias("fetched_at"), key.alias("ord"),
    )


def test_dense_city_is_many_small_cells(spark):
    """Nine of ten positions and stations lie within one degree; no position meets many stations."""
    key = F.col("id")
    spot = lambda seed: F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000)) / 1e6
    city = key % 10 != 0
    place = lambda a, b: (F.when(city, 40.0 + spot(a)).otherwise(spot(a) * 170 - 85), F.when(city, -3.0 + spot(b)).otherwise(spot(b) * 350 - 175))
    lat, lon = place(1, 2)
    sensors = spark.range(3_000).select(key.alias("sensor_id"), lat.alias("latitude"), lon.alias("longitude"))
    stations = _grid_stations(spark, 2_000, *place(3, 4))
    small = joins.nearest_station(sensors, stations, array_rows=10_000)
    large = joins.nearest_station(sensors, stations, array_rows=0)
    assert _rows(small, "sensor_id") == _rows(large, "sensor_id")
    positions = sensors.select(F.col("latitude").alias("__y"), F.col("longitude").alias("__x"))
    leaves = joins.station_cells(positions, joins._usable(stations, "ord"))
    sizes = leaves.select(F.size("stations").alias("n"), "level").agg(F.max("n"), F.max("level"), F.sum("n")).first()
    assert sizes[0] <= joins.LEAF_STATIONS and sizes[1] >= 6 and sizes[2] < 3_000 * 16


def test_odd_coordinates_and_one_spot(spark):
    """Positions beyond the globe's ranges, poles, and many positions on one spot."""
    odd = [(0, 100.0, 10.0), (1, -95.0, 200.0), (2, 90.0, 0.0), (3, -90.0, 180.0), (4, 45.0, -540.5), (5, None, 1.0), (6, float("nan"), 1.0)]
    sensors = spark.createDataFrame(odd + [(10 + i, 12.5, 12.5) for i in range(300)], "sensor_id long, latitude double, longitude double")
    key = F.col("id")
    stations = _grid_stations(spark, 500, (key * 0.36 - 90.0), (key * 7 % 360 - 180.0))
    small = joins.nearest_station(sensors, stations, array_rows=10_000)
    large = joins.nearest_station(sensors, stations, array_rows=0, leaf_stations=4)
    assert _rows(small.drop("latitude"), "sensor_id") == _rows(large.drop("latitude"), "sensor_id")


def test_percentiles_of_large_groups_by_counters(spark):
    """Ties, nulls, infinities, NaN, equal and few values against Spark's own percentile; no row is moved."""
    key = F.col("id")
    odd = F.when(key % 97 == 0, F.lit(float("nan"))).when(key % 89 == 0, F.lit(float("-inf"))).when(key % 83 == 0, F.lit(float("inf")))
    df = spark.range(40_000).select(
        F.when(key % 3 != 0, key % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("spread"),
        F.when(key % 10 == 0, (key % 50).cast("double")).otherwise(0.0).alias("zeros"), F.when(key % 2 == 0, F.sqrt(key.cast("double"))).alias("holes"),
        odd.otherwise(F.exp(key / 100.0)).alias("odd"), F.lit(7.0).alias("same"), F.lit(None).cast("double").alias("none"),
    )
    probs = {"lo": 0.01, "q1": 0.25, "mid": 0.5, "hi": 0.99, "top": 1.0, "low": 0.0}
    wanted = {c: {f"{c}_{n}": p for n, p in probs.items()} for c in ("spread", "zeros", "holes", "same", "none")}
    wanted["odd"] = {"odd_lo": 0.05, "odd_mid": 0.5}
    for keys in (["g"], []):
        plain = [F.percentile(c, F.lit(p)).alias(label) for c, labels in wanted.items() for label, p in labels.items()]
        expected = df.groupBy(*keys).agg(*plain)
        found = order_stats.aggregate_with_percentiles(df, keys, wanted, hot_rows=1).select(*expected.columns)
        assert _rows(found, *(keys or ["same_mid"])) == _rows(expected, *(keys or ["same_mid"]))
    few = spark.createDataFrame([(1, 4.0), (1, 5.0), (2, None)], "g long, v double")
    found = order_stats.aggregate_with_percentiles(few, ["g"], {"v": {"m": 0.5, "h": 0.9}}, hot_rows=0)
    assert _rows(found.select("g", "m", "h"), "g") == [(1, 4.5, 4.9), (2, None, None)]


def test_frequent_values_are_not_moved(spark):
    """Of a column with nine in ten zeros only the rare values meet a shuffle."""
    key = F.col("id")
    value = F.when(key % 10 != 0, F.lit(0.0)).otherwise(key.cast("double"))
    df = spark.range(60_000).select(key, value.alias("v"), (key % 2).alias("g"))
    ranked = order_stats.ranked_value_counts(df, ["g"], "v").select("g", "v", "n", "avg_rank")
    frequent, rest = order_stats.split_frequent(df, ranked, ["g", "v"])
    assert rest.count() == 5_999 and frequent.count() == 54_001
    assert rest.columns == df.columns
    whole = order_stats.average_rank(df, "v", ["g"])
    window = Window.partitionBy("g").orderBy("v")
    below = F.rank().over(window) + (F.count(F.lit(1)).over(Window.partitionBy("g", "v")) - 1) / 2.0
    wanted = df.withColumn("avg_rank", below)
    assert _rows(whole, "id") == _rows(wanted, "id")
    clash = order_stats.average_rank(df.withColumn("n", F.lit(1)), "v", ["g"])
    assert _rows(clash.drop("n"), "id") == _rows(whole, "id")


@pytest.mark.parametrize("block_rows", [64, 200])
def test_blocks_do_not_change_the_silhouette(spark, block_rows):
    space, features = st.labelled_space(spark, SMALL), st.feature_names(6)
    one = validity.silhouette(space, features, mode="exact")
    many = validity.silhouette(space, features, mode="exact", block_rows=block_rows)
    assert _rows(one, "image_id") == _rows(many, "image_id")
    assert all(-1 <= r["silhouette_value"] <= 1 for r in one.collect())


def test_blocks_do_not_change_density_clusters(spark):
    space, features = st.labelled_space(spark, SMALL).drop("cluster_label"), st.feature_names(4)
    one = density.density_clusters(min_cluster_size=5, min_samples=4, eps_quantile=0.3)(space, features, 0)[0]
    many = density.density_clusters(min_cluster_size=5, min_samples=4, eps_quantile=0.3, block_rows=70)(space, features, 0)[0]
    assert _rows(one, "image_id") == _rows(many, "image_id")


def test_sample_is_exact_and_ignores_partitioning(spark):
    orders = st.table(spark, SMALL, "orders").select("o_orderkey")
    one = exact_sample(orders, "o_orderkey", 333, 5)
    many = exact_sample(orders.repartition(7), "o_orderkey", 333, 5)
    assert one.count() == 333 and _rows(one, "o_orderkey") == _rows(many, "o_orderkey")
    assert exact_sample(orders, "o_orderkey", 10**6, 5).count() == orders.count()
    want = {r[0] for r in orders.orderBy(F.shiftrightunsigned(F.xxhash64("o_orderkey", F.lit(5)), 1), "o_orderkey").limit(333).collect()}
    assert {r[0] for r in one.collect()} == want


def test_slices(spark):
    orders = st.table(spark, SMALL, "orders").select("o_orderkey", "o_custkey")
    everything = [r[0] for r in orders.orderBy("o_custkey", "o_orderkey").collect()]
    part = slice_rows(orders, ["o_custkey", "o_orderkey"], 100, 50)
    assert sorted(r[0] for r in part.collect()) == sorted(everything[100:150])


def test_results_do_not_depend_on_shuffle_partitions(spark):
    space = st.labelled_space(spark, SMALL)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found.append(_rows(context.kruskal_wallis(space, "cluster_label", st.feature_names(4)), "variable"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]
