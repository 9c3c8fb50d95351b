"""Readers, writers, parsing rules, streams and images on hand-written input."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from particlelake.functions import dates, scalar
from particlelake.operators import joins, records, taxonomy
from particlelake.operators.pixels import image_pixel_stats, image_statistics, read_images
from particlelake.sources import files
from particlelake.streaming import ingest


def test_records_as_array_object_and_lines(spark, tmp_path):
    array = [{"_id": {"$oid": "a1"}, "PM10": {"$numberDouble": "12.5"}, "n": {"inner": {"$numberInt": "3"}}}, {"_id": "b2", "PM10": 7, "other": [1]}]
    (tmp_path / "a.json").write_text(json.dumps(array))
    (tmp_path / "o.json").write_text(json.dumps(array[1], indent=1))
    (tmp_path / "l.jsonl").write_text("\n".join(json.dumps(r) for r in array))
    fields = {"_id": "string", "PM10": "double", "n.inner": "int"}
    for name, lines, want in (("a.json", False, 2), ("o.json", False, 1), ("l.jsonl", True, 2)):
        df = files.normalize_extended_json(files.read_records(spark, str(tmp_path / name), json_lines=lines), "doc", fields)
        assert df.count() == want
    rows = {r["_id"]: r for r in files.normalize_extended_json(files.read_records(spark, str(tmp_path / "a.json")), "doc", fields).collect()}
    assert rows["a1"]["PM10"] == 12.5 and rows["a1"]["n.inner"] == 3 and rows["b2"]["PM10"] == 7.0


def test_feature_csv_modes(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("image_id,latitude,a,b\ni1,40,1.5,2\ni2,,3,4\n")
    bad.write_text("image_id,a,b,c\ni1,1,true,\ni2,x,pending,\n")
    df = files.read_feature_csv(spark, str(good))
    assert dict(df.dtypes)["a"] == "double" and dict(df.dtypes)["latitude"] == "string"
    with pytest.raises(ValueError, match="image i1: missing or unparsable value in b"):
        files.read_feature_csv(spark, str(bad))
    lenient = files.read_feature_csv(spark, str(bad), mode="lenient")
    assert lenient.columns == ["image_id", "a"] and [r["a"] for r in lenient.orderBy("image_id").collect()] == [1.0, None]
    (tmp_path / "empty.csv").write_text("image_id,a\n")
    with pytest.raises(ValueError, match="empty"):
        files.read_feature_csv(spark, str(tmp_path / "empty.csv"))


def test_stations(spark, tmp_path):
    (tmp_path / "s.csv").write_text("GML_ID,Name,Latitude,Longitude\n1,A,40.1,-3\n2,,40,-3\n3,C,,-3\n4,D,x,1\n")
    assert [tuple(r) for r in files.read_stations(spark, str(tmp_path / "s.csv")).collect()] == [("1", "A", 40.1, -3.0)]
    (tmp_path / "old.csv").write_text("Plaza, centro,-3.7,40.4\nbad\nX,abc,1\n")
    assert [tuple(r) for r in files.read_legacy_stations(spark, str(tmp_path / "old.csv")).collect()] == [("Plaza, centro", 40.4, -3.7)]


def test_tables_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("x", True, float("nan"), None), ("y", False, 1.5, "t")], "b string, a boolean, n double, s string")
    files.write_table(df, str(tmp_path / "t"), preferred=("s", "b", "s", "zzz"), fmt="csv")
    text = "".join(p.read_text() for p in sorted((tmp_path / "t").glob("*.csv")))
    assert text.startswith("s,b,a,n\n") and ",x,true,\n" in text and "t,y,false,1.5\n" in text
    files.write_table(df, str(tmp_path / "p"), preferred=("n",))
    assert spark.read.parquet(str(tmp_path / "p")).columns == ["n", "b", "a", "s"]
    files.write_report({"rows": 2}, str(tmp_path / "r"), spark)
    files.write_report(df.agg(F.count("*").alias("rows")), str(tmp_path / "q"))
    for name in ("r", "q"):
        assert json.loads("".join(p.read_text() for p in (tmp_path / name).glob("part-*"))) == {"rows": 2}


@pytest.mark.parametrize(
    "text, strict, prefix",
    [("12.5", 12.5, 12.5), (" 7 ", 7.0, 7.0), ("1_000", 1000.0, 1.0), ("12abc", None, 12.0), ("nan", None, None), ("inf", None, None), ("", None, None), ("-.5e1", -5.0, -5.0), (None, None, None)],
)
def test_number_parsing(spark, text, strict, prefix):
    r = spark.createDataFrame([(text,)], "t string").select(scalar.to_float(F.col("t")).alias("s"), scalar.to_float(F.col("t"), "prefix").alias("p")).first()
    assert (r["s"], r["p"]) == (strict, prefix)


@pytest.mark.parametrize(
    "text, shown",
    [(None, "–"), ("", "–"), ("05/03/2024", "05/03/2024"), ("2024-03-05", "05/03/2024"), ("2024-03-05T23:30:00Z", "05/03/2024"), ("soon", "soon")],
)
def test_display_dates(spark, text, shown):
    assert spark.createDataFrame([(text,)], "t string").select(dates.display_date(F.col("t"))).first()[0] == shown


def test_capture_moments(spark):
    texts = ["2025-11-18T10:30:00Z", "2025-11-18 10:30", "2025-11-18", "2025-11-18 noon", "18/11/2025", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(dates.capture_moment(F.col("t")).cast("string"))
    assert [r[0] for r in df.collect()] == ["2025-11-18 10:30:00", "2025-11-18 10:30:00", "2025-11-18 00:00:00", "2025-11-18 00:00:00", None, None]


def test_radius_filter_edges(spark):
    rows = [(1, 40.0, -3.0, "diy"), (2, float("nan"), -3.0, "diy"), (3, 41.0, -3.0, "official"), (4, 40.5, -3.0, "official")]
    df = spark.createDataFrame([(*r, "bad", None) for r in rows], "id int, latitude double, longitude double, type string, fechaInicio string, fechaRecogida string")
    found = records.spatiotemporal_filter(df, center=(40.0, -3.0), radius_km=60.0, start="2024-01-01", end="2024-02-01")
    assert sorted(r["id"] for r in found.collect()) == [1, 4]
    assert [r["id"] for r in records.spatiotemporal_filter(df, types=("official",)).orderBy("id").collect()] == [3, 4]


def test_uniqueness_errors(spark):
    twice = spark.createDataFrame([("a", 1.0), ("a", 2.0)], "image_id string, x double")
    once = spark.createDataFrame([("a", 1.0)], "image_id string, x double")
    other = spark.createDataFrame([("b", 1.0)], "image_id string, y double")
    with pytest.raises(ValueError, match="duplicate"):
        joins.align_feature_spaces({"s": twice, "pca_scores": once})
    with pytest.raises(ValueError, match="missing"):
        joins.align_feature_spaces({"s": other, "pca_scores": once})
    with pytest.raises(ValueError, match="duplicate"):
        joins.lookup_join(once, twice.withColumnRenamed("x", "z"), "image_id")
    with pytest.raises(ValueError, match="overlapping"):
        joins.align_labels(once, other.withColumn("cluster_label", F.lit(1)))


def test_error_status_without_numbers(spark):
    df = spark.createDataFrame([("a", None, "true"), ("b", 2.0, "3")], "image_id string, area_median double, area_iqr string")
    rows = {r["image_id"]: r for r in taxonomy.taxonomy_rank(df, ["area_median", "area_iqr"]).collect()}
    assert rows["a"]["status"] == "error" and rows["a"]["ranked_categories"] is None
    assert rows["b"]["status"] == "ok" and rows["b"]["used_formula_features"] == ["area_iqr", "area_median"]
    assert sum(e["percentage"] for e in rows["b"]["ranked_categories"]) == pytest.approx(100.0)


def test_backfill_dry_run_changes_nothing(spark):
    recs = spark.createDataFrame([("a", "u", None), ("b", "u", None)], "id string, image string, taxonomy string")
    feats = spark.createDataFrame([("a", 2.0)], "id string, area_median double")
    ranked = taxonomy.taxonomy_rank(feats, ["area_median"], keep=("id",))
    same, counts = taxonomy.backfill_taxonomy(recs, ranked, dry_run=True)
    assert tuple(counts.first()) == (2, 1, 1, 0) and same.where("taxonomy IS NOT NULL").isEmpty()
    changed, _ = taxonomy.backfill_taxonomy(recs, ranked)
    assert [r["id"] for r in changed.where("taxonomy IS NOT NULL").collect()] == ["a"]


def test_streams_match_batch_and_survive_a_replay(spark, tmp_path):
    schema = "id long, pm10 double, fetched_at string"
    source = tmp_path / "in"
    for i, rows in enumerate(([(1, 5.0, "t1"), (1, 6.0, "t2"), (9, 1.0, "t1")], [(2, float("inf"), "t3")])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    path = str(tmp_path / "stations")
    ingest.write_snapshot(spark.createDataFrame([(1, 0.0, ""), (2, 0.0, ""), (3, 0.0, "")], schema), path)
    stream = spark.readStream.schema(schema).parquet(str(source))
    for state in ("s1", "s2"):  # a fresh state folder replays every batch
        ingest.upsert_values_stream(stream, path, "id", ["pm10", "fetched_at"], str(tmp_path / state)).awaitTermination()
        found = {r["id"]: (r["pm10"], r["fetched_at"]) for r in ingest.read_snapshot(spark, path).collect()}
        assert found == {1: (6.0, "t2"), 2: (None, "t3"), 3: (0.0, "")}


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    schema = "id long, pm10 double, fetched_at string, name string"
    path, source = str(tmp_path / "stations"), str(tmp_path / "in")
    first = spark.range(200).selectExpr("id", "cast(id as double) as pm10", "'' as fetched_at", "concat('s', id) as name")
    ingest.write_snapshot(first, path, buckets=16)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("id long, pm10 double, fetched_at string").option("maxFilesPerTrigger", 1).parquet(source)
    wanted = {i: (float(i), "", f"s{i}") for i in range(200)}
    before = ingest._manifest(spark, path, -1)[0]
    for step, rows in enumerate([[(7, 70.0, "t1"), (7, 71.0, "t2")], [(7, None, "t3"), (8, 80.0, "t3")], [(999, 1.0, "t4"), (None, 2.0, "t4")], [(9, float("nan"), "t5")]]):
        spark.createDataFrame(rows, "id long, pm10 double, fetched_at string").coalesce(1).write.mode("append").parquet(source)
        ingest.upsert_values_stream(stream, path, "id", ["pm10", "fetched_at"], str(tmp_path / "state")).awaitTermination()
        after = ingest._manifest(spark, path, step)[0]
        moved = {b for b in after if after[b] != before[b]}
        assert len(moved) <= len({r[0] for r in rows if r[0] is not None}) and all(after[b] == step for b in moved)
        assert moved or not {r[0] for r in rows} & set(range(200))
        before = after
        for i, value, at in rows:
            if i in wanted:
                wanted[i] = (None if value is None or value != value else value, at, wanted[i][2])
        assert {r["id"]: (r["pm10"], r["fetched_at"], r["name"]) for r in ingest.read_snapshot(spark, path).collect()} == wanted
    assert ingest._versions(spark, path) == [2, 3]
    listed = set(before.values()) | set(ingest._manifest(spark, path, 2)[0].values())
    assert {int(n.split("=")[1]) for n in ingest._children(spark, f"{path}/data")} <= listed | {3}


def test_an_empty_snapshot_stays_readable(spark, tmp_path):
    path = str(tmp_path / "none")
    ingest.write_snapshot(spark.createDataFrame([], "id long, pm10 double"), path)
    assert ingest.read_snapshot(spark, path).columns == ["id", "pm10"] and ingest.read_snapshot(spark, path).count() == 0


def test_pixel_statistics():
    red = np.zeros((4, 4, 3), dtype=np.uint8)
    red[..., 2] = 255
    out = image_statistics(red)
    assert (out["roi_r_mean"], out["roi_h_mean"], out["roi_s_mean"], out["roi_v_mean"]) == (255, 0, 255, 255)
    assert (out["roi_lab_l_mean"], out["roi_lab_a_mean"], out["roi_lab_b_mean"]) == (136, 208, 195)
    assert out["colorfulness"] == pytest.approx(0.3 * np.hypot(255, 127.5))
    assert out["blur_score_laplacian"] == 0.0 and out["particle_mask_mean_rgb_contrast"] is None
    mask = np.zeros((4, 4), dtype=bool)
    mask[:2] = True
    half = red.copy()
    half[2:] = 0
    out = image_statistics(half, mask)
    assert out["particle_mask_mean_rgb_contrast"] == pytest.approx(85.0)
    assert out["particle_mask_mean_v_contrast"] == pytest.approx(255.0)
    assert image_statistics(red, np.ones((4, 4), dtype=bool))["particle_mask_mean_v_contrast"] is None


def test_images_from_files(spark, tmp_path):
    pixels = np.arange(2 * 2 * 3, dtype=np.uint8).reshape(2, 2, 3) * 20
    rows = b"".join(bytes(pixels[y].tobytes()) + b"\0\0" for y in (1, 0))
    header = b"BM" + (54 + len(rows)).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little")
    info = (40).to_bytes(4, "little") + (2).to_bytes(4, "little") * 2 + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24)
    (tmp_path / "a.bmp").write_bytes(header + info + rows)
    r = image_pixel_stats(read_images(spark, str(tmp_path))).first()
    assert r["roi_b_mean"] == pytest.approx(pixels[..., 0].mean())
    assert r["roi_r_std"] == pytest.approx(pixels[..., 2].astype(float).std())
