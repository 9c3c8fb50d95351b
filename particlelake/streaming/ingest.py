"""Record ingestion and keyed value refresh as streaming jobs.

Both write folders of their own per batch id and overwrite them on a replay, so a batch that
runs twice after a lost driver or executor leaves the same result.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from particlelake.functions import scalar
from particlelake.operators.joins import upsert
from particlelake.operators.records import validate_records
from particlelake.runtime import quoted


def _writer(stream: DataFrame, checkpoint: str, once: bool):
    writer = stream.writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer


def ingest_records_stream(
    stream: DataFrame, target: str, rejects: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Validate every record; good rows go to ``target``, the others to ``rejects``.

    The rules are the batch rules of ``validate_records``; a reject keeps the name
    of its first broken rule.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # both parts come from one evaluation
        try:
            good = batch.where(F.col("rejection").isNull()).drop("rejection")
            bad = batch.where(F.col("rejection").isNotNull())
            good.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
            bad.write.mode("overwrite").parquet(f"{rejects}/batch={batch_id}")
        finally:
            batch.unpersist()

    return _writer(validate_records(stream), checkpoint, once).foreachBatch(write).start()


# Parts of a keyed snapshot; a batch rewrites those that hold one of its keys.
BUCKETS = 64
_BUCKET = "__bucket"


def _folder(spark: SparkSession, path: str):
    """The file system of a folder, and the folder."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _folder(spark, path)
    return [status.getPath().getName() for status in fs.listStatus(folder)] if fs.exists(folder) else []


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests."""
    found = []
    for name in _children(spark, f"{path}/manifest"):
        fs, done = _folder(spark, f"{path}/manifest/{name}/_SUCCESS")
        if name.startswith("version=") and fs.exists(done):
            found.append(int(name.removeprefix("version=")))
    return sorted(found)


def _manifest(spark: SparkSession, path: str, version: int) -> tuple[dict[int, int], str, str, int]:
    """Version of every bucket of a snapshot, and its schema, key and number of buckets."""
    rows = spark.read.parquet(f"{path}/manifest/version={version}").collect()
    return {r["bucket"]: r["version"] for r in rows if r["bucket"] is not None}, rows[0]["schema"], rows[0]["key"], rows[0]["buckets"]


def _in_bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(quoted(key)), F.lit(buckets)).cast("int")


def _write_buckets(df: DataFrame, path: str, version: int, key: str, buckets: int, kept: dict[int, int]) -> None:
    """Writes the buckets of ``df`` and a manifest that takes the others from earlier versions.

    The manifest is written last and by itself, so a snapshot is there as a whole or not at all.
    """
    spark, data = df.sparkSession, f"{path}/data/version={version}"
    df.withColumn(_BUCKET, _in_bucket(key, buckets)).write.mode("overwrite").partitionBy(_BUCKET).parquet(data)
    own = [int(name.split("=")[1]) for name in _children(spark, data) if name.startswith(f"{_BUCKET}=")]
    places = {**kept, **dict.fromkeys(own, version)}
    rows = [(b, v, df.schema.json(), key, buckets) for b, v in sorted(places.items())] or [(None, None, df.schema.json(), key, buckets)]
    listed = spark.createDataFrame(rows, "bucket int, version long, schema string, key string, buckets int")
    listed.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={version}")


def _read_buckets(spark: SparkSession, path: str, places: dict[int, int], schema: str) -> DataFrame:
    kind = T.StructType.fromJson(json.loads(schema))
    folders = [f"{path}/data/version={v}/{_BUCKET}={b}" for b, v in places.items()]
    return spark.read.schema(kind).parquet(*folders) if folders else spark.createDataFrame([], kind)


def _drop_unlisted(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes bucket folders and manifests that none of the newest ``keep`` manifests needs.

    The one before the newest stays, because a replayed batch starts from it.
    """
    versions = _versions(spark, path)
    needed = {(v, b) for version in versions[-keep:] for b, v in _manifest(spark, path, version)[0].items()}
    newest = versions[-1]
    for name in _children(spark, f"{path}/data"):
        version = int(name.removeprefix("version="))
        if version > newest:
            continue  # not listed yet
        inside = [int(b.split("=")[1]) for b in _children(spark, f"{path}/data/{name}") if b.startswith(f"{_BUCKET}=")]
        unlisted = [b for b in inside if (version, b) not in needed]
        gone = [f"{path}/data/{name}"] if len(unlisted) == len(inside) else [f"{path}/data/{name}/{_BUCKET}={b}" for b in unlisted]
        for folder in gone:
            fs, place = _folder(spark, folder)
            fs.delete(place, True)
    for version in versions[:-keep]:
        fs, place = _folder(spark, f"{path}/manifest/version={version}")
        fs.delete(place, True)


def write_snapshot(df: DataFrame, path: str, version: int = -1, key: str = "id", buckets: int = BUCKETS) -> None:
    """First (or given) snapshot of a keyed table, in parts by key hash."""
    _write_buckets(df, path, version, key, buckets, {})


def read_snapshot(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """Newest complete snapshot, or the newest below a version."""
    versions = [v for v in _versions(spark, path) if before is None or v < before]
    if not versions:
        raise ValueError(f"no snapshot in {path}")
    places, schema, _, _ = _manifest(spark, path, versions[-1])
    return _read_buckets(spark, path, places, schema)


def upsert_values_stream(
    stream: DataFrame,
    path: str,
    key: str,
    columns: Sequence[str],
    checkpoint: str,
    order: str = "fetched_at",
    once: bool = True,
) -> StreamingQuery:
    """Refresh the values of known keys from a stream.

    Plain Parquet has no atomic merge, so each batch writes the buckets that hold its keys
    anew and then a manifest that lists them beside the untouched ones; what no recent
    manifest lists is dropped. Within a batch the latest ``order`` wins, non-finite
    numbers become null, and an update also wins when its value is null.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        numbers = {n for n, kind in batch.dtypes if kind in ("double", "float")}
        versions = [v for v in _versions(spark, path) if v < batch_id]
        if not versions:
            raise ValueError(f"no snapshot in {path}")
        places, schema, own_key, buckets = _manifest(spark, path, versions[-1])
        if own_key != key:
            raise ValueError(f"the snapshot in {path} is kept by {own_key}")
        clean = batch.select(
            quoted(key), *[(scalar.finite(quoted(c)) if c in numbers else quoted(c)).alias(c) for c in columns],
            *([] if order in columns else [quoted(order)]),
        ).persist()
        try:
            # at most as many rows as there are buckets
            met = [r[0] for r in clean.where(quoted(key).isNotNull()).select(_in_bucket(key, buckets)).distinct().collect()]
            touched = {b: places[b] for b in met if b in places}
            merged = upsert(_read_buckets(spark, path, touched, schema), clean, key, columns, insert=False, order=order)
            kept = {b: v for b, v in places.items() if b not in touched}
            _write_buckets(merged.drop("action"), path, batch_id, key, buckets, kept)
        finally:
            clean.unpersist()
        _drop_unlisted(spark, path)

    return _writer(stream, checkpoint, once).foreachBatch(merge).start()
