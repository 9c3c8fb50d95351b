"""Queries over readers and writers: tables go to files and come back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from particlelake.plans import standins as st
from particlelake.plans.registry import query, rounded
from particlelake.runtime import checkpoint_root
from particlelake.sources import files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "read_records",
    """SELECT 'lines' AS kind, c_custkey::VARCHAR AS id, c_name AS name, round(c_acctbal, 6)::DOUBLE AS amount FROM customer
UNION ALL SELECT 'array', n_nationkey::VARCHAR, n_name, n_regionkey::DOUBLE FROM nation""",
)
def read_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as extended JSON Lines, nations as one JSON array a region; both read back."""
    fields = {"_id": "string", "name": "string", "amount": "double"}
    named = lambda key, name, amount: F.struct(
        F.struct(F.col(key).cast("string").alias("$oid")).alias("_id"), F.col(name).alias("name"), F.struct(F.col(amount).cast("string").alias("$numberDouble")).alias("amount")
    )
    lines, arrays = _folder(spark, "lines"), _folder(spark, "arrays")
    st.table(spark, sf_dir, "customer").select(F.to_json(named("c_custkey", "c_name", "c_acctbal")).alias("value")).write.text(lines)
    nations = st.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(named("n_nationkey", "n_name", "n_regionkey"))).alias("value"))
    nations.write.partitionBy("n_regionkey").text(arrays)
    parts = [("lines", files.read_records(spark, lines, json_lines=True)), ("array", files.read_records(spark, f"{arrays}/*"))]
    read = [files.normalize_extended_json(df, "doc", fields).select(F.lit(kind).alias("kind"), F.col("_id").alias("id"), "name", "amount") for kind, df in parts]
    return rounded(read[0].unionByName(read[1]))


@query(
    "read_feature_csv",
    """SELECT o_orderkey::VARCHAR AS image_id, round(o_totalprice, 6)::DOUBLE AS price, round(o_custkey / 8.0, 6)::DOUBLE AS share FROM orders""",
)
def read_feature_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict mode: every cell of a feature column is a number."""
    o, path = st.table(spark, sf_dir, "orders"), _folder(spark, "features")
    table = o.select((F.col("o_custkey") / 8).alias("share"), F.col("o_totalprice").cast("double").alias("price"), F.col("o_orderkey").alias("image_id"))
    files.write_table(table, path, preferred=("image_id", "price"), fmt="csv")
    return rounded(files.read_feature_csv(spark, path))


@query(
    "read_feature_csv_lenient",
    """SELECT o_orderkey::VARCHAR AS image_id, CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice, 6)::DOUBLE END AS price FROM orders""",
)
def read_feature_csv_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lenient mode: words are null, and a column without numbers is dropped."""
    o, path = st.table(spark, sf_dir, "orders"), _folder(spark, "features")
    price = F.when(F.col("o_orderkey") % 7 == 0, "pending").otherwise(F.col("o_totalprice").cast("double").cast("string"))
    files.write_table(o.select(F.col("o_orderkey").alias("image_id"), price.alias("price"), F.lit("none").alias("blank")), path, fmt="csv")
    return rounded(files.read_feature_csv(spark, path, mode="lenient"))


_STATIONS = """SELECT s_suppkey::VARCHAR AS id, s_name AS name, round(s_acctbal / 200, 6)::DOUBLE AS lat, round(s_nationkey * 7.0 - 90, 6)::DOUBLE AS long FROM supplier"""


@query("read_stations", _STATIONS + " WHERE s_suppkey % 5 <> 0 AND s_suppkey % 7 <> 0")
def read_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as stations; some have no name or no latitude and are dropped."""
    s, path = st.table(spark, sf_dir, "supplier"), _folder(spark, "stations")
    key, lat = F.col("s_suppkey"), (F.col("s_acctbal").cast("double") / 200).cast("string")
    written = s.select(
        key.alias("GML_ID"), F.when(key % 5 != 0, F.concat(F.lit(" "), "s_name")).alias(" Name"),
        F.when(key % 7 != 0, lat).otherwise("unknown").alias("Latitude"), (F.col("s_nationkey") * 7.0 - 90).alias("Longitude"),
    )
    files.write_table(written, path, fmt="csv")
    return rounded(files.read_stations(spark, path))


@query("read_legacy_stations", _STATIONS.replace("s_suppkey::VARCHAR AS id, s_name AS name", "s_name || ', ' || s_suppkey AS name") + " WHERE s_suppkey % 7 <> 0")
def read_legacy_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header-less layout: names with commas, longitude and latitude last."""
    s, path = st.table(spark, sf_dir, "supplier"), _folder(spark, "stations")
    lat = F.when(F.col("s_suppkey") % 7 != 0, (F.col("s_acctbal").cast("double") / 200).cast("string")).otherwise("?")
    long = (F.col("s_nationkey") * 7.0 - 90).cast("string")
    s.select(F.concat_ws(",", "s_name", F.concat(F.lit(" "), F.col("s_suppkey").cast("string")), long, lat).alias("value")).write.text(path)
    return rounded(files.read_legacy_stations(spark, path))


@query(
    "write_table",
    """SELECT o_orderkey::VARCHAR AS image_id, CASE WHEN o_orderstatus = 'O' THEN 'true' WHEN o_orderstatus = 'F' THEN 'false' END AS flag,
  CASE WHEN o_custkey % 3 <> 0 THEN o_custkey::VARCHAR END AS customer, NULL::VARCHAR AS bad FROM orders""",
)
def write_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV table read back as text: booleans as words, nulls and non-finite numbers empty, preferred columns first."""
    o, path = st.table(spark, sf_dir, "orders"), _folder(spark, "table")
    flag = F.when(F.col("o_orderstatus") == "O", True).when(F.col("o_orderstatus") == "F", False)
    odd = F.when(F.col("o_orderkey") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    written = o.select(odd.alias("bad"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("customer"), flag.alias("flag"), F.col("o_orderkey").alias("image_id"))
    files.write_table(written, path, preferred=("image_id", "flag", "absent", "image_id"), fmt="csv")
    return spark.read.option("header", True).csv(path)


@query(
    "write_report",
    """SELECT count(*) AS rows, count(DISTINCT o_custkey) AS customers, round(max(o_totalprice), 6)::DOUBLE AS dearest, NULL::DOUBLE AS missing FROM orders""",
)
def write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-row summary of a table as a JSON document, read back with its null."""
    path = _folder(spark, "report")
    summary = st.table(spark, sf_dir, "orders").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("o_custkey").alias("customers"), F.max("o_totalprice").cast("double").alias("dearest"), F.lit(None).cast("double").alias("missing")
    )
    files.write_report(summary, path)
    return rounded(spark.read.schema(summary.schema).json(path))
