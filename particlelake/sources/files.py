"""Reading records, feature tables and stations; writing tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from particlelake import fixed_values as fv
from particlelake.functions import scalar
from particlelake.runtime import any_row, quoted


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None, json_lines: bool = False) -> DataFrame:
    """JSON array or single object per file (or JSON Lines) as rows.

    Without a schema each record is one VARIANT column ``doc``, so unknown keys
    never break a load. JSON Lines files are splittable and preferred at scale.
    """
    reader = spark.read.option("multiLine", not json_lines)
    if schema is not None:
        return reader.schema(schema).json(path)
    if json_lines:
        return spark.read.text(path).select(F.try_parse_json("value").alias("doc")).where(F.col("doc").isNotNull())
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    items = whole.select(
        F.explode(
            F.coalesce(
                F.try_variant_get("doc", "$", "array<variant>"),
                F.array(F.col("doc")),
            )
        ).alias("doc")
    )
    return items.where(F.col("doc").isNotNull())


def _variant_path(name: str) -> str:
    escaped = name.replace("'", "\\'")
    return f"$['{escaped}']"


def extended_json_field(doc: Column, name: str, kind: str) -> Column:
    """One field of an extended-JSON document with its wrappers removed."""
    base = _variant_path(name)
    if kind == "string":
        return F.coalesce(
            F.try_variant_get(doc, f"{base}['$oid']", "string"),
            *[F.try_variant_get(doc, f"{base}['{w}']", "string") for w in fv.NUMBER_WRAPPERS],
            F.try_variant_get(doc, base, "string"),
        )
    return F.coalesce(
        *[F.try_variant_get(doc, f"{base}['{w}']", "string").try_cast(kind) for w in fv.NUMBER_WRAPPERS],
        F.try_variant_get(doc, base, kind),
    )


def normalize_extended_json(df: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """Unwrap declared fields of a VARIANT column; a dotted name reaches nested ones."""
    doc = F.col(column)

    def value(name: str, kind: str) -> Column:
        if "." not in name or kind not in ("string", "double", "bigint", "int"):
            return extended_json_field(doc, name, kind)
        parent, leaf = name.rsplit(".", 1)
        nested = F.try_variant_get(doc, "$" + "".join(f"['{p}']" for p in parent.split(".")), "variant")
        return F.coalesce(extended_json_field(doc, name, kind), extended_json_field(nested, leaf, kind))

    return df.select(*[c for c in df.columns if c != column], *[value(n, k).alias(n) for n, k in fields.items()])


def read_feature_csv(
    spark: SparkSession,
    path: str,
    non_feature_columns: Sequence[str] = fv.NON_FEATURE_COLUMNS,
    mode: str = "strict",
) -> DataFrame:
    """Header CSV whose unlisted columns are numeric features.

    ``strict`` raises on the first blank or unparsable feature value, naming the
    image and the column; ``lenient`` turns such values into null and drops
    columns without any number.
    """
    raw = spark.read.option("header", True).csv(path)
    features = [c for c in raw.columns if c not in set(non_feature_columns)]
    if not features:
        raise ValueError(f"no feature columns in {path}")
    if mode == "lenient":
        typed = raw.withColumns({c: scalar.to_float(quoted(c), "taxonomy") for c in features})
        counts = typed.agg(F.count(F.lit(1)).alias("__rows"), *[F.count(quoted(c)).alias(c) for c in features]).first()
        if counts["__rows"] == 0:
            raise ValueError(f"{path} is empty")
        return typed.drop(*[c for c in features if counts[c] == 0])
    if not any_row(raw):
        raise ValueError(f"{path} is empty")
    parsed = {c: F.trim(quoted(c)).try_cast("double") for c in features}
    image = F.coalesce(quoted("image_id"), F.lit("?")) if "image_id" in raw.columns else F.lit("?")
    problems = F.array_compact(F.array(*[F.when(parsed[c].isNull(), F.lit(c)) for c in features]))
    first_bad = raw.select(image.alias("image"), problems.alias("bad")).where(F.size("bad") > 0).first()
    if first_bad is not None:
        raise ValueError(f"image {first_bad['image']}: missing or unparsable value in {first_bad['bad'][0]}")
    return raw.withColumns(parsed)


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Stations from a gml_id,name,latitude,longitude CSV; invalid rows are dropped."""
    raw = spark.read.option("header", True).option("mode", "PERMISSIVE").csv(path)
    lowered = raw.toDF(*[c.strip().lower() for c in raw.columns])
    needed = ("gml_id", "name", "latitude", "longitude")
    missing = [c for c in needed if c not in lowered.columns]
    if missing:
        raise ValueError(f"stations need the columns {', '.join(needed)}")
    return lowered.select(
        F.trim("gml_id").alias("id"),
        F.trim("name").alias("name"),
        scalar.to_float(F.col("latitude")).alias("lat"),
        scalar.to_float(F.col("longitude")).alias("long"),
    ).where((F.col("id") != "") & (F.col("name") != "") & F.col("lat").isNotNull() & F.col("long").isNotNull())


def read_legacy_stations(spark: SparkSession, path: str) -> DataFrame:
    """Old layout: the last two columns are longitude and latitude, the rest the name."""
    lines = spark.read.text(path).select(F.trim("value").alias("line")).where(F.col("line") != "")
    parts = F.split("line", ",")
    count = F.size(parts)
    return (
        lines.select(parts.alias("parts"), count.alias("n"))
        .where(F.col("n") >= 3)
        .select(
            F.trim(F.array_join(F.slice("parts", F.lit(1), F.col("n") - 2), ",")).alias("name"),
            scalar.to_float(F.element_at("parts", -1)).alias("lat"),
            scalar.to_float(F.element_at("parts", -2)).alias("long"),
        )
        .where((F.col("name") != "") & F.col("lat").isNotNull() & F.col("long").isNotNull())
    )


def text_ready(df: DataFrame) -> DataFrame:
    """CSV cells: booleans as true/false, non-finite numbers empty, nulls empty."""
    columns = []
    for name, kind in df.dtypes:
        col = quoted(name)
        if kind in ("double", "float"):
            col = scalar.finite(col)
        elif kind == "boolean":
            col = F.when(col, F.lit("true")).when(~col, F.lit("false"))
        elif kind.startswith(("array", "struct", "map")):
            col = F.to_json(col)
        columns.append(col.alias(name))
    return df.select(*columns)


def ordered_columns(df: DataFrame, preferred: Sequence[str]) -> DataFrame:
    """Preferred columns first (once each, only those present), then the others."""
    first = list(dict.fromkeys(c for c in preferred if c in df.columns))
    return df.select(*[quoted(c) for c in first], *[quoted(c) for c in df.columns if c not in first])


def write_table(df: DataFrame, path: str, preferred: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite") -> None:
    arranged = ordered_columns(df, preferred)
    if fmt == "csv":
        text_ready(arranged).write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    else:
        arranged.write.mode(mode).format(fmt).save(path)


def write_report(report: DataFrame | dict, path: str, spark: SparkSession | None = None) -> None:
    """Run summary as one JSON document; meant for one-row reports."""
    if isinstance(report, dict):
        import json

        if spark is None:
            raise ValueError("a dict report needs the session")
        text = json.dumps(report, ensure_ascii=False)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
        return
    report.coalesce(1).write.mode("overwrite").option("ignoreNullFields", False).json(path)
