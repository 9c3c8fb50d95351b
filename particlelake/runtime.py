"""Session-level helpers: checkpoints, shared files, one-row lookups and size checks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A group with more rows than this is never handed to a single-task aggregate
# buffer (exact percentile) or to one window partition.
HOT_GROUP_ROWS = 5_000_000


def checkpoint_root(spark: SparkSession) -> str:
    """Folder for reliable checkpoints, taken from ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own; on a
    cluster a machine-local folder would be lost with its executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the whole cluster")
        configured = spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="particlelake-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(configured)
    return configured


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint directory; nothing is created yet."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder in the shared directory, and the path there."""
    if uri.startswith("file:"):
        uri = "/" + uri[len("file:"):].lstrip("/")
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def write_once(folder: str, stem: str, fill: Callable[[pa.NativeFile], None]) -> str:
    """Writes a file under a name no other attempt uses; returns its URI.

    The caller lists finished files in a manifest that Spark commits, so files of
    failed or repeated attempts are never read.
    """
    name = f"{folder}/{stem}-{uuid.uuid4().hex}"
    fs, path = filesystem(name)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as sink:
        fill(sink)
    return name


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and fixes partition contents."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def one_row(stats: DataFrame) -> Column:
    """A one-row table as a struct column usable in any other DataFrame.

    Becomes a scalar subquery, so no join is planned for it.
    """
    return stats.select(F.struct(*[F.col(f"`{c}`") for c in stats.columns])).scalar()


def has_more_rows_than(df: DataFrame, rows: int) -> bool:
    """True if ``df`` has more than ``rows`` rows; reads no column data."""
    return df.select(F.lit(1).alias("one")).agg(F.count("one")).first()[0] > rows


def any_row(df: DataFrame) -> bool:
    return not df.isEmpty()


def quoted(name: str) -> Column:
    """Column by literal name, also when the name holds dots or accents."""
    return F.col(f"`{name}`")


def melt(df: DataFrame, ids: list, columns: dict[str, Column], name: str, value: str) -> DataFrame:
    """Long form of same-typed expressions: (ids, name, value), nulls kept.

    One array per row and a position lookup compile far faster than one
    projection per column, and columns are still pruned at the scan.
    """
    labels = F.array(*[F.lit(c) for c in columns])
    packed = df.select(*ids, F.posexplode(F.array(*columns.values())).alias("__pos", value))
    kept = packed.columns[: -2]
    return packed.select(*[quoted(c) for c in kept], F.element_at(labels, F.col("__pos") + 1).alias(name), quoted(value))
