"""Helpers shared by the training-data operators.

Words everywhere are maximal runs of characters other than the ASCII white space
``\\x20 \\x09-\\x0D``; ``bytes.split()`` on UTF-8 cuts exactly there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from particlelake.runtime import filesystem, shared_folder, write_once  # noqa: F401

WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"

Batches = Iterator[pa.RecordBatch]


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint directory; nothing is created yet."""
    return shared_folder(spark, f"llm-{name}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage, fixes the rows for every later reader and survives lost
    executors. The files stay, since lazy results may still read them.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Tables of one operator that no lazy result reads: all are deleted when it ends.

    Each is written like ``stored``; the shuffle files of that job go once it is committed.
    """

    #: Shuffle files of a finished query are of no more use to a table that is written once.
    CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for folder in list(self.folders):
            self._delete(folder)

    def _delete(self, folder: str) -> None:
        self.folders.pop(folder)
        fs, path = filesystem(folder)
        if fs.get_file_info(path).type == pafs.FileType.Directory:
            fs.delete_dir(path)

    def discard(self, table: DataFrame) -> None:
        """Deletes a table of this scratch that nothing reads any more."""
        for folder in [f for f, held in self.folders.items() if held is table]:
            self._delete(folder)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        path = new_folder(self.spark, name)
        self.folders[path] = None
        before = self.spark.conf.get(self.CLEAN_UP, "false")
        self.spark.conf.set(self.CLEAN_UP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(self.CLEAN_UP, before)
        self.folders[path] = self.spark.read.schema(df.schema).parquet(path)
        return self.folders[path]


def row_signature(text: Column) -> Column:
    """Tells rows apart that share an id but not their text; null has one too."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def plain_names(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """Only the named columns, under the operator's own names, so extras cannot clash."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in columns])


def binary_values(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    values = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
    return [b"" if v is None else v for v in values.to_pylist()]


def column_values(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def in_slices(batches: Batches, size: int) -> Batches:
    """The same rows in smaller batches, so Python lists of whole texts stay small."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            yield batch.slice(start, size)


def appended(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """The batch with new columns at its end."""
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *columns.values()], names=[*batch.schema.names, *columns]
    )


def with_results(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without the columns an operator is about to add; its results win a clash."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
