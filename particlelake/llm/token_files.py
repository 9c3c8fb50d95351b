"""Token-id files with bit-plane or byte-plane shuffled, compressed blocks.

A file holds the ids of a range of documents, one after the other, in blocks of
``block_ids``. A block is transposed into planes: all lowest bits (or bytes), then
the next ones, as far as the largest id needs; each plane is a Zstandard frame. The
document table and the chunk index close the file:

    magic | planes of block 0 | planes of block 1 ... | document table | index | its length | magic

The index is JSON: per block its offset, number of ids and plane lengths; for the
document table its offset, length and number of documents.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from particlelake.llm.common import Batches, binary_values, column_values, filesystem, in_slices, new_folder, plain_names, stored, write_once
from particlelake.llm.encoding import word_encoder

MAGIC = b"IDPLANE1"
BLOCK_IDS = 1 << 16
PLANES = ("bit", "byte")
DOCS_AT_ONCE = 200
MANIFEST = "path string, docs long, tokens long, first_doc long, has_null boolean"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block, lowest first, without the empty ones above the largest id."""
    bits = int(ids.max(initial=0)).bit_length()
    if planes == "byte":
        columns = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
        return [columns[:, k].tobytes() for k in range((bits + 7) // 8)]
    return [np.packbits(((ids >> k) & 1).astype(bool)).tobytes() for k in range(bits)]


def from_planes(parts: list[bytes], count: int, planes: str) -> np.ndarray:
    if planes == "byte":
        columns = np.zeros((count, 4), np.uint8)
        for k, part in enumerate(parts):
            columns[:, k] = np.frombuffer(part, np.uint8)
        return columns.reshape(-1).view("<u4")
    ids = np.zeros(count, "<u4")
    for k, part in enumerate(parts):
        ids |= np.unpackbits(np.frombuffer(part, np.uint8), count=count).astype("<u4") << np.uint32(k)
    return ids


class IdFileWriter:
    """Appends documents to one file; holds at most a block of ids and the document table."""

    def __init__(self, sink, planes: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3):
        if planes not in PLANES:
            raise ValueError(f"planes must be one of {PLANES}")
        self.sink, self.planes, self.block_bytes = sink, planes, 4 * block_ids
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.buffer, self.blocks = bytearray(), []
        self.docs: list[int] = []
        self.nulls: list[int] = []
        self.lengths: list[int] = []
        self.offset = 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.offset += len(data)

    def _block(self, raw: bytes) -> None:
        frames = [self.compressor.compress(p) for p in to_planes(np.frombuffer(raw, "<u4"), self.planes)]
        self.blocks.append([self.offset, len(raw) // 4, [len(f) for f in frames]])
        for frame in frames:
            self._write(frame)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if doc_id is None:
            self.nulls.append(len(self.docs))
        self.docs.append(doc_id or 0)
        self.lengths.append(len(ids) // 4)
        self.buffer += ids
        if len(self.buffer) >= self.block_bytes:
            whole = len(self.buffer) // self.block_bytes * self.block_bytes
            view = bytes(self.buffer[:whole])
            del self.buffer[:whole]
            for start in range(0, whole, self.block_bytes):
                self._block(view[start: start + self.block_bytes])

    def close(self) -> None:
        if self.buffer:
            self._block(bytes(self.buffer))
        table = np.array([self.docs, self.lengths], dtype="<i8").reshape(2, -1)
        packed = self.compressor.compress(table.tobytes())
        at = self.offset
        self._write(packed)
        index = json.dumps({
            "planes": self.planes, "blocks": self.blocks, "nulls": self.nulls,
            "table": [at, len(packed), len(self.docs)],
        }).encode()
        self._write(index + struct.pack("<Q", len(index)) + MAGIC)


def read_id_file(source) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of every document of a seekable file, block by block."""
    size = source.size()
    source.seek(size - 16)
    (length,), magic = struct.unpack("<Q", source.read(8)), source.read(8)
    source.seek(0)
    if magic != MAGIC or source.read(8) != MAGIC:
        raise ValueError("not a token-id file")
    source.seek(size - 16 - length)
    index = json.loads(source.read(length))
    unpack = zstandard.ZstdDecompressor()
    at, packed, count = index["table"]
    source.seek(at)
    docs, lengths = np.frombuffer(unpack.decompress(source.read(packed)), "<i8").reshape(2, count)
    nulls = set(index["nulls"])
    blocks, buffer, taken = iter(index["blocks"]), bytearray(), 0
    for place, (doc, n) in enumerate(zip(docs.tolist(), lengths.tolist())):
        while len(buffer) - taken < 4 * n:
            del buffer[:taken]
            taken = 0
            offset, ids, parts = next(blocks)
            source.seek(offset)
            buffer += from_planes([unpack.decompress(source.read(p)) for p in parts], ids, index["planes"]).tobytes()
        yield (None if place in nulls else doc), bytes(buffer[taken: taken + 4 * n])
        taken += 4 * n


def write_token_files(
    docs: DataFrame,
    tokenizer_path: str,
    folder: str,
    end_id: int = 1,
    planes: str = "byte",
    block_ids: int = BLOCK_IDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Encodes ``docs``, writes them in ascending id order and returns the manifest.

    Manifest: one row per file (path, docs, tokens, first_doc, has_null), committed as
    a Parquet table beside the files; a file not in it is a leftover of a lost or
    repeated attempt. A partition of ids makes a file. Null texts count as empty and
    hold the end id only; null ids come first; repeated rows are all written, ordered
    by text. An empty table gives no file.
    """

    def run(batches: Batches) -> Batches:
        encoder = word_encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        seen = {"docs": 0, "tokens": 0, "first": column_values(first, "doc_id")[0], "null": False}

        def fill(sink) -> None:
            writer = IdFileWriter(sink, planes, block_ids)

            def every():
                yield first
                yield from batches

            for batch in in_slices(every(), DOCS_AT_ONCE):
                for doc, ids in zip(column_values(batch, "doc_id"), encoder.encode(binary_values(batch, "text"))):
                    writer.add(doc, ids + end)
                    seen["docs"] += 1
                    seen["tokens"] += len(ids) // 4 + 1
                    seen["null"] |= doc is None
            writer.close()

        path = write_once(folder, "ids", fill)
        row = [[path], [seen["docs"]], [seen["tokens"]], [seen["first"]], [seen["null"]]]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, k) for v, k in zip(row, kinds)], names=["path", "docs", "tokens", "first_doc", "has_null"]
        )

    rows = plain_names(docs, (id_col, "doc_id"), (text_col, "text")).withColumn("doc_id", F.col("doc_id").cast("long"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    spark = docs.sparkSession
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def token_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in the files of a manifest.

    ``start`` counts the ids of all documents before it; ``ids`` are little-endian
    unsigned 32-bit integers. The running total is over files, not documents.
    """
    before = Window.orderBy(F.col("has_null").desc(), "first_doc", "path").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("path", F.coalesce(F.sum("tokens").over(before), F.lit(0)).cast("long").alias("start"))

    def run(batches: Batches) -> Batches:
        for batch in batches:
            for path, start in zip(column_values(batch, "path"), column_values(batch, "start")):
                fs, place = filesystem(path)
                with fs.open_input_file(place) as source:
                    rows: list[tuple] = []
                    held = 0
                    for doc, ids in read_id_file(source):
                        rows.append((doc, start, len(ids) // 4, ids))
                        start += len(ids) // 4
                        held += len(ids)
                        if held > 8 << 20:
                            yield _rows(rows)
                            rows, held = [], 0
                    if rows:
                        yield _rows(rows)

    return files.repartition(max(1, manifest.count())).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "start", "n_tokens", "ids"])


def token_id_files(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the files into a new shared folder and reads them back."""
    folder = new_folder(docs.sparkSession, "ids")
    return token_documents(write_token_files(docs, tokenizer_path, folder, **options))


def with_crc32(documents: DataFrame) -> DataFrame:
    """``ids_crc32`` of the id bytes in place of the ids."""
    return documents.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
