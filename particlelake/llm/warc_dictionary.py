"""WARC archives of individually compressed records with a Zstandard dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the
compressed dictionary, built from the archive's own first records; every record then
is one Zstandard frame. Records with equal payloads are written once: the others are
revisit records without payload.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from particlelake.llm.common import Batches, column_values, filesystem, in_slices, new_folder, plain_names, write_once

DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records up to this many bytes, the first of each archive, make its dictionary.
SAMPLE_BYTES = 4 << 20
DICTIONARY_BYTES = 64 << 10
ROWS_AT_ONCE = 500
MANIFEST = "path string, records long"


def _name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def warc_record(page_id, url: str | None, payload: bytes, refers_to, date: str) -> bytes:
    """One record; ``refers_to`` names the response of a revisit."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}", f"WARC-Date: {date}"]
    if url:
        fields.append("WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url))
    fields.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
        payload = b""
    fields += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(head) + len(payload)}"]
    return "\r\n".join(fields).encode("utf-8") + b"\r\n\r\n" + head + payload + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.split(":", 1) for line in head.decode("utf-8").split("\r\n")[1:] if ":" in line)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_record(record: bytes) -> dict:
    """The record's id, url, type, payload (null for a revisit), its length and digest in hex."""
    head, rest = record.split(b"\r\n\r\n", 1)
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")

    def number(name: str | None):
        value = (name or "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    return {
        "page_id": number(fields["warc-record-id"]),
        "url": fields.get("warc-target-uri"),
        "record_type": fields["warc-type"],
        "refers_to": number(fields.get("warc-refers-to")),
        "payload": None if revisit else payload,
        "payload_bytes": int(_fields(http)["content-length"]) if revisit else len(payload),
        "payload_digest": digest,
    }


def build_dictionary(records: list[bytes], size: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from the records; none if they are too few or too small for one."""
    total = sum(map(len, records))
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), records, k=200, d=8)
    except zstandard.ZstdError:
        return None


def write_archive(sink, records: Iterator[bytes], level: int = 3, sample_bytes: int = SAMPLE_BYTES, dictionary_bytes: int = DICTIONARY_BYTES) -> int:
    """Writes the records to one archive; holds the dictionary's sample and one record."""
    sample, held = [], 0
    for record in records:
        sample.append(record)
        held += len(record)
        if held >= sample_bytes:
            break
    dictionary = build_dictionary(sample, dictionary_bytes)
    if dictionary is not None:
        frame = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
        sink.write(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary)
    count = 0
    for part in (sample, records):
        for record in part:
            sink.write(compressor.compress(record))
            count += 1
    return count


def read_archive(source, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    dictionary, waiting = None, source.read(chunk)
    if waiting[:4] == struct.pack("<I", DICTIONARY_MAGIC):
        (size,) = struct.unpack("<I", waiting[4:8])
        while len(waiting) < 8 + size:
            waiting += source.read(chunk)
        content = zstandard.ZstdDecompressor().decompress(waiting[8: 8 + size])
        dictionary, waiting = zstandard.ZstdCompressionDict(content), waiting[8 + size:]
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary)
    while waiting or (waiting := source.read(chunk)):
        frame, parts = unpack.decompressobj(), []
        while True:
            parts.append(frame.decompress(waiting))
            if frame.eof:
                waiting = frame.unused_data
                break
            waiting = source.read(chunk)
            if not waiting:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def with_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """``pages(page_id, url, payload)`` with ``refers_to``: the largest id with an equal payload.

    Null for responses. Payloads under ``min_bytes`` are all responses. Equality is
    by SHA-256. Rows that share the largest id are all responses, as are rows of a
    payload that has null ids only. Digests are compared before payloads move.
    """
    key = F.sha2("payload", 256)
    long_enough = F.octet_length("payload") >= min_bytes
    keepers = (
        pages.where(long_enough).select("page_id", key.alias("key")).groupBy("key")
        .agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select("key", "keeper")
    )
    keyed = pages.withColumn("key", F.when(long_enough, key).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "payload"))))
    joined = keyed.join(keepers, "key", "left")
    other = F.col("page_id").isNull() | (F.col("page_id") != F.col("keeper"))
    return joined.select("page_id", "url", "payload", F.when(other, F.col("keeper")).alias("refers_to"))


def write_archives(
    pages: DataFrame,
    folder: str,
    min_bytes: int = 1000,
    date: str = "1970-01-01T00:00:00Z",
    level: int = 3,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> DataFrame:
    """Writes one archive per partition and returns the committed manifest (path, records).

    A file that is not in the manifest is a leftover of a lost or repeated attempt.
    Null payloads are empty, null urls have no target field, repeated rows are
    repeated records; an empty table gives no archive.
    """

    def run(batches: Batches) -> Batches:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def records() -> Iterator[bytes]:
            def every():
                yield first
                yield from batches

            for batch in in_slices(every(), ROWS_AT_ONCE):
                for row in zip(*[column_values(batch, c) for c in ("page_id", "url", "payload", "refers_to")]):
                    yield warc_record(*row, date)

        written: list[int] = []
        path = write_once(folder, "archive", lambda sink: written.append(write_archive(sink, records(), level)))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array(written, pa.int64())], names=["path", "records"])

    rows = plain_names(pages, (id_col, "page_id"), (url_col, "url"), (payload_col, "payload")).withColumn(
        "payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b""))
    ).withColumn("page_id", F.col("page_id").cast("long"))
    with_revisits(rows, min_bytes).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


RECORD = (
    ("page_id", "long", pa.int64()),
    ("url", "string", pa.string()),
    ("record_type", "string", pa.string()),
    ("refers_to", "long", pa.int64()),
    ("payload_bytes", "long", pa.int64()),
    ("payload_digest", "string", pa.string()),
    ("payload", "binary", pa.binary()),
)


def archived_records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the archives of a manifest."""
    shape = [r for r in RECORD if with_payload or r[0] != "payload"]

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, _, k in shape], names=[n for n, _, _ in shape])

    def run(batches: Batches) -> Batches:
        for paths in batches:
            for path in column_values(paths, "path"):
                fs, place = filesystem(path)
                with fs.open_input_stream(place, compression=None) as source:
                    rows, held = [], 0
                    for record in read_archive(source):
                        rows.append(read_record(record))
                        held += len(record)
                        if held > 8 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return manifest.select("path").repartition(max(1, manifest.count())).mapInArrow(run, ", ".join(f"{n} {k}" for n, k, _ in shape))


def warc_round_trip(pages: DataFrame, with_payload: bool = True, **options) -> DataFrame:
    """Writes the pages into a new shared folder and reads the archives back."""
    folder = new_folder(pages.sparkSession, "warc")
    return archived_records(write_archives(pages, folder, **options), with_payload)
