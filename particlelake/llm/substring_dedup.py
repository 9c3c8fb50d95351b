"""Removal of passages that repeat across documents, by super-k-mer partitioning.

A window is ``window`` consecutive words. Its minimiser is the smallest hash of
the ``gram``-word sequences in it; consecutive windows with one minimiser travel
as one packed string to the minimiser's bucket, where sorting counts them.

1. Every document yields its minimisers. Those of a single document need no bucket:
   a fixed-size bit table of the others (false positives only cost work) is sent to
   the tasks of the second pass.
2. The second pass packs the remaining super-k-mers. Buckets are sorted by Spark and
   streamed; equal windows meet, and each keeps the smallest document that has it.
3. Minimisers with very many windows (a passage that a large share of documents
   holds) would make one bucket too large. A second bit table marks them; their windows
   are compared one by one through a partial aggregate on a 128-bit digest instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from particlelake.llm.common import (
    Batches,
    appended,
    binary_values,
    column_values,
    in_slices,
    plain_names,
    row_signature,
    stored,
    with_results,
)

FILTER_BITS = 1 << 26
HOT_WINDOWS = 200_000
DOCS_AT_ONCE = 500


def window_minimisers(words: list[bytes], window: int, gram: int) -> np.ndarray:
    """The minimiser of every window of a text, as unsigned 64-bit hashes."""
    digest = xxhash.xxh3_64_intdigest
    hashes = np.fromiter(map(digest, words), np.uint64, len(words))
    size = len(words) - gram + 1
    mixed = np.zeros(size, np.uint64)
    for j in range(gram):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[j: j + size]
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    span, wanted = 1, window - gram + 1
    while span * 2 <= wanted:
        mixed = np.minimum(mixed[:-span], mixed[span:])
        span *= 2
    rest = wanted - span
    return np.minimum(mixed[: len(mixed) - rest], mixed[rest:]) if rest else mixed


def super_kmers(minimisers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of each run of one minimiser."""
    first = np.flatnonzero(np.concatenate(([True], minimisers[1:] != minimisers[:-1])))
    return first, np.diff(np.append(first, len(minimisers)))


def _in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    place = (values % np.uint64(len(table) * 8)).astype(np.int64)
    return (table[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def _bit_table(keys: DataFrame, bits: int) -> np.ndarray:
    """Bit table of ``bits`` places (bits / 8 bytes, whatever the rows) of ``minimiser``."""
    # The unsigned remainder of a power of two is the number's low bits.
    place = F.col("minimiser").bitwiseAND(F.lit(bits - 1).cast("long")) + 1
    parts = keys.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")
    )
    table = np.zeros(max(bits // 8, 4096), np.uint8)
    for row in parts.toLocalIterator():
        table[(row["bucket"] - 1) * 4096: row["bucket"] * 4096] = np.frombuffer(row["bitmap"], np.uint8)
    return table[: bits // 8]


def _minimiser_rows(rows: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        for batch in in_slices(batches, DOCS_AT_ONCE):
            ids, keys, counts = [], [], []
            for doc, text in zip(column_values(batch, "doc_id"), binary_values(batch, "text")):
                words = text.split()
                if len(words) < window:
                    continue
                found = window_minimisers(words, window, gram)
                first, n = super_kmers(found)
                keys.append(found[first])
                counts.append(n)
                ids.append(np.full(len(first), doc, np.int64))
            if keys:
                columns = [np.concatenate(keys).view(np.int64), np.concatenate(ids), np.concatenate(counts)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["minimiser", "doc_id", "windows"])

    return rows.mapInArrow(run, "minimiser long, doc_id long, windows long")


def _packed_rows(rows: DataFrame, window: int, gram: int, shared, hot) -> DataFrame:
    """Super-k-mers whose minimiser other documents have, without the hot ones."""

    def run(batches: Batches) -> Batches:
        table, apart = shared.value, hot.value
        for batch in in_slices(batches, DOCS_AT_ONCE):
            out: list[tuple] = []
            signatures = column_values(batch, "signature")
            for doc, signature, text in zip(column_values(batch, "doc_id"), signatures, binary_values(batch, "text")):
                words = text.split()
                if len(words) < window:
                    continue
                found = window_minimisers(words, window, gram)
                first, n = super_kmers(found)
                wanted = _in_table(table, found[first]) & ~_in_table(apart, found[first])
                for i, k in zip(first[wanted].tolist(), n[wanted].tolist()):
                    packed = b" ".join(words[i: i + k + window - 1])
                    out.append((int(found[i].view(np.int64)), doc, signature, i, packed))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["minimiser", "doc_id", "signature", "first", "packed"])

    return rows.mapInArrow(run, "minimiser long, doc_id long, signature long, first long, packed binary")


def _hot_windows(rows: DataFrame, window: int, gram: int, hot) -> DataFrame:
    """Every single window of the hot minimisers, by the digest of its words."""

    def run(batches: Batches) -> Batches:
        apart = hot.value
        for batch in in_slices(batches, DOCS_AT_ONCE):
            out: list[tuple] = []
            signatures = column_values(batch, "signature")
            for doc, signature, text in zip(column_values(batch, "doc_id"), signatures, binary_values(batch, "text")):
                words = text.split()
                if len(words) < window:
                    continue
                for i in np.flatnonzero(_in_table(apart, window_minimisers(words, window, gram))).tolist():
                    digest = hashlib.blake2b(b" ".join(words[i: i + window]), digest_size=16).digest()
                    out.append((digest, doc, signature, i))
            if out:
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "doc_id", "signature", "first"])

    return rows.mapInArrow(run, "digest binary, doc_id long, signature long, first long")


def _bucket_spans(members: list[tuple], window: int) -> list[tuple]:
    """Word spans to remove among the super-k-mers (doc, signature, first, packed) of one minimiser."""
    if len({m[0] for m in members}) < 2:
        return []
    smallest: dict[bytes, int] = {}
    for doc, _, _, packed in members:
        smallest[packed] = min(doc, smallest.get(packed, doc))
    entries = []
    for packed, doc in smallest.items():
        ends = np.flatnonzero(np.frombuffer(packed + b" ", np.uint8) == 32)
        starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
        ends = ends.tolist()
        entries += [(packed[starts[i]: ends[i + window - 1]], doc, packed, i) for i in range(len(ends) - window + 1)]
    entries.sort(key=lambda e: e[:2])
    owners: dict[bytes, list] = {}
    current, owner = None, None
    for text, doc, packed, i in entries:
        if text != current:
            current, owner = text, doc
        owners.setdefault(packed, []).append((i, owner))
    found = []
    for doc, signature, first, packed in members:
        end = -1
        for i, owner in sorted(owners[packed]):
            if owner < doc:
                if i > end:
                    found.append([doc, signature, first + i, first + i + window])
                else:
                    found[-1][3] = first + i + window
                end = i + window
    return found


def _sorted_spans(packed: DataFrame, window: int) -> DataFrame:
    def run(batches: Batches) -> Batches:
        def flush(spans):
            columns = [pa.array(c, pa.int64()) for c in zip(*spans)]
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "signature", "first", "last"])

        key, members, spans = None, [], []
        for batch in in_slices(batches, 2000):
            for k, *member in zip(*[column_values(batch, c) for c in ("minimiser", "doc_id", "signature", "first", "packed")]):
                if k != key:
                    spans += _bucket_spans(members, window)
                    key, members = k, []
                members.append(tuple(member))
            if len(spans) > 5000:
                yield flush(spans)
                spans = []
        spans += _bucket_spans(members, window)
        if spans:
            yield flush(spans)

    grouped = packed.repartition("minimiser").sortWithinPartitions("minimiser")
    return grouped.mapInArrow(run, "doc_id long, signature long, first long, last long")


def repeated_spans(rows: DataFrame, window: int, gram: int, filter_bits: int, hot_windows: int) -> DataFrame:
    """(doc_id, signature, first, last) word spans of windows that a smaller document has too."""
    spark = rows.sparkSession
    met = _minimiser_rows(rows, window, gram).groupBy("minimiser").agg(
        F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.sum("windows").alias("windows")
    )
    met = stored(met.where("lo < hi").select("minimiser", "windows"), "minimisers")
    many = met.where(F.col("windows") > hot_windows)
    shared = spark.sparkContext.broadcast(_bit_table(met, filter_bits))
    hot = spark.sparkContext.broadcast(_bit_table(many, filter_bits))
    spans = _sorted_spans(_packed_rows(rows, window, gram, shared, hot), window)
    if many.isEmpty():
        return spans
    single = stored(_hot_windows(rows, window, gram, hot), "windows")
    owners = single.groupBy("digest").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi")).where("owner < hi")
    repeats = single.join(owners.select("digest", "owner"), "digest").where("doc_id > owner")
    return spans.unionByName(
        repeats.select("doc_id", "signature", "first", (F.col("first") + window).alias("last"))
    )


def remove_repeats(
    docs: DataFrame,
    window: int = 50,
    gram: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    filter_bits: int = FILTER_BITS,
    hot_windows: int = HOT_WINDOWS,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_removed`` (longs) and ``kept_text`` (kept words, one space between).

    A word goes if a window covers it whose word sequence also starts in a document
    with a smaller id, judged on the input. ``spans`` lists the removed word ranges
    as [first, last). Null texts have no words and ``kept_text`` ''. Rows with a null
    id lose nothing and take nothing from others. Rows with equal ids never take
    words from one another; repeated rows all come back. Columns of ``docs`` named
    like a result are replaced by it.
    """
    window_rows = plain_names(docs, (id_col, "doc_id"), (text_col, "text")).where("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", row_signature(F.col("text")).alias("signature")
    )
    spans = repeated_spans(window_rows, window, gram, filter_bits, hot_windows)
    by_doc = spans.groupBy(F.col("doc_id").alias("__doc"), F.col("signature").alias("__signature")).agg(
        F.array_sort(F.collect_set(F.struct("first", "last"))).alias("__spans")
    )
    results = ["n_words", "n_removed", "kept_text", "spans"]
    kept = with_results(docs, results)
    matches: Column = (kept[id_col].cast("long") == F.col("__doc")) & (
        row_signature(kept[text_col]) == F.col("__signature")
    )
    joined = kept.join(by_doc, matches, "left").drop("__doc", "__signature")
    shape = joined.drop("__spans").schema
    for name in ("n_words", "n_removed"):
        shape = shape.add(name, "long")
    span = StructType().add("first", "long").add("last", "long")
    shape = shape.add("kept_text", "string").add("spans", ArrayType(span))

    def run(batches: Batches) -> Batches:
        for batch in in_slices(batches, DOCS_AT_ONCE):
            place = batch.schema.get_field_index("__spans")
            spans = batch.column(place).to_pylist()
            total, removed, texts, merged = [], [], [], []
            for text, ranges in zip(binary_values(batch, text_col), spans):
                words = text.split()
                mine: list[dict] = []
                for r in ranges or ():
                    if mine and r["first"] <= mine[-1]["last"]:
                        mine[-1]["last"] = max(mine[-1]["last"], r["last"])
                    else:
                        mine.append(dict(r))
                left, at = [], 0
                for r in mine:
                    left += words[at: r["first"]]
                    at = r["last"]
                left += words[at:]
                total.append(len(words))
                removed.append(len(words) - len(left))
                texts.append(b" ".join(left).decode("utf-8"))
                merged.append(mine)
            rest = pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(batch.columns) if i != place],
                names=[n for i, n in enumerate(batch.schema.names) if i != place],
            )
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield appended(rest, {
                "n_words": pa.array(total, pa.int64()),
                "n_removed": pa.array(removed, pa.int64()),
                "kept_text": pa.array(texts, pa.string()),
                "spans": pa.array(merged, kind),
            })

    return joined.mapInArrow(run, shape)
