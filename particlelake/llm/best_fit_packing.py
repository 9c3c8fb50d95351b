"""Packing token pieces into sequences: best-fit decreasing over a segment tree."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from particlelake.llm.common import Batches, binary_values, in_slices, plain_names, stored
from particlelake.llm.encoding import word_encoder

#: Pieces packed together in one task. Groups share no sequence, so each may leave
#: one or two sequences partly filled, whatever the size of the table.
GROUP_PIECES = 100_000
DOCS_AT_ONCE = 200


class OpenBins:
    """Bins by remaining capacity in a segment tree; finds the tightest in logarithmic time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.filled = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def push(self, remaining: int, number: int) -> None:
        self.bins[remaining].append(number)
        node = self.leaves + remaining
        while node and not self.filled[node]:
            self.filled[node] = 1
            node >>= 1

    def pop(self, remaining: int) -> int:
        number = self.bins[remaining].pop()
        if not self.bins[remaining]:
            node = self.leaves + remaining
            self.filled[node] = 0
            while node > 1 and not self.filled[node ^ 1]:
                node >>= 1
                self.filled[node] = 0
        return number

    def tightest(self, needed: int) -> int:
        """The smallest remaining capacity of an open bin that is at least ``needed``, or -1."""
        filled, node = self.filled, self.leaves + needed
        if filled[node]:
            return needed
        while node > 1 and (node & 1 or not filled[node ^ 1]):
            node >>= 1
        if node <= 1:
            return -1
        node ^= 1
        while node < self.leaves:
            node = 2 * node + (not filled[2 * node])
        return node - self.leaves


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every length, taken in the given order (longest first)."""
    open_bins, used = OpenBins(capacity), 0
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in enumerate(lengths.tolist()):
        remaining = open_bins.tightest(length)
        if remaining < 0:
            number, remaining, used = used, capacity, used + 1
        else:
            number = open_bins.pop(remaining)
        bins[i], offsets[i] = number, capacity - remaining
        if remaining > length:
            open_bins.push(remaining - length, number)
    return bins, offsets


def token_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document.

    A document is its token ids and the end id; only longer ones than ``capacity`` are
    cut, into full pieces and a rest. Null texts count as empty: one piece of one id.
    Null ids and repeated rows pass like others.
    """
    kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
    if with_ids:
        kinds["ids"] = pa.binary()

    def run(batches: Batches) -> Batches:
        encoder = word_encoder(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in in_slices(batches, DOCS_AT_ONCE):
            owners, out = [], []
            for row, ids in enumerate(encoder.encode(binary_values(batch, "text"))):
                ids += end
                for piece, at in enumerate(range(0, len(ids), step)):
                    part = ids[at: at + step]
                    owners.append(row)
                    out.append((piece, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds.values())]
            docs_of = batch.column(0).take(pa.array(owners, pa.int64()))
            yield pa.RecordBatch.from_arrays([docs_of, *columns], names=["doc_id", *kinds])

    rows = plain_names(docs, (id_col, "doc_id"), (text_col, "text"))
    shape = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(run, shape + ", ids binary" * with_ids)


def best_fit(pieces: DataFrame, capacity: int = 2048, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``; no sequence exceeds ``capacity``.

    Pieces are dealt to groups of about ``group_pieces`` rows without regard to their
    values, so equal rows spread too; each group is packed longest first. Columns named
    like the results are replaced. An empty table stays empty.
    """
    keep = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset", "__group")]
    pieces = pieces.select(*[F.col(f"`{c}`") for c in keep])
    groups = max(1, -(-pieces.count() // group_pieces))
    order = [c for c in ("doc_id", "piece") if c in keep]
    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), *[(c, "ascending") for c in order]])
        lengths = table.column("length").to_numpy()
        if len(lengths) and lengths[0] > capacity:
            raise ValueError(f"a piece of {lengths[0]} tokens is longer than a sequence")
        bins, offsets = best_fit_decreasing(lengths, capacity)
        group = table.column("__group").to_numpy()
        table = table.drop_columns(["__group"])
        return table.append_column("sequence_id", pa.array(group * (1 << 32) + bins)).append_column("offset", pa.array(offsets))

    return dealt.groupBy("__group").applyInArrow(pack, pieces.schema.add("sequence_id", "long").add("offset", "long"))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, **options) -> DataFrame:
    """Pieces of all documents with their place in packed sequences.

    Pieces are written to the shared folder first, without their ids unless
    ``with_ids``, so texts are encoded once.
    """
    group = options.pop("group_pieces", GROUP_PIECES)
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, end_id, **options), "pieces")
    return best_fit(pieces, capacity, group)
