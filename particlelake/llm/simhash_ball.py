"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at most three bits apart have a common variant: at two bits or
fewer, one that is one flip from each; at three bits, one that is one flip from
the fingerprint of even parity and two flips from the odd one. Of any three
differing bits two lie in the same half of the word, so the odd fingerprint emits
only flips of two bits in one half. By the triangle inequality everything that
meets at a variant is linked to any fingerprint that lies within one flip of it,
so a variant yields a star, never pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from particlelake.llm.common import Batches, binary_values, in_slices, plain_names, stored
from particlelake.llm.components import linked_components

SEED = 42
HASHES_AT_ONCE = 1 << 16


def shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """64-bit hashes of the word shingles of one text, some thousands at a time."""
    found = text.lower().split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(words, len(found))
    first, last = starts[: len(found) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    for begin in range(0, len(first), HASHES_AT_ONCE):
        pairs = zip(first[begin: begin + HASHES_AT_ONCE], last[begin: begin + HASHES_AT_ONCE])
        yield np.array([digest(joined[s:e], SEED) for s, e in pairs], dtype=np.uint64)


def fingerprint_of(hashes: Iterable[np.ndarray]) -> int:
    """Unsigned 64-bit SimHash of shingle hashes; 0 for none."""
    ones, n = np.zeros(64, np.int64), 0
    for part in hashes:
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def text_fingerprint(text: bytes, words: int) -> int:
    """Unsigned 64-bit SimHash of the word shingles of one text."""
    return fingerprint_of(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint long) of every row; null and empty texts have fingerprint 0."""

    def run(batches: Batches) -> Batches:
        for batch in in_slices(batches, 1000):
            prints = np.array([text_fingerprint(t, words) for t in binary_values(batch, "text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fingerprint"])

    rows = plain_names(docs, (id_col, "doc_id"), (text_col, "text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint long")


def _single_flips(first: int, last: int) -> Column:
    return F.expr(f"transform(sequence({first}, {last}), i -> shiftleft(1L, i))")


def _block_masks(blocks: int) -> list[int]:
    """Masks of all but three of ``blocks`` blocks of bits, as signed numbers."""
    edges = [round(k * 64 / blocks) for k in range(blocks + 1)]
    parts = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    masks = [sum(chosen) for chosen in itertools.combinations(parts, blocks - 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _blocks_for(prints: int) -> int:
    """The fewest blocks of bits at which ``prints`` random fingerprints seldom agree in all but three."""
    for blocks in range(5, 12):
        if prints * math.comb(blocks, 3) <= 0.1 * 2 ** (64 * (blocks - 3) / blocks):
            return blocks
    return 12


def _crowded(prints: DataFrame, within: list[str]) -> DataFrame:
    """Distinct fingerprints that agree with another one in all but three of some blocks of bits.

    Three differing bits leave all other blocks alike, so nothing else can have a partner
    and need not emit its ball. The number of blocks follows that of the fingerprints; it
    changes the work, not the links.
    """
    distinct = prints.distinct()
    found = _block_masks(_blocks_for(distinct.count()))
    masks = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("m")) for i, m in enumerate(found)])
    keys = F.transform(masks, lambda m: F.xxhash64(m["i"], F.col("fingerprint").bitwiseAND(m["m"]), *within))
    blocks = distinct.select("*", F.explode(keys).alias("key"))
    order = Window.partitionBy("key").orderBy("fingerprint", *within)
    company = F.lag("fingerprint").over(order).isNotNull() | F.lead("fingerprint").over(order).isNotNull()
    return blocks.withColumn("met", company).where("met").select(*prints.columns).distinct()


def ball_links(prints: DataFrame, radius: int = 3, within: str | None = None) -> DataFrame:
    """(a, b) links that connect all distinct ``fingerprint`` values ``radius`` or fewer bits apart.

    With ``within``, a column that tells kinds of fingerprints apart, only those of one kind
    are linked and (within, a, b) is returned. The links are a spanning set: components
    are exact, and every link is verified. A variant holds at most 2,081 fingerprints, so no
    window partition is large.
    """
    if radius not in (1, 2, 3):
        raise ValueError("radius must be 1, 2 or 3")
    kind = [within] if within else []
    fp = F.col("fingerprint")
    itself = F.array(F.lit(0).cast("long"))
    singles = _single_flips(0, 63)
    doubles = F.expr(
        "flatten(transform(array(0, 32), h -> flatten(transform(sequence(0, 30), i -> "
        "transform(sequence(i + 1, 31), j -> shiftleft(1L, h + i) | shiftleft(1L, h + j))))))"
    )
    near = itself if radius == 1 else F.concat(itself, singles)
    far = {1: singles, 2: F.expr("cast(array() as array<bigint>)"), 3: doubles}[radius]
    odd = F.bit_count(fp) % 2 == 1
    balls = F.concat(
        F.transform(near, lambda m: F.struct(fp.bitwiseXOR(m).alias("variant"), F.lit(True).alias("near"))),
        F.when(odd, F.transform(far, lambda m: F.struct(fp.bitwiseXOR(m).alias("variant"), F.lit(False).alias("near"))))
        .otherwise(F.expr("cast(array() as array<struct<variant: bigint, near: boolean>>)")),
    )
    crowded = _crowded(prints.select(*kind, "fingerprint"), kind)
    emitted = crowded.select(*kind, "fingerprint", F.explode(balls).alias("v")).select(*kind, "fingerprint", "v.variant", "v.near")
    centre = F.min(F.when(F.col("near"), fp)).over(Window.partitionBy(*kind, "variant"))
    met = emitted.withColumn("centre", centre).where("centre is not null and centre <> fingerprint")
    close = met.where(F.bit_count(fp.bitwiseXOR(F.col("centre"))) <= radius)
    return close.select(*kind, fp.alias("a"), F.col("centre").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, words: int = 5, radius: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row, fingerprint as 16 hex digits.

    Copies share a fingerprint and are one class; only classes are compared.
    ``component_id`` is the smallest id reachable by links. Null or empty texts and
    texts of white space have fingerprint 0 and link like others. Rows with a null
    id take the component of their class, null if all its ids are null. Repeated
    rows are returned as often as they come; an empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, words, id_col, text_col), "fingerprints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("rep"))
    roots = linked_components(ball_links(classes.select("fingerprint"), radius))
    linked = classes.join(roots.withColumnRenamed("id", "fingerprint"), "fingerprint")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("smallest"))
    moved = linked.join(smallest, "root").select("fingerprint", "smallest")
    labelled = classes.join(moved, "fingerprint", "left").select(
        "fingerprint", F.coalesce("smallest", "rep").alias("component_id")
    )
    return prints.join(labelled, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
