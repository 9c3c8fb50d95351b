"""One document of every group of texts whose sets of word shingles are alike.

A single SimHash of whole texts finds few pairs of similarity 0.8: there about ten of
64 bits differ. So a text has several fingerprints: that of all its shingles, and one of each
of ``PARTS`` parts of them, the ``PART_SHINGLES`` smallest under a hash of the part's own. Each kind goes
through ball hashing, and texts with near fingerprints of one kind are candidates. Two texts
of similarity s share a part with probability s**3, so at 0.8 twelve parts miss a pair once in 5,500 times.

Candidates are compared by their whole shingle sets. The texts of a bucket, which are those of
equal or chained near fingerprints of one kind, are first compared with the smallest of them, as stars.
Where some stay apart, every pair of texts of unlike groups of the bucket is compared: the texts
are dealt to blocks of bounded size, and a task compares two blocks and returns links that span
what it found. So no link between two texts of a bucket is lost. A group that fills blocks has
blocks of its own, which never meet each other; the work grows with the square of a bucket's
unlike texts, the rows sent with that square over a block. Equal sets are one node; ids and
hashes travel, and texts only to the tasks that compare them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from particlelake.llm.common import Batches, Scratch, binary_values, in_slices, stored
from particlelake.llm.components import linked_components
from particlelake.llm.simhash_ball import SEED, ball_links, fingerprint_of, shingle_hashes

PARTS, PART_SHINGLES = 12, 3
#: Texts that one task compares with a copy of their centre.
STAR_TEXTS = 512
#: Texts of a block, and shingles of all of them, about; a task holds two blocks.
BLOCK_TEXTS, BLOCK_SHINGLES = 2048, 1 << 20
_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(0, 1 << 64, PARTS, dtype=np.uint64) | np.uint64(1)
#: The node of null texts; texts without words are another one.
NULL_NODE = -1
_ROW = ["__s1", "__s2"]


def distinct_hashes(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def part_fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of every part of a text's distinct shingle hashes."""
    if len(hashes) <= PART_SHINGLES:
        return np.full(PARTS, fingerprint_of([hashes]), np.uint64)
    prints = []
    for factor, other in zip(_FACTORS, _FACTORS[::-1]):
        mixed = hashes * factor
        mixed ^= mixed >> np.uint64(32)
        mixed *= other
        prints.append(fingerprint_of([hashes[np.argpartition(mixed, PART_SHINGLES - 1)[:PART_SHINGLES]]]))
    return np.array(prints, np.uint64)


def content_key(df: DataFrame) -> list[Column]:
    """Two hashes of all columns of a row: rows that share them are equal, so either stands for both."""

    def plain(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        return F.to_json(F.struct(c)) if isinstance(field.dataType, (T.MapType, T.StructType, T.ArrayType)) else c

    parts = [x for f in df.schema.fields for x in (plain(f), F.col(f"`{f.name}`").isNull())]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in enumerate(_ROW)]


def described(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(__s1, __s2, id, node, size, fingerprint, parts) of every row."""

    def run(batches: Batches) -> Batches:
        for batch in in_slices(batches, 500):
            nulls = batch.column(3).is_null().to_pylist()
            nodes, sizes, prints, parts = [], [], [], []
            for text, null in zip(binary_values(batch, "text"), nulls):
                hashed = list(shingle_hashes(text, words))
                hashes = distinct_hashes(hashed)
                node = np.uint64(xxhash.xxh64_intdigest(hashes.astype("<u8").tobytes(), seed=SEED)).view(np.int64)
                nodes.append(NULL_NODE if null else int(node))
                sizes.append(len(hashes))
                prints.append(fingerprint_of(hashed))
                parts.append(part_fingerprints(hashes).view(np.int64) if len(hashes) else np.zeros(0, np.int64))
            columns = [
                *batch.columns[:3], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()),
                pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(parts, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*_ROW, "id", "node", "size", "fingerprint", "parts"])

    rows = docs.select(*content_key(docs), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__s1 long, __s2 long, id {kind}, node long, size long, fingerprint long, parts array<bigint>")


def _similar(batches: Batches, words: int, similarity: float) -> Batches:
    """(a, b) of texts and their centres, from rows (b, salt, a, text) sorted so that a centre precedes its texts."""

    def found() -> Iterator[tuple[int, int]]:
        centre, known = None, np.zeros(0, np.uint64)
        for batch in in_slices(batches, 100):
            for b, a, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), binary_values(batch, "text")):
                hashes = distinct_hashes(list(shingle_hashes(text, words)))
                if a is None:
                    centre, known = b, hashes
                elif b == centre:
                    shared = len(np.intersect1d(known, hashes, assume_unique=True))
                    if shared >= similarity * (len(known) + len(hashes) - shared) - 1e-9:
                        yield a, b

    pairs = list(found())
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])


class _Comparer:
    """Compares texts of pairs of nodes; holds the texts that have any candidate."""

    def __init__(self, texts: DataFrame, words: int, similarity: float, scratch: Scratch):
        self.texts, self.words, self.similarity, self.scratch = texts, words, similarity, scratch

    def possible(self, pairs: DataFrame) -> DataFrame:
        """Distinct pairs (a, a_n, b, b_n) whose sizes allow the similarity, as (a, b)."""
        least, most = F.least("a_n", "b_n"), F.greatest("a_n", "b_n")
        return pairs.where(F.col("a") != F.col("b")).where(least >= self.similarity * most - 1e-9).select("a", "b").distinct()

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs(a, b)`` whose shingle sets are similar enough; few b have many a."""
        pairs = self.scratch.stored(pairs, "star-pairs")
        stars = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select("b", F.ceil(F.col("n") / STAR_TEXTS).cast("long").alias("salts"))
        stars = self.scratch.stored(stars, "stars")
        salted = pairs.join(stars, "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("salts")).alias("salt"), "a")
        centres = stars.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("a"))
        sent = salted.unionByName(centres).join(self.texts, "node").select("b", "salt", "a", "text")
        placed = sent.repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
        words, similarity = self.words, self.similarity
        return self.scratch.stored(placed.mapInArrow(lambda x: _similar(x, words, similarity), "a long, b long"), "star-links")


def _shared(members: DataFrame) -> DataFrame:
    """Rows of ``members(key, node, ...)`` whose key has several nodes."""
    met = members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    return members.join(met.select("key", F.col("lo").alias("centre")), "key")


def spanning_links(sets: list[np.ndarray], groups: np.ndarray, block: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Places of similar ``sets`` of unlike ``groups``, as many as connect all that are similar.

    ``block`` tells two blocks apart; sets of one block are compared only where there is no other one.
    Overlaps are counted through lists of the sets that hold a shingle. A set that is similar to another
    one shares one of its rarest shingles with it, all but ``similarity`` of them and one more.
    """
    groups, sizes = groups.copy(), np.array([len(x) for x in sets])
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    owners = np.repeat(np.arange(len(right)), sizes[right])
    held = np.concatenate([sets[y] for y in right])
    order = np.argsort(held, kind="stable")
    tokens, first = np.unique(held[order], return_index=True)
    lists, ends = owners[order], np.append(first[1:], len(held))

    def holders(places: np.ndarray) -> np.ndarray:
        n = ends[places] - first[places]
        return lists[np.repeat(first[places] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    found = []
    for x in left.tolist():
        if (groups[right] == groups[x]).all():
            continue
        places = np.minimum(np.searchsorted(tokens, sets[x]), len(tokens) - 1)
        places = places[tokens[places] == sets[x]]
        absent = sizes[x] - len(places)
        rarest = sizes[x] - int(np.ceil(similarity * sizes[x] - 1e-9)) + 1 - absent
        if rarest <= 0:
            continue
        if rarest < len(places):
            near = holders(places[np.argpartition((ends - first)[places], rarest - 1)[:rarest]])
            if (groups[right[near]] == groups[x]).all():
                continue
        shared = np.bincount(holders(places), minlength=len(right))
        alike = shared >= similarity * (sizes[x] + sizes[right] - shared) - 1e-9
        for y in right[alike & (groups[right] != groups[x])].tolist():
            if groups[y] != groups[x]:
                found.append((x, y))
                groups[groups == groups[y]] = groups[x]
    return found


def _dealt(members: DataFrame) -> DataFrame:
    """(key, i, j, block, node, root) of ``members(key, node, size, root)``, once for each other block of a key it meets.

    Groups larger than a block have blocks of their own; all others of the key share mixed ones.
    """
    blocks = lambda n, size: F.ceil(F.greatest(n / BLOCK_TEXTS, size / BLOCK_SHINGLES)).cast("int")
    groups = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    own = F.when(blocks(F.col("n"), F.col("size")) > 1, F.col("root"))
    kinds = groups.groupBy("key", own.alias("own")).agg(blocks(F.sum("n"), F.sum("size")).alias("blocks"))
    kinds = kinds.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("own", "blocks"))).alias("kinds"))
    before = F.transform("kinds", lambda k, at: F.struct(
        k["own"].alias("own"), k["blocks"].alias("blocks"),
        F.aggregate(F.slice("kinds", F.lit(1), at), F.lit(0), lambda s, x: s + x["blocks"]).alias("start"),
    ))
    placed = members.join(kinds.select("key", before.alias("kinds")), "key")
    mine = F.coalesce(*[F.get(F.filter("kinds", of), F.lit(0)) for of in (lambda k: k["own"] == F.col("root"), lambda k: k["own"].isNull())])
    placed = placed.withColumn("mine", mine).withColumn("total", F.aggregate("kinds", F.lit(0), lambda s, x: s + x["blocks"]))
    block = F.col("mine.start") + F.pmod(F.xxhash64("node"), F.col("mine.blocks")).cast("int")
    sent = placed.select("key", "node", "root", "mine", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("total") - 1)).alias("other"))
    alike = F.col("mine.own").isNotNull() & F.col("other").between(F.col("mine.start"), F.col("mine.start") + F.col("mine.blocks") - 1)
    return sent.where(~alike).select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")


def unlike_links(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(a, b) links that connect all similar nodes of a key of ``members(key, node, size, root)`` whose roots differ."""

    def compared(rows: pa.Table) -> pa.Table:
        nodes, roots, block = (rows.column(c).to_numpy() for c in ("node", "root", "block"))
        texts = rows.column("text").cast(pa.binary()).to_pylist()
        sets = [distinct_hashes(list(shingle_hashes(t, words))) for t in texts]
        pairs = np.array(spanning_links(sets, roots, block, similarity), np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(nodes[pairs[:, 0]], pa.int64()), "b": pa.array(nodes[pairs[:, 1]], pa.int64())})

    apart = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    sent = _dealt(members.join(apart, "key", "left_semi")).join(texts, "node")
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # by number, as few bytes can be much work
    return sent.repartition(tasks, "key", "i", "j").groupBy("key", "i", "j").applyInArrow(compared, "a long, b long").distinct()


def similar_links(nodes: DataFrame, docs: DataFrame, words: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(a, b) links that connect similar ``nodes(node, __s1, __s2, size, fingerprint, parts)``; texts from ``docs(__s1, __s2, text)``."""
    kinds = nodes.select("node", "size", F.posexplode(F.concat("parts", F.array("fingerprint"))).alias("part", "fp"))
    prints = kinds.select("part", F.col("fp").alias("fingerprint")).distinct()
    balls = ball_links(prints, within="part").select(F.xxhash64("part", "a").alias("a"), F.xxhash64("part", "b").alias("b"))
    chained = linked_components(balls).select(F.col("id").alias("key"), F.col("root").alias("chain"))
    keyed = kinds.select(F.xxhash64("part", "fp").alias("key"), "node", "size").join(chained, "key", "left")
    buckets = scratch.stored(_shared(keyed.select(F.coalesce("chain", "key").alias("key"), "node", "size")), "buckets")
    wanted = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select(*_ROW, "node")
    texts = scratch.stored(docs.join(wanted, _ROW).select("node", "text").dropDuplicates(["node"]), "crowd-texts")
    comparer = _Comparer(texts, words, similarity, scratch)
    sizes = buckets.where("node = centre").select("key", F.col("size").alias("b_n"))
    stars = buckets.join(sizes, "key").select(F.col("node").alias("a"), F.col("size").alias("a_n"), F.col("centre").alias("b"), "b_n")
    links = comparer.links(comparer.possible(stars))
    roots = linked_components(links).select(F.col("id").alias("node"), "root")
    rooted = scratch.stored(buckets.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root")), "rooted")
    return scratch.stored(links.unionByName(unlike_links(rooted, texts, words, similarity)).distinct(), "links")


def first_of_similar(
    docs: DataFrame, words: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row of ``docs`` of every group of texts linked by ``similarity`` or more.

    Similarity is the share of common ones among all distinct ``words``-word shingles of two
    texts, cut as for fingerprints. The row with the smallest id stays, null ids last;
    of rows with that id the one with the smallest content hash, of equal rows one.
    Null texts are one group, and texts without words another. All columns of ``docs`` are
    returned, whatever their names. An empty table gives an empty one.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.stored(described(docs, words, id_col, text_col), "described")
        of_node = F.min(F.struct(*_ROW, "size", "fingerprint", "parts")).alias("x")
        nodes = scratch.stored(rows.where("size > 0").groupBy("node").agg(of_node).select("node", "x.*"), "nodes")
        texts = docs.select(*content_key(docs), F.col(f"`{text_col}`").alias("text"))
        links = similar_links(nodes, texts, words, similarity, scratch)
        roots = linked_components(links).select(F.col("id").alias("node"), "root")
        order = F.struct(F.col("id").isNull().alias("none"), "id", *_ROW)
        chosen = rows.select("node", order.alias("first")).join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("group")).agg(F.min("first").alias("first"))
        chosen = scratch.stored(chosen.select(*[F.col(f"first.{c}").alias(c) for c in _ROW]), "chosen")
        copies = scratch.stored(rows.groupBy(*_ROW).count().where("count > 1").join(chosen, _ROW, "left_semi").select(*_ROW), "repeated-rows")
        single = stored(chosen.join(copies, _ROW, "left_anti"), "first-rows")
        repeated = None if copies.isEmpty() else stored(copies, "first-rows")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *content_key(docs))
    kept = keyed.join(single, _ROW, "left_semi").select("__row.*")
    if repeated is None:
        return kept
    one = keyed.join(repeated, _ROW, "left_semi").groupBy(*_ROW).agg(F.first("__row").alias("__row"))
    return kept.unionByName(one.select("__row.*"))
