"""Spelling variants: words one edit apart, found by pivotal grams.

All bigrams have one global order, rare ones first. Of each word the three first
occurrences (and others of the third one's bigram) are its gram prefix, and two that do
not overlap, chosen from them for the least total frequency, its pivots. One edit
spoils at most one pivot. If the prefix of a word ends no later in the order than that
of its neighbour, a pivot that survives lies in the neighbour's prefix: all grams up to there do.

Where it lies is limited too: the edit is behind the end of the first pivot, or
before the start of the second one, so positions agree from one end, and all up to that end
is unchanged. Of the rest, one of two halves is unchanged as well. The index key of an
occurrence is therefore its position from that end, the word's length, the unchanged side
and one half of the rest; a pivot asks for the lengths that one edit allows. Such keys
meet little but neighbours; candidates are verified by their edit distance.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from particlelake.llm.common import Batches, in_slices, stored

#: Code points that make up words, as Latin-1; capitals A-Z become small, all else is a gap.
LETTERS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0xC0 else 0x20 for c in range(256))
#: Counters of bigrams, so what travels to tasks does not grow with the alphabet.
COUNTERS = 1 << 16
PREFIX, SHORTEST = 3, 4
COUNTED_AT_ONCE = 200_000


def misspelt(run: bytes, prefix_crc: int, every: int) -> bytes:
    """A run of Latin-1 letters, or, if a hash says so, the run without one of them."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), prefix_crc)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


def word_counts(
    docs: DataFrame, min_length: int = 5, min_count: int = 3, id_col: str = "doc_id", text_col: str = "text", every: int = 97
) -> DataFrame:
    """(word, n) of the distinct letter runs of whole texts with enough code points and occurrences.

    Runs are of ASCII letters and U+00C0 to U+00FF, lower-cased in A-Z only; one in ``every`` by a hash of
    id and run loses a letter first. Null ids count as empty strings, null texts hold no run.
    Tasks add up a bounded number of words before they send them on.
    """

    def run(batches: Batches) -> Batches:
        counts: dict[bytes, int] = {}

        def drained() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in counts], pa.string())
            batch = pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return batch

        for batch in in_slices(batches, 100):
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                crc = zlib.crc32(f"{name or ''}:".encode())
                for found, n in Counter(text.encode("latin-1", "replace").translate(LETTERS).split()).items():
                    if len(found) >= min_length:
                        word = misspelt(found, crc, every)
                        if len(word) >= min_length:
                            counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED_AT_ONCE:
                    yield drained()
        yield drained()

    named = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    partial = named.mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % COUNTERS


def gram_counts(words: DataFrame) -> np.ndarray:
    """How many bigrams of all ``word`` values fall to each of a fixed number of counters."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))).alias("gram"))
    counted = grams.groupBy((F.crc32("gram") % COUNTERS).alias("bucket")).count().collect()
    counts = np.zeros(COUNTERS, np.int64)
    for bucket, n in counted:
        counts[bucket] = n
    return counts


def gram_prefix(word: str, counts: np.ndarray) -> list[int]:
    """Starts of the first three bigrams in the global order, and of all others equal to the third."""
    grams = [word[k: k + 2] for k in range(len(word) - 1)]
    order = sorted(range(len(grams)), key=lambda k: (counts[_bucket(grams[k])], grams[k], k))
    last = grams[order[PREFIX - 1]]
    return sorted(order[:PREFIX] + [k for k in order[PREFIX:] if grams[k] == last])


def pivots(word: str, prefix: list[int], counts: np.ndarray) -> tuple[int, int]:
    """Starts of two bigrams of ``prefix`` that do not overlap, of least total frequency.

    ``best[j]`` is the cheapest choice of j of the bigrams passed so far, by the last one's end.
    """
    cost = {k: int(counts[_bucket(word[k: k + 2])]) for k in prefix}
    one: list[tuple[int, int]] = []
    two: tuple[int, int, int] | None = None
    for k in prefix:
        free = [x for x in one if x[1] + 2 <= k]
        if free:
            before = min(free)
            two = min(x for x in (two, (before[0] + cost[k], before[1], k)) if x is not None)
        one.append((cost[k], k))
    return two[1], two[2]


def _key(text: str, length: int, at: int, kind: int) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed=(length << 32) + (at << 2) + kind)


def offered_keys(word: str, at: int, side: int) -> list[int]:
    """Index keys of the occurrence of a bigram at ``at``, for edits behind it: with either half of the rest."""
    end, n = at + 2, len(word)
    middle = (end + n) // 2
    return [_key(word[:middle], n, at, side), _key(f"{word[:end]}\0{word[middle:]}", n, at, side + 2)]


def asked_keys(word: str, at: int, side: int) -> list[int]:
    """The keys under which neighbours that are unchanged up to the bigram at ``at`` are found."""
    end, keys = at + 2, []
    for n in range(max(end, len(word) - 1), len(word) + 2):
        middle = (end + n) // 2
        if middle <= len(word):
            keys.append(_key(word[:middle], n, at, side))
        if n - middle <= len(word) - end:
            keys.append(_key(f"{word[:end]}\0{word[len(word) - n + middle:]}", n, at, side + 2))
    return keys


def _signatures(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """(word, n, pivots, prefix): keys a word asks for, and keys it is found under.

    The second pivot, and every occurrence a second time, is seen from the word's other end.
    """

    def run(batches: Batches) -> Batches:
        for batch in in_slices(batches, 5000):
            asked, offered = [], []
            for word in batch.column(0).to_pylist():
                prefix, back = gram_prefix(word, counts), word[::-1]
                first, second = pivots(word, prefix, counts)
                ask = asked_keys(word, first, 0) + asked_keys(back, len(word) - 2 - second, 1)
                offer = [k for p in prefix for k in offered_keys(word, p, 0) + offered_keys(back, len(word) - 2 - p, 1)]
                asked.append(np.array(ask, np.uint64).view(np.int64))
                offered.append(np.array(offer, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(asked, pa.list_(pa.int64())), pa.array(offered, pa.list_(pa.int64()))], names=["word", "n", "pivots", "prefix"]
            )

    return words.mapInArrow(run, "word string, n long, pivots array<bigint>, prefix array<bigint>")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all ordered pairs of ``words(word, n)`` exactly one edit apart."""
    signed = stored(_signatures(words.select("word", F.col("n").cast("long").alias("n")), gram_counts(words)), "word-grams")
    asking = signed.select("word", "n", F.explode(F.array_distinct("pivots")).alias("key"))
    offering = signed.select(F.col("word").alias("near"), F.col("n").alias("near_n"), F.explode(F.array_distinct("prefix")).alias("key"))
    met = asking.join(offering, "key").where(F.abs(F.length("word") - F.length("near")) <= 1)
    close = met.where("word <> near").where(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")
    both = close.unionByName(close.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return both.distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the end of every chain of ``forms(word, form)``, by jumps that double.

    Counts double along a chain, so none is longer than the bits of the largest count.
    """
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(state.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return moved.select("word", "root")
        state = moved.select("word", "root")


def spelling_variants(words: DataFrame, factor: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``words(word, n)``.

    Two words are near if one inserted, deleted or replaced code point tells them apart.
    ``form`` is the near word of the largest count, ties going to the smaller in code-point order,
    if it occurs at least ``factor`` times as often; ``root`` is where forms lead. Words have
    four code points at least; repeated words add their counts, null words are left out.
    Other columns are ignored; an empty table gives an empty one.
    """
    known = words.where("word is not null").groupBy("word").agg(F.sum(F.col("n").cast("long")).alias("n"))
    known = stored(known, "words")
    if not known.where(F.length("word") < SHORTEST).isEmpty():
        raise ValueError(f"words need {SHORTEST} code points at least")
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), "near", "near_n")).alias("best")
    summed = near_words(known).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    enough = F.col("best.near_n") >= factor * F.col("n")
    formed = stored(summed.select("word", "n_near", F.when(enough, F.col("best.near")).alias("form"), F.when(enough, F.col("best.near_n")).alias("form_n")), "forms")
    roots = _roots(formed.where("form is not null"))
    joined = known.join(formed, "word", "left").join(roots, "word", "left")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))


def document_variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spelling variants among the words of whole texts, with misspellings put in by a hash."""
    return spelling_variants(word_counts(docs, min_length, min_count, id_col, text_col))
