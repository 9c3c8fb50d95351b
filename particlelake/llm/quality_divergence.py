"""Quality rules: repetition and Jensen-Shannon distance to language references.

Two histograms of a document are compared to its language's reference, which is the
same histogram over all documents of the language that pass the base rules, drawn a little
towards that of the whole table: classes of characters in words, and
the language's common words against all other words. The distance is the square root
of the divergence in bits, from 0 to 1. A document too short for a histogram passes it.

Whole texts are read once: counts per document are written to the shared folder,
references are sums of them, and verdicts need the counts only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from particlelake.llm.common import GAP, WORD, stored, with_results

#: Frequent function words by language.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an er so".split(),
    "en": "the of and to in a is that it for on was be with as by this are at from or an have not".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como o pero".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par sur au pas ne se plus ce".split(),
}
OTHER = "*"
#: Character classes that are counted; letters beyond them are what is left of the words.
COUNTED_CLASSES = ("[A-Z]", "[0-9]", "[.,;:!?'\"()\\-]")
SYMBOLS = "[#*$%&|<>]"
REPEAT = 8
#: Words of the whole table's histogram that every language's reference starts from.
PRIOR_WORDS = 1_000
MIN_CHARS, MAX_CHAR_DISTANCE = 200, 0.33
MIN_WORDS, MAX_WORD_DISTANCE = 50, 0.42
#: A text at this part of the distance of one without common words lacks them too,
#: if the reference leads one to expect at least so many common words in it.
LACKS_COMMON, MIN_EXPECTED = 0.93, 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, GAP), "")


def language_key(lang: Column) -> Column:
    """The language a document is compared to: its own if it has a word list."""
    short = F.substring_index(F.lower(lang.cast("string")), "-", 1)
    return F.when(short.isin(list(COMMON_WORDS)), short).otherwise(OTHER)


def common_words(key: Column) -> Column:
    """The word list of a language; all lists together for the others."""
    lists = F.array(*[F.lit(w) for w in dict.fromkeys(w for ws in COMMON_WORDS.values() for w in ws)])
    for name, words in COMMON_WORDS.items():
        lists = F.when(key == name, F.array(*[F.lit(w) for w in words])).otherwise(lists)
    return lists


def class_counts(text: Column, word_chars: Column, symbols: Column) -> Column:
    """Capitals, digits, punctuation, symbols, bytes beyond ASCII and small letters, in words."""
    counted = [F.regexp_count(text, F.lit(c)).cast("long") for c in COUNTED_CLASSES]
    beyond = (F.octet_length(text) - F.length(text)).cast("long")
    return let(
        F.array(*counted, symbols, beyond),
        lambda c: F.concat(c, F.array(F.greatest(word_chars - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long")))),
    )


def window_hashes(words: Column) -> Column:
    """A 64-bit hash of every window of eight words: of pairs, of pairs of them, and again."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    for step in (1, 2, 4):
        hashed = _paired(hashed, step)
    return F.slice(hashed, 1, F.size(words) - (REPEAT - 1))


def _paired(hashes: Column, step: int) -> Column:
    return let(hashes, lambda h: F.zip_with(h, F.slice(h, step + 1, 1 << 30), lambda a, b: F.xxhash64(a, b)))


def repeated_words(words: Column) -> Column:
    """Words covered by eight-word windows that are found twice or more; windows by 64-bit hash."""
    none = F.lit(0).cast("long")

    def covered(windows: Column) -> Column:
        placed = F.array_sort(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def repeats(s: Column) -> Column:
            like = lambda x, k: F.coalesce(F.get(s, k)["w"] == x["w"], F.lit(False))
            found = F.filter(s, lambda x, k: (like(x, k - 1) & (k > 0)) | like(x, k + 1))
            return F.sort_array(F.transform(found, lambda x: x["i"]))

        def union(p: Column) -> Column:
            steps = F.transform(p, lambda x, k: F.least(F.coalesce(F.get(p, k + 1) - x, F.lit(REPEAT)), F.lit(REPEAT)))
            return F.aggregate(steps, none, lambda a, x: a + x)

        return let(let(placed, repeats), union)

    counted = let(window_hashes(words), lambda ws: F.when(F.size(F.array_distinct(ws)) < F.size(ws), covered(ws)).otherwise(none))
    return F.when(F.size(words) > REPEAT, counted).otherwise(none)


def jensen_shannon(counts: Column, shares: Column) -> Column:
    """Distance of a histogram of counts to one of shares; null if either is empty."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def term(a: Column, b: Column) -> Column:
        part = lambda x: F.when(x > 0, x * F.log2(2 * x / (a + b))).otherwise(0.0)
        return (part(a) + part(b)) / 2

    def distance(t: Column) -> Column:
        terms = F.zip_with(counts, shares, lambda c, s: term(c / t, s))
        divergence = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
        return F.when((t > 0) & shares.isNotNull(), F.sqrt(F.greatest(divergence, F.lit(0.0))))

    return let(total, distance)


def lacking_limit(key: Column, shares: Column, n_words: Column) -> Column:
    """The word distance from which a text lacks its language's common words; null if it cannot tell.

    It follows the distance of a text without any common word, so it lies below that
    distance for every language. Languages without a list of their own have no such limit.
    """
    other = F.element_at(shares, -1)
    none = F.transform(shares, lambda s, i: (i == F.size(shares) - 1).cast("long"))
    expected = n_words * (1 - other)
    return F.when((key != OTHER) & (expected >= MIN_EXPECTED), LACKS_COMMON * jensen_shannon(none, shares))


def document_counts(text: Column, key: Column) -> Column:
    """Everything that is counted in a text, as one struct that is computed once."""

    def first(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda found: (F.size(found) - F.size(F.array_distinct(found))).cast("long")).alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            let(common_words(key), lambda c: F.filter(words, lambda w: F.array_contains(c, w))).alias("common"),
        )

    def second(x: Column) -> Column:
        of_each = F.transform(common_words(key), lambda r: (F.size(x["common"]) - F.size(F.array_remove(x["common"], r))).cast("long"))
        histogram = F.concat(of_each, F.array(x["n_words"] - F.size(x["common"])))
        classes = class_counts(text, x["word_chars"], x["n_symbols"])
        return F.struct(*[x[n].alias(n) for n in COUNTS], histogram.alias("word_counts"), classes.alias("class_counts"))

    return let(let(words_of(text), first), second)


def language_references(counted: DataFrame) -> DataFrame:
    """(key, word_shares, class_shares) from the counts of all given documents: a row per word list and one more.

    Every reference has ``PRIOR_WORDS`` words (or as many characters) of the histogram of the
    whole table on top, place by place, the last places (other words) together. So a
    language of few documents has a reference as well, and there is no size from which it counts.
    """

    def summed(name: str) -> DataFrame:
        found = F.col(f"__counts.{name}")
        long = counted.select("__key", F.size(found).alias("size"), F.posexplode(found).alias("place", "n"))
        sums = long.groupBy("__key", "place", (F.col("place") == F.col("size") - 1).alias("last")).agg(F.sum("n").alias("n"))
        like = F.when(F.col("last"), -1).otherwise(F.col("place")).alias("like")
        pooled = sums.groupBy(like).agg(F.sum("n").alias("all"))
        both = sums.select("__key", "place", "n", like).join(pooled, "like")
        parts = both.groupBy("__key").agg(
            F.array_sort(F.collect_list(F.struct("place", "n", "all"))).alias("parts"), F.sum("n").alias("total"), F.sum("all").alias("prior")
        )
        weight = F.lit(float(PRIOR_WORDS))
        share = lambda p: (p["n"] + weight * p["all"] / F.col("prior")) / (F.col("total") + weight)
        return parts.select(F.col("__key").alias("key"), F.when(F.col("prior") > 0, F.transform("parts", share)).alias("shares"))

    words, classes = summed("word_counts"), summed("class_counts")
    return words.alias("w").join(classes.alias("c"), "key").select("key", F.col("w.shares").alias("word_shares"), F.col("c.shares").alias("class_shares"))


def quality_verdicts(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    min_words: int = 20,
    max_repeated: float = 0.30,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``docs`` (or its ``carry`` columns) with counts, distances and ``kept``.

    Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``
    (longs), ``base_failed``, ``char_distance``, ``word_distance`` (null under the length
    guards) and ``kept``. A document fails the base rules with fewer than ``min_words``
    words or more than ``max_repeated`` of them repeated, and the method's rule if a
    distance exceeds its limit or the text lacks common words (``lacking_limit``). References
    come from the documents that pass the base rules. No Python runs and nothing is shuffled but sums. Null
    texts have no words and fail; languages without a word list, and null ones, share
    a reference; repeated rows get equal results; columns of ``docs`` named like a result are
    replaced; an empty table gives an empty one.
    """
    results = [*COUNTS, "base_failed", "char_distance", "word_distance", "kept"]
    kept = with_results(docs, results) if carry is None else docs.select(*[F.col(f"`{c}`") for c in carry])
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = language_key(F.col(f"`{lang_col}`"))
    carried = [F.col(f"`{c}`") for c in kept.columns]
    counted = stored(docs.select(*carried, key.alias("__key"), document_counts(text, key).alias("__counts")), "counts")
    found, ref = F.col("__counts"), F.col("__ref")
    failed = (found["n_words"] < min_words) | (100 * found["n_repeat_words"] > round(100 * max_repeated) * found["n_words"])
    references = stored(language_references(counted.where(~failed)), "references").select(
        F.col("key").alias("__key"), F.struct("word_shares", "class_shares").alias("__ref")
    )
    chars = F.when(found["word_chars"] >= MIN_CHARS, jensen_shannon(found["class_counts"], ref["class_shares"]))
    words = F.when(found["n_words"] >= MIN_WORDS, jensen_shannon(found["word_counts"], ref["word_shares"]))
    lacking = lacking_limit(F.col("__key"), ref["word_shares"], found["n_words"]).alias("__lacking")
    measured = counted.join(F.broadcast(references), "__key", "left").select(
        *carried, *[found[n].alias(n) for n in COUNTS], failed.alias("base_failed"), chars.alias("char_distance"), words.alias("word_distance"), lacking
    )
    far = F.coalesce(F.col("char_distance") > MAX_CHAR_DISTANCE, F.lit(False)) | F.coalesce(F.col("word_distance") > MAX_WORD_DISTANCE, F.lit(False))
    far = far | F.coalesce(F.col("word_distance") > F.col("__lacking"), F.lit(False))
    return measured.withColumn("kept", ~(F.col("base_failed") | far)).drop("__lacking")
