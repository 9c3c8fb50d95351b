"""Pivotal grams beside all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from particlelake.llm import queries
from particlelake.llm import spelling_variants as spelling
from tests.conftest import SMALL


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def plain_variants(counts):
    """{word: (n, n_near, form, form_n, root)}: pairs of words that are alike but for one place."""
    cut = {}
    for w in counts:
        for k in range(len(w)):
            cut.setdefault(w[:k] + w[k + 1:], set()).add(w)
        cut.setdefault(w, set()).add(w)
    near = {w: {x for k in [*range(len(w)), None] for x in cut[w if k is None else w[:k] + w[k + 1:]] if one_edit(w, x)} for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (counts[w], len(near[w]), form[w], counts.get(form[w]), root)
    return out


def document_counts(docs):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def found(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


def test_query_as_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert found(queries.op13_pivotal_grams(spark, SMALL)) == plain_variants(document_counts(docs))


def words_over(draw, letters, n):
    out = {}
    while len(out) < n:
        word = "".join(draw.choices(letters, k=draw.randrange(4, 9)))
        out[word] = draw.randrange(3, 50)
        for _ in range(draw.randrange(4)):
            k = draw.randrange(len(word))
            edited = draw.choice([word[:k] + word[k + 1:], word[:k] + draw.choice(letters) + word[k + 1:], word[:k] + draw.choice(letters) + word[k:]])
            if len(edited) >= 4:
                out[edited] = draw.randrange(3, 200)
    return out


@pytest.mark.parametrize("letters", ["ab", "abc", "aeiouéß", "àÿ×z"])
def test_few_letters_as_plain(spark, letters):
    counts = words_over(random.Random(len(letters)), letters, 150)
    counts["x" * 3_000] = 3
    counts["x" * 2_999 + "y"] = 9
    rows = [(w, n) for w, n in counts.items()]
    df = spark.createDataFrame([(w, n - 1, "k") for w, n in rows] + [(w, 1, "k") for w, _ in rows] + [(None, 5, None)], "word string, n long, near string")
    assert found(spelling.spelling_variants(df.repartition(3))) == plain_variants(counts)


def test_pivots_are_cheap_and_apart():
    draw = random.Random(4)
    for _ in range(500):
        word = "".join(draw.choices("abcd", k=draw.randrange(4, 12)))
        counts = np.array([draw.randrange(5) for _ in range(spelling.COUNTERS)])
        prefix = spelling.gram_prefix(word, counts)
        cost = lambda k: counts[spelling._bucket(word[k: k + 2])]
        a, b = spelling.pivots(word, prefix, counts)
        assert b - a >= 2 and {a, b} <= set(prefix)
        assert cost(a) + cost(b) == min(cost(x) + cost(y) for x in prefix for y in prefix if y - x >= 2)


def test_texts_with_holes(spark):
    rows = [(None, "Hello hello HELLO"), (1, None), (1, ""), (2, "ÉTÉÉÉ étééé ÀÀÀÀÀ 12345 a-b"), (2, "ÉTÉÉÉ étééé ÀÀÀÀÀ 12345 a-b"), (3, "ÉTÉÉÉ " * 400 + "z" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    assert found(spelling.document_variants(df)) == plain_variants(document_counts(rows))
    assert spelling.document_variants(df.limit(0)).count() == 0


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError):
        spelling.spelling_variants(spark.createDataFrame([("abc", 3)], "word string, n long"))


def test_one_common_word_does_not_multiply(spark):
    """A hub with thousands of near words yields a link to each, not all their pairs."""
    letters = [chr(c) for c in range(0x61, 0x7b)]
    hub = "qwertzuiopas"
    spokes = {hub[:k] + c + hub[k + j:] for k in range(len(hub)) for c in letters for j in (0, 1)} - {hub}
    rows = [(hub, 10_000), *((w, 3) for w in spokes)]
    got = found(spelling.spelling_variants(spark.createDataFrame(rows, "word string, n long")))
    assert got == plain_variants(dict(rows)) and got[hub][1] == len(spokes)
