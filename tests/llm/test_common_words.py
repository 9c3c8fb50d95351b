"""The common-word rule on texts without common words."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from particlelake.llm import quality_divergence as quality
from tests.conftest import SMALL
from tests.llm import brute


def texts(spark, lang, clean, junk):
    draw = random.Random(2)
    common = quality.COMMON_WORDS["en"]

    def text(share):
        other = lambda: "".join(draw.choice("abcdefghijklmnoprstuvw") for _ in range(draw.randrange(3, 9)))
        return " ".join(draw.choice(common) if draw.random() < share else other() for _ in range(120))

    rows = [(i, text(0.25 if i < clean else 0.0), lang) for i in range(clean + junk)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def kept(docs):
    return {r["doc_id"] for r in quality.quality_verdicts(docs).where("kept").collect()}


def test_texts_without_common_words_go(spark):
    assert kept(texts(spark, "en", 80, 8)) == set(range(80))


@pytest.mark.parametrize("lang", ["fi", None])
def test_languages_without_list_stay(spark, lang):
    assert kept(texts(spark, lang, 0, 60)) == set(range(60))


def french(draw, words=300):
    common = quality.COMMON_WORDS["fr"]
    other = lambda: "".join(draw.choice("abcdefghijlmnopqrstuvxyzéè") for _ in range(draw.randrange(3, 9)))
    return " ".join(draw.choice(common) if draw.random() < 0.3 else other() for _ in range(words))


@pytest.mark.parametrize("beside", [5, 15, 100])
def test_verdicts_do_not_wait_for_a_size(spark, beside):
    """150 invented words are no French beside few French texts as beside many; the others stay."""
    draw = random.Random(4)
    invented = " ".join("".join(draw.choice("abcdefghijlmnopqrst") for _ in range(6)) for _ in range(150))
    rows = [(i, french(draw), "fr") for i in range(beside)] + [(1_000, invented, "fr")]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string, lang string")) == set(range(beside))


def distance(counts, shares):
    total = sum(counts)
    if not total or shares is None:
        return None
    part = lambda a, m: a * math.log2(a / m) if a > 0 else 0.0
    return math.sqrt(max(0.0, sum((part(c / total, (c / total + s) / 2) + part(s, (c / total + s) / 2)) / 2 for c, s in zip(counts, shares))))


def plain_kept(docs):
    """The whole rule on (text, lang) pairs: counts, references of the texts that pass the base rules, limits."""
    union = list(dict.fromkeys(w for ws in quality.COMMON_WORDS.values() for w in ws))
    rows = []
    for text, lang in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        key = (lang or "").lower().split("-")[0]
        common = quality.COMMON_WORDS.get(key, union)
        key = key if key in quality.COMMON_WORDS else "*"
        found = Counter(words)
        of_words = [found[w] for w in common]
        chars = sum(map(len, words))
        counted = [len(re.findall(c, text or "")) for c in ("[A-Z]", "[0-9]", "[.,;:!?'\"()\\-]", "[#*$%&|<>]")]
        counted.append(len((text or "").encode()) - len(text or ""))
        classes = [*counted, max(0, chars - sum(counted))]
        rows.append((key, len(words), chars, [*of_words, len(words) - sum(of_words)], classes, brute.quality_counts(text)[-1]))

    def reference(place):
        sums, pooled = {}, Counter()
        for row in rows:
            if not row[5]:
                sums[row[0]] = [a + b for a, b in zip(sums.get(row[0], [0] * len(row[place])), row[place])]
        for counts in sums.values():
            for k, n in enumerate(counts):
                pooled[-1 if k == len(counts) - 1 else k] += n
        out = {}
        for key, counts in sums.items():
            prior = [pooled[-1 if k == len(counts) - 1 else k] for k in range(len(counts))]
            if sum(prior):
                out[key] = [(n + 1_000 * p / sum(prior)) / (sum(counts) + 1_000) for n, p in zip(counts, prior)]
        return out

    word_shares, class_shares = reference(3), reference(4)
    verdicts = []
    for key, n, chars, of_words, classes, failed in rows:
        far = chars >= 200 and (distance(classes, class_shares.get(key)) or 0) > 0.33
        shares = word_shares.get(key)
        gap = distance(of_words, shares) if n >= 50 else None
        lacking = None
        if key != "*" and shares and n * (1 - shares[-1]) >= 5:
            lacking = 0.93 * distance([0] * (len(shares) - 1) + [1], shares)
        far = far or (gap is not None and (gap > 0.42 or (lacking is not None and gap > lacking)))
        verdicts.append(not (failed or far))
    return verdicts


def test_given_documents_as_plain(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in table.collect()]
    docs += [(10_000, "kurz", "de"), (10_001, None, None), (10_002, "x " * 60, "xx"), (10_003, "ABC DEF " * 40 + " ".join(map(str, range(90))), "en")]
    found = kept(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert found == {i for (i, *_), ok in zip(docs, plain_kept([d[1:] for d in docs])) if ok}
