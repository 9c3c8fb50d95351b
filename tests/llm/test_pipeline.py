"""Every stage of the pipeline on what its predecessor kept, beside a plain version."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from particlelake.llm import queries
from particlelake.llm.common import stored
from tests.conftest import SMALL
from tests.llm import brute
from tests.llm.test_similar_texts import similar_groups


@pytest.fixture(scope="module")
def stages(spark):
    """The documents and the result of every stage."""
    docs = [spark.read.parquet(f"{SMALL}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(stored(stage(spark, docs[-1], SMALL), "test-stage"))
    return docs


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_are_those_of_documents(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality(stages):
    before, after = rows_of(stages[0]), rows_of(stages[1])
    assert all(after[i] == before[i] for i in after)
    assert not any(brute.quality_counts(r["text"])[-1] for r in after.values())
    gone = [before[i]["text"] for i in before.keys() - after.keys() if not brute.quality_counts(before[i]["text"])[-1]]
    symbols = [t for t in gone if sum(c in "#*$%&|<>" for c in t) > 0.02 * len(t) or t.upper() == t]
    assert len(symbols) == len(gone)


def test_near_duplicates(stages):
    before, after = rows_of(stages[1]), rows_of(stages[2])
    groups = similar_groups({i: r["text"] for i, r in before.items()})
    assert after == {i: r for i, r in before.items() if groups[i] == i}
    assert len(after) < len(before)


def test_repeats(stages):
    before, after = rows_of(stages[2]), rows_of(stages[3])
    wanted = brute.repeats({i: r["text"] for i, r in before.items()})
    assert before.keys() == after.keys()
    for i, r in after.items():
        words = b" ".join(r["text"].encode().split())
        assert hashlib.sha256(words).hexdigest() == wanted[i][2]
        assert r["n_chars"] == (len(r["text"]) if wanted[i][1] else before[i]["n_chars"])
        assert wanted[i][1] or r["text"] == before[i]["text"]


def test_mix(stages):
    before, after = rows_of(stages[3]), stages[4].collect()
    sizes, taken, times = Counter(), Counter(), defaultdict(list)
    for r in before.values():
        sizes[r["source"]] += len(r["text"].encode().split())
    for r in after:
        words = r["text"].encode().split()
        assert words == before[r["doc_id"]]["text"].encode().split()[: len(words)]
        taken[r["source"]] += len(words)
        times[r["doc_id"]].append(len(words))
    wanted = brute.targets(sizes)
    assert all(abs(taken[s] - wanted[s]) <= 4 * 64 for s in sizes)
    assert all(len(t) <= 3 for t in times.values())


def test_packing(stages):
    mixed, packed = stages[4].collect(), stages[5].collect()
    wanted = Counter()
    for r, ids in zip(mixed, brute.token_ids([r["text"] for r in mixed], queries.WORD_TOKENIZER)):
        ids = [*ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at: at + 2048]
            wanted[r["doc_id"], piece, at, len(part), brute.crc(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == wanted
    used = Counter()
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048 and len(used) == brute.best_fit([r["length"] for r in packed], 2048)


@pytest.mark.parametrize("place", range(5))
def test_stages_take_nothing(spark, place):
    nothing = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    assert corpus_pipeline.STAGES[place][1](spark, nothing, SMALL).count() == 0


@pytest.mark.parametrize("place", range(5))
def test_stages_take_nulls_and_repeats(spark, place):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(5)
    holes = spark.createDataFrame([(None, None, None, None, None), (7_000, None, None, None, None), (7_001, "", "", "", 0)], docs.schema)
    mixed = docs.unionByName(docs).unionByName(holes).unionByName(holes)
    out = corpus_pipeline.STAGES[place][1](spark, mixed, SMALL)
    found = Counter(r["doc_id"] for r in out.collect())
    originals = {r["doc_id"] for r in docs.collect()}
    if place in (2, 4):
        assert found[7_000] == found[7_001] == found[None] == 2 and all(found[i] >= 2 for i in originals)
    elif place == 1:
        assert found[None] == 0 and found[7_000] + found[7_001] == 2
    else:
        assert found[None] == found[7_000] == found[7_001] == 0 and originals >= found.keys()
