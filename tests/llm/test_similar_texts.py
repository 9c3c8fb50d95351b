"""The near-dedup stage beside brute-force Jaccard of five-word shingles."""

from __future__ import annotations

import random
from collections import Counter

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from particlelake.llm import similar_texts
from particlelake.llm.common import Scratch, filesystem
from tests.conftest import SMALL
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text, width=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[k: k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def similar_groups(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]
    return brute.components(ids, links)


def kept_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    return Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.simhash_dedup(spark, docs, SMALL).collect())


def test_edited_copies_as_brute_force(spark):
    draw, docs = random.Random(3), {}
    for base in range(25):
        words = [f"w{draw.randrange(5_000)}" for _ in range(draw.choice((40, 150, 400)))]
        docs[len(docs)] = " ".join(words)
        for edits in (0.01, 0.02, 0.03, 0.05):  # similarity from about 0.9 to 0.6; later copies build on former ones
            words = [f"x{draw.randrange(5_000)}" if draw.random() < edits else w for w in words]
            docs[len(docs)] = " ".join(words)
    groups = similar_groups(docs)
    alone = {i for i in docs if groups[i] == i}
    assert 25 < len(alone) < len(docs) - 25
    assert kept_rows(spark, docs.items()) == Counter((i, docs[i]) for i in alone)


def test_given_documents_as_brute_force(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    groups = similar_groups(docs)
    empty = [i for i in docs if not (docs[i] or "").split()]
    assert not empty
    out = corpus_pipeline.simhash_dedup(spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL)
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(i for i in docs if groups[i] == i)


def test_null_and_repeated_ids(spark):
    one, two, three = (" ".join(f"{c}{k}" for k in range(60)) for c in "abc")
    rows = [(None, one), (None, one), (5, two), (5, two), (5, three), (6, three), (None, two), (7, None), (None, None)]
    assert kept_rows(spark, rows) == Counter({(None, one): 1, (5, two): 1, (5, three): 1, (7, None): 1})


def copies_of_one_text(copies, seed=9):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5_000)}" for _ in range(300)]
    out = []
    for _ in range(copies):
        words = list(base)
        for k in draw.sample(range(300), 3):
            words[k] = f"x{draw.randrange(10**9)}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("copies", [200, 800])
def test_pairs_of_a_large_group_stay_linear(spark, monkeypatch, copies):
    """Every copy is compared with a few centres, however large its group is."""
    compared = []
    links = similar_texts._Comparer.links

    def counted(self, pairs):
        compared.append(pairs.count())
        return links(self, pairs)

    monkeypatch.setattr(similar_texts._Comparer, "links", counted)
    assert sum(kept_rows(spark, enumerate(copies_of_one_text(copies))).values()) == 1
    assert sum(compared) <= 13 * copies


def test_a_shared_passage_does_not_hide_links(spark):
    """Texts that share a long passage with all others, but are alike only in pairs."""
    draw, docs = random.Random(2), {}
    passage = [f"p{k}" for k in range(150)]
    for k in range(60):
        own = [f"w{draw.randrange(10**6)}" for _ in range(60)]
        docs[2 * k] = " ".join(passage + own)
        docs[2 * k + 1] = " ".join(passage + own[:-4] + ["z1", "z2", "z3", f"z{k}"])
    groups = similar_groups(docs)
    assert len(set(groups.values())) == 60
    assert kept_rows(spark, docs.items()) == Counter((i, docs[i]) for i in docs if groups[i] == i)


def linked(spark, docs, buckets, roots):
    """Links between the unlike texts of every bucket."""
    texts = spark.createDataFrame(list(enumerate(docs)), "node long, text string")
    rows = [(key, node, len(shingles(docs[node])), roots[node]) for key, nodes in enumerate(buckets) for node in nodes]
    members = spark.createDataFrame(rows, "key long, node long, size long, root long")
    return [(r["a"], r["b"]) for r in similar_texts.unlike_links(members, texts, 5, 0.8).collect()]


@pytest.mark.parametrize("block", [2048, 7])
def test_a_bucket_of_many_unlike_groups_loses_no_link(spark, monkeypatch, block):
    """Every pair of unlike texts of a bucket is compared, in one block or in many, and none of like ones."""
    monkeypatch.setattr(similar_texts, "BLOCK_TEXTS", block)
    draw, texts = random.Random(4), []
    passage = [f"p{k}" for k in range(40)]
    for _ in range(30):
        words = passage + [f"w{draw.randrange(10**6)}" for _ in range(draw.choice((30, 60, 90)))]
        texts += [" ".join(words), " ".join(words[:-4] + [f"x{draw.randrange(10**6)}" for _ in range(4)])]
    draw.shuffle(texts)
    sets = dict(enumerate(texts))
    roots = [k if k >= 20 else 0 for k in range(len(texts))]  # twenty texts are one group already
    pairs = linked(spark, texts, [range(60), range(10, 30)], roots)
    expected, group = similar_groups(sets), [(0, k) for k in range(20)]
    s = {k: shingles(t) for k, t in sets.items()}
    exact = [(a, b) for a in sets for b in sets if a < b and 5 * len(s[a] & s[b]) >= 4 * len(s[a] | s[b])]
    assert len(set(expected.values())) == 30
    assert brute.components(list(sets), pairs + group) == brute.components(list(sets), exact + group)
    assert all(roots[a] != roots[b] and tuple(sorted((a, b))) in exact for a, b in pairs)


def test_a_link_in_one_bucket_of_many_groups_is_kept(spark):
    """One shared fingerprint only, in a bucket of more unlike groups than any number of centres."""
    draw, docs = random.Random(6), {}
    for k in range(40):
        words = [f"w{draw.randrange(10**6)}" for _ in range(60)]
        docs[2 * k] = " ".join(words)
        docs[2 * k + 1] = " ".join(words[:-3] + [f"x{draw.randrange(10**6)}" for _ in range(3)])
    nodes = []
    for k, text in docs.items():
        hashes = similar_texts.distinct_hashes(list(similar_texts.shingle_hashes(text.encode(), 5)))
        nodes.append((k, k, k, len(hashes), draw.getrandbits(62), [7, 1000 * k]))
    nodes = spark.createDataFrame(nodes, "node long, __s1 long, __s2 long, size long, fingerprint long, parts array<bigint>")
    texts = spark.createDataFrame([(k, k, t) for k, t in docs.items()], "__s1 long, __s2 long, text string")
    with Scratch(spark) as scratch:
        links = similar_texts.similar_links(nodes, texts, 5, 0.8, scratch).collect()
    assert brute.components(list(docs), [(r["a"], r["b"]) for r in links]) == similar_groups(docs)


def test_texts_of_chained_fingerprints_are_compared(spark):
    """Two texts whose fingerprints are near, neither of them the smallest text of its fingerprint."""
    draw = random.Random(8)
    one, two, three = ([f"{c}{draw.randrange(10**6)}" for _ in range(60)] for c in "abc")
    docs = [" ".join(x) for x in (one, two, three, three[:-3] + ["z1", "z2", "z3"])]
    rows = [(k, k, k, 56, 12 if k == 3 or k == 1 else 13, [1000 * k + 5]) for k in range(4)]  # 0 and 2 share one, 1 and 3 another
    nodes = spark.createDataFrame(rows, "node long, __s1 long, __s2 long, size long, fingerprint long, parts array<bigint>")
    texts = spark.createDataFrame([(k, k, t) for k, t in enumerate(docs)], "__s1 long, __s2 long, text string")
    with Scratch(spark) as scratch:
        links = similar_texts.similar_links(nodes, texts, 5, 0.8, scratch).collect()
    assert {tuple(sorted((r["a"], r["b"]))) for r in links} == {(2, 3)}


def test_clashing_columns_and_long_texts(spark):
    long = " ".join(f"w{k * k % 100_003}" for k in range(60_000))
    rows = [(1, long), (2, long + " end"), (3, "x" * 1_000_000), (4, "x" * 1_000_000), (5, "short one"), (6, "short one"), (7, "SHORT\tone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("node", F.lit("clash")).withColumn("__s1", F.lit(1)).withColumn("key", F.array(F.lit(1))).withColumn("size", F.create_map(F.lit(1), F.lit(2)))
    out = similar_texts.first_of_similar(docs.repartition(3))
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 5]


def test_scratch_folders_go(spark):
    with Scratch(spark) as scratch:
        table = scratch.stored(spark.range(5), "test")
        assert table.count() == 5
        folder = next(iter(scratch.folders))
    fs, path = filesystem(folder)
    assert fs.get_file_info(path).type == pafs.FileType.NotFound
