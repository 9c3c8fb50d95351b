"""Every registered training-data query beside a plain version on the smallest tables."""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pytest

from particlelake.llm import queries
from tests.conftest import SMALL
from tests.llm import brute


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def texts(docs):
    return {i: r["text"] for i, r in docs.items()}


def test_op1(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()}
    wanted = brute.cosine_links(vectors)
    rows = queries.op1_pq_near_embeddings(spark, SMALL).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows} == wanted
    assert len(rows) == len(vectors)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in rows)


def test_op2(spark, texts):
    rows = {r["doc_id"]: r for r in queries.op2_bit_plane_token_files(spark, SMALL).collect()}
    start = 0
    for i, ids in zip(sorted(texts), brute.token_ids([texts[i] for i in sorted(texts)], queries.WORD_TOKENIZER)):
        ids = [*ids, 1]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (start, len(ids), brute.crc(ids))
        start += len(ids)
    assert len(rows) == len(texts)


def test_op3(spark, texts):
    rows = queries.op3_simhash_ball(spark, SMALL).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == brute.simhash(texts)


def test_op4(spark, texts):
    rows = queries.op4_super_kmer_dedup(spark, SMALL).collect()
    found = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows}
    assert found == brute.repeats(texts)
    assert sum(n for _, n, _ in found.values()) > 0


def test_op5(spark, texts):
    wanted = brute.base_scores(texts)
    rows = {r["doc_id"]: r for r in queries.op5_subword_lattice(spark, SMALL).collect()}
    assert rows.keys() == wanted.keys()
    for i, r in rows.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == wanted[i][:4]
        assert r["base_score"] == pytest.approx(wanted[i][4], rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_op6(spark, docs):
    rows = queries.op6_golden_mix(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    size = {i: len((r["text"] or "").encode().split()) for i, r in docs.items()}
    sizes = Counter()
    for i, r in docs.items():
        sizes[r["source"]] += size[i]
    wanted, taken = brute.targets(sizes), Counter()
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == sizes[source]
        assert r["target"] == pytest.approx(wanted[source]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 4 * 64 for s in sizes)
    again = queries.op6_golden_mix(spark, SMALL).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_op7(spark, texts):
    rows = queries.op7_best_fit_packing(spark, SMALL).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for i, ids in zip(texts, brute.token_ids(texts.values(), queries.WORD_TOKENIZER)):
        ids, found = [*ids, 0], sorted(by_doc[i], key=lambda r: r["piece"])
        cuts = range(0, len(ids), 2048)
        assert [(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found] == [
            (k, at, len(ids[at: at + 2048]), brute.crc(ids[at: at + 2048])) for k, at in enumerate(cuts)
        ]
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) == brute.best_fit([r["length"] for r in rows], 2048)


def test_op8(spark):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    keeper = {h: max(i for i in pages if pages[i] == h) for h in pages.values() if len(h) >= 1000}
    rows = queries.op8_warc_dictionary(spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        html = pages[r["page_id"]]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(html), hashlib.sha1(html).hexdigest())
        other = keeper.get(html, r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if other == r["page_id"] else ("revisit", other))


def test_op9(spark):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    rows = queries.op9_url_templates(spark, SMALL).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        assert (r["host"], r["path"]) == brute.url_parts(pages[r["page_id"]])
        rule, verdict = brute.rule_of(r["host"], r["path"])
        assert r["rule"] == rule and r["verdict"] in ("allow", "block") and r["verdict"] == (verdict or r["verdict"])


def test_op10(spark, texts):
    rows = queries.op10_divergence_rules(spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:7] == brute.quality_counts(texts[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])
