"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from particlelake.llm import (
    best_fit_packing,
    common,
    pq_neighbors,
    quality_divergence,
    queries,
    simhash_ball,
    source_schedule,
    substring_dedup,
    subword_lattice,
    token_files,
    url_templates,
    warc_dictionary,
)
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, signature int, kept string, start int"


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    words = ["".join(draw.choice(["an", "the", "ti", "on", "é", "ß"]) for _ in range(draw.randint(1, 4))) for _ in range(300)]
    text = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage, long_text = text(60), text(30_000)
    texts = {
        1: text(80) + " " + passage, 2: passage + "\n" + text(70), 3: "", 4: None, 5: " \t\n ", 6: long_text, 7: long_text,
        8: "word " * 300, 9: "one", 10: text(49), 11: text(50), 12: "Ünï ☃ 𝄞 <|endoftext|> it's 's 1999!!", 13: passage.upper(), 14: "|" * 30,
        15: text(2100), 16: text(120) + "\x1c" + text(30) + "\xa0x",
    }
    return {i: (i, t, ["en", "de", None, "xx"][i % 4], [None, "b", "a", ""][i % 4], 0, "x", 1, "no", 2) for i, t in texts.items()}


@pytest.fixture(scope="module")
def docs(spark, rows):
    """Every row, row 2 three times, and two rows without id."""
    extra = [rows[2], rows[2], (None, *rows[1][1:]), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame([*rows.values(), *extra], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(rows):
    return {i: r[1] for i, r in rows.items()}


def test_simhash_edges(docs, nothing, rows):
    found = simhash_ball.near_duplicates(docs, words=3).collect()
    wanted = brute.simhash(texts_of(rows))
    assert len(found) == len(rows) + 4
    named = [r for r in found if r["doc_id"] is not None]
    assert all((r["fingerprint"], r["component_id"]) == wanted[r["doc_id"]] for r in named)
    nameless = sorted((r["fingerprint"], r["component_id"]) for r in found if r["doc_id"] is None)
    assert nameless == sorted([wanted[1], wanted[4]])
    assert simhash_ball.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_balls_find_every_link(spark, radius):
    draw = random.Random(radius)
    centres = [draw.getrandbits(64) for _ in range(12)]
    prints = {c ^ sum(1 << b for b in draw.sample(range(64), draw.randint(0, 5))) for c in centres for _ in range(25)}
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    links = simhash_ball.ball_links(spark.createDataFrame([(p,) for p in signed], "fingerprint long"), radius).collect()
    far = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert all(far(r["a"], r["b"]) <= radius for r in links)
    every = [(a, b) for a in signed for b in signed if a < b and far(a, b) <= radius]
    assert brute.components(signed, [(r["a"], r["b"]) for r in links]) == brute.components(signed, every)


@pytest.mark.parametrize("hot_windows", [substring_dedup.HOT_WINDOWS, 60, 0])
def test_substring_edges(docs, rows, hot_windows):
    found = substring_dedup.remove_repeats(docs, hot_windows=hot_windows).collect()
    wanted = brute.repeats(texts_of(rows))
    assert len(found) == len(rows) + 4
    for r in found:
        assert set(docs.columns) <= set(r.asDict())
        total, removed, _ = wanted[r["doc_id"] if r["doc_id"] is not None else 1 if r["text"] else 4]
        assert r["n_words"] == total and r["n_removed"] == (removed if r["doc_id"] is not None else 0)
        assert r["n_removed"] == sum(s["last"] - s["first"] for s in r["spans"])
        assert len(r["kept_text"].encode().split()) == total - r["n_removed"]
    assert {r["doc_id"] for r in found if r["n_removed"]} == {2, 7}


def test_substring_small_filter(docs, nothing):
    full = sorted(map(str, substring_dedup.remove_repeats(docs).drop("spans").collect()))
    assert full == sorted(map(str, substring_dedup.remove_repeats(docs, filter_bits=1 << 15).drop("spans").collect()))
    assert substring_dedup.remove_repeats(nothing).count() == 0


@pytest.mark.parametrize("planes", token_files.PLANES)
def test_token_files(spark, docs, nothing, rows, planes):
    found = token_files.token_id_files(docs, queries.WORD_TOKENIZER, planes=planes, block_ids=1000).collect()
    texts = texts_of(rows)
    encoded = dict(zip(texts, brute.token_ids(texts.values(), queries.WORD_TOKENIZER)))
    order = sorted(found, key=lambda r: r["start"])
    assert [r["doc_id"] for r in order] == [None, None, 1, 2, 2, 2, *range(3, 17)]
    start = 0
    for r in order:
        if r["doc_id"] is not None:
            assert r["ids"] == common_bytes([*encoded[r["doc_id"]], 1])
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) // 4
        start += r["n_tokens"]
    assert token_files.token_id_files(nothing, queries.WORD_TOKENIZER).count() == 0


def common_bytes(ids):
    return b"".join(i.to_bytes(4, "little") for i in ids)


@pytest.mark.parametrize("planes", token_files.PLANES)
@pytest.mark.parametrize("ids", [[], [0], [0, 0, 0], [2**32 - 1, 0, 7], list(range(70_000))])
def test_planes_round_trip(planes, ids):
    import numpy as np

    block = np.array(ids, "<u4")
    assert token_files.from_planes(token_files.to_planes(block, planes), len(ids), planes).tolist() == ids


def test_packing_edges(docs, nothing, rows):
    packed = best_fit_packing.pack_documents(docs, queries.WORD_TOKENIZER, with_ids=True, group_pieces=7).collect()
    texts = texts_of(rows)
    encoded = dict(zip(texts, brute.token_ids(texts.values(), queries.WORD_TOKENIZER)))
    whole = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert whole == Counter({**dict.fromkeys(texts, 1), 2: 3, None: 2})
    for i in texts:
        ids = b"".join(dict.fromkeys(r["ids"] for r in sorted((r for r in packed if r["doc_id"] == i), key=lambda r: r["piece"])))
        assert ids == common_bytes([*encoded[i], 0])
    used = Counter()
    for r in sorted(packed, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == used[r["sequence_id"]]
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048
    assert best_fit_packing.pack_documents(nothing, queries.WORD_TOKENIZER).count() == 0


def test_best_fit_matches_plain():
    import numpy as np

    draw = random.Random(3)
    lengths = sorted((draw.randint(1, 2048) for _ in range(3000)), reverse=True)
    bins, offsets = best_fit_packing.best_fit_decreasing(np.array(lengths), 2048)
    assert len(set(bins.tolist())) == brute.best_fit(lengths, 2048)


def test_lattice_is_the_sum_of_segmentations():
    import numpy as np

    vocab = subword_lattice.vocabulary(queries.PIECES)
    weights = vocab.first_weights

    def plain(text):
        if not text:
            return 1.0
        total = 0.0
        for k in range(1, len(text) + 1):
            if text[:k] in vocab.lattice:
                total += np.exp(weights[vocab.lattice[text[:k]]]) * plain(text[k:])
        if text[:1] not in vocab.lattice:
            total += np.exp(sum(weights[vocab.bytes[b]] for b in text[0].encode())) * plain(text[1:])
        return total

    words = ["the", "a", "nation", "été", "𝄞x", "tionthe"]
    lattices = subword_lattice.Lattices(words, vocab)
    assert lattices.log_likelihoods(weights) == pytest.approx([np.log(plain("▁" + w)) for w in words])
    uses = lattices.expected_counts(weights, np.ones(len(words)))
    assert uses.sum() > len(words) and (uses >= 0).all()


def test_lattice_edges(docs, nothing, rows):
    found = subword_lattice.lattice_scores(docs, queries.PIECES, frequent=8).collect()
    assert Counter(r["doc_id"] for r in found) == Counter({**dict.fromkeys(rows, 1), 2: 3, None: 2})
    again = {r["doc_id"]: r for r in subword_lattice.lattice_scores(docs, queries.PIECES).collect()}
    for r in found:
        if r["doc_id"] is not None:
            other = again[r["doc_id"]]
            assert r["n_tokens"] == len((rows[r["doc_id"]][1] or "").encode().split()) + 1
            assert (r["n_known"], r["train_tokens"]) == (other["n_known"], other["train_tokens"])
            assert r["base_score"] == pytest.approx(other["base_score"]) and r["score"] == pytest.approx(other["score"])
    assert subword_lattice.lattice_scores(nothing, queries.PIECES).count() == 0


def test_lattices_are_built_once_per_word(spark):
    rows = spark.createDataFrame([("a b a", False), ("B c", False), ("c d d", True), ("d é", True), (None, False)], "text string, held_out boolean")
    counts = subword_lattice.word_counts(rows.repartition(5))
    weights = subword_lattice.vocabulary(queries.PIECES).first_weights
    scored = subword_lattice.word_likelihoods(counts, queries.PIECES, weights).collect()
    assert Counter((r["word"], r["n"]) for r in scored) == Counter([("a", 2), ("b", 2), ("c", 1), ("d", 0), ("é", 0)])
    values = subword_lattice.Lattices([r["word"] for r in scored], subword_lattice.vocabulary(queries.PIECES)).log_likelihoods(weights)
    assert [r["likely"] for r in scored] == pytest.approx(list(values / np.log(10)))


def test_mix_edges(docs, nothing, rows):
    found = source_schedule.taken_words(docs, block=16).collect()
    assert Counter(r["doc_id"] for r in found) == Counter({**dict.fromkeys(rows, 1), 2: 3, None: 2})
    assert all(r["taken"] <= 3 * r["size"] for r in found)
    total = sum(r["size"] for r in found)
    assert abs(sum(r["taken"] for r in found) - total) <= 4 * 16 * 4
    mixed = source_schedule.mixed_texts(docs, block=16)
    assert mixed.columns == docs.columns
    words = sum(len(r["text"].encode().split()) for r in mixed.collect())
    assert words == sum(r["taken"] for r in found)
    assert source_schedule.taken_words(nothing).count() == 0 and source_schedule.mixed_texts(nothing).count() == 0


def test_targets_match_resharing(spark):
    draw = random.Random(11)
    for n in (1, 2, 5, 30):
        sizes = {f"s{k:02d}": draw.choice([0, 1, 10, 1000, 10**6]) for k in range(n)} | {None: 5}
        rows = source_schedule.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        wanted = brute.targets(sizes)
        assert {r["source"]: r["target"] for r in rows} == pytest.approx(wanted)


def test_golden_points_stay_exact(spark):
    slots = [0, 1, 2, 10**6, 10**9 + 7, 10**11 + 3]
    found = spark.createDataFrame([(s,) for s in slots], "slot long").select(source_schedule.golden_point(common.F.col("slot"))).collect()
    assert [r[0] for r in found] == pytest.approx([float((s + 1) * source_schedule.GOLDEN % 1) for s in slots], abs=1e-9)


def test_warc_edges(spark):
    page = "<p>" + "long page " * 200 + "</p>"
    rows = [(1, "http://a/b c", page), (2, None, page), (3, "http://é/\r\n", ""), (4, "u", None), (5, "u", "é" * 499), (6, "u", "é" * 499),
            (7, "u", "x" * 1000), (7, "u", "x" * 1000), (None, "u", page), (9, "u", "x" * 1000), (10, "u", "a\r\n\r\nb")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    found = warc_dictionary.warc_round_trip(pages).collect()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found)
    assert kinds == Counter({
        (1, "revisit", 2, len(page)): 1, (2, "response", None, len(page)): 1, (None, "revisit", 2, len(page)): 1, (3, "response", None, 0): 1,
        (4, "response", None, 0): 1, (5, "response", None, 998): 1, (6, "response", None, 998): 1, (7, "revisit", 9, 1000): 2,
        (9, "response", None, 1000): 1, (10, "response", None, 6): 1,
    })
    assert {r["payload"] for r in found if r["page_id"] == 10} == {b"a\r\n\r\nb"}
    assert warc_dictionary.warc_round_trip(pages.limit(0)).count() == 0


def test_warc_dictionary_is_in_front():
    import io

    records = [warc_dictionary.warc_record(i, f"http://h/{i}", b"<p>same words</p>" * (i % 9 + 1) + str(i * i).encode(), None, "d") for i in range(400)]
    sink = io.BytesIO()
    assert warc_dictionary.write_archive(sink, iter(records), sample_bytes=50_000) == 400
    assert sink.getvalue()[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc_dictionary.read_archive(io.BytesIO(sink.getvalue()), chunk=777)) == records
    assert len(sink.getvalue()) < sum(map(len, records)) / 3


def test_url_edges(spark):
    urls = {1: "HTTP://A.Example.NET/En/", 2: "http://x.example.net/en/1", 3: "http://example.com/de/x?/de/", 4: "http://net/", 5: "http://net",
            6: None, 7: "no scheme/net/", 8: "http://b.org/fr/../#f", 9: "http://", 10: "x://h?q://z/", 11: "http://h/" + "a/" * 5000}
    pages = spark.createDataFrame([*[(i, u, "c") for i, u in urls.items()], (2, urls[2], "c"), (None, urls[2], "c")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(10, True), (10, None), (99, True), (None, True)], "page_id long, bad boolean")
    found = url_templates.url_verdicts(pages, queries.URL_RULES, labels).collect()
    assert Counter(r["page_id"] for r in found) == Counter({**dict.fromkeys(urls, 1), 2: 2, None: 1})
    for r in found:
        host, path = brute.url_parts(urls[r["page_id"] or 2])
        rule, verdict = brute.rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and verdict in (None, r["verdict"])
    assert url_templates.url_verdicts(pages.limit(0), queries.URL_RULES, labels.limit(0)).count() == 0


def test_bad_templates_are_blocked(spark):
    rows = [(i, f"http://h.example/{'shop' if i % 2 else 'news'}/{i}.html") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, bool(i % 2)) for i in range(0, 200)], "page_id long, bad boolean")
    found = url_templates.url_verdicts(pages, (), labels).collect()
    assert {(r["page_id"] % 2, r["verdict"]) for r in found} == {(0, "allow"), (1, "block")}
    assert {r["template"] for r in found} == {"/shop/#.html", "/news/#.html"}


def test_quality_edges(docs, nothing, rows):
    found = quality_divergence.quality_verdicts(docs).collect()
    assert len(found) == len(rows) + 4
    for r in found:
        own = rows[r["doc_id"]][1] if r["doc_id"] is not None else r["text"]
        assert tuple(r[c] for c in (*quality_divergence.COUNTS, "base_failed")) == brute.quality_counts(own)
    assert quality_divergence.quality_verdicts(nothing).count() == 0


def test_jensen_shannon(spark):
    import math

    f = common.F
    row = spark.range(1).select(
        quality_divergence.jensen_shannon(f.array(f.lit(3), f.lit(1)), f.array(f.lit(0.25), f.lit(0.75))).alias("a"),
        quality_divergence.jensen_shannon(f.array(f.lit(5), f.lit(0)), f.array(f.lit(0.0), f.lit(1.0))).alias("b"),
        quality_divergence.jensen_shannon(f.array(f.lit(0), f.lit(0)), f.array(f.lit(0.5), f.lit(0.5))).alias("c"),
    ).first()
    p, q = (0.75, 0.25), (0.25, 0.75)
    wanted = math.sqrt(sum(x * math.log2(x / ((x + y) / 2)) / 2 + y * math.log2(y / ((x + y) / 2)) / 2 for x, y in zip(p, q)))
    assert row["a"] == pytest.approx(wanted) and row["b"] == pytest.approx(1.0) and row["c"] is None


def test_embedding_edges(spark):
    draw = random.Random(2)
    vectors = {i: [draw.gauss(0, 1) for _ in range(12)] for i in range(1, 60)}
    for i in range(60, 90):
        vectors[i] = [x + draw.gauss(0, 0.1) for x in vectors[i % 5 + 1]]
    vectors |= {90: vectors[1], 91: [2 * x for x in vectors[1]], 92: None, 93: [], 94: [0.0] * 12, 95: [None, 1.0], 96: [float("nan")] * 3, 97: [float("inf"), 1.0],
                98: [1e-200, 1e-200], 99: [1e-200, 1.1e-200]}
    rows = [(i, v, "x") for i, v in vectors.items()]
    table = spark.createDataFrame([*rows, (None, vectors[2], "x")], "vec_id long, embedding array<double>, rep string")
    found = {r["vec_id"]: r for r in pq_neighbors.near_embeddings(table, list_rows=16, block_rows=8, sample_rows=64).collect()}
    wanted = brute.cosine_links({**vectors, 98: [1.0, 1.0], 99: [1.0, 1.1], 1000: vectors[2]})
    for i in vectors:
        assert (found[i]["n_links"], found[i]["component_id"]) == wanted[i], i
    assert found[None]["n_links"] == wanted[1000][0] and not found[None]["kept"]
    assert pq_neighbors.near_embeddings(table.limit(0)).count() == 0
