"""Url templates below the fourth segment."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from particlelake.llm import quality_divergence, queries, url_templates
from tests.conftest import SMALL
from tests.llm import brute


def word(draw):
    return "".join(draw.choice("abcdefghij") for _ in range(8))


def verdicts(spark, paths, bad):
    pages = spark.createDataFrame([(i, f"http://h.org{p}") for i, p in enumerate(paths)], "page_id long, url string")
    labels = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "page_id long, bad boolean")
    return {r["page_id"]: r for r in url_templates.url_verdicts(pages, (), labels).collect()}


def test_deciding_segment_is_deep(spark):
    draw = random.Random(1)
    for deep in ("/blog/2024/05/12", "/a/b/c/d/e/f/g"):
        paths = [f"{deep}/{kind}/{word(draw)}" for kind in ("casino", "news") for _ in range(30)]
        found = verdicts(spark, paths, [k < 30 for k in range(60)])
        assert {found[i]["verdict"] for i in range(30)} == {"block"}
        assert {found[i]["verdict"] for i in range(30, 60)} == {"allow"}


def test_single_and_rare_paths_end_early(spark):
    single, rare = "/" + "/".join("abcdefghijkl"), "/" + "/".join("mnopqrstuvwx")
    found = verdicts(spark, [single] * 5, [False] * 5)
    assert {r["template"] for r in found.values()} == {single}
    found = verdicts(spark, [single] * 5 + [rare], [False] * 6)
    assert found[0]["template"] == found[5]["template"] == "/*" * 12
    found = verdicts(spark, [single, rare], [False] * 2)
    assert found[0]["template"] == found[1]["template"] == "/*" * 12


def test_a_long_chain_is_one_step(spark):
    """Two thousand shared segments above the deciding one take no round each."""
    draw = random.Random(2)
    deep = "".join(f"/s{k % 7}x" for k in range(2_000))
    paths = [f"{deep}/{kind}/{word(draw)}" for kind in ("casino", "news") for _ in range(30)]
    found = verdicts(spark, paths, [k < 30 for k in range(60)])
    assert [found[i]["verdict"] for i in range(60)] == ["block"] * 30 + ["allow"] * 30


def plain_templates(paths, min_urls=5):
    """{(host, shape): template} of {(host, shape): (urls, labelled, bad)}, node by node."""
    out = {}

    def differs(b, m, rest_b, rest_m):
        if not m or not rest_m:
            return False
        pooled = (b + rest_b) / (m + rest_m)
        spread = (pooled * (1 - pooled) * (1 / m + 1 / rest_m)) ** 0.5
        return spread > 0 and abs(b / m - rest_b / rest_m) >= 1.96 * spread

    def grow(host, template, members):
        """``members``: (shape, rest, counts) below one node."""
        for shape, rest, _ in members:
            if not rest:
                out[host, shape] = template
        members = [m for m in members if m[1]]
        urls = sum(c[0] for _, _, c in members)
        if not members:
            return
        if urls < min_urls or len(members) == 1:
            for shape, rest, _ in members:
                own = ["*"] * len(rest) if urls < min_urls else rest
                out[host, shape] = template + "/" + "/".join(own)
            return
        branches, total = defaultdict(list), [sum(c[k] for _, _, c in members) for k in range(3)]
        for m in members:
            branches[m[1][0]].append(m)
        below = defaultdict(list)
        for segment, own in branches.items():
            n = [sum(c[k] for _, _, c in own) for k in range(3)]
            literal = n[0] >= min_urls and (len(branches) == 1 or differs(n[2], n[1], total[2] - n[2], total[1] - n[1]))
            below[segment if literal else "*"] += [(shape, rest[1:], c) for shape, rest, c in own]
        for segment, own in below.items():
            grow(host, f"{template}/{segment}", own)

    hosts = defaultdict(list)
    for (host, shape), counts in paths.items():
        hosts[host].append((shape, [s for s in shape.split("/") if s], counts))
    for host, members in hosts.items():
        grow(host, "", members)
    return out


def test_random_trees_as_plain(spark):
    draw, paths = random.Random(6), Counter()
    for host in ("a.org", "b.org"):
        for _ in range(400):
            depth = draw.choice((0, 1, 2, 3, 3, 4, 6))
            shape = "".join(f"/{draw.choice('pqrs') if k % 2 == 0 else draw.choice('xy') * (k + 1)}" for k in range(depth)) or "/"
            paths[host, shape] += draw.randrange(1, 4)
    rows = [(h, s, n, m := draw.randrange(n + 1), min(m, draw.randrange(m + 2)) if "p" in s else 0) for (h, s), n in paths.items()]
    got = url_templates.path_templates(spark.createDataFrame(rows, "host string, shape string, urls long, labelled long, bad long"))
    assert {(r["host"], r["shape"]): r["template"] for r in got.collect()} == plain_templates({(h, s): (n, m, b) for h, s, n, m, b in rows})


def test_labels_follow_rules_and_texts(spark):
    good = "the cat sat on the mat and it was good to be in the house of a friend for that day " * 2
    pages = [(1, "http://a.net/x", "<p>" + good), (2, "http://example.net/en/1", "x"), (3, "http://c.org/fr/1", None), (4, "http://d.com/1", f"<script>junk</script><p>{good}</p><!-- no -->"), (5, "http://d.com/2", "<b>buy</b>"), (None, "http://a.net/y", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    texts = df.select("page_id", url_templates.page_text(F.col("html")).alias("text"))
    assert "junk" not in texts.where("page_id = 4").first()["text"] and "<" not in texts.where("page_id = 4").first()["text"]
    kept = texts.select("page_id", F.coalesce(F.length("text") > 100, F.lit(False)).alias("kept"))
    labels = url_templates.page_labels(df, queries.URL_RULES, kept).collect()
    assert {r["page_id"]: r["bad"] for r in labels} == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_query_verdicts_follow_from_templates(spark):
    """Verdicts where no rule fits, recomputed from templates and labels of the given pages."""
    table = spark.read.parquet(f"{SMALL}/pages.parquet")
    texts = table.select("page_id", url_templates.page_text(F.col("html")).alias("text"), F.lit(None).cast("string").alias("lang"))
    kept = {r["page_id"]: r["kept"] for r in quality_divergence.quality_verdicts(texts, carry=["page_id"]).collect()}
    pages, labels, paths = {}, {}, {}
    for r in table.select("page_id", "url").collect():
        host, path = brute.url_parts(r["url"])
        rule, action = brute.rule_of(host, path)
        pages[r["page_id"]] = (host, re.sub("[0-9]+", "#", path), action)
        labels[r["page_id"]] = action == "block" if action else not kept[r["page_id"]]
    for i, (host, shape, _) in pages.items():
        n = paths.setdefault((host, shape), [0, 0, 0])
        paths[host, shape] = [n[0] + 1, n[1] + 1, n[2] + labels[i]]
    templates = plain_templates(paths)
    sums = defaultdict(lambda: [0, 0])
    for key, (_, m, b) in paths.items():
        sums[key[0], templates[key]][0] += b
        sums[key[0], templates[key]][1] += m
    prior = sum(labels.values()) / len(labels)
    for r in queries.op9_url_templates(spark, SMALL).collect():
        host, shape, action = pages[r["page_id"]]
        b, m = sums[host, templates[host, shape]]
        assert r["verdict"] == (action or ("block" if (b + 10 * prior) / (m + 10) >= 0.6 else "allow"))
