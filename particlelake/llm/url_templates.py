"""URL verdicts from rules and from a tree of path templates per host.

A path is its segments with every run of digits generalised. Going down the tree of
a host, a segment stays literal if enough urls of its branch have it and its labelled
share of bad pages differs from its siblings'; branches that are rare or statistically
alike merge into a wildcard. A template is rejected if its smoothed share of bad
labelled pages reaches a limit. Distinct generalised paths are counted first, and the
tree is built on those counts, so a large host is many partial sums, never one task.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from particlelake.llm.common import Scratch, plain_names, stored

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_URLS = 5
#: Two-sided 95 % limit of the normal distribution.
DIFFERENT = 1.96
WILD = "*"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    none = url.isNull() | (at == 0)
    return (
        F.when(none, "").otherwise(F.translate(host, CAPITALS, SMALL)),
        F.when(none, "").otherwise(path),
    )


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its action; rules are (``host/path``, action)."""
    name = action = F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: len(r[0])):
        of_host, of_path = rule.split("/", 1)
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith("/" + of_path)
        name, action = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(action)
    return name, action


def _differs(bad: str, n: str, bad_all: str, n_all: str) -> Column:
    """Two-proportion z test of a branch against its siblings; no difference without labels."""
    b, m, rest_b, rest_m = (F.col(bad), F.col(n), F.col(bad_all) - F.col(bad), F.col(n_all) - F.col(n))
    pooled = F.try_divide(b + rest_b, m + rest_m)
    spread = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), m) + F.try_divide(F.lit(1.0), rest_m)))
    gap = F.abs(F.try_divide(b, m) - F.try_divide(rest_b, rest_m))
    return F.coalesce((spread > 0) & (gap >= DIFFERENT * spread), F.lit(False))


def path_templates(paths: DataFrame, min_urls: int = MIN_URLS) -> DataFrame:
    """(host, shape, template) of distinct ``paths(host, shape, urls, labelled, bad)``.

    A round decides the next branching of every node and is written before the next one
    reads it; what all paths of a node share is passed in one step, however deep, and paths
    that have ended leave the state. The tree grows until no branch is left to decide: below a
    node of one path everything is alone, and below one of fewer than ``min_urls`` urls
    everything is rare.
    """
    segments = F.filter(F.split("shape", "/"), lambda s: s != "")
    finished = []
    with Scratch(paths.sparkSession) as scratch:
        tree = scratch.stored(paths.withColumn("rest", segments).withColumn("template", F.lit("")), "tree")
        while True:
            finished.append(scratch.stored(tree.where(F.size("rest") == 0).select("host", "shape", "template"), "ended-paths"))
            going = tree.where(F.size("rest") > 0)
            if going.isEmpty():
                return stored(functools.reduce(DataFrame.unionByName, finished), "templates")
            nodes = going.groupBy("host", "template").agg(
                F.sum("labelled").alias("s_n"), F.sum("bad").alias("s_bad"), F.sum("urls").alias("s_urls"), F.count(F.lit(1)).alias("s_paths"),
                F.min("rest").alias("lo"), F.max("rest").alias("hi"),
            )
            common = F.array_position(F.zip_with("lo", "hi", lambda x, y: F.coalesce(x == y, F.lit(False))), False)
            depth = F.when(common == 0, F.size("lo")).otherwise(common - 1).cast("int")
            rare = F.col("s_urls") < min_urls
            alone = F.col("s_paths") == 1
            nodes = nodes.select(
                "host", "template", "s_n", "s_bad",
                F.when(rare, F.lit("wild")).when(alone, F.lit("whole")).when(depth > 0, F.lit("chain")).otherwise(F.lit("fork")).alias("step"), depth.alias("depth"),
            )
            nodes = scratch.stored(nodes, "nodes")
            placed = going.withColumn("segment", F.get("rest", F.lit(0)))
            forks = placed.join(nodes.where("step = 'fork'").select("host", "template"), ["host", "template"], "left_semi")
            branches = forks.groupBy("host", "template", "segment").agg(F.sum("urls").alias("b_urls"), F.sum("labelled").alias("b_n"), F.sum("bad").alias("b_bad"))
            literal = (F.col("b_urls") >= min_urls) & _differs("b_bad", "b_n", "s_bad", "s_n")
            branches = branches.join(nodes.select("host", "template", "s_n", "s_bad"), ["host", "template"]).select("host", "template", "segment", literal.alias("literal"))
            met = placed.join(nodes.select("host", "template", "step", "depth"), ["host", "template"]).join(branches, ["host", "template", "segment"], "left")
            step, rest = F.col("step"), F.col("rest")
            taken = F.when(step == "chain", F.col("depth")).when(step == "fork", 1).otherwise(F.size("rest"))
            own = F.slice(rest, F.lit(1), taken)
            wild = (step == "wild") | ((step == "fork") & ~F.col("literal"))
            added = F.when(wild, F.transform(own, lambda s: F.lit(WILD))).otherwise(own)
            grown = F.concat("template", F.lit("/"), F.array_join(added, "/"))
            left = F.slice(rest, taken + 1, F.size("rest"))
            before, tree = tree, scratch.stored(met.select("host", "shape", "urls", "labelled", "bad", left.alias("rest"), grown.alias("template")), "tree")
            scratch.discard(before)
            scratch.discard(nodes)


def page_text(html: Column) -> Column:
    """The text of a page: no scripts, styles and tags, blocks on lines of their own."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    lines = F.regexp_replace(bare, r"(?i)<(/?(p|div|li|ul|ol|h[1-6]|tr|table|section|article|header|footer|nav)|br)\b[^>]*>", "\n")
    return F.regexp_replace(lines, "<[^>]*>", " ")


def page_labels(pages: DataFrame, rules: Sequence[tuple[str, str]], kept: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, bad): the verdict of the fitting rule, else what ``kept(page_id, kept)`` says about the page's text."""
    rows = plain_names(pages, (id_col, "page_id"), (url_col, "url"))
    host, path = url_parts(F.col("url"))
    split = rows.select("page_id", host.alias("host"), path.alias("path"))
    action = rule_columns(F.col("host"), F.col("path"), rules)[1]
    ruled = split.select("page_id", action.alias("action")).where("page_id is not null").join(kept.select("page_id", "kept"), "page_id", "left")
    return ruled.select("page_id", F.coalesce(F.col("action") == "block", ~F.col("kept")).alias("bad"))


def url_verdicts(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    labels: DataFrame,
    reject_at: float = 0.6,
    prior_weight: float = 10.0,
    min_urls: int = MIN_URLS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, badness) of every page.

    ``labels`` has (page_id, bad boolean). ``badness`` is the smoothed share of bad
    labelled pages of the template, drawn to the share of all labelled pages by
    ``prior_weight`` pages; a template is blocked from ``reject_at`` on. The longest
    fitting rule overrides it. Null urls, and urls without ``://``, have empty host and
    path and are one template of their own, allowed unless its labels say otherwise.
    Pages without label, and null ids, count as urls only; a page labelled more than once is bad
    if any label says so. Repeated rows are repeated urls. Without labels all is allowed.
    """
    rows = plain_names(pages, (id_col, "page_id"), (url_col, "url"))
    host, path = url_parts(F.col("url"))
    split = rows.select("page_id", host.alias("host"), path.alias("path"))
    split = split.withColumn("shape", F.regexp_replace("path", "[0-9]+", "#"))
    marks = labels.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    paths = stored(
        split.join(marks, "page_id", "left").groupBy("host", "shape")
        .agg(F.count(F.lit(1)).alias("urls"), F.count("bad").alias("labelled"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")),
        "paths",
    )
    templates = path_templates(paths, min_urls)
    known = paths.join(templates, ["host", "shape"])
    all_of = known.agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("n"))
    prior = all_of.select(F.coalesce(F.col("bad") / F.nullif("n", F.lit(0)), F.lit(0.0))).scalar()
    sums = known.groupBy("host", "template").agg(F.sum("bad").alias("bad"), F.sum("labelled").alias("n"))
    rated = sums.select("host", "template", ((F.col("bad") + prior * prior_weight) / (F.col("n") + prior_weight)).alias("badness"))
    judged = templates.join(rated, ["host", "template"]).select("host", "shape", "template", "badness")
    rule, action = rule_columns(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("badness") >= reject_at, "block").otherwise("allow"))
    return split.join(judged, ["host", "shape"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "template", "badness"
    )
