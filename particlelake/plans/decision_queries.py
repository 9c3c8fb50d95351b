"""Queries over candidate selection, taxonomy and feature cleaning."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from particlelake import fixed_values as fv
from particlelake.operators import preprocess, selection, taxonomy
from particlelake.plans import standins as st
from particlelake.plans.particle_queries import build_image_features
from particlelake.plans.registry import query, rounded, with_ctes
from particlelake.runtime import cut_lineage

_ENTROPY = """CASE WHEN len(sizes) >= 2 THEN -list_sum(list_transform(sizes, lambda x: x / list_sum(sizes) * ln(x / list_sum(sizes) + 1e-12))) / ln(len(sizes)) END"""
_GRANULARITY = """CASE WHEN num_clusters BETWEEN 3 AND 6 THEN 1.0 WHEN num_clusters < 3 THEN greatest(0.0, 1 - 0.35::DOUBLE * (3 - num_clusters))
  ELSE greatest(0.0, 1 - 0.18::DOUBLE * (num_clusters - 6)) END"""
_REASONS = """array_to_string(list_filter([CASE WHEN num_clusters < 2 THEN 'fewer_than_two_clusters' END,
   CASE WHEN smallest_cluster_fraction IS NULL OR smallest_cluster_fraction < 0.02 THEN 'tiny_cluster' END,
   CASE WHEN repeat_mean_ari IS NULL OR repeat_mean_ari < 0.95 THEN 'repeat_instability' END,
   CASE WHEN bootstrap_mean_ari IS NULL OR bootstrap_mean_ari < 0.95 THEN 'bootstrap_instability' END,
   CASE WHEN noise_fraction > 0.35 THEN 'excessive_noise' END, CASE WHEN method = 'hdbscan' THEN 'robustness_only_method' END,
   CASE WHEN silhouette_score IS NULL OR davies_bouldin_score IS NULL THEN 'missing_internal_metric' END], lambda x: x IS NOT NULL), ',')"""

_SCORED_SQL = with_ctes(
    st.BENCHMARK_SQL,
    f"j AS (SELECT *, {_ENTROPY} AS cluster_entropy, {_GRANULARITY} AS granularity_score, {_REASONS} AS exclusion_reasons FROM results)",
    """f AS (SELECT candidate_id, coalesce(silhouette_score, 0) AS a, coalesce(calinski_harabasz_score, 0) AS b, davies_bouldin_score AS c,
   coalesce(bootstrap_mean_ari, 0) AS d, coalesce(repeat_mean_ari, 0) AS e, coalesce(cluster_entropy, 0) AS f,
   coalesce(smallest_cluster_fraction, 0) AS g, granularity_score AS h FROM j WHERE silhouette_score IS NOT NULL)""",
    "b AS (SELECT "
    + ", ".join(f"min({x}) AS lo_{x}, max({x}) AS hi_{x}" for x in "abcdefg")
    + " FROM f)",
    "s AS (SELECT candidate_id, 0.05::DOUBLE * h + "
    + " + ".join(
        f"{w}::DOUBLE * (CASE WHEN abs(hi_{x} - lo_{x}) <= 1e-9 * greatest(abs(hi_{x}), abs(lo_{x})) THEN 1 ELSE "
        + (f"(hi_{x} - {x})" if x == "c" else f"({x} - lo_{x})")
        + f" / (hi_{x} - lo_{x}) END)"
        for x, w in zip("abcdefg", (0.22, 0.12, 0.18, 0.18, 0.10, 0.10, 0.05))
    )
    + " AS selection_score FROM f, b)",
    """scored AS (SELECT j.*, exclusion_reasons = '' AS eligible, coalesce(selection_score, 0) AS selection_score
   FROM j LEFT JOIN s USING (candidate_id))""",
    body="",
)


@query(
    "distribution_entropy",
    with_ctes(st.BENCHMARK_SQL, body=f"SELECT candidate_id, round({_ENTROPY}, 6) AS cluster_entropy FROM results"),
)
def distribution_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = st.benchmark_results(spark, sf_dir)
    return rounded(results.select("candidate_id", selection.distribution_entropy(F.col("cluster_size_distribution")).alias("cluster_entropy")))


@query(
    "granularity_score",
    f"""SELECT p_partkey, round(CASE WHEN num_clusters IS NULL THEN 0 ELSE {_GRANULARITY} END, 6) AS granularity_score
FROM (SELECT p_partkey, CASE WHEN p_size % 10 <> 0 THEN p_size % 14 END AS num_clusters FROM part)""",
)
def granularity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.when(F.col("p_size") % 10 != 0, F.col("p_size") % 14)
    return rounded(st.table(spark, sf_dir, "part").select("p_partkey", selection.granularity_score(k).alias("granularity_score")))


@query(
    "eligibility",
    with_ctes(st.BENCHMARK_SQL, body=f"SELECT candidate_id, {_REASONS} AS exclusion_reasons FROM results"),
)
def eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.benchmark_results(spark, sf_dir).select("candidate_id", selection.exclusion_reasons().alias("exclusion_reasons"))


@query(
    "score_candidates",
    _SCORED_SQL + "SELECT candidate_id, eligible AS eligible_for_final_selection, round(selection_score, 6) AS selection_score, round(granularity_score, 6) AS granularity_score, exclusion_reasons FROM scored",
)
def score_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.score_candidates(st.benchmark_results(spark, sf_dir))
    return rounded(out.select("candidate_id", "eligible_for_final_selection", "selection_score", "granularity_score", "exclusion_reasons"))


@query(
    "select_final",
    _SCORED_SQL + """, short AS (SELECT candidate_id, row_number() OVER (ORDER BY selection_score DESC, coalesce(silhouette_score, -1) DESC, candidate_id) AS place, selection_score
  FROM scored WHERE eligible)
SELECT candidate_id, place, round(selection_score, 6) AS selection_score, CASE WHEN place = 1 THEN 'recommended' ELSE 'shortlist' END AS role FROM short WHERE place <= 10
UNION ALL SELECT candidate_id, NULL, round(selection_score, 6), 'robustness_only' FROM scored WHERE NOT eligible AND method = 'hdbscan'""",
)
def select_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.select_final(selection.score_candidates(st.benchmark_results(spark, sf_dir))))


# --- taxonomy -----------------------------------------------------------------
PROFILE_FEATURES = (
    "num_particles", "area_median", "area_iqr", "feret_p90", "feret_iqr", "circularity_median", "aspect_ratio_median",
    "aspect_ratio_p90", "eccentricity_p90", "orientation_entropy", "circular_variance", "solidity_median",
    "mean_intensity_median",
)


def order_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A light feature profile per order; some values are missing."""
    li = st.table(spark, sf_dir, "lineitem")
    n = F.count(F.lit(1))
    return li.groupBy(F.col("l_orderkey").alias("image_id")).agg(
        (n * 100.0).alias("num_particles"),
        (F.avg("l_quantity") / 8.11).alias("area_median"),
        F.when(n > 1, (F.max("l_quantity") - F.min("l_quantity")) / 7.79).alias("area_iqr"),
        (F.max("l_extendedprice") / 20983.0).alias("feret_p90"),
        (F.min("l_extendedprice") / 31013.0).alias("feret_iqr"),
        (F.min("l_discount") * 8.0).alias("circularity_median"),
        (F.avg("l_tax") * 10.0 + 1.0).alias("aspect_ratio_median"),
        (F.max("l_tax") * 20.0 + 1.0).alias("aspect_ratio_p90"),
        (1.0 - F.min("l_tax")).alias("eccentricity_p90"),
        F.when(n <= 6, n / 2.0).alias("orientation_entropy"),
        F.max("l_discount").alias("circular_variance"),
        (1.0 - F.avg("l_discount") / 10.0).alias("solidity_median"),
        (F.avg("l_quantity") * 7.0).alias("mean_intensity_median"),
    )


_VALUES = ", ".join(
    f"('{c}', {ci}, '{f}', {fi}, {w!r}::DOUBLE)"
    for ci, (c, ws) in enumerate(fv.TAXONOMY_WEIGHTS.items())
    for fi, (f, w) in enumerate(ws.items())
)
_STATS = ", ".join(f"('{f}', {m!r}::DOUBLE, {s!r}::DOUBLE)" for f, (m, s) in fv.REFERENCE_STATS.items())
_PROFILE_SQL = f"""profile AS (SELECT l_orderkey AS image_id, count(*) * 100.0::DOUBLE AS num_particles, avg(l_quantity) / 8.11::DOUBLE AS area_median,
   CASE WHEN count(*) > 1 THEN (max(l_quantity) - min(l_quantity)) / 7.79::DOUBLE END AS area_iqr, max(l_extendedprice) / 20983.0::DOUBLE AS feret_p90,
   min(l_extendedprice) / 31013.0::DOUBLE AS feret_iqr, min(l_discount) * 8.0::DOUBLE AS circularity_median, avg(l_tax) * 10.0::DOUBLE + 1 AS aspect_ratio_median,
   max(l_tax) * 20.0::DOUBLE + 1 AS aspect_ratio_p90, 1 - min(l_tax) AS eccentricity_p90, CASE WHEN count(*) <= 6 THEN count(*) / 2.0::DOUBLE END AS orientation_entropy,
   max(l_discount) AS circular_variance, 1 - avg(l_discount) / 10.0::DOUBLE AS solidity_median, avg(l_quantity) * 7.0::DOUBLE AS mean_intensity_median
   FROM lineitem GROUP BY l_orderkey),
w(category, ord, feature, ford, weight) AS (VALUES {_VALUES}),
ref(feature, mean, std) AS (VALUES {_STATS}),
plong AS (SELECT image_id, unnest([{', '.join(repr(f) for f in PROFILE_FEATURES)}]) AS feature, unnest([{', '.join(PROFILE_FEATURES)}]) AS v FROM profile)"""

_RANK_SQL = _PROFILE_SQL + """,
z AS (SELECT image_id, feature, (v - mean) / std AS z FROM plong JOIN ref USING (feature) WHERE v IS NOT NULL),
sc AS (SELECT image_id, category, ord, sum(z * weight) AS score FROM z JOIN w USING (feature) GROUP BY ALL),
ex AS (SELECT *, exp(score / 1.5 - max(score / 1.5) OVER (PARTITION BY image_id)) AS e FROM sc),
pc AS (SELECT *, e * 100 / sum(e) OVER (PARTITION BY image_id) AS pct FROM ex),
rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pct DESC, ord) AS place FROM pc)"""


@query(
    "taxonomy_scores",
    with_ctes(
        _PROFILE_SQL,
        body="""SELECT image_id, category, ord AS category_ord, round(sum(v * weight), 6) AS score,
       string_agg(feature, ',' ORDER BY abs(v * weight) DESC, ford) AS contributions
FROM plong JOIN w USING (feature) WHERE v IS NOT NULL GROUP BY ALL""",
    ),
)
def taxonomy_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taxonomy.taxonomy_scores(order_profile(spark, sf_dir), ["image_id"])
    names = F.transform("contributions", lambda e: e["feature"])
    return rounded(out.withColumn("contributions", F.array_join(names, ",")))


def ranked_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.taxonomy_rank(order_profile(spark, sf_dir), PROFILE_FEATURES)


@query(
    "taxonomy_rank",
    with_ctes(
        _RANK_SQL,
        """n AS (SELECT image_id, count(v) AS feature_count FROM plong GROUP BY image_id)""",
        body="""SELECT image_id, 'ok' AS status, feature_count, max(category) FILTER (place = 1) AS top_category, string_agg(category, ',' ORDER BY place) AS ranking,
       round(max(pct) FILTER (place = 1), 6) AS top_percentage, round(max(score) FILTER (place = 2), 6) AS second_score FROM rk JOIN n USING (image_id) GROUP BY ALL""",
    ),
)
def taxonomy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = F.col("ranked_categories")
    return rounded(
        ranked_orders(spark, sf_dir).select(
            "image_id", "status", F.col("feature_count").cast("long").alias("feature_count"), "top_category",
            F.array_join(F.transform(ranks, lambda e: e["category"]), ",").alias("ranking"),
            ranks[0]["percentage"].alias("top_percentage"), ranks[1]["score"].alias("second_score"),
        )
    )


@query(
    "taxonomy_suggestions",
    with_ctes(
        _PROFILE_SQL,
        "sc AS (SELECT image_id, category, ord, sum(v * weight) AS score FROM plong JOIN w USING (feature) WHERE v IS NOT NULL GROUP BY ALL)",
        "rk AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, ord) AS place FROM sc)",
        """t AS (SELECT image_id, max(category) FILTER (place = 1) AS c1, max(score) FILTER (place = 1) AS s1, max(category) FILTER (place = 2) AS c2,
     max(score) FILTER (place = 2) AS s2 FROM rk GROUP BY image_id)""",
        body="""SELECT image_id, CASE WHEN s1 < 0.5 OR s1 - s2 < 0.25 THEN 'mixed_unknown' ELSE c1 END AS primary_category, round(s1, 6) AS primary_score,
       c2 AS secondary_category, round(s2, 6) AS secondary_score, round(s1 - s2, 6) AS score_gap,
       CASE WHEN s1 < 0.5 OR s1 - s2 < 0.25 THEN 'low' WHEN s1 >= 1.5 AND s1 - s2 >= 0.8 THEN 'high' ELSE 'moderate' END AS confidence FROM t""",
    ),
)
def taxonomy_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taxonomy.taxonomy_suggestions(order_profile(spark, sf_dir), key="image_id")
    return rounded(out.drop("evidence_summary"))


_CATEGORIES = list(fv.TAXONOMY_WEIGHTS)


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = st.labelled_space(spark, sf_dir).select("image_id", "cluster_label")
    assignments = space.withColumn("noise_flag", F.when(F.col("cluster_label") == -1, "True").otherwise("false"))
    names = F.array(*[F.lit(c) for c in _CATEGORIES])
    suggestions = space.select("cluster_label").distinct().where("cluster_label BETWEEN 0 AND 7").select(
        "cluster_label",
        F.element_at(names, F.col("cluster_label") % 6 + 1).alias("primary_category"),
        F.when(F.col("cluster_label") % 2 == 0, "high").otherwise("low").alias("confidence"),
    )
    return taxonomy.compare_assignments(assignments, ranked_orders(spark, sf_dir), suggestions)


_CONSISTENCY_SQL = _RANK_SQL + f""",
a AS (SELECT vec_id AS image_id, CASE WHEN label = 9 THEN -1 ELSE label END AS cluster_label FROM embeddings),
tops AS (SELECT image_id, max(category) FILTER (place = 1) AS top, max(pct) FILTER (place = 1) AS top_pct, max(category) FILTER (place = 2) AS second,
     max(pct) FILTER (place = 2) AS second_pct FROM rk GROUP BY image_id),
sg AS (SELECT a.*, [{', '.join(repr(c) for c in _CATEGORIES)}][cluster_label % 6 + 1] AS prim FROM a),
cmp AS (SELECT sg.image_id, cluster_label, CASE WHEN cluster_label = -1 THEN 'noise_row' WHEN top IS NULL THEN 'missing_feature_row'
     WHEN cluster_label > 7 THEN 'missing_cluster_taxonomy:' || cluster_label END AS skip_reason, prim, top, top_pct, second, second_pct, rk.pct AS own_pct
   FROM sg LEFT JOIN tops USING (image_id) LEFT JOIN rk ON rk.image_id = sg.image_id AND rk.category = prim),
ok AS (SELECT *, (top = prim)::INT AS agree FROM cmp WHERE skip_reason IS NULL)"""


@query(
    "taxonomy_consistency",
    with_ctes(
        _CONSISTENCY_SQL,
        body="""SELECT image_id, cluster_label, skip_reason, CASE WHEN skip_reason IS NULL THEN prim END AS cluster_primary_category,
   CASE WHEN skip_reason IS NULL THEN top END AS temp_top_category, CASE WHEN skip_reason IS NULL THEN round(top_pct, 6) END AS temp_top_percentage,
   CASE WHEN skip_reason IS NULL THEN second END AS temp_second_category,
   CASE WHEN skip_reason IS NULL THEN round(own_pct, 6) END AS cluster_assigned_percentage_in_temp,
   CASE WHEN skip_reason IS NULL THEN top = prim END AS agreement FROM cmp""",
    ),
)
def taxonomy_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        _compared(spark, sf_dir).select(
            "image_id", "cluster_label", "skip_reason", "cluster_primary_category", "temp_top_category", "temp_top_percentage",
            "temp_second_category", "cluster_assigned_percentage_in_temp", "agreement",
        )
    )


@query(
    "taxonomy_consistency_clusters",
    with_ctes(
        _CONSISTENCY_SQL,
        f"""ct AS (SELECT cluster_label, top, count(*) AS n, list_position([{', '.join(repr(c) for c in _CATEGORIES)}], top) AS o FROM ok GROUP BY ALL),
dom AS (SELECT * FROM ct QUALIFY row_number() OVER (PARTITION BY cluster_label ORDER BY n DESC, o) = 1)""",
        body="""SELECT cluster_label, prim AS cluster_primary_category, count(*) AS row_count, sum(agree)::BIGINT AS agreement_count, round(avg(agree), 6) AS agreement_rate,
   any_value(dom.top) AS dominant_temp_category, any_value(dom.n) AS dominant_temp_category_count, round(avg(own_pct), 6) AS mean_cluster_assigned_percentage_in_temp
FROM ok JOIN dom USING (cluster_label) GROUP BY cluster_label, prim""",
    ),
)
def taxonomy_consistency_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = taxonomy.consistency_clusters(_compared(spark, sf_dir))
    return rounded(out.drop("cluster_confidence", "dominant_temp_category_fraction", "mean_temp_top_percentage"))


@query(
    "taxonomy_consistency_grid",
    with_ctes(
        _CONSISTENCY_SQL,
        f"cats AS (SELECT unnest([{', '.join(repr(c) for c in _CATEGORIES)}]) AS temp_top_category)",
        body="""SELECT cluster_label, prim AS cluster_primary_category, temp_top_category, count(*) FILTER (top = temp_top_category) AS count,
   round(count(*) FILTER (top = temp_top_category) / count(*), 6) AS fraction_within_cluster FROM ok, cats GROUP BY ALL""",
    ),
)
def taxonomy_consistency_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(taxonomy.consistency_grid(_compared(spark, sf_dir)))


@query(
    "taxonomy_consistency_summary",
    with_ctes(
        _CONSISTENCY_SQL,
        body="""SELECT (SELECT count(*) FROM ok) AS row_count_compared, (SELECT count(*) FROM cmp WHERE skip_reason IS NOT NULL) AS row_count_skipped,
   round((SELECT avg(agree) FROM ok), 6) AS overall_agreement_rate, round((SELECT avg(own_pct) FROM ok), 6) AS mean_cluster_assigned_percentage_in_temp,
   round((SELECT avg(top_pct) FROM ok), 6) AS mean_temp_top_percentage""",
    ),
)
def taxonomy_consistency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(taxonomy.consistency_summary(_compared(spark, sf_dir)).drop("skipped_examples"))


def _backfill_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = st.table(spark, sf_dir, "documents"), st.table(spark, sf_dir, "labels")
    return docs.select("doc_id", "lang", "source").join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.when(F.col("lang") == "fr", F.lit("")).when(F.col("lang") == "de", F.lit("  ")).otherwise(F.col("source")).alias("image"),
        F.when(F.col("quality") == 1, F.lit("done")).alias("taxonomy"),
    )


@query(
    "backfill_taxonomy",
    """WITH r AS (SELECT d.doc_id, CASE WHEN lang = 'fr' THEN '' WHEN lang = 'de' THEN '  ' ELSE source END AS image, quality,
   d.doc_id IN (SELECT l_orderkey FROM lineitem) AS known FROM documents d LEFT JOIN labels l USING (doc_id)),
c AS (SELECT * FROM r WHERE image <> '' AND (quality IS NULL OR quality <> 1))
SELECT count(*) AS processed, count(*) FILTER (trim(image) <> '' AND known) AS updated, count(*) FILTER (trim(image) = '' OR NOT known) AS skipped,
   0::BIGINT AS failed, (SELECT count(*) FILTER (quality = 1) FROM r) + count(*) FILTER (trim(image) <> '' AND known) AS filled FROM c""",
)
def backfill_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ranked_orders(spark, sf_dir).withColumnRenamed("image_id", "id")
    updated, counts = taxonomy.backfill_taxonomy(_backfill_records(spark, sf_dir), ranked)
    filled = updated.agg(F.count("taxonomy").alias("filled")).select("filled").scalar()
    return counts.withColumn("filled", filled)


@query(
    "selection_agreement",
    _SCORED_SQL + """, short AS (SELECT candidate_id, row_number() OVER (ORDER BY selection_score DESC, coalesce(silhouette_score, -1) DESC, candidate_id) AS place
  FROM scored WHERE eligible),
top_six AS (SELECT candidate_id, place, split_part(candidate_id, 'k-', 2)::INT AS n FROM short WHERE place <= 6),
placed AS (SELECT candidate_id, place, vec_id, (vec_id // (n + 2)) % (2 + n % 4) AS label FROM top_six, embeddings),
both_labels AS (SELECT a.candidate_id AS reference, b.candidate_id AS other, a.label AS la, b.label AS lb FROM placed a JOIN placed b USING (vec_id) WHERE a.place = 1 AND b.place > 1),
cells AS (SELECT reference, other, la, lb, count(*)::DOUBLE AS n FROM both_labels GROUP BY ALL),
ra AS (SELECT other, la, sum(n) AS n FROM cells GROUP BY ALL), rb AS (SELECT other, lb, sum(n) AS n FROM cells GROUP BY ALL),
totals AS (SELECT reference, other, sum(n) AS t, sum(n * (n - 1) / 2) AS same FROM cells GROUP BY ALL),
sa AS (SELECT ra.other, sum(n * (n - 1) / 2) AS sa, -sum(n / t * ln(n / t)) AS ha FROM ra JOIN totals t USING (other) GROUP BY ALL),
sb AS (SELECT rb.other, sum(n * (n - 1) / 2) AS sb, -sum(n / t * ln(n / t)) AS hb FROM rb JOIN totals t USING (other) GROUP BY ALL),
mi AS (SELECT c.other, sum(c.n / t * ln(c.n * t / (ra.n * rb.n))) AS mi FROM cells c JOIN ra USING (other, la) JOIN rb USING (other, lb) JOIN totals t USING (other) GROUP BY ALL)
SELECT reference AS reference_candidate_id, other AS comparison_candidate_id, t::BIGINT AS overlap_count,
  round((same - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 6) AS adjusted_rand_index,
  round(mi / ((ha + hb) / 2), 6) AS normalized_mutual_information
FROM totals t JOIN sa USING (other) JOIN sb USING (other) JOIN mi USING (other)""",
)
def selection_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recommended candidate beside the next five, on labels derived from the image number."""
    results = st.benchmark_results(spark, sf_dir)
    selected = selection.select_final(selection.score_candidates(results))
    number = F.element_at(F.split("candidate_id", "k-"), -1).cast("int")
    candidates = results.select("candidate_id", number.alias("n"))
    images = st.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image_id"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("n"))
    label = F.pmod(F.floor(F.col("image_id") / (F.col("n") + 2)), 2 + F.col("n") % 4).cast("int")
    assignments = images.join(candidates, "n").select("image_id", "candidate_id", label.alias("cluster_label"))
    return rounded(selection.candidate_agreement(selected, assignments))


# --- feature cleaning ------------------------------------------------------------
CLEAN_COLUMNS = fv.EXTENDED_FEATURES
_SPECIAL = (
    "num_particles", "particle_density", "mean_pixel_intensity", "area_median", "feret_p90", "solidity_median",
    "circularity_median", "aspect_ratio_p90", "eccentricity_iqr",
)
#: The other columns: quarters of a remainder, every third one skewed by its cube.
_PLAIN = tuple((j, c) for j, c in enumerate(CLEAN_COLUMNS) if c not in _SPECIAL)


def _plain_column(j: int, name: str) -> Column:
    part = ((F.col("o_custkey") * (j + 3) + F.col("o_orderkey") * (2 * j + 1)) % (101 + 2 * j)).cast("double") / 4.0
    return (part * part * part if j % 3 == 0 else part).alias(name)


def _plain_sql(j: int, name: str) -> str:
    part = f"((o_custkey * {j + 3} + o.o_orderkey * {2 * j + 1}) % {101 + 2 * j})::DOUBLE / 4.0::DOUBLE"
    return f"({part}) * ({part}) * ({part}) AS {name}" if j % 3 == 0 else f"{part} AS {name}"


def cleaning_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with features that are constant, missing, skewed or nearly flat."""
    o = st.table(spark, sf_dir, "orders")
    per_order = st.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("q"), F.max("l_extendedprice").alias("p"), F.avg("l_discount").alias("d")
    )
    joined = o.join(per_order, "o_orderkey", "left")
    n = F.coalesce("n", F.lit(0))
    return joined.select(
        F.col("o_orderkey").alias("image_id"),
        F.lit("TRUE").alias("roi_detected"), F.lit(True).alias("analysis_success"),
        F.when(F.col("o_orderstatus") == "P", "no").otherwise("yes").alias("segmentation_success"),
        (n == 0).alias("zero_particle_flag"),
        n.cast("double").alias("num_particles"),
        F.pow(n.cast("double"), F.lit(4.0)).alias("particle_density"),
        (F.col("o_totalprice") / 2000.0).alias("mean_pixel_intensity"),
        F.col("q").alias("area_median"),
        (F.col("p") / 1000.0).alias("feret_p90"),
        F.when(F.col("o_custkey") % 50 != 0, 1.0 - F.col("d")).alias("solidity_median"),
        F.lit(0.5).alias("circularity_median"),
        F.lit(None).cast("double").alias("aspect_ratio_p90"),
        F.when(F.col("o_orderkey") % 40 == 0, 1.0).otherwise(0.0).alias("eccentricity_iqr"),
        *[_plain_column(j, c) for j, c in _PLAIN],
    )


_KEPT = tuple(c for c in CLEAN_COLUMNS if c not in ("circularity_median", "aspect_ratio_p90"))  # constant, empty


def _each(template: str) -> str:
    return ", ".join(template.format(c=c) for c in _KEPT)


_CLEAN_SQL = f"""base AS (SELECT o.o_orderkey AS image_id, coalesce(n, 0) = 0 AS zero, coalesce(n, 0)::DOUBLE AS num_particles, pow(coalesce(n, 0)::DOUBLE, 4) AS particle_density,
   o_totalprice / 2000.0::DOUBLE AS mean_pixel_intensity, q AS area_median, p / 1000.0::DOUBLE AS feret_p90,
   CASE WHEN o_custkey % 50 <> 0 THEN 1 - d END AS solidity_median, CASE WHEN o.o_orderkey % 40 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS eccentricity_iqr,
   {", ".join(_plain_sql(j, c) for j, c in _PLAIN)}
   FROM orders o LEFT JOIN (SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS q, max(l_extendedprice) AS p, avg(l_discount) AS d FROM lineitem GROUP BY 1) l
     ON o.o_orderkey = l.l_orderkey WHERE o_orderstatus <> 'P'),
fills AS (SELECT {_each("CASE WHEN count(*) FILTER ({c} IS NULL AND NOT zero) > 0 THEN median({c}) ELSE 0 END AS {c}")} FROM base),
imputed AS (SELECT b.image_id, {_each("coalesce(b.{c}, f.{c}) AS {c}")} FROM base b, fills f),
cuts AS (SELECT {_each("quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}")} FROM imputed),
clipped AS (SELECT image_id, {_each("least(greatest({c}, lo_{c}), hi_{c}) AS {c}")} FROM imputed, cuts),
means AS (SELECT {_each("avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}, min({c}) AS lo_{c}")} FROM clipped),
skews AS (SELECT {_each("avg(pow(({c} - m_{c}) / s_{c}, 3)) AS k_{c}")} FROM clipped, means),
logged AS (SELECT image_id, {", ".join(
    (f"CASE WHEN lo_{c} >= 0 AND abs(k_{c}) > 1 THEN ln(1 + {c}) ELSE {c} END AS {c}"
     if c.startswith(("num_particles", "particle_density", "area_", "feret_", "equivalent_diameter_")) else c) for c in _KEPT)}
   FROM clipped, means, skews),
spread AS (SELECT {_each("median({c}) AS m_{c}, quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) AS q_{c}, stddev_pop({c}) AS s_{c}")} FROM logged),
scaled AS (SELECT image_id, {_each("({c} - m_{c}) / (CASE WHEN q_{c} = 0 OR q_{c} < 0.1::DOUBLE * s_{c} THEN CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END ELSE q_{c} END) AS {c}")} FROM logged, spread)"""


def _cleaned(spark: SparkSession, sf_dir: str, *stages: str) -> DataFrame:
    wide = cleaning_input(spark, sf_dir)
    model = preprocess.FeaturePreprocessor(CLEAN_COLUMNS, stages=("impute", *stages)).fit(wide)
    return rounded(model.transform(wide, keep=("image_id",)))


def _clean_sql(table: str) -> str:
    return with_ctes(_CLEAN_SQL, body=f"SELECT image_id, {_each('round({c}, 6) AS {c}')} FROM {table}")


@query("preprocess_impute", _clean_sql("imputed"))
def preprocess_impute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir)


@query("preprocess_winsorize", _clean_sql("clipped"))
def preprocess_winsorize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "winsorize")


@query("preprocess_log1p", _clean_sql("logged"))
def preprocess_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "winsorize", "log1p")


@query("preprocess_scale", _clean_sql("scaled"))
def preprocess_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir, "winsorize", "log1p", "scale")


@query(
    "spearman_matrix",
    with_ctes(
        st.LABELLED_LONG_SQL,
        """r AS (SELECT image_id, feature, rank() OVER (PARTITION BY feature ORDER BY value)
            + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rk FROM long)""",
        body="""SELECT a.feature AS feature_a, b.feature AS feature_b, round(corr(a.rk, b.rk), 6) AS rho FROM r a JOIN r b USING (image_id) GROUP BY ALL""",
    ),
)
def spearman_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = st.labelled_space(spark, sf_dir)
    return rounded(preprocess.spearman_matrix(space, st.feature_names()))


@query("reduce_features")
def reduce_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision per feature column of the cleaned table."""
    wide = cut_lineage(cleaning_input(spark, sf_dir))
    model = preprocess.FeaturePreprocessor(CLEAN_COLUMNS).fit(wide)
    selected, report = preprocess.reduce_features(model.transform(wide, keep=("image_id",)), model.kept)
    reasons = {c: "selected" for c in selected}
    reasons |= {c: f"correlated with {k}" for c, k in report["removed_by_correlation"].items()}
    reasons |= {c: f"balance: {k}" for c, k in report["removed_by_family_balance"].items()}
    return spark.createDataFrame(sorted(reasons.items()), "feature string, decision string")


@query("prepare_final")
def prepare_final(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature matrix of the whole image table, cleaned and reduced."""
    features = build_image_features(spark, sf_dir).withColumns(
        {"roi_detected": F.lit(True), "analysis_success": F.lit(True), "segmentation_success": F.lit(True), "manual_qc_flag": F.lit("ok")}
    )
    final, report = preprocess.prepare_final(features)
    return final.withColumn("selected_columns", F.lit(json.dumps(report.get("selected_columns", []))))
