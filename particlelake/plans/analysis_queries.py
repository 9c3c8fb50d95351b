"""Queries over labelled feature spaces: validity, explanation and context."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from particlelake import fixed_values as fv
from particlelake.operators import context as ctx
from particlelake.operators import explain, ranking, validity
from particlelake.operators.records import with_row_position
from particlelake.plans import standins as st
from particlelake.plans.aggregate_queries import context_orders
from particlelake.plans.registry import query, rounded, with_ctes

FEATURES = st.feature_names()

_MEMBERS = "m AS (SELECT * FROM long WHERE cluster_label <> -1)"
_CENTRES = """c AS (SELECT cluster_label, feature, avg(value) AS centre FROM m GROUP BY ALL),
d AS (SELECT image_id, m.cluster_label, sqrt(sum(pow(value - centre, 2))) AS dist FROM m JOIN c USING (cluster_label, feature) GROUP BY ALL)"""


@query(
    "normalize_labels",
    """WITH x AS (SELECT vec_id AS image_id, CASE WHEN label = 9 THEN -1 WHEN label = 4 THEN -3 ELSE label * 10 END AS l FROM embeddings)
SELECT image_id, CASE WHEN l < 0 THEN -1 ELSE dense_rank() OVER (ORDER BY CASE WHEN l < 0 THEN NULL ELSE l END NULLS LAST) END AS cluster_label FROM x""",
)
def normalize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = st.table(spark, sf_dir, "embeddings")
    raw = F.when(F.col("label") == 9, -1).when(F.col("label") == 4, -3).otherwise(F.col("label") * 10)
    return validity.normalize_labels(e.select(F.col("vec_id").alias("image_id"), raw.alias("cluster_label")))


@query(
    "internal_metrics",
    with_ctes(
        st.LABELLED_LONG_SQL, _MEMBERS, _CENTRES,
        """g AS (SELECT feature, avg(value) AS grand FROM m GROUP BY feature),
n AS (SELECT cluster_label, count(*) AS n FROM space GROUP BY cluster_label),
tot AS (SELECT count(*) AS rows, count(*) FILTER (cluster_label <> -1) AS members, count(*) FILTER (cluster_label = -1) AS noise FROM space),
w AS (SELECT sum(dist * dist) AS within FROM d),
b AS (SELECT sum(n * pow(centre - grand, 2)) AS between FROM c JOIN g USING (feature) JOIN n USING (cluster_label)),
s AS (SELECT cluster_label, avg(dist) AS s FROM d GROUP BY cluster_label),
gaps AS (SELECT a.cluster_label AS i, b.cluster_label AS j, sqrt(sum(pow(a.centre - b.centre, 2))) AS gap
         FROM c a JOIN c b ON a.feature = b.feature AND a.cluster_label <> b.cluster_label GROUP BY ALL),
worst AS (SELECT i, max((si.s + sj.s) / gap) AS w FROM gaps JOIN s si ON i = si.cluster_label JOIN s sj ON j = sj.cluster_label GROUP BY i),
k AS (SELECT count(*) AS k, min(n) AS lo, max(n) AS hi FROM n WHERE cluster_label <> -1)""",
        body="""SELECT k AS num_clusters, noise AS noise_points, round(noise / rows, 6) AS noise_fraction, round(lo / rows, 6) AS smallest_cluster_fraction,
       round(hi / rows, 6) AS largest_cluster_fraction, lo / rows < 0.02 AS tiny_cluster_flag,
       round(between * (members - k) / (within * (k - 1)), 6) AS calinski_harabasz_score,
       round((SELECT avg(w) FROM worst), 6) AS davies_bouldin_score FROM k, tot, w, b""",
    ),
)
def internal_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validity.internal_metrics(st.labelled_space(spark, sf_dir), FEATURES)
    return rounded(out.drop("cluster_size_distribution"))


_SILHOUETTE_CTES = (
    st.LABELLED_LONG_SQL.split(",\nlong AS")[0],
    "p AS (SELECT image_id, cluster_label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM space WHERE cluster_label <> -1)",
    "sizes AS (SELECT cluster_label AS other, count(*) AS n FROM p GROUP BY 1)",
)
_SILHOUETTE_BODY = """,
pairs AS (SELECT a.image_id, a.cluster_label, b.cluster_label AS other, sum({distance}) AS total
          FROM p a, p b GROUP BY ALL),
ab AS (SELECT image_id, cluster_label,
         max(CASE WHEN other = cluster_label THEN n END) AS own,
         max(CASE WHEN other = cluster_label THEN total / greatest(n - 1, 1) END) AS a,
         min(CASE WHEN other <> cluster_label THEN total / n END) AS b
       FROM pairs JOIN sizes USING (other) GROUP BY ALL),
sil AS (SELECT image_id, cluster_label, CASE WHEN own <= 1 THEN 0.0 ELSE (b - a) / greatest(a, b) END AS value FROM ab)
"""
_EXACT = with_ctes(*_SILHOUETTE_CTES, body=_SILHOUETTE_BODY.format(distance="list_distance(a.e, b.e)"))
_SQUARED = with_ctes(*_SILHOUETTE_CTES, body=_SILHOUETTE_BODY.format(distance="pow(list_distance(a.e, b.e), 2)"))


def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validity.silhouette(st.labelled_space(spark, sf_dir), FEATURES, mode="exact")


@query("silhouette_exact", _EXACT + "SELECT image_id, cluster_label, round(value, 6) AS silhouette_value FROM sil")
def silhouette_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_exact(spark, sf_dir).drop("silhouette_mode"))


@query("silhouette_squared", _SQUARED + "SELECT image_id, cluster_label, round(value, 6) AS silhouette_value FROM sil")
def silhouette_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = validity.silhouette(st.labelled_space(spark, sf_dir), FEATURES, mode="squared")
    return rounded(out.drop("silhouette_mode"))


@query(
    "silhouette_summary",
    _EXACT + """SELECT cluster_label, count(*) AS count, round(avg(value), 6) AS mean_silhouette, round(median(value), 6) AS median_silhouette,
       round(stddev_pop(value), 6) AS std_silhouette, round(min(value), 6) AS min_silhouette,
       round(quantile_cont(value, 0.1), 6) AS p10_silhouette, round(quantile_cont(value, 0.9), 6) AS p90_silhouette
FROM sil GROUP BY cluster_label""",
)
def silhouette_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validity.silhouette_summary(_exact(spark, sf_dir)))


@query(
    "borderline",
    _EXACT + """SELECT image_id, cluster_label, round(value, 6) AS silhouette_value,
       row_number() OVER (PARTITION BY cluster_label ORDER BY value, image_id) AS rank_within_cluster FROM sil QUALIFY rank_within_cluster <= 5""",
)
def borderline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.borderline(_exact(spark, sf_dir).drop("silhouette_mode"), 5))


@query(
    "representatives",
    with_ctes(
        st.LABELLED_LONG_SQL, _MEMBERS, _CENTRES,
        body="""SELECT cluster_label, image_id, round(dist, 6) AS distance_to_cluster_centroid,
       row_number() OVER (PARTITION BY cluster_label ORDER BY dist, image_id) AS rank_in_cluster FROM d QUALIFY rank_in_cluster <= 5""",
    ),
)
def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ranking.representatives(st.labelled_space(spark, sf_dir), FEATURES, 5))


_AGREE_SQL = """WITH x AS (SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END AS la, label % 3 AS lb FROM embeddings WHERE vec_id % 5 <> 0),
c AS (SELECT la, lb, count(*)::DOUBLE AS n FROM x GROUP BY ALL),
a AS (SELECT la, sum(n) AS n FROM c GROUP BY la), b AS (SELECT lb, sum(n) AS n FROM c GROUP BY lb), t AS (SELECT sum(n) AS t FROM c)
"""


def _labelings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    space = st.labelled_space(spark, sf_dir).select("image_id", "cluster_label")
    e = st.table(spark, sf_dir, "embeddings").where("vec_id % 5 <> 0")
    return space, e.select(F.col("vec_id").alias("image_id"), (F.col("label") % 3).alias("cluster_label"))


@query(
    "label_agreement",
    _AGREE_SQL + """, p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS same, (SELECT sum(n * (n - 1) / 2) FROM a) AS sa,
   (SELECT sum(n * (n - 1) / 2) FROM b) AS sb, t * (t - 1) / 2 AS pairs, t FROM t),
e AS (SELECT (SELECT -sum(n / t * ln(n / t)) FROM a, t) AS ha, (SELECT -sum(n / t * ln(n / t)) FROM b, t) AS hb,
   (SELECT sum(c.n / t * ln(c.n * t / (a.n * b.n))) FROM c JOIN a USING (la) JOIN b USING (lb), t) AS mi)
SELECT round((same - sa * sb / pairs) / ((sa + sb) / 2 - sa * sb / pairs), 6) AS adjusted_rand_index,
       round(mi / ((ha + hb) / 2), 6) AS normalized_mutual_information, t::BIGINT AS overlap_count FROM p, e""",
)
def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validity.label_agreement(*_labelings(spark, sf_dir)))


@query(
    "solution_agreement",
    _AGREE_SQL + """SELECT a.la AS selected_cluster_label, b.lb AS alternative_cluster_label, coalesce(c.n, 0)::BIGINT AS overlap_count,
       round(coalesce(c.n, 0) / a.n, 6) AS fraction_within_selected_cluster
FROM a CROSS JOIN b LEFT JOIN c ON c.la = a.la AND c.lb = b.lb""",
)
def solution_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(validity.solution_agreement(*_labelings(spark, sf_dir)))


_PROFILE_SQL = """g AS (SELECT feature, avg(value) AS gm, stddev_pop(value) AS gs, count(*) AS rows FROM long GROUP BY feature),
prof AS (SELECT cluster_label, count(*) AS count, feature, avg(value) AS mean, median(value) AS median FROM m GROUP BY ALL),
std AS (SELECT prof.*, count / rows AS fraction, (median - gm) / gs AS standardized FROM prof JOIN g USING (feature))"""


def _profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explain.cluster_profiles(st.labelled_space(spark, sf_dir), FEATURES)


@query(
    "cluster_profiles",
    with_ctes(
        st.LABELLED_LONG_SQL, _MEMBERS, _PROFILE_SQL,
        body="""SELECT cluster_label, count, round(fraction, 6) AS fraction, feature, round(mean, 6) AS mean, round(median, 6) AS median,
       round(standardized, 6) AS standardized FROM std""",
    ),
)
def cluster_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_profiles(spark, sf_dir))


@query(
    "pairwise_differences",
    with_ctes(
        st.LABELLED_LONG_SQL, _MEMBERS, _PROFILE_SQL,
        body="""SELECT a.cluster_label AS cluster_a, b.cluster_label AS cluster_b, a.feature, round(a.standardized - b.standardized, 6) AS standardized_median_delta,
       CASE WHEN a.standardized - b.standardized > 0 THEN a.cluster_label ELSE b.cluster_label END AS higher_cluster,
       row_number() OVER (PARTITION BY a.cluster_label, b.cluster_label
         ORDER BY abs(a.standardized - b.standardized) DESC, substr(a.feature, 2)::INT) AS rank
FROM std a JOIN std b ON a.feature = b.feature AND a.cluster_label < b.cluster_label QUALIFY rank <= 8""",
    ),
)
def pairwise_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = explain.profile_table(_profiles(spark, sf_dir), "standardized", FEATURES)
    return rounded(ranking.pairwise_differences(table, FEATURES, 8))


_KRUSKAL_SQL = """r AS (SELECT cluster_label, feature, value, rank() OVER (PARTITION BY feature ORDER BY value)
        + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0::DOUBLE AS rk FROM m),
ties AS (SELECT feature, sum(n * n * n - n) AS t, sum(n) AS nn FROM (SELECT feature, value, count(*)::DOUBLE AS n FROM m GROUP BY ALL) GROUP BY feature),
gr AS (SELECT feature, cluster_label, count(*)::DOUBLE AS n, avg(rk) AS mr FROM r GROUP BY ALL),
kw AS (SELECT feature, 12 / (nn * (nn + 1)) * sum(n * pow(mr - (nn + 1) / 2, 2)) / (1 - t / (nn * nn * nn - nn)) AS h, count(*) AS k
       FROM gr JOIN ties USING (feature) GROUP BY feature, nn, t)"""
# closed form of the tail for eight degrees of freedom (nine groups)
_TAIL8 = "exp(-h / 2) * (1 + h / 2 + pow(h / 2, 2) / 2 + pow(h / 2, 3) / 6)"


@query(
    "kruskal_wallis",
    with_ctes(
        st.LABELLED_LONG_SQL, _MEMBERS, _KRUSKAL_SQL,
        body=f"""SELECT feature AS variable, nn::BIGINT AS n, k AS group_count, round(h, 6) AS kruskal_wallis_statistic,
       round({_TAIL8}, 9) AS kruskal_wallis_p_value FROM kw JOIN ties USING (feature)""",
    ),
)
def kruskal_wallis(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = st.labelled_space(spark, sf_dir).where("cluster_label <> -1")
    return rounded(ctx.kruskal_wallis(members, "cluster_label", FEATURES), kruskal_wallis_p_value=9)


@query(
    "feature_discrimination",
    with_ctes(
        st.LABELLED_LONG_SQL, _MEMBERS, _KRUSKAL_SQL, _PROFILE_SQL,
        """ss AS (SELECT feature, var_pop(value) * count(*) AS total FROM m GROUP BY feature),
bt AS (SELECT feature, sum(count * pow(mean - gm, 2)) AS between, max(mean) - min(mean) AS mr, max(median) - min(median) AS dr
       FROM prof JOIN g USING (feature) GROUP BY feature)""",
        f"pv AS (SELECT feature, h, {_TAIL8} AS p FROM kw)",
        "rk AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM pv)",
        """bh AS (SELECT feature, h, p, min(least(1.0, p * n / k)) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM rk)""",
        body="""SELECT feature, round(between / total, 6) AS eta_squared, round(h, 6) AS kruskal_wallis_statistic, round(p, 9) AS kruskal_wallis_p_value,
       round(mr, 6) AS cluster_mean_range, round(dr, 6) AS cluster_median_range, round(q, 9) AS kruskal_wallis_p_value_bh
FROM ss JOIN bt USING (feature) JOIN bh USING (feature)""",
    ),
)
def feature_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = explain.feature_discrimination(st.labelled_space(spark, sf_dir), FEATURES)
    return rounded(out, kruskal_wallis_p_value=9, kruskal_wallis_p_value_bh=9)


_HIGH = {f: i for i, (f, _, _) in enumerate(fv.HIGH_PHRASES)}


@query(
    "cluster_descriptions",
    with_ctes(
        st.LABELLED_LONG_SQL, _MEMBERS, _PROFILE_SQL,
        "z AS (SELECT cluster_label, count, fraction, "
        + ", ".join(f"max(standardized * 8) FILTER (feature = 'f{i}') AS {f}" for f, i in _HIGH.items())
        + " FROM std GROUP BY ALL)",
        "t AS (SELECT *, list_distinct_ordered FROM (SELECT *, list_filter(["
        + ", ".join(
            [f"CASE WHEN {f} >= {t} THEN '{p}' END" for f, p, t in fv.HIGH_PHRASES]
            + [f"CASE WHEN {f} <= -{t} THEN '{p}' END" for f, p, t in fv.LOW_PHRASES]
        )
        + "], lambda p: p IS NOT NULL) AS list_distinct_ordered FROM z))",
        body=f"""SELECT cluster_label, count, round(fraction, 6) AS fraction,
       CASE WHEN len(list_distinct_ordered) = 0 THEN '{fv.DEFAULT_PHRASE}' ELSE array_to_string(list_distinct_ordered, ', ') END AS morphology_summary FROM t""",
    ),
)
def cluster_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = explain.profile_table(_profiles(spark, sf_dir), "standardized", FEATURES)
    named = table.select(
        "cluster_label", "count", "fraction", *[(F.col(f"f{i}") * 8).alias(f) for f, i in _HIGH.items()]
    )
    out = explain.cluster_descriptions(named, list(_HIGH))
    return rounded(out.select("cluster_label", "count", "fraction", "morphology_summary"))


@query(
    "projection_positions",
    """WITH p AS (SELECT CASE WHEN label = 9 THEN -1 ELSE label END AS cluster_label, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings),
c AS (SELECT cluster_label, count(*) AS count, avg(x) AS pc1_mean, avg(y) AS pc2_mean, stddev_pop(x) AS pc1_std, stddev_pop(y) AS pc2_std
      FROM p WHERE cluster_label <> -1 GROUP BY 1),
d AS (SELECT c.*, sqrt(pow(x - pc1_mean, 2) + pow(y - pc2_mean, 2)) AS dist FROM p JOIN c USING (cluster_label))
SELECT cluster_label, count, round(pc1_mean, 6) AS pc1_mean, round(pc2_mean, 6) AS pc2_mean, round(pc1_std, 6) AS pc1_std, round(pc2_std, 6) AS pc2_std,
       round(avg(dist), 6) AS mean_distance_to_pca_centroid, round(quantile_cont(dist, 0.9), 6) AS p90_distance_to_pca_centroid
FROM d GROUP BY ALL""",
)
def projection_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(explain.projection_positions(st.labelled_space(spark, sf_dir), x="f0", y="f1"))


# --- context -------------------------------------------------------------------
def image_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with record and station values; some are missing or zero."""
    o = st.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("image_id"), "o_orderstatus",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("capture_datetime"),
        F.when(key % 7 != 0, F.col("o_custkey") % 60).cast("double").alias("record_pm10"),
        F.when(key % 5 != 0, F.col("o_custkey") % 35).cast("double").alias("record_pm25"),
        F.when(key % 3 != 0, key % 80).cast("double").alias("official_pm10"),
        (key % 41).cast("double").alias("official_pm25"),
        F.when(key % 11 != 0, F.col("o_totalprice") / 40000.0).alias("official_station_distance_km"),
    )


_CONTEXT_SQL = """c AS (SELECT o_orderkey AS image_id, o_orderstatus, o_orderdate AS d,
  CASE WHEN o_orderkey % 7 <> 0 THEN (o_custkey % 60)::DOUBLE END AS r10, CASE WHEN o_orderkey % 5 <> 0 THEN (o_custkey % 35)::DOUBLE END AS r25,
  CASE WHEN o_orderkey % 3 <> 0 THEN (o_orderkey % 80)::DOUBLE END AS o10, (o_orderkey % 41)::DOUBLE AS o25,
  CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 40000.0::DOUBLE END AS km FROM orders)"""


@query(
    "context_columns",
    with_ctes(
        _CONTEXT_SQL,
        body="""SELECT image_id, round(CASE WHEN r10 <> 0 THEN r25 / r10 END, 6) AS record_pm25_to_pm10_ratio,
  round(CASE WHEN o10 <> 0 THEN o25 / o10 END, 6) AS official_pm25_to_pm10_ratio,
  o10 - r10 AS official_pm10_minus_record_pm10, o25 - r25 AS official_pm25_minus_record_pm25, abs(o10 - r10) AS abs_pm10_gap, abs(o25 - r25) AS abs_pm25_gap,
  o10 + o25 AS official_pm_total, r10 + r25 AS record_pm_total, year(d)::INT AS capture_year, month(d)::INT AS capture_month,
  CASE WHEN month(d) IN (12, 1, 2) THEN 'winter' WHEN month(d) IN (3, 4, 5) THEN 'spring' WHEN month(d) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS capture_season,
  dayofyear(d)::INT AS capture_dayofyear, (isodow(d) - 1)::INT AS capture_weekday,
  CASE WHEN km IS NULL THEN 'missing' WHEN km < 1 THEN 'under_1km' WHEN km < 3 THEN '1_to_3km' WHEN km < 10 THEN '3_to_10km' ELSE 'over_10km' END AS station_distance_band,
  CASE WHEN o25 IS NULL THEN 'missing' WHEN o25 <= 10 THEN 'low' WHEN o25 <= 25 THEN 'moderate' ELSE 'high' END AS official_pm25_band,
  CASE WHEN o10 IS NULL THEN 'missing' WHEN o10 <= 20 THEN 'low' WHEN o10 <= 50 THEN 'moderate' ELSE 'high' END AS official_pm10_band FROM c""",
    ),
)
def context_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = image_context(spark, sf_dir)
    out = ctx.context_columns(base)
    return rounded(out.drop(*[c for c in base.columns if c != "image_id"]))


@query(
    "detect_context_columns",
    """SELECT 'record_pm10' AS column, 'numeric' AS kind, 3 AS position FROM orders HAVING count(DISTINCT o_custkey % 60) >= 2
UNION ALL SELECT 'official_pm25', 'numeric', 6 FROM orders HAVING count(DISTINCT o_orderkey % 41) >= 2
UNION ALL SELECT 'capture_season', 'categorical', 1 FROM orders HAVING count(DISTINCT o_orderstatus) >= 2""",
)
def detect_context_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = image_context(spark, sf_dir).select(
        "record_pm10", "official_pm25", F.lit(4.0).alias("latitude"), F.lit(None).cast("double").alias("longitude"),
        F.col("o_orderstatus").alias("capture_season"), F.when(F.col("o_orderstatus") == "F", "x").otherwise(" ").alias("official_station_id"),
    )
    return ctx.detect_context_columns(base)


_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "constant"]


@query(
    "numeric_association",
    """WITH m AS (SELECT l_returnflag AS cluster_label, unnest(['l_quantity', 'l_extendedprice', 'l_discount']) AS feature,
            unnest([l_quantity, l_extendedprice, l_discount]) AS value FROM lineitem),"""
    + _KRUSKAL_SQL
    + """, t AS (SELECT feature AS variable, h, exp(-h / 2) AS p, greatest(0.0, (h - k + 1) / (nn - k)) AS e FROM kw JOIN ties USING (feature)),
rk AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM t),
bh AS (SELECT *, min(least(1.0, p * n / i)) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM rk)
SELECT variable, round(h, 6) AS kruskal_wallis_statistic, round(p, 9) AS kruskal_wallis_p_value, round(e, 9) AS epsilon_squared, round(q, 9) AS kruskal_wallis_p_value_bh FROM bh
UNION ALL SELECT 'constant', NULL, NULL, NULL, NULL""",
)
def numeric_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = st.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount", F.lit(1.0).alias("constant"))
    _, tests = ctx.numeric_association(li, "l_returnflag", _NUMERIC)
    return rounded(tests, 9, kruskal_wallis_statistic=6)


_CATEGORICAL_SQL = """WITH long AS (SELECT o_orderstatus AS g, unnest(['priority', 'flag']) AS variable,
         unnest([o_orderpriority, CASE WHEN o_custkey % 2 = 0 AND o_orderstatus <> 'P' THEN 'even' WHEN o_custkey % 3 = 0 THEN ' ' ELSE 'odd' END]) AS category FROM orders),
kept AS (SELECT * FROM long WHERE trim(category) <> ''),
grid AS (SELECT variable, category, g.g, (SELECT count(*)::DOUBLE FROM kept k WHERE k.variable = c.variable AND k.category = c.category AND k.g = g.g) AS n
         FROM (SELECT DISTINCT variable, category FROM kept) c, (SELECT DISTINCT o_orderstatus AS g FROM orders) g),
ex AS (SELECT *, sum(n) OVER (PARTITION BY variable, g) * sum(n) OVER (PARTITION BY variable, category) / sum(n) OVER (PARTITION BY variable) AS e,
         sum(n) OVER (PARTITION BY variable) AS total FROM grid)
"""


@query(
    "categorical_association",
    _CATEGORICAL_SQL + """, t AS (SELECT variable, sum(pow(n - e, 2) / e) AS x, (count(DISTINCT g) - 1) * (count(DISTINCT category) - 1) AS df,
    count(DISTINCT category) AS category_count, any_value(total) AS total, least(count(DISTINCT g), count(DISTINCT category)) - 1 AS m FROM ex GROUP BY variable),
p AS (SELECT *, CASE df WHEN 2 THEN exp(-x / 2) WHEN 8 THEN exp(-x / 2) * (1 + x / 2 + pow(x / 2, 2) / 2 + pow(x / 2, 3) / 6) END AS p FROM t),
rk AS (SELECT *, row_number() OVER (ORDER BY p) AS i, count(*) OVER () AS n FROM p),
bh AS (SELECT *, min(least(1.0, p * n / i)) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS q FROM rk)
SELECT variable, round(x, 6) AS chi_square_statistic, df AS degrees_of_freedom, round(sqrt(x / total / m), 6) AS cramers_v, category_count,
       round(p, 9) AS chi_square_p_value, round(q, 9) AS chi_square_p_value_bh FROM bh""",
)
def categorical_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, tests = ctx.categorical_association(context_orders(spark, sf_dir), "o_orderstatus", ["priority", "flag"])
    return rounded(tests, chi_square_p_value=9, chi_square_p_value_bh=9)


@query(
    "categorical_enrichment",
    _CATEGORICAL_SQL + """SELECT variable, g AS o_orderstatus, category, n::BIGINT AS observed_count, round(e, 6) AS expected_count,
       round(CASE WHEN e > 0 THEN (n - e) / sqrt(e) ELSE 0 END, 6) AS pearson_residual FROM ex""",
)
def categorical_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ctx.categorical_enrichment(context_orders(spark, sf_dir), "o_orderstatus", ["priority", "flag"]))


@query(
    "row_position",
    "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_position FROM events",
)
def row_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = st.table(spark, sf_dir, "events").select("event_id", "ts")
    return with_row_position(events, ["ts", "event_id"]).select("event_id", "row_position")
