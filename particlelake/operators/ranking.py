"""Top-k reports, rankings and rank-based corrections.

``row_number() <= n`` filters become WindowGroupLimit, which keeps only n rows per
group and partition before the shuffle, so a group with most of the rows is safe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from particlelake import fixed_values as fv
from particlelake.functions import scalar
from particlelake.operators.order_stats import key_join, rank_counts
from particlelake.runtime import (
    HOT_GROUP_ROWS,
    cut_lineage,
    has_more_rows_than,
    melt,
    one_row,
    quoted,
)


def first_n(df: DataFrame, groups: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """The n first rows of every group in a total order, with their rank."""
    window = Window.partitionBy(*[quoted(g) for g in groups]).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def review_sample(df: DataFrame, per_bucket: int, key: str = "image_id", mode: str = "sample") -> DataFrame:
    """Rows to label by hand: the clearest of each kind and the most doubtful.

    Each bucket gives its first ``per_bucket`` rows; a row picked by an earlier
    bucket is not replaced. ``mode="all"`` keeps every row with its place.
    """
    score = F.coalesce(scalar.number(df, "roi_grid_score"), F.lit(0.0))
    confidence = F.coalesce(scalar.number(df, "roi_grid_confidence"), F.lit(0.0))
    review = F.coalesce(scalar.to_bool(quoted("roi_grid_needs_review")), F.lit(False))
    base = df.withColumns({"__score": score, "__confidence": confidence, "__review": review})
    if mode == "all":
        return base.orderBy("__score", quoted(key)).drop("__score", "__confidence", "__review")
    label = F.col("roi_grid_label")
    # (bucket, membership, sort value ascending)
    entries = F.array_compact(
        F.array(
            F.when(label == "no_grid", F.struct(F.lit(1).alias("bucket"), F.col("__score").alias("by"))),
            F.when(label == "grid", F.struct(F.lit(2).alias("bucket"), (-F.col("__score")).alias("by"))),
            F.when(
                (label == "uncertain") | F.col("__review"),
                F.struct(F.lit(3).alias("bucket"), F.abs(F.col("__score") - fv.GRID_CENTRE_SCORE).alias("by")),
            ),
        )
    )
    tagged = base.withColumn("__e", F.explode(entries)).withColumns(
        {"__bucket": F.col("__e.bucket"), "__by": F.col("__e.by")}
    ).drop("__e")
    picked = first_n(
        tagged, ["__bucket"], [F.col("__by"), F.col("__confidence").desc(), quoted(key)], per_bucket, "__rank"
    )
    kept = first_n(picked, [key], [F.col("__bucket")], 1, "__once")
    return kept.withColumns({"bucket": F.col("__bucket"), "rank_in_bucket": F.col("__rank")}).drop(
        *[c for c in kept.columns if c.startswith("__")]
    )


def cluster_centroids(df: DataFrame, features: Sequence[str], label: str = "cluster_label") -> DataFrame:
    """Mean of every feature per cluster; combines map-side."""
    return df.groupBy(quoted(label)).agg(*[F.avg(quoted(f)).alias(f"__c_{f}") for f in features])


def squared_distance(features: Sequence[str], prefix: str = "__c_") -> Column:
    total = F.lit(0.0)
    for f in features:
        gap = quoted(f) - quoted(f"{prefix}{f}")
        total = total + gap * gap
    return total


def with_centroid_distance(df: DataFrame, features: Sequence[str], label: str = "cluster_label") -> DataFrame:
    """Distance to the own cluster's mean for all non-noise rows."""
    members = df.where(quoted(label) != -1)
    centroids = cluster_centroids(members, features, label)
    return (
        members.join(centroids, label)
        .withColumn("distance_to_cluster_centroid", F.sqrt(squared_distance(features)))
        .drop(*[f"__c_{f}" for f in features])
    )


def representatives(
    df: DataFrame, features: Sequence[str], n: int, label: str = "cluster_label", key: str = "image_id"
) -> DataFrame:
    """The n rows nearest to each cluster mean."""
    measured = with_centroid_distance(df, features, label).drop(*features)
    return first_n(measured, [label], [F.col("distance_to_cluster_centroid"), quoted(key)], n, "rank_in_cluster")


def borderline(silhouettes: DataFrame, n: int, label: str = "cluster_label", key: str = "image_id") -> DataFrame:
    """The n lowest silhouettes of each cluster."""
    return first_n(silhouettes, [label], [F.col("silhouette_value"), quoted(key)], n, "rank_within_cluster")


def pairwise_differences(profile: DataFrame, features: Sequence[str], n: int, label: str = "cluster_label") -> DataFrame:
    """Largest standardised median gaps for every pair of clusters."""
    long = melt(profile, [quoted(label)], {f: quoted(f) for f in features}, "feature", "value")
    ordinal = {f: i for i, f in enumerate(features)}
    place = F.create_map(*[F.lit(x) for pair in ordinal.items() for x in pair])
    left = long.select(quoted(label).alias("cluster_a"), "feature", F.col("value").alias("value_a"))
    right = long.select(quoted(label).alias("cluster_b"), F.col("feature").alias("feature_b"), F.col("value").alias("value_b"))
    pairs = left.join(right, (F.col("feature") == F.col("feature_b")) & (F.col("cluster_a") < F.col("cluster_b")))
    delta = F.col("value_a") - F.col("value_b")
    gaps = pairs.withColumn("standardized_median_delta", delta)
    ranked = first_n(
        gaps, ["cluster_a", "cluster_b"], [F.abs("standardized_median_delta").desc(), place[F.col("feature")]], n
    )
    return ranked.select(
        "cluster_a", "cluster_b", "rank", "feature", "standardized_median_delta",
        F.when(F.col("standardized_median_delta") > 0, F.col("cluster_a")).otherwise(F.col("cluster_b")).alias("higher_cluster"),
    )


def benjamini_hochberg(
    df: DataFrame, p: str, output: str, within: Sequence[str] = (), large: bool | None = None
) -> DataFrame:
    """Adjusted p-values; nulls stay null and are not counted.

    A table with one row per tested column is small and takes one window
    (``large=False``); otherwise the size is checked and a large table of tests is
    ranked in ranges, with the running minimum carried from range to range.
    """
    if large is None:
        large = has_more_rows_than(df, HOT_GROUP_ROWS)
    return _adjusted_in_ranges(df, p, output, within) if large else _adjusted_in_window(df, p, output, within)


def _adjusted_in_window(df: DataFrame, p: str, output: str, within: Sequence[str]) -> DataFrame:
    groups = [quoted(c) for c in within]
    tested = quoted(p).isNotNull()
    by_rank = Window.partitionBy(*groups, tested).orderBy(quoted(p))
    everyone = Window.partitionBy(*groups, tested)
    # a frame that grows is one pass; one that shrinks is read anew for every row
    downward = everyone.orderBy(quoted(p).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    scaled = quoted(p) * F.count(F.lit(1)).over(everyone) / F.row_number().over(by_rank)
    return (
        df.withColumn("__scaled", F.when(tested, F.least(F.lit(1.0), scaled)))
        .withColumn(output, F.when(tested, F.min("__scaled").over(downward)))
        .drop("__scaled")
    )


def _adjusted_in_ranges(df: DataFrame, p: str, output: str, within: Sequence[str]) -> DataFrame:
    """Equal p-values share the result of their highest rank, so one row per value is enough."""
    keys = list(within)
    counts = df.where(quoted(p).isNotNull()).groupBy(*[quoted(k) for k in keys], quoted(p)).agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(*[quoted(k) for k in keys]).agg(F.sum("n").alias("__tests"))
    ranked = key_join(rank_counts(counts, keys, p), totals, keys) if keys else rank_counts(counts, keys, p).withColumn(
        "__tests", one_row(totals)["__tests"]
    )
    scaled = F.least(F.lit(1.0), quoted(p) * F.col("__tests") / (F.col("rows_below") + F.col("n")))
    ranged = cut_lineage(
        ranked.select(*[quoted(k) for k in keys], quoted(p), scaled.alias("__scaled"))
        .repartitionByRange(*[quoted(k) for k in keys], quoted(p))
        .withColumn("__range", F.spark_partition_id())
    )
    later = Window.partitionBy(*keys).orderBy("__range").rowsBetween(1, Window.unboundedFollowing)
    beyond = (
        ranged.groupBy(*keys, "__range").agg(F.min("__scaled").alias("__least"))
        .select(*keys, "__range", F.coalesce(F.min("__least").over(later), F.lit(1.0)).alias("__beyond"))
    )
    inside = Window.partitionBy(*keys, "__range").orderBy(quoted(p).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumn("__local", F.min("__scaled").over(inside))
    adjusted = key_join(local, beyond, [*keys, "__range"]).select(
        *[quoted(k) for k in keys], quoted(p), F.least("__local", "__beyond").alias(output)
    )
    return key_join(df, adjusted, [*keys, p], "left")


RANKED_METRICS = {
    "top_by_silhouette": ("silhouette_score", True),
    "top_by_calinski_harabasz": ("calinski_harabasz_score", True),
    "top_by_davies_bouldin": ("davies_bouldin_score", False),
    "top_by_repeat_stability": ("repeat_mean_ari", True),
    "top_by_bootstrap_stability": ("bootstrap_mean_ari", True),
}


def benchmark_rankings(results: DataFrame, n: int = 10, key: str = "candidate_id") -> DataFrame:
    """Five rankings of the candidates that have at least two clusters."""
    usable = results.where(F.coalesce(F.col("num_clusters"), F.lit(0)) >= 2)
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("ranking"),
                quoted(metric).alias("value"),
                (-quoted(metric) if descending else quoted(metric)).alias("__by"),
            )
            for name, (metric, descending) in RANKED_METRICS.items()
        ]
    )
    long = usable.select("*", F.explode(entries).alias("__e")).select(*usable.columns, "__e.*").where("value IS NOT NULL")
    return first_n(long, ["ranking"], [F.col("__by"), quoted(key)], n).drop("__by")


def top_loadings(loadings: DataFrame, components: Sequence[str], n: int, feature: str = "feature") -> DataFrame:
    """Per component the features with the largest absolute loading."""
    long = melt(loadings, [quoted(feature)], {c: quoted(c) for c in components}, "component", "loading")
    return first_n(long, ["component"], [F.abs("loading").desc(), quoted(feature)], n)


def minmax_normalize(
    df: DataFrame, columns: dict[str, bool], prefix: str = "normalized_", rows: Column | None = None
) -> DataFrame:
    """(v - min) / (max - min), inverted where higher is worse; constant reads 1.

    Bounds come from the rows that satisfy ``rows`` (all by default); the other
    rows stay null.
    """
    scope = df if rows is None else df.where(rows)
    bounds = one_row(
        scope.agg(
            *[F.min(quoted(c)).alias(f"lo_{c}") for c in columns], *[F.max(quoted(c)).alias(f"hi_{c}") for c in columns]
        )
    )
    # one subquery column, read field by field, instead of one subquery per field
    bounded = df.withColumn("__bounds", bounds)
    added = {}
    for c, higher in columns.items():
        lo, hi = F.col("__bounds")[f"lo_{c}"], F.col("__bounds")[f"hi_{c}"]
        share = (quoted(c) - lo if higher else hi - quoted(c)) / (hi - lo)
        close = F.abs(hi - lo) <= 1e-9 * F.greatest(F.abs(hi), F.abs(lo))
        value = F.when(close, F.lit(1.0)).otherwise(share)
        value = F.when(quoted(c).isNotNull(), value)
        added[f"{prefix}{c}"] = value if rows is None else F.when(rows, value)
    return bounded.withColumns(added).drop("__bounds")
