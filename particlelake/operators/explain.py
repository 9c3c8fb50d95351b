"""Profiles, discrimination, descriptions and positions of clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from particlelake import fixed_values as fv
from particlelake.functions import scalar
from particlelake.operators.context import kruskal_wallis
from particlelake.operators.order_stats import aggregate_with_percentiles
from particlelake.operators.ranking import benjamini_hochberg
from particlelake.runtime import HOT_GROUP_ROWS, melt, one_row, quoted


def _long(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    numbers = {f: quoted(f).cast("double") for f in features}
    return melt(df, [quoted(label).alias("cluster_label")], numbers, "feature", "value")


def _global_stats(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(feature, global_mean, global_std) over all rows, noise included."""
    return _long(df, features, label).groupBy("feature").agg(
        F.avg("value").alias("global_mean"),
        F.coalesce(F.nullif(F.stddev_pop("value"), F.lit(0.0)), F.lit(1.0)).alias("global_std"),
    )


def cluster_profiles(
    df: DataFrame, features: Sequence[str], label: str = "cluster_label", hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Long profile of the non-noise clusters: mean, median and standardised median.

    Standardisation uses the mean and population std of all rows, noise included.
    """
    stats = aggregate_with_percentiles(
        _long(df.where(quoted(label) != -1), features, label),
        ["feature", "cluster_label"],
        {"value": {"median": 0.5}},
        [F.count(F.lit(1)).alias("count"), F.avg("value").alias("mean")],
        hot_rows=hot_rows,
    )
    total = one_row(df.agg(F.count(F.lit(1)).alias("n")))["n"]
    return stats.join(_global_stats(df, features, label), "feature").select(
        "cluster_label",
        "count",
        (F.col("count") / total).alias("fraction"),
        "feature",
        "mean",
        "median",
        ((F.col("median") - F.col("global_mean")) / F.col("global_std")).alias("standardized"),
    )


def profile_table(profiles: DataFrame, value: str, features: Sequence[str]) -> DataFrame:
    """One row per cluster with a column per feature of the chosen value."""
    return profiles.groupBy("cluster_label", "count", "fraction").pivot("feature", list(features)).agg(F.first(quoted(value)))


def feature_discrimination(
    df: DataFrame, features: Sequence[str], label: str = "cluster_label", hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Eta squared, Kruskal-Wallis and ranges of cluster means and medians."""
    members = df.where(quoted(label) != -1)
    groups = aggregate_with_percentiles(
        _long(members, features, label),
        ["feature", "cluster_label"],
        {"value": {"median": 0.5}},
        [F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("variance")],
        hot_rows=hot_rows,
    )
    centre = groups.groupBy("feature").agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("pooled_mean"))
    joined = groups.join(centre, "feature").join(_global_stats(df, features, label), "feature")
    off = F.col("mean") - F.col("pooled_mean")
    shift = F.col("mean") - F.col("global_mean")
    summary = joined.groupBy("feature").agg(
        F.sum(F.col("n") * (F.col("variance") + off * off)).alias("ss_total"),
        F.sum(F.col("n") * shift * shift).alias("ss_between"),
        (F.max("mean") - F.min("mean")).alias("cluster_mean_range"),
        (F.max("median") - F.min("median")).alias("cluster_median_range"),
    )
    eta = F.when(F.col("ss_total") > 0, F.col("ss_between") / F.col("ss_total")).otherwise(0.0)
    tests = kruskal_wallis(members, label, features, hot_rows).select(
        F.col("variable").alias("feature"), "kruskal_wallis_statistic", "kruskal_wallis_p_value"
    )
    result = summary.join(tests, "feature", "left").select(
        "feature", eta.alias("eta_squared"), "kruskal_wallis_statistic", "kruskal_wallis_p_value",
        "cluster_mean_range", "cluster_median_range",
    )
    adjusted = benjamini_hochberg(result, "kruskal_wallis_p_value", "kruskal_wallis_p_value_bh", large=False)
    return adjusted.orderBy(
        F.col("eta_squared").desc(), F.coalesce("kruskal_wallis_statistic", F.lit(0.0)).desc(), "feature"
    )


def _phrases(columns: Sequence[str]) -> Column:
    parts = [
        F.when(quoted(f) >= t, F.lit(phrase)) for f, phrase, t in fv.HIGH_PHRASES if f in columns
    ] + [F.when(quoted(f) <= -t, F.lit(phrase)) for f, phrase, t in fv.LOW_PHRASES if f in columns]
    return F.array_distinct(F.array_compact(F.array(*parts))) if parts else F.array().cast("array<string>")


def signed_text(value: Column, digits: int = 2) -> Column:
    return F.format_string(f"%+.{digits}f", value)


def _signature(features: Sequence[str], highest: bool, n: int = 4) -> Column:
    entries = F.array(
        *[
            F.struct((-quoted(f) if highest else quoted(f)).alias("by"), F.lit(i).alias("ord"), F.lit(f).alias("name"), quoted(f).alias("z"))
            for i, f in enumerate(features)
        ]
    )
    top = F.slice(F.array_sort(entries), 1, n)
    return F.array_join(F.transform(top, lambda e: F.concat(e["name"], F.lit(" (z="), signed_text(e["z"]), F.lit(")"))), "; ")


def cluster_descriptions(profile: DataFrame, features: Sequence[str]) -> DataFrame:
    """Phrases and top signatures of each standardised profile."""
    phrases = _phrases([f for f in features])
    summary = F.when(F.size(phrases) > 0, F.array_join(phrases, ", ")).otherwise(F.lit(fv.DEFAULT_PHRASE))
    return profile.select(
        "cluster_label", "count", "fraction", summary.alias("morphology_summary"),
        _signature(features, True).alias("top_positive_signature"),
        _signature(features, False).alias("top_negative_signature"),
    )


def projection_positions(
    points: DataFrame, label: str = "cluster_label", x: str = "PC1", y: str = "PC2", hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """Centre, spread and distances to the centre of each cluster in two axes."""
    members = points.where(quoted(label) != -1).select(
        quoted(label).alias("cluster_label"), scalar.finite(quoted(x)).alias("x"), scalar.finite(quoted(y)).alias("y")
    )
    centres = members.groupBy("cluster_label").agg(
        F.count(F.lit(1)).alias("count"), F.avg("x").alias("pc1_mean"), F.avg("y").alias("pc2_mean"),
        F.stddev_pop("x").alias("pc1_std"), F.stddev_pop("y").alias("pc2_std"),
    )
    dx, dy = F.col("x") - F.col("pc1_mean"), F.col("y") - F.col("pc2_mean")
    measured = members.join(centres, "cluster_label").select("cluster_label", F.sqrt(dx * dx + dy * dy).alias("d"))
    spread = aggregate_with_percentiles(
        measured, ["cluster_label"], {"d": {"p90_distance_to_pca_centroid": 0.9}},
        [F.avg("d").alias("mean_distance_to_pca_centroid")], hot_rows=hot_rows,
    )
    return centres.join(spread, "cluster_label")
