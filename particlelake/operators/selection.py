"""Scoring and choosing clustering candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from particlelake import fixed_values as fv
from particlelake.operators.ranking import minmax_normalize
from particlelake.operators.validity import agreement_of
from particlelake.runtime import quoted


def distribution_entropy(sizes: Column) -> Column:
    """Normalised entropy of the non-noise cluster sizes; null below two clusters."""
    counts = F.transform(F.filter(sizes, lambda s: s["label"] != -1), lambda s: s["count"].cast("double"))
    total = F.aggregate(counts, F.lit(0.0), lambda a, n: a + n)
    bits = F.aggregate(counts, F.lit(0.0), lambda a, n: a - (n / total) * F.ln(n / total + F.lit(1e-12)))
    return F.when(F.size(counts) >= 2, bits / F.ln(F.size(counts).cast("double")))


def granularity_score(k: Column, lo: int = 3, hi: int = 6) -> Column:
    score = (
        F.when(k.between(lo, hi), F.lit(1.0))
        .when(k < lo, F.greatest(F.lit(0.0), 1.0 - F.lit(0.35) * (lo - k)))
        .otherwise(F.greatest(F.lit(0.0), 1.0 - F.lit(0.18) * (k - hi)))
    )
    return F.coalesce(F.when(k.isNotNull(), score), F.lit(0.0))


def exclusion_reasons(
    min_cluster_fraction: float = 0.02,
    min_repeat_ari: float = 0.95,
    min_bootstrap_ari: float = 0.95,
    max_noise_fraction: float = 0.35,
    robustness_only: Sequence[str] = ("hdbscan",),
) -> Column:
    """Comma list of the rules a candidate breaks, in fixed order."""
    low = lambda c, bound: F.coalesce(quoted(c) < bound, F.lit(True))
    rules = (
        ("fewer_than_two_clusters", F.coalesce(F.col("num_clusters"), F.lit(0)) < 2),
        ("tiny_cluster", low("smallest_cluster_fraction", min_cluster_fraction)),
        ("repeat_instability", low("repeat_mean_ari", min_repeat_ari)),
        ("bootstrap_instability", low("bootstrap_mean_ari", min_bootstrap_ari)),
        ("excessive_noise", F.coalesce(F.col("noise_fraction") > max_noise_fraction, F.lit(False))),
        ("robustness_only_method", F.col("method").isin(*robustness_only) if robustness_only else F.lit(False)),
        ("missing_internal_metric", F.col("silhouette_score").isNull() | F.col("davies_bouldin_score").isNull()),
    )
    return F.array_join(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in rules])), ",")


def score_candidates(results: DataFrame, k_range: tuple[int, int] = (3, 6), **thresholds) -> DataFrame:
    """Candidates with entropy, granularity, eligibility and composite score, best first."""
    judged = results.withColumns(
        {
            "cluster_entropy": distribution_entropy(F.col("cluster_size_distribution")),
            "granularity_score": granularity_score(F.col("num_clusters"), *k_range),
            "exclusion_reasons": exclusion_reasons(**thresholds),
        }
    ).withColumn("eligible_for_final_selection", F.col("exclusion_reasons") == "")
    pool = F.col("silhouette_score").isNotNull()
    metrics = [m for m in fv.SELECTION_WEIGHTS if m != "granularity_score"]
    filled = judged.withColumns({f"__{m}": F.coalesce(quoted(m), F.lit(0.0)) for m in metrics})
    scaled = minmax_normalize(
        filled, {f"__{m}": m != "davies_bouldin_score" for m in metrics}, prefix="normalized", rows=pool
    )
    scaled = scaled.drop(*[f"__{m}" for m in metrics]).withColumnsRenamed(
        {f"normalized__{m}": f"normalized_{m}" for m in metrics}
    )
    total = F.lit(0.0)
    for metric, weight in fv.SELECTION_WEIGHTS.items():
        part = F.col("granularity_score") if metric == "granularity_score" else quoted(f"normalized_{metric}")
        total = total + F.lit(weight) * part
    scored = scaled.withColumn("selection_score", F.coalesce(F.when(pool, total), F.lit(0.0)))
    return scored.orderBy(*best_first())


def best_first() -> list[Column]:
    return [
        F.col("eligible_for_final_selection").desc(),
        F.col("selection_score").desc(),
        F.coalesce(F.col("silhouette_score"), F.lit(-1.0)).desc(),
        F.col("candidate_id"),
    ]


def select_final(scored: DataFrame, n: int = 10, robustness_only: Sequence[str] = ("hdbscan",)) -> DataFrame:
    """Recommended candidate, the rest of the shortlist and robustness checks.

    ``role`` is recommended, shortlist or robustness_only; ``place`` counts within
    the eligible candidates.
    """
    short = scored.where("eligible_for_final_selection").orderBy(*best_first()).limit(n)
    packed = short.agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("selection_score")).alias("s"), (-F.coalesce("silhouette_score", F.lit(-1.0))).alias("t"), F.col("candidate_id").alias("candidate_id")
    ))).alias("all"))
    listed = packed.select(F.posexplode("all").alias("place", "c")).select(
        F.col("c.candidate_id").alias("candidate_id"), (F.col("place") + 1).alias("place"), (-F.col("c.s")).alias("selection_score"),
        F.when(F.col("place") == 0, F.lit("recommended")).otherwise(F.lit("shortlist")).alias("role"),
    )
    checks = scored.where(~F.col("eligible_for_final_selection") & F.col("method").isin(*robustness_only)).select(
        "candidate_id", F.lit(None).cast("int").alias("place"), "selection_score", F.lit("robustness_only").alias("role")
    )
    return listed.unionByName(checks)


def candidate_agreement(
    selected: DataFrame, assignments: DataFrame, last_place: int = 6, key: str = "image_id"
) -> DataFrame:
    """ARI and NMI of the recommended candidate with the shortlist from place 2 to ``last_place``.

    ``selected`` comes from ``select_final``; all pairs are compared in one job.
    """
    named = assignments.join(selected.where(F.col("place") <= last_place).select("candidate_id", "place"), "candidate_id")
    best = named.where("place = 1").select(key, F.col("candidate_id").alias("reference_candidate_id"), F.col("cluster_label").alias("la"))
    others = named.where("place > 1").select(
        key, F.col("candidate_id").alias("comparison_candidate_id"), F.col("cluster_label").alias("lb")
    )
    ids = ["reference_candidate_id", "comparison_candidate_id"]
    return agreement_of(best.join(others, key), ids).orderBy(F.col("adjusted_rand_index").desc(), "comparison_candidate_id")
