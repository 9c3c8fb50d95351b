"""Source-category scores of profiles, images and clusters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from particlelake import fixed_values as fv
from particlelake.functions import scalar
from particlelake.operators.explain import signed_text
from particlelake.operators.joins import upsert
from particlelake.operators.records import backfill_candidates
from particlelake.runtime import quoted

Weights = Mapping[str, Mapping[str, float]]


def _contributions(z: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Available (feature, z, weight, contribution) entries, largest effect first."""
    entries = [
        F.when(
            z[f].isNotNull(),
            F.struct(
                (-F.abs(z[f] * F.lit(w))).alias("by"), F.lit(i).alias("ord"), F.lit(f).alias("feature"),
                z[f].alias("z"), F.lit(w).alias("weight"), (z[f] * F.lit(w)).alias("contribution"),
            ),
        )
        for i, (f, w) in enumerate(weights.items())
        if f in z
    ]
    kind = "array<struct<by:double,ord:int,feature:string,z:double,weight:double,contribution:double>>"
    if not entries:
        return F.array().cast(kind)
    return F.array_sort(F.array_compact(F.array(*entries)))


def _score(z: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    total = F.lit(0.0)
    for f, w in weights.items():
        if f in z:
            total = total + F.coalesce(z[f] * F.lit(w), F.lit(0.0))
    return total


def _public(contributions: Column) -> Column:
    return F.transform(
        contributions,
        lambda e: F.struct(e["feature"].alias("feature"), e["z"].alias("z"), e["weight"].alias("weight"), e["contribution"].alias("contribution")),
    )


def taxonomy_scores(profile: DataFrame, keep: Sequence[str], weights: Weights = fv.TAXONOMY_WEIGHTS) -> DataFrame:
    """One row per profile and category with its score and ordered contributions.

    Profiles already hold standardised values; a missing feature adds nothing.
    """
    names = {f for w in weights.values() for f in w if f in profile.columns}
    z = {f: scalar.finite(quoted(f)) for f in names}
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"), F.lit(i).alias("category_ord"), _score(z, w).alias("score"),
                _public(_contributions(z, w)).alias("contributions"),
            )
            for i, (c, w) in enumerate(weights.items())
        ]
    )
    return profile.select(*[quoted(k) for k in keep], F.inline(entries))


def taxonomy_rank(
    features: DataFrame,
    columns: Sequence[str],
    reference: Mapping[str, tuple[float, float]] | None = None,
    temperature: float = fv.SOFTMAX_TEMPERATURE,
    weights: Weights = fv.TAXONOMY_WEIGHTS,
    keep: Sequence[str] = ("image_id",),
) -> DataFrame:
    """Ranked categories of every row, all by column arithmetic.

    Values are standardised with ``reference`` (mean, std); an unknown column uses
    0 and 1. Percentages are a softmax; ties follow the category order. A row
    without any number gets an error status.
    """
    known = fv.REFERENCE_STATS if reference is None else reference
    numeric = [c for c in columns if c in features.columns]
    used = sorted({f for w in weights.values() for f in w if f in numeric})
    parse = lambda c: scalar.number(features, c, "taxonomy")
    count = F.lit(0)
    for c in numeric:
        count = count + F.when(parse(c).isNotNull(), 1).otherwise(0)
    staged = features.select(
        *[quoted(k) for k in keep],
        count.alias("feature_count"),
        *[((parse(f) - F.lit(known.get(f, (0.0, 1.0))[0])) / F.lit(known.get(f, (0.0, 1.0))[1])).alias(f"__z_{f}") for f in used],
    )
    z = {f: F.col(f"__z_{f}") for f in used}
    heat = temperature if temperature > 0 else 1.0
    names = list(weights)
    scored = staged.withColumns({f"__s_{c}": _score(z, weights[c]) for c in names})
    highest = F.greatest(*[F.col(f"__s_{c}") / F.lit(heat) for c in names])
    warm = scored.withColumn("__top", highest).withColumns(
        {f"__e_{c}": F.exp(F.col(f"__s_{c}") / F.lit(heat) - F.col("__top")) for c in names}
    )
    total = sum((F.col(f"__e_{c}") for c in names[1:]), F.col(f"__e_{names[0]}"))
    ranked = F.array_sort(
        F.array(
            *[
                F.struct(
                    (-(F.col(f"__e_{c}") * 100.0 / F.col("__sum"))).alias("by"),
                    F.lit(i).alias("ord"),
                    F.lit(c).alias("category"),
                    F.lit(fv.TAXONOMY_LABELS.get(c, c)).alias("label"),
                    F.col(f"__s_{c}").alias("score"),
                    (F.col(f"__e_{c}") * 100.0 / F.col("__sum")).alias("percentage"),
                    F.slice(_public(_contributions(z, weights[c])), 1, fv.EVIDENCE_COUNT).alias("evidence"),
                )
                for i, c in enumerate(names)
            ]
        )
    )
    out = warm.withColumn("__sum", total).withColumn("__ranked", ranked)
    good = F.col("feature_count") > 0
    listed = F.transform("__ranked", lambda e: e.dropFields("by", "ord"))
    return out.select(
        *[quoted(k) for k in keep],
        F.when(good, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
        F.when(~good, F.lit(fv.NO_NUMERIC_FEATURE_MESSAGE)).alias("message"),
        F.when(good, F.col("__ranked")[0]["category"]).alias("top_category"),
        F.when(good, F.col("__ranked")[0]["label"]).alias("top_category_label"),
        F.when(good, listed).alias("ranked_categories"),
        "feature_count",
        F.array_compact(F.array(*[F.when(z[f].isNotNull(), F.lit(f)) for f in used])).alias("used_formula_features"),
    )


def taxonomy_suggestions(
    profile: DataFrame,
    weights: Weights = fv.TAXONOMY_WEIGHTS,
    min_primary_score: float = 0.5,
    ambiguity_gap: float = 0.25,
    key: str = "cluster_label",
    descriptions: DataFrame | None = None,
) -> DataFrame:
    """Primary and secondary category of each cluster, its confidence and evidence."""
    names = {f for w in weights.values() for f in w if f in profile.columns}
    z = {f: scalar.finite(quoted(f)) for f in names}
    place = {c: [(-_score(z, w)).alias("by"), F.lit(i).alias("ord")] for i, (c, w) in enumerate(weights.items())}
    listed = {c: F.struct(*place[c], _public(_contributions(z, w)).alias("contributions")) for c, w in weights.items()}
    # two places of a row are all that its cluster's two best need; entries travel for the named categories only
    best = F.slice(F.array_sort(F.array(*[F.struct(*p) for p in place.values()])), 1, 2).alias("best")
    leading = (F.array_min(F.array(*listed.values())) if len(listed) > 1 else next(iter(listed.values()))).alias("leading")
    fallback = [listed[c].alias("fallback") for c in listed if c == fv.FALLBACK_CATEGORY]
    packed = profile.select(quoted(key), best, leading, *fallback).groupBy(quoted(key)).agg(
        F.sort_array(F.flatten(F.collect_list("best"))).alias("places"),
        F.min("leading").alias("leading"), *[F.min("fallback").alias("fallback") for _ in fallback],
    )
    categories = F.array(*[F.lit(c) for c in weights])
    named = F.transform("places", lambda e: F.struct(F.get(categories, e["ord"]).alias("category"), (-e["by"]).alias("score")))
    packed = packed.withColumn("all", named)
    first, second = F.col("all")[0], F.col("all")[1]
    gap = first["score"] - second["score"]
    primary = F.when(
        (first["score"] < min_primary_score) | (gap < ambiguity_gap), F.lit(fv.FALLBACK_CATEGORY)
    ).otherwise(first["category"])
    confidence = (
        F.when((first["score"] < 0.5) | (gap < 0.25), F.lit("low"))
        .when((first["score"] >= 1.5) & (gap >= 0.8), F.lit("high"))
        .otherwise(F.lit("moderate"))
    )
    chosen = packed.withColumns({"primary_category": primary, "score_gap": gap, "confidence": confidence})
    own = F.when(F.col("primary_category") == first["category"], F.col("leading")["contributions"])
    if fallback:
        own = own.when(F.col("primary_category") == fv.FALLBACK_CATEGORY, F.col("fallback")["contributions"])
    evidence = F.array_join(
        F.transform(
            F.slice(own, 1, fv.EVIDENCE_COUNT),
            lambda e: F.concat(
                F.when(e["z"] >= 0, F.lit("higher ")).otherwise(F.lit("lower ")), e["feature"], F.lit(" (z="),
                signed_text(e["z"]), F.lit(", score="), signed_text(e["contribution"]), F.lit(")"),
            ),
        ),
        "; ",
    )
    out = chosen.select(
        quoted(key), "primary_category", first["score"].alias("primary_score"), second["category"].alias("secondary_category"),
        second["score"].alias("secondary_score"), "score_gap", "confidence", evidence.alias("evidence_summary"),
    )
    if descriptions is not None:
        texts = descriptions.select(quoted(key), "morphology_summary")
        out = out.join(texts, key, "left").withColumn("morphology_summary", F.coalesce("morphology_summary", F.lit("")))
    return out


def compare_assignments(
    assignments: DataFrame, ranked: DataFrame, suggestions: DataFrame, key: str = "image_id", label: str = "cluster_label"
) -> DataFrame:
    """Row-level comparison of the cluster's category with the direct ranking.

    ``skip_reason`` is null for compared rows; the first failing check names it.
    """
    base = assignments.where(scalar.non_blank(quoted(key).cast("string")).isNotNull()).select(
        quoted(key), quoted(label), F.coalesce(scalar.to_bool(quoted("noise_flag")), F.lit(False)).alias("__noise")
    )
    direct = ranked.select(quoted(key), F.col("status").alias("__status"), F.col("message").alias("__message"), "ranked_categories")
    taxonomy = suggestions.select(quoted(label), F.col("primary_category").alias("cluster_primary_category"), F.col("confidence").alias("cluster_confidence"))
    joined = base.join(direct, key, "left").join(taxonomy, label, "left")
    ranks = F.col("ranked_categories")
    assigned = F.filter(ranks, lambda e: e["category"] == F.col("cluster_primary_category"))[0]
    reason = (
        F.when(F.col("__noise"), F.lit("noise_row"))
        .when(F.col("__status").isNull(), F.lit("missing_feature_row"))
        .when(F.col("cluster_primary_category").isNull(), F.concat(F.lit("missing_cluster_taxonomy:"), quoted(label)))
        .when(F.col("__status") != "ok", F.col("__message"))
    )
    used = reason.isNull()
    return joined.select(
        quoted(key), quoted(label), reason.alias("skip_reason"),
        F.when(used, F.col("cluster_primary_category")).alias("cluster_primary_category"),
        F.when(used, F.col("cluster_confidence")).alias("cluster_confidence"),
        F.when(used, ranks[0]["category"]).alias("temp_top_category"),
        F.when(used, ranks[0]["percentage"]).alias("temp_top_percentage"),
        F.when(used, ranks[1]["category"]).alias("temp_second_category"),
        F.when(used, ranks[1]["percentage"]).alias("temp_second_percentage"),
        F.when(used, F.coalesce(assigned["percentage"], F.lit(0.0))).alias("cluster_assigned_percentage_in_temp"),
        F.when(used, F.coalesce(assigned["score"], F.lit(0.0))).alias("cluster_assigned_score_in_temp"),
        F.when(used, ranks[0]["category"] == F.col("cluster_primary_category")).alias("agreement"),
    )


def _top_counts(compared: DataFrame, label: str, categories: Sequence[str]) -> DataFrame:
    """Counts of the direct category per cluster, one column set per cluster row."""
    used = compared.where(F.col("skip_reason").isNull())
    return used.groupBy(quoted(label), "cluster_primary_category", "cluster_confidence").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.count_if("agreement").alias("agreement_count"),
        F.avg("cluster_assigned_percentage_in_temp").alias("mean_cluster_assigned_percentage_in_temp"),
        F.avg("temp_top_percentage").alias("mean_temp_top_percentage"),
        F.array(
            *[
                F.struct(F.count_if(F.col("temp_top_category") == c).alias("n"), F.lit(-i).alias("ord"), F.lit(c).alias("category"))
                for i, c in enumerate(categories)
            ]
        ).alias("__counts"),
    )


def consistency_clusters(compared: DataFrame, label: str = "cluster_label", categories: Sequence[str] = tuple(fv.TAXONOMY_WEIGHTS)) -> DataFrame:
    """Agreement and dominant direct category per cluster."""
    top = F.array_max("__counts")
    return _top_counts(compared, label, categories).select(
        quoted(label), "cluster_primary_category", "cluster_confidence", "row_count", "agreement_count",
        (F.col("agreement_count") / F.col("row_count")).alias("agreement_rate"),
        top["category"].alias("dominant_temp_category"),
        top["n"].alias("dominant_temp_category_count"),
        (top["n"] / F.col("row_count")).alias("dominant_temp_category_fraction"),
        "mean_cluster_assigned_percentage_in_temp", "mean_temp_top_percentage",
    )


def consistency_grid(compared: DataFrame, label: str = "cluster_label", categories: Sequence[str] = tuple(fv.TAXONOMY_WEIGHTS)) -> DataFrame:
    """Cluster x category counts with zeros."""
    counts = _top_counts(compared, label, categories)
    return counts.select(quoted(label), "cluster_primary_category", "row_count", F.inline("__counts")).select(
        quoted(label), "cluster_primary_category", F.col("category").alias("temp_top_category"), F.col("n").alias("count"),
        (F.col("n") / F.col("row_count")).alias("fraction_within_cluster"),
    )


def consistency_summary(compared: DataFrame, key: str = "image_id", examples: int = 20) -> DataFrame:
    """Overall counts, rates and a few skipped examples in one row."""
    used = F.col("skip_reason").isNull()
    skipped = compared.where(~used).select(quoted(key).cast("string").alias("id"), "skip_reason").orderBy("id").limit(examples)
    listed = skipped.agg(F.sort_array(F.collect_list(F.struct("id", "skip_reason"))).alias("all")).select(F.struct("all")).scalar()["all"]
    return compared.agg(
        F.count_if(used).alias("row_count_compared"),
        F.count_if(~used).alias("row_count_skipped"),
        F.avg(F.when(used, F.col("agreement").cast("double"))).alias("overall_agreement_rate"),
        F.avg("cluster_assigned_percentage_in_temp").alias("mean_cluster_assigned_percentage_in_temp"),
        F.avg("temp_top_percentage").alias("mean_temp_top_percentage"),
    ).withColumn("skipped_examples", listed)


def backfill_taxonomy(
    records: DataFrame,
    ranked: DataFrame,
    key: str = "id",
    taxonomy: str = "taxonomy",
    image: str = "image",
    force: bool = False,
    skip: int = 0,
    limit: int = 0,
    dry_run: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(records after the update, one-row counts) for records that lack a taxonomy.

    A candidate without a blank-free image or ranking is skipped; one whose
    ranking failed counts as failed. A dry run returns the records unchanged.
    """
    candidates = backfill_candidates(records, image, taxonomy, (key,), force, skip, limit)
    model = F.struct("status", "top_category", "top_category_label", "ranked_categories", "feature_count", "used_formula_features")
    # rankings are wide: only those of candidates are made and moved
    asked = ranked.join(candidates.select(quoted(key)).distinct(), key, "left_semi")
    found = asked.select(quoted(key), F.col("status").alias("__status"), model.alias("__model"))
    joined = candidates.join(found, key, "left")
    blank = scalar.non_blank(F.trim(quoted(image))).isNull()
    outcome = (
        F.when(blank | F.col("__status").isNull(), F.lit("skipped"))
        .when(F.col("__status") != "ok", F.lit("failed"))
        .otherwise(F.lit("updated"))
    )
    judged = joined.withColumn("__outcome", outcome)
    counts = judged.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(F.col("__outcome") == "updated").alias("updated"),
        F.count_if(F.col("__outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("__outcome") == "failed").alias("failed"),
    )
    if dry_run:
        return records, counts
    updates = judged.where(F.col("__outcome") == "updated").select(quoted(key), F.to_json("__model").alias(taxonomy))
    return upsert(records, updates, key, [taxonomy], insert=False).drop("action"), counts
