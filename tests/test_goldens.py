"""Published numbers recomputed by the operators."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from particlelake import fixed_values as fv
from particlelake.functions.tails import chi2_upper_tail
from particlelake.operators import context, explain, preprocess, ranking, selection, taxonomy
from particlelake.operators.cluster.reduction import retained_components
from particlelake.operators.particles import particle_summaries
from particlelake.operators.records import temporal_features

# one measured image: areas and orientations of its 36 particles
AREAS = [
    16, 22, 23, 11, 1, 1, 76, 10, 10, 16, 9, 14, 174, 4, 4, 4, 2, 9, 3, 18, 16, 3, 11, 13, 66, 12, 9, 3, 3, 10, 43, 124, 5,
    8, 1, 206,
]
ORIENTATIONS = [
    0.2581653536457651, 1.5707963267948966, 0.11371238038081662, 1.307763117296515, -0.7853981633974483,
    -0.7853981633974483, 0.07038740695906727, 0.0, 1.5707963267948966, 0.0, 1.2164831907310614, -0.42512109547532756,
    -0.03129771922267968, -0.7853981633974483, -0.3217505543966422, -0.7853981633974483, 1.5707963267948966,
    -0.7853981633974483, 0.0, 0.4429875404261481, 1.5707963267948966, 0.0, -0.26303320949838166, 0.7853981633974483,
    1.0489028788813446, -1.4064408273784121, -0.3543131360638352, 0.7853981633974483, -0.7853981633974483, 0.0,
    0.02419718968232996, -0.3329496229586277, -0.7853981633974483, 1.5707963267948966, -0.7853981633974483,
    -0.676991549476398,
]

# standardised medians of two published clusters
PROFILE_FEATURES = (
    "num_particles", "mean_pixel_intensity", "orientation_entropy", "circular_variance", "area_median", "area_iqr",
    "solidity_median", "solidity_iqr", "solidity_p90", "aspect_ratio_median", "aspect_ratio_iqr", "aspect_ratio_p90",
    "feret_iqr", "feret_p90", "eccentricity_iqr", "eccentricity_p90", "circularity_median", "circularity_iqr",
    "circularity_p90", "mean_intensity_median", "mean_intensity_iqr", "mean_intensity_p90",
)
PROFILES = (
    (1, 1335, 0.52046783625731,
     -0.10024624363521127, 0.5393531765332926, 0.22731246286974788, 0.2568003684435344, -0.34434791958319305,
     0.08758873018882694, 0.15511499638692336, -0.43186725363884393, 0.0, 0.6466338877402612, 0.6538715325392152,
     0.058423459935696864, 0.21436423446520295, -0.11863300645429764, 0.4471739205156408, 0.2839531716589019,
     -0.800929417008174, 0.6351829159536377, -0.027264126889236802, 0.33124314434395213, 0.3439729298058978,
     0.26040539311943117),
    (2, 550, 0.21442495126705652,
     0.510570234014344, 0.41824837787766256, -1.1936030481346738, -1.1643361856986805, -1.1893958654177923,
     -1.3042109620990348, 0.15511499638692336, -0.43186725363884393, 0.0, -1.7759141665712934, 0.6538715325392152,
     -0.9675656894205669, -1.070858825721251, -0.9536040876297603, 0.37405521658486657, 0.2839531716589019,
     -0.800929417008174, -1.7974478267300054, -0.15915776488786526, 1.0172437581998286, -0.07733252473786136,
     0.26040539311943117),
)

# observed counts of a published season x cluster table (clusters 1-4)
SEASONS = {
    "spring": (366, 941, 203, 141), "summer": (0, 1, 1, 0), "autumn": (1, 12, 30, 1), "winter": (67, 256, 39, 23),
}


@pytest.fixture(scope="module")
def profile(spark):
    schema = "cluster_label int, count long, fraction double, " + ", ".join(f"{f} double" for f in PROFILE_FEATURES)
    return spark.createDataFrame(list(PROFILES), schema)


def test_particle_summary_of_one_image(spark):
    rows = [("i", float(a), o, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0) for a, o in zip(AREAS, ORIENTATIONS)]
    names = [c for c in fv.PARTICLE_FAMILIES if c != "area_px"]
    df = spark.createDataFrame(rows, "image_id string, area_px double, orientation_rad double, " + ", ".join(f"{c} double" for c in names))
    for hot_rows in (5_000_000, 1):
        r = particle_summaries(df, hot_rows=hot_rows).first()
        assert r["num_particles"] == 36
        assert r["orientation_entropy"] == pytest.approx(3.215354779870082, rel=1e-12)
        assert r["circular_variance"] == pytest.approx(0.7394831345420236, rel=1e-12)
        assert (r["area_median"], r["area_iqr"], r["area_p25"], r["area_p75"], r["area_p90"]) == (10, 12.5, 4, 16.5, 71)
        assert r["area_mean"] == pytest.approx(26.666666666666668, rel=1e-14)
        assert r["area_std"] == pytest.approx(46.561786907291264, rel=1e-14)


def test_season_of_a_capture_date(spark):
    r = temporal_features(spark.createDataFrame([("2025-11-18",)], "capture_datetime string")).first()
    assert (r["capture_month"], r["capture_season"], r["season_autumn"]) == (11, "autumn", 1.0)
    assert r["capture_month_sin"] == pytest.approx(-0.8660254037844386, rel=1e-12)
    assert r["capture_month_cos"] == pytest.approx(0.5, rel=1e-12)


@pytest.mark.parametrize(
    "statistic, df, expected",
    [
        (1213.8210124799436, 3, 7.353445332610443e-263),
        (388.7175195445573, 3, 6.15082272375159e-84),
        (76.69670305986811, 3, 1.5682187415611968e-16),
        (135.36487378548236, 9, 9.324280310413486e-25),
        (0.0, 5, 1.0),
    ],
)
def test_chi_square_tail(spark, statistic, df, expected):
    r = spark.createDataFrame([(statistic, df)], "s double, d long").select(chi2_upper_tail(F.col("s"), F.col("d")).alias("p")).first()
    assert r["p"] == pytest.approx(expected, rel=1e-10)


def test_benjamini_hochberg_matches_definition(spark):
    p = [0.01, 0.04, None, 0.03, 0.005, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "i int, p double")
    out = {r["i"]: r["q"] for r in ranking.benjamini_hochberg(df, "p", "q").collect()}
    assert out[2] is None
    known = sorted((v, i) for i, v in enumerate(p) if v is not None)
    running = 1.0
    for rank in range(len(known), 0, -1):
        value, i = known[rank - 1]
        running = min(running, min(1.0, value * len(known) / rank))
        assert out[i] == pytest.approx(running, rel=1e-14)


def test_taxonomy_suggestions(profile):
    rows = {r["cluster_label"]: r for r in taxonomy.taxonomy_suggestions(profile).collect()}
    first, second = rows[1], rows[2]
    assert (first["primary_category"], first["secondary_category"], first["confidence"]) == (
        "fibrous_synthetic_materials", "biological", "moderate",
    )
    assert first["primary_score"] == pytest.approx(2.0197631310078417, rel=1e-13)
    assert first["secondary_score"] == pytest.approx(1.3506382902517793, rel=1e-13)
    assert first["evidence_summary"] == (
        "lower circularity_median (z=-0.80, score=+0.80); higher aspect_ratio_median (z=+0.65, score=+0.78); "
        "higher eccentricity_p90 (z=+0.28, score=+0.28); higher eccentricity_iqr (z=+0.45, score=+0.27)"
    )
    assert (second["primary_category"], second["confidence"]) == ("combustion_related", "high")
    assert second["primary_score"] == pytest.approx(3.5145635725084436, rel=1e-13)


def test_pairwise_differences(profile):
    rows = ranking.pairwise_differences(profile, PROFILE_FEATURES, 3).orderBy("rank").collect()
    assert [(r["feature"], r["higher_cluster"]) for r in rows] == [
        ("circularity_iqr", 1), ("aspect_ratio_median", 1), ("circular_variance", 1),
    ]
    assert rows[0]["standardized_median_delta"] == pytest.approx(2.432630742683643, rel=1e-14)


def test_cluster_descriptions(profile):
    rows = {r["cluster_label"]: r for r in explain.cluster_descriptions(profile, PROFILE_FEATURES).collect()}
    assert rows[1]["morphology_summary"] == "heterogeneous circularity, less circular particles"
    assert rows[1]["top_positive_signature"] == (
        "aspect_ratio_iqr (z=+0.65); aspect_ratio_median (z=+0.65); circularity_iqr (z=+0.64); mean_pixel_intensity (z=+0.54)"
    )
    assert rows[2]["top_negative_signature"] == (
        "circularity_iqr (z=-1.80); aspect_ratio_median (z=-1.78); area_iqr (z=-1.30); orientation_entropy (z=-1.19)"
    )


def test_season_association(spark):
    cells = [(c + 1, s, n) for s, row in SEASONS.items() for c, n in enumerate(row)]
    df = spark.createDataFrame(cells, "cluster_label int, capture_season string, n int").select(
        "cluster_label", "capture_season", F.explode(F.sequence(F.lit(0), F.col("n"))).alias("i")
    ).where("i > 0")
    _, tests = context.categorical_association(df, "cluster_label", ["capture_season"])
    r = tests.first()
    assert r["degrees_of_freedom"] == 9
    assert r["chi_square_statistic"] == pytest.approx(135.36487378548236, rel=1e-12)
    assert r["cramers_v"] == pytest.approx(0.14721497901268887, rel=1e-12)
    assert r["chi_square_p_value"] == pytest.approx(9.324280310413486e-25, rel=1e-10)
    top = context.categorical_enrichment(df, "cluster_label", ["capture_season"]).first()
    assert (top["cluster_label"], top["category"], top["observed_count"]) == (3, "autumn", 30)
    assert top["expected_count"] == pytest.approx(5.769452449567724, rel=1e-13)
    assert top["pearson_residual"] == pytest.approx(10.08778758913835, rel=1e-13)


def test_yates_correction_at_one_degree(spark):
    cells = [("a", "x", 10), ("a", "y", 20), ("b", "x", 30), ("b", "y", 15)]
    df = spark.createDataFrame(cells, "g string, c string, n int").select("g", "c", F.explode(F.sequence(F.lit(1), F.col("n"))))
    r = context.categorical_association(df, "g", ["c"])[1].first()
    expected = {("a", "x"): 16.0, ("a", "y"): 14.0, ("b", "x"): 24.0, ("b", "y"): 21.0}
    want = sum((abs(n - expected[g, c]) - 0.5) ** 2 / expected[g, c] for g, c, n in cells)
    assert r["chi_square_statistic"] == pytest.approx(want, rel=1e-12)


def test_selection_of_one_candidate(spark):
    sizes = [(1, 1335), (2, 550), (3, 317), (4, 363)]
    df = spark.createDataFrame([(sizes,)], "d array<struct<label:int,count:long>>")
    entropy = df.select(selection.distribution_entropy(F.col("d"))).first()[0]
    assert entropy == pytest.approx(0.869341616540468, rel=1e-12)


def test_retained_components():
    ratios = [
        0.30391085832394626, 0.17598440813161884, 0.16186413414800963, 0.0709219998979461, 0.052039699690961505,
        0.0506992448811749, 0.035934242132143995, 0.03,
    ]
    assert retained_components(ratios, 0.85) == 7


def test_pruning_and_balance_rules():
    rho = {("area_median", "feret_median"): 0.95, ("num_particles", "particle_density"): -0.97}
    kept, removed = preprocess.prune_correlated(
        ["feret_median", "area_median", "particle_density", "num_particles", "zzz"], rho
    )
    assert kept == ["num_particles", "area_median", "zzz"]
    assert removed == {"particle_density": "num_particles", "feret_median": "area_median"}
    kept, removed = preprocess.balance_families(
        ["area_median", "area_mean", "area_p75", "area_p25", "area_std", "feret_mean", "num_particles", "extra"]
    )
    assert kept == ["num_particles", "area_median", "area_std", "feret_mean", "extra"]
    assert removed == {"area_mean": "area_median", "area_p75": "family_balance_rule", "area_p25": "family_balance_rule"}


def test_enriched_columns_keep_the_order_of_their_list():
    from particlelake import fixed_values as fv

    lists = {"default": fv.ENRICHED_DEFAULT_FEATURES, "extended": fv.ENRICHED_FEATURES}
    rho = {("roi_v_mean", "roi_lab_l_mean"): 0.97}
    kept, removed = preprocess.prune_correlated(["roi_lab_l_mean", "roi_v_mean"], rho, **lists)
    assert kept == ["roi_v_mean"] and removed == {"roi_lab_l_mean": "roi_v_mean"}
    assert preprocess.by_priority(["zzz", "total", "area_p25", "num_particles", "aaa"], **lists) == [
        "num_particles", "total", "area_p25", "aaa", "zzz"
    ]
    assert len(fv.ENRICHED_DEFAULT_FEATURES) == 57 and set(fv.ENRICHED_DEFAULT_FEATURES) <= set(fv.ENRICHED_FEATURES)


def test_granularity(spark):
    df = spark.createDataFrame([(2,), (3,), (6,), (8,), (20,), (None,)], "k int")
    found = [r[0] for r in df.select(selection.granularity_score(F.col("k"))).collect()]
    assert found == pytest.approx([0.65, 1.0, 1.0, 0.64, 0.0, 0.0])


def test_weights_cover_the_reference_features():
    used = {f for w in fv.TAXONOMY_WEIGHTS.values() for f in w}
    assert used == set(fv.REFERENCE_STATS)
    assert len(fv.EXTENDED_FEATURES) == 63 and len(fv.DEFAULT_FEATURES) == 31 and len(fv.ENRICHED_FEATURES) == 99
    assert math.isclose(sum(fv.SELECTION_WEIGHTS.values()), 1.0)
