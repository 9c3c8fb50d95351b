"""Fixed values that results must agree with.

Word lists, coefficients, limits and labels only; no logic lives here.
"""

from __future__ import annotations

# --- particle summaries -------------------------------------------------------
PARTICLE_FAMILIES = {
    "area_px": "area",
    "solidity": "solidity",
    "aspect_ratio": "aspect_ratio",
    "feret_diameter_max_px": "feret",
    "equivalent_diameter_px": "equivalent_diameter",
    "eccentricity": "eccentricity",
    "circularity": "circularity",
    "mean_intensity": "mean_intensity",
}
SUMMARY_SUFFIXES = ("median", "iqr", "p25", "p75", "p90", "mean", "std")
ORIENTATION_BINS = 18

PARTICLE_LIMITS = {
    "area_px": (0.0, 300.0),
    "solidity": (0.3, 1.0),
    "aspect_ratio": (0.0, 4.0),
    "feret_diameter_max_px": (0.0, 50.0),
}

# --- feature lists ------------------------------------------------------------
IMAGE_LEVEL_FEATURES = (
    "num_particles",
    "area_percentage",
    "particle_density",
    "mean_pixel_intensity",
    "std_pixel_intensity",
    "orientation_entropy",
    "circular_variance",
)
CORE_SUMMARY_FEATURES = (
    "area_median",
    "area_iqr",
    "area_p90",
    "solidity_median",
    "solidity_iqr",
    "aspect_ratio_median",
    "aspect_ratio_iqr",
    "feret_median",
    "feret_p90",
    "equivalent_diameter_median",
    "equivalent_diameter_p90",
    "circularity_median",
    "mean_intensity_median",
)
CORE_FEATURES = IMAGE_LEVEL_FEATURES + CORE_SUMMARY_FEATURES
ALL_SUMMARY_FEATURES = tuple(
    f"{family}_{suffix}" for family in PARTICLE_FAMILIES.values() for suffix in SUMMARY_SUFFIXES
)
EXTENDED_FEATURES = CORE_FEATURES + tuple(f for f in ALL_SUMMARY_FEATURES if f not in CORE_FEATURES)
DEFAULT_FEATURES = IMAGE_LEVEL_FEATURES + tuple(
    f"{family}_{suffix}" for family in PARTICLE_FAMILIES.values() for suffix in ("median", "iqr", "p90")
)
COLOR_FEATURES = tuple(
    f"roi_{channel}_{stat}"
    for channel in ("b", "g", "r", "h", "s", "v", "lab_l", "lab_a", "lab_b")
    for stat in ("mean", "std")
) + ("colorfulness", "particle_mask_mean_rgb_contrast", "particle_mask_mean_v_contrast")
PLACE_NUMERIC_FEATURES = (
    "total",
    "transit",
    "park",
    "gas_station",
    "parking",
    "industrial",
    "major_road_proxy",
    "place_diversity_entropy",
    "green_vs_traffic_ratio_500m",
)
PLACE_TEXT_FEATURES = ("dominant_place_category",)
TEMPORAL_FEATURES = (
    "capture_month_sin",
    "capture_month_cos",
    "season_winter",
    "season_spring",
    "season_summer",
    "season_autumn",
)
ENRICHED_DEFAULT_FEATURES = (
    DEFAULT_FEATURES
    + (
        "roi_s_mean",
        "roi_s_std",
        "roi_v_mean",
        "roi_v_std",
        "roi_lab_l_mean",
        "roi_lab_l_std",
        "roi_lab_b_mean",
        "roi_lab_b_std",
        "colorfulness",
        "particle_mask_mean_rgb_contrast",
        "particle_mask_mean_v_contrast",
    )
    + PLACE_NUMERIC_FEATURES
    + TEMPORAL_FEATURES
)
ENRICHED_FEATURES = EXTENDED_FEATURES + COLOR_FEATURES + PLACE_NUMERIC_FEATURES + TEMPORAL_FEATURES

LOG_PREFIXES = ("num_particles", "particle_density", "area_", "feret_", "equivalent_diameter_")
SUFFIX_GROUPS = {
    "median": "central",
    "mean": "central",
    "iqr": "dispersion",
    "std": "dispersion",
    "p90": "upper",
    "p75": "upper_fallback",
    "p25": "lower",
}

# --- table layouts ------------------------------------------------------------
METADATA_COLUMNS = (
    "image_id", "sensor_id", "capture_datetime", "collection_datetime", "latitude", "longitude",
    "image_path", "roi_detected", "roi_width_px", "roi_height_px", "segmentation_method",
    "analysis_success", "segmentation_success", "manual_qc_flag", "device_type",
    "sensor_exposure_time", "paper_type", "camera_type", "magnification", "weather_context",
    "official_station_id", "roi_grid_label", "roi_grid_score", "roi_grid_confidence",
    "roi_grid_needs_review", "failure_reason",
)
CONTEXT_COLUMNS = (
    "record_pm10", "record_pm25", "record_pollution_level", "official_station_name",
    "official_station_distance_km", "official_pm10", "official_pm25", "official_fetched_at",
)
ID_COLUMNS = (
    "image_id", "sensor_id", "capture_datetime", "collection_datetime", "latitude", "longitude",
    "official_station_id", "official_station_name", "official_station_distance_km", "record_pm10",
    "record_pm25", "official_pm10", "official_pm25", "zero_particle_flag",
)
QC_COLUMNS = ("manual_qc_flag", "analysis_success", "segmentation_success")
IMAGE_NUMERIC_COLUMNS = (
    "roi_area_px", "num_particles", "area_percentage", "particle_density", "mean_pixel_intensity",
    "std_pixel_intensity", "blur_score_laplacian", "orientation_entropy", "circular_variance",
    "roi_grid_inner_margin_ratio", "roi_grid_inner_dark_ratio", "roi_grid_horizontal_line_count",
    "roi_grid_vertical_line_count", "roi_grid_horizontal_coverage", "roi_grid_vertical_coverage",
    "roi_grid_row_peak_count", "roi_grid_col_peak_count", "roi_grid_spacing_regularity",
)
NON_FEATURE_COLUMNS = (
    "image_id", "sensor_id", "capture_datetime", "collection_datetime", "latitude", "longitude",
    "official_station_id", "official_station_name", "official_station_distance_km", "record_pm10",
    "record_pm25", "record_pollution_level", "official_pm10", "official_pm25",
    "official_fetched_at", "zero_particle_flag", "manual_qc_flag", "analysis_success",
    "segmentation_success", "image_path", "roi_detected", "roi_width_px", "roi_height_px",
    "segmentation_method", "device_type", "sensor_exposure_time", "paper_type", "camera_type",
    "magnification", "weather_context", "failure_reason",
)

# --- record spellings ---------------------------------------------------------
LEGACY_CONCENTRATION_KEYS = (
    "Concentración estándar", "Concentracion estándar", "Concentración estandar",
    "Concentracion estandar", "concentration",
)
PM25_KEYS = ("PM2.5", "PM25", "pm25", "pm2.5")
PM10_KEYS = ("PM10", "pm10")
LATITUDE_KEYS = ("Localización latitud", "Localizacion latitud")
LONGITUDE_KEYS = ("Localización longitud", "Localizacion longitud")
START_KEY = "Fecha de inicio"
END_KEY = "Fecha de recogida"
IMAGE_KEY = "Imagen de entrada"
TAXONOMY_KEY = "Posibles fuentes contaminantes"
POLLUTION_LEVEL_KEY = "Nivel de polución"
NUMBER_WRAPPERS = ("$numberDouble", "$numberInt", "$numberLong", "$numberDecimal")

# --- pollution ----------------------------------------------------------------
NO_DATA_LABEL = "Sin datos"
# (upper bound, bound is inclusive, label); the last one has no bound
POLLUTION_LABELS = (
    (10.0, True, "Nivel de contaminación Muy bueno, menos de 10 μg/m³"),
    (20.0, False, "Nivel de contaminación Bueno, entre 10 to 19 μg/m³"),
    (50.0, False, "Nivel de contaminación Moderado, entre 20 to 49 ug/m^3"),
    (100.0, False, "Nivel de contaminación Malo, entre 50 to 99 μg/m³"),
    (150.0, False, "Nivel de contaminación Muy Malo, entre 100 to 150 μg/m³"),
    (None, False, "Nivel de contaminación Extremo, mas de 150 μg/m³"),
)
# (lower bound inclusive, category)
POLLUTION_CATEGORIES = ((150.0, "Extremo"), (50.0, "Alto"), (20.0, "Moderado"), (10.0, "Bueno"))
LOWEST_CATEGORY = "Bajo"
MAP_NO_DATA = "SinDatos"
CATEGORY_COLORS = (
    ("extremo", "#d73027"),
    ("alto", "#fc8d59"),
    ("moderado", "#fee08b"),
    ("bueno", "#91cf60"),
    ("bajo", "#1a9850"),
)
NO_DATA_COLOR = "#999"

CONCENTRATION_MODELS = {
    "PM10": {"slope": 5.912886205097057e-05, "intercept": 6.763489480198955, "diameter_um": 10.0},
    "PM25": {"slope": 0.00021507963691545865, "intercept": 5.412905369227905, "diameter_um": 2.5},
}
PARTICLE_DENSITY_G_CM3 = 1.65
SENSOR_SIDE_M = 0.06
UPLOAD_MODELS = {"PM10": (6.763489480198955, 0.8), "PM25": (5.412905369227905, 0.45)}

EARTH_RADIUS_STATION_KM = 6371.0088
EARTH_RADIUS_MAP_KM = 6371.0

# --- grid decision ------------------------------------------------------------
GRID_ACCEPT_SCORE = 0.62
GRID_REJECT_SCORE = 0.22
GRID_CENTRE_SCORE = 0.42
GRID_REVIEW_CONFIDENCE = 0.45

# --- places -------------------------------------------------------------------
PLACE_TYPE_SETS = {
    "transit": ("transit_station", "bus_station", "train_station", "subway_station", "light_rail_station"),
    "park": ("park",),
    "gas_station": ("gas_station",),
    "parking": ("parking",),
}
PLACE_KEYWORDS = {
    "industrial": ("industrial", "warehouse", "storage", "logistics"),
    "major_road_proxy": ("route", "intersection", "highway"),
}
PLACE_CATEGORIES = ("transit", "park", "gas_station", "parking", "industrial", "major_road_proxy")
TRAFFIC_CATEGORIES = ("transit", "gas_station", "parking", "major_road_proxy")

# --- context ------------------------------------------------------------------
NUMERIC_CONTEXT_COLUMNS = (
    "latitude", "longitude", "official_station_distance_km", "record_pm10", "record_pm25",
    "official_pm10", "official_pm25", "record_pm25_to_pm10_ratio", "official_pm25_to_pm10_ratio",
    "official_pm10_minus_record_pm10", "official_pm25_minus_record_pm25", "abs_pm10_gap",
    "abs_pm25_gap", "official_pm_total", "record_pm_total", "capture_year", "capture_month",
    "capture_dayofyear", "capture_weekday",
)
CATEGORICAL_CONTEXT_COLUMNS = (
    "official_station_id", "capture_season", "station_distance_band", "official_pm25_band",
    "official_pm10_band",
)

# --- candidate selection ------------------------------------------------------
SELECTION_WEIGHTS = {
    "silhouette_score": 0.22,
    "calinski_harabasz_score": 0.12,
    "davies_bouldin_score": 0.18,
    "bootstrap_mean_ari": 0.18,
    "repeat_mean_ari": 0.10,
    "cluster_entropy": 0.10,
    "smallest_cluster_fraction": 0.05,
    "granularity_score": 0.05,
}

# --- cluster descriptions -----------------------------------------------------
# (feature, phrase, threshold): phrase applies when z >= threshold
HIGH_PHRASES = (
    ("area_median", "larger particle bodies", 0.8),
    ("feret_p90", "long upper-tail particle extent", 0.8),
    ("aspect_ratio_median", "elongated particle shapes", 0.8),
    ("aspect_ratio_p90", "very elongated tail cases", 0.8),
    ("circularity_median", "round compact particles", 0.8),
    ("circularity_iqr", "heterogeneous circularity", 0.6),
    ("solidity_iqr", "heterogeneous solidity", 0.6),
    ("orientation_entropy", "high orientation dispersion", 0.8),
    ("circular_variance", "broad directional spread", 0.8),
    ("mean_pixel_intensity", "brighter overall deposits", 0.8),
    ("mean_intensity_iqr", "heterogeneous particle intensity", 0.6),
    ("num_particles", "higher particle counts", 0.8),
)
# phrase applies when z <= -threshold
LOW_PHRASES = (
    ("area_median", "smaller particle bodies", 0.8),
    ("feret_p90", "shorter upper-tail particle extent", 0.8),
    ("aspect_ratio_median", "more compact non-elongated shapes", 0.8),
    ("circularity_median", "less circular particles", 0.8),
    ("orientation_entropy", "more aligned orientations", 0.8),
    ("mean_pixel_intensity", "darker overall deposits", 0.8),
    ("num_particles", "lower particle counts", 0.8),
)
DEFAULT_PHRASE = "mixed morphology without one dominant extreme"

# --- taxonomy -----------------------------------------------------------------
TAXONOMY_WEIGHTS = {
    "combustion_related": {
        "num_particles": 1.15,
        "area_median": -1.05,
        "feret_p90": -0.85,
        "circularity_median": 0.95,
        "aspect_ratio_median": -0.80,
        "eccentricity_p90": -0.70,
        "mean_intensity_median": 0.40,
    },
    "mechanical_non_combustion_particulate": {
        "area_median": 1.05,
        "feret_p90": 0.95,
        "solidity_median": 0.85,
        "num_particles": -0.30,
        "solidity_iqr": 0.80,
        "aspect_ratio_iqr": 0.65,
        "circularity_median": -0.70,
        "mean_intensity_iqr": 0.45,
        "feret_iqr": 0.55,
    },
    "biological": {
        "area_iqr": 0.85,
        "mean_intensity_iqr": 0.90,
        "circularity_iqr": 0.70,
        "orientation_entropy": 0.55,
        "aspect_ratio_iqr": 0.45,
        "circular_variance": 0.40,
    },
    "fibrous_synthetic_materials": {
        "aspect_ratio_median": 1.20,
        "aspect_ratio_p90": 1.15,
        "eccentricity_p90": 1.00,
        "feret_p90": 0.90,
        "circularity_median": -1.00,
        "solidity_median": -0.45,
        "eccentricity_iqr": 0.60,
    },
    "industrial": {
        "solidity_iqr": 0.85,
        "eccentricity_iqr": 0.80,
        "feret_iqr": 0.80,
        "mean_intensity_iqr": 0.70,
        "orientation_entropy": 0.55,
        "aspect_ratio_iqr": 0.40,
    },
    "mixed_unknown": {
        "orientation_entropy": 0.95,
        "circular_variance": 0.90,
        "area_iqr": 0.80,
        "circularity_iqr": 0.80,
        "mean_intensity_iqr": 0.70,
        "solidity_iqr": 0.55,
    },
}
TAXONOMY_LABELS = {
    "combustion_related": "Relacionada con combustion",
    "mechanical_non_combustion_particulate": "Particulado mecanico no ligado a combustion",
    "biological": "Origen biologico",
    "fibrous_synthetic_materials": "Materiales sinteticos fibrosos",
    "industrial": "Origen industrial",
    "mixed_unknown": "Mixto o desconocido",
}
FALLBACK_CATEGORY = "mixed_unknown"
NO_NUMERIC_FEATURE_MESSAGE = "No numeric features could be extracted for the taxonomy model."
# feature: (mean, population standard deviation)
REFERENCE_STATS = {
    "area_iqr": (5.125388198757764, 6.252988403934275),
    "area_median": (3.1364518633540373, 3.4465915723547753),
    "aspect_ratio_iqr": (1.6221534981715564, 0.5853239356480204),
    "aspect_ratio_median": (1.1994690358827673, 0.6728583550854693),
    "aspect_ratio_p90": (2.422480442878371, 0.42465447664069056),
    "circular_variance": (0.5561294030363724, 0.15928781126293878),
    "circularity_iqr": (0.7474104443312359, 0.41895191070251303),
    "circularity_median": (0.39679511485048713, 0.47661803322027163),
    "eccentricity_iqr": (0.8135553888777802, 0.2502971212464762),
    "eccentricity_p90": (0.9885018065695288, 0.05787810595752964),
    "feret_iqr": (2.1077497925905555, 1.285196108115477),
    "feret_p90": (5.080794829256514, 2.508662323126464),
    "mean_intensity_iqr": (20.193423703590536, 11.68446640740085),
    "mean_intensity_median": (198.06670793983506, 11.615553844212268),
    "num_particles": (496.2509697439876, 1034.0774668170714),
    "orientation_entropy": (2.4727370643906514, 0.5956790080732651),
    "solidity_iqr": (0.016955063129178747, 0.0413432228744446),
    "solidity_median": (0.9985627923635724, 0.010284307506014927),
}
SOFTMAX_TEMPERATURE = 1.5
EVIDENCE_COUNT = 4
