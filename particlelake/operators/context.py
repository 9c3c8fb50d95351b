"""Context variables of images and their association with clusters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from particlelake import fixed_values as fv
from particlelake.functions import dates, scalar
from particlelake.functions.tails import chi2_upper_tail
from particlelake.operators.aggregates import contingency, group_values, numeric_summary
from particlelake.operators.order_stats import rank_counts
from particlelake.operators.ranking import benjamini_hochberg
from particlelake.runtime import HOT_GROUP_ROWS, has_more_rows_than, melt, quoted


def _band(value: Column, steps: Sequence[tuple[float, str]], last: str, strict: bool) -> Column:
    chain = F.when(value.isNull(), F.lit("missing"))
    for bound, name in steps:
        chain = chain.when(value < bound if strict else value <= bound, F.lit(name))
    return chain.otherwise(F.lit(last))


def context_columns(df: DataFrame) -> DataFrame:
    """Ratios, gaps, totals, calendar parts and bands of the context values."""
    number = {c: scalar.finite(quoted(c)) for c in ("record_pm10", "record_pm25", "official_pm10", "official_pm25")}
    moment = dates.capture_moment(quoted("capture_datetime"))
    staged = df.withColumns({**{f"__{c}": v for c, v in number.items()}, "__moment": moment})
    rp10, rp25, op10, op25 = (F.col(f"__{c}") for c in number)
    ratio = lambda top, bottom: F.when(bottom != 0, top / bottom)
    month = F.month("__moment")
    distance = scalar.finite(quoted("official_station_distance_km"))
    return staged.withColumns(
        {
            "record_pm25_to_pm10_ratio": ratio(rp25, rp10),
            "official_pm25_to_pm10_ratio": ratio(op25, op10),
            "official_pm10_minus_record_pm10": op10 - rp10,
            "official_pm25_minus_record_pm25": op25 - rp25,
            "abs_pm10_gap": F.abs(op10 - rp10),
            "abs_pm25_gap": F.abs(op25 - rp25),
            "official_pm_total": op10 + op25,
            "record_pm_total": rp10 + rp25,
            "capture_year": F.year("__moment"),
            "capture_month": month,
            "capture_season": F.when(month.isNotNull(), dates.season(month)),
            "capture_dayofyear": F.dayofyear("__moment"),
            "capture_weekday": F.weekday("__moment"),
            "station_distance_band": _band(
                distance, ((1.0, "under_1km"), (3.0, "1_to_3km"), (10.0, "3_to_10km")), "over_10km", strict=True
            ),
            "official_pm25_band": _band(op25, ((10.0, "low"), (25.0, "moderate")), "high", strict=False),
            "official_pm10_band": _band(op10, ((20.0, "low"), (50.0, "moderate")), "high", strict=False),
        }
    ).drop("__moment", *[f"__{c}" for c in number])


def detect_context_columns(
    df: DataFrame,
    numeric: Sequence[str] = fv.NUMERIC_CONTEXT_COLUMNS,
    categorical: Sequence[str] = fv.CATEGORICAL_CONTEXT_COLUMNS,
) -> DataFrame:
    """(column, kind, position) of the preferred columns that vary, from one pass."""
    aggs: list[Column] = []
    for c in (c for c in numeric if c in df.columns):
        value = F.round(scalar.finite(quoted(c)), 8)
        aggs.append(F.struct(F.lit(c).alias("column"), F.lit("numeric").alias("kind"), F.lit(numeric.index(c)).alias("position"),
                             F.coalesce(F.min(value) != F.max(value), F.lit(False)).alias("varies")))
    for c in (c for c in categorical if c in df.columns):
        value = scalar.non_blank(F.trim(quoted(c).cast("string")))
        aggs.append(F.struct(F.lit(c).alias("column"), F.lit("categorical").alias("kind"), F.lit(categorical.index(c)).alias("position"),
                             F.coalesce(F.min(value) != F.max(value), F.lit(False)).alias("varies")))
    return df.agg(F.array(*aggs).alias("all")).select(F.inline("all")).where("varies").drop("varies")


def kruskal_wallis(
    df: DataFrame, group: str, columns: Sequence[str], hot_rows: int = HOT_GROUP_ROWS
) -> DataFrame:
    """H statistic and p-value of every column; null when all values are equal.

    Values are counted per (variable, value, group) before anything is ranked; on
    large tables the ranks come from range-partitioned counts, so no variable sits
    in one task.
    """
    numbers = {c: scalar.finite(quoted(c)) for c in columns}
    long = melt(df, [quoted(group).alias("__g")], numbers, "variable", "value").where(
        F.col("value").isNotNull() & F.col("__g").isNotNull()
    )
    counts = long.groupBy("variable", "value", "__g").agg(F.count(F.lit(1)).alias("c"))
    # the list holds one entry per group, so it is bounded by their number
    by_value = counts.groupBy("variable", "value").agg(
        F.sum("c").alias("n"), F.collect_list(F.struct("__g", "c")).alias("groups")
    )
    large = has_more_rows_than(df, hot_rows)
    ranked = rank_counts(by_value, ["variable"], "value", carry=["groups"], spread=large)
    per_group = (
        ranked.select("variable", "avg_rank", F.inline("groups"))
        .groupBy("variable", "__g")
        .agg(F.sum(F.col("avg_rank") * F.col("c")).alias("r"), F.sum("c").alias("m"))
    )
    n3 = F.col("n").cast("double")
    per_variable = ranked.groupBy("variable").agg(
        F.sum("n").cast("double").alias("total"),
        F.sum(n3 * n3 * n3 - n3).alias("ties"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
    )
    total = F.col("total")
    joined = per_group.join(per_variable, "variable")
    gap = F.col("r") / F.col("m") - (total + 1) / 2.0
    scored = joined.groupBy("variable", "total", "ties", "lo", "hi").agg(
        F.sum(F.col("m") * gap * gap).alias("spread"), F.count(F.lit(1)).alias("group_count")
    )
    statistic = 12.0 / (total * (total + 1)) * F.col("spread") / (1.0 - F.col("ties") / (total * total * total - total))
    same = F.col("hi") - F.col("lo") <= 1e-8 + 1e-5 * F.abs("lo")
    h = F.when(~same & (F.col("group_count") >= 2), statistic)
    tested = scored.select("variable", F.col("total").cast("long").alias("n"), "group_count", h.alias("kruskal_wallis_statistic"))
    return tested.withColumn(
        "kruskal_wallis_p_value", chi2_upper_tail(F.col("kruskal_wallis_statistic"), F.col("group_count") - 1)
    )


def numeric_association(
    df: DataFrame, group: str, columns: Sequence[str], hot_rows: int = HOT_GROUP_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(summary per cell, test per variable) with epsilon squared and adjusted p."""
    summary = numeric_summary(df, group, columns, hot_rows)
    tests = kruskal_wallis(df, group, columns, hot_rows)
    h, k, n = F.col("kruskal_wallis_statistic"), F.col("group_count"), F.col("n")
    effect = F.when(h.isNotNull() & (n > k), F.greatest(F.lit(0.0), (h - k + 1) / (n - k)))
    names = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(columns)], "variable string, position int")
    complete = names.join(tests.withColumn("epsilon_squared", effect), "variable", "left")
    adjusted = benjamini_hochberg(complete, "kruskal_wallis_p_value", "kruskal_wallis_p_value_bh", large=False)
    return summary, adjusted.orderBy(F.col("epsilon_squared").desc_nulls_last(), "position").select(
        "variable", "kruskal_wallis_statistic", "kruskal_wallis_p_value", "epsilon_squared", "kruskal_wallis_p_value_bh"
    )


def _with_expected(grid: DataFrame) -> DataFrame:
    """Only variables with two or more categories, with expected counts."""
    wide = grid.groupBy("variable").agg(F.count_distinct("category").alias("category_count")).where("category_count >= 2")
    return grid.join(wide, "variable").withColumn(
        "expected_count", F.col("group_total") * F.col("category_total") / F.col("total")
    )


def categorical_association(df: DataFrame, group: str, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(grid, test per variable): chi-square with Yates correction at one degree of freedom."""
    grid = contingency(df, group, columns)
    cells = _with_expected(grid)
    group_count = F.size(group_values(df, group))
    rows = cells.withColumns({"r": group_count, "df": (group_count - 1) * (F.col("category_count") - 1)})
    gap = F.abs(F.col("count") - F.col("expected_count"))
    corrected = F.when(F.col("df") == 1, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
    term = F.when(F.col("expected_count") > 0, corrected * corrected / F.col("expected_count")).otherwise(0.0)
    tested = rows.groupBy("variable", "r", "df", "category_count", "total").agg(F.sum(term).alias("chi_square_statistic"))
    smaller = F.least(F.col("r") - 1, F.col("category_count") - 1)
    tests = tested.select(
        "variable",
        "chi_square_statistic",
        F.col("df").cast("long").alias("degrees_of_freedom"),
        F.when((F.col("total") > 0) & (smaller > 0), F.sqrt(F.col("chi_square_statistic") / F.col("total") / smaller)).alias("cramers_v"),
        "category_count",
    ).withColumn("chi_square_p_value", chi2_upper_tail(F.col("chi_square_statistic"), F.col("degrees_of_freedom")))
    adjusted = benjamini_hochberg(tests, "chi_square_p_value", "chi_square_p_value_bh", large=False)
    return grid, adjusted.orderBy(F.col("cramers_v").desc_nulls_last(), "variable")


def categorical_enrichment(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    """Observed and expected counts with Pearson residuals for every cell."""
    cells = _with_expected(contingency(df, group, columns))
    expected = F.col("expected_count")
    residual = F.when(expected > 0, (F.col("count") - expected) / F.sqrt(expected)).otherwise(0.0)
    return cells.select(
        "variable", quoted(group), "category", F.col("count").alias("observed_count"), "expected_count",
        residual.alias("pearson_residual"),
    ).orderBy(F.abs("pearson_residual").desc(), "variable", group, "category")
