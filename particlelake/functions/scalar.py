"""Parsing, labelling and pollution rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from particlelake import fixed_values as fv

_LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
_WHOLE_NUMBER = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$"


def finite(col: Column) -> Column:
    """The double itself, or null when it is NaN or infinite.

    Spark orders NaN above infinity, so one comparison covers both.
    """
    value = col.cast("double")
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def non_blank(col: Column) -> Column:
    """Null for the empty string, else unchanged."""
    return F.nullif(col, F.lit(""))


def to_float(col: Column, mode: str = "strict") -> Column:
    """Text to finite double or null.

    ``strict``    the whole (trimmed) text must be a number;
    ``prefix``    a leading number is enough;
    ``taxonomy``  as strict, with true/false/pending read as missing.
    """
    text = col.cast("string")
    if mode == "prefix":
        lead = F.regexp_extract(text, _LEADING_NUMBER, 1)
        return finite(lead.try_cast("double"))
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    if mode == "taxonomy":
        trimmed = F.when(~F.lower(trimmed).isin("true", "false", "pending"), trimmed)
    elif mode != "strict":
        raise ValueError(f"unknown mode {mode!r}")
    plain = F.when(trimmed.rlike(_WHOLE_NUMBER), F.regexp_replace(trimmed, "_", ""))
    return finite(plain.try_cast("double"))


def number(df: DataFrame, name: str, mode: str = "strict") -> Column:
    """Finite value of a column: text is parsed, numbers are only checked."""
    column = F.col(f"`{name}`")
    return to_float(column, mode) if dict(df.dtypes)[name] == "string" else finite(column)


def to_bool(col: Column) -> Column:
    """true/1/yes and false/0/no in any case; anything else is null."""
    text = F.lower(F.trim(col.cast("string")))
    return (
        F.when(text.isin("true", "1", "yes"), F.lit(True))
        .when(text.isin("false", "0", "no"), F.lit(False))
    )


def number_to_bool(col: Column) -> Column:
    """Numeric flag: non-zero is true, null stays null."""
    return col != 0


def pollution_label(col: Column, guard: bool = True) -> Column:
    """Long Spanish label; with ``guard`` null and negative values have no data."""
    value = finite(col)
    chain = F.when(value.isNull() | (value < 0), F.lit(fv.NO_DATA_LABEL)) if guard else None
    *bounded, (_, _, last) = fv.POLLUTION_LABELS
    for bound, inclusive, label in bounded:
        test = value <= bound if inclusive else value < bound
        chain = F.when(test, F.lit(label)) if chain is None else chain.when(test, F.lit(label))
    return chain.otherwise(F.lit(last))


def _category_chain(value: Column) -> Column:
    (first_bound, first_name), *rest = fv.POLLUTION_CATEGORIES
    chain = F.when(value >= first_bound, F.lit(first_name))
    for bound, name in rest:
        chain = chain.when(value >= bound, F.lit(name))
    return chain.otherwise(F.lit(fv.LOWEST_CATEGORY))


def station_category(col: Column) -> Column:
    """Short category of a station value; non-finite has no data."""
    value = finite(col)
    return F.when(value.isNull(), F.lit(fv.NO_DATA_LABEL)).otherwise(_category_chain(value))


def map_category(value: Column, label: Column) -> Column:
    """Map category: by value if positive, else by label, else no data."""
    number = value.cast("double")
    return (
        F.when((number > 0) & ~F.isnan(number), _category_chain(number))
        .when(non_blank(label).isNotNull() & (label != fv.NO_DATA_LABEL), label)
        .otherwise(F.lit(fv.MAP_NO_DATA))
    )


def category_color(category: Column) -> Column:
    lowered = F.lower(category)
    (first_word, first_color), *rest = fv.CATEGORY_COLORS
    chain = F.when(lowered.contains(first_word), F.lit(first_color))
    for word, color in rest:
        chain = chain.when(lowered.contains(word), F.lit(color))
    return chain.otherwise(F.lit(fv.NO_DATA_COLOR))


def model_type(col: Column, default: str = "PM10") -> Column:
    """PM10 / PM25 from free spellings, ``default`` for anything else."""
    compact = F.translate(F.upper(F.trim(col)), " _,.", "")
    return F.when(compact.isin("PM10", "PM25"), compact).otherwise(F.lit(default))


def fixed_point(col: Column, digits: int, missing: str) -> Column:
    return F.when(finite(col).isNull(), F.lit(missing)).otherwise(
        F.format_string(f"%.{digits}f", finite(col))
    )
