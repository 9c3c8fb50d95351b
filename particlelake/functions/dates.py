"""Date parsing and calendar features as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO_MOMENT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d{1,6})?)?)?)?(Z|[+-]\d{2}:?\d{2})?$"
_ZONE = r"(Z|[+-]\d{2}:?\d{2})$"


def capture_moment(col: Column) -> Column:
    """Local wall-clock time of an ISO text, else its first ten characters as a date."""
    text = F.trim(col.cast("string"))
    iso = F.when(text.rlike(_ISO_MOMENT), F.regexp_replace(F.replace(text, F.lit("T"), F.lit(" ")), _ZONE, ""))
    padded = F.when(F.length(iso) == 13, F.concat(iso, F.lit(":00"))).otherwise(iso)
    day = F.when(F.substring(text, 1, 10).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(text, 1, 10))
    return F.coalesce(padded.try_cast("timestamp_ntz"), day.try_cast("timestamp_ntz"))


def instant(col: Column) -> Column:
    """Absolute time of a text with or without zone (no zone means the session zone)."""
    return F.trim(col.cast("string")).try_cast("timestamp")


def season(month: Column, unknown: str = "") -> Column:
    return (
        F.when(month.isin(12, 1, 2), F.lit("winter"))
        .when(month.isin(3, 4, 5), F.lit("spring"))
        .when(month.isin(6, 7, 8), F.lit("summer"))
        .when(month.isin(9, 10, 11), F.lit("autumn"))
        .otherwise(F.lit(unknown))
    )


def month_angle(month: Column) -> Column:
    return F.lit(2.0 * math.pi) * (month - 1) / F.lit(12.0)


def display_date(col: Column) -> Column:
    """dd/mm/yyyy; a dash if missing; the text itself if already so or unparsable."""
    text = col.cast("string")
    parsed = F.coalesce(text.try_cast("timestamp"), text.try_cast("date").cast("timestamp"))
    return (
        F.when(text.isNull() | (text == ""), F.lit("–"))
        .when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), text)
        .otherwise(F.coalesce(F.date_format(F.to_utc_timestamp(parsed, F.current_timezone()), "dd/MM/yyyy"), text))
    )
