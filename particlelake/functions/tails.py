"""Upper tail of the chi-square distribution for small result tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _upper_tail(statistic: float, df: int) -> float:
    """Closed form for whole degrees of freedom, summed in log space.

    Half-integer orders start at erfc, whole ones at exp; each further pair of
    degrees adds one term, all positive, so nothing cancels.
    """
    if not (statistic == statistic) or df < 1:
        return float("nan")
    if statistic <= 0.0:
        return 1.0
    half = statistic / 2.0
    start = 0.0 if df % 2 == 0 else 0.5
    orders = np.arange(start, df / 2.0 - 0.5, 1.0)
    logs = np.array([(s * math.log(half)) - half - math.lgamma(s + 1.0) for s in orders])
    total = 0.0 if logs.size == 0 else math.fsum(np.exp(logs))
    head = math.erfc(math.sqrt(half)) if df % 2 else 0.0
    return min(1.0, head + total)


@F.pandas_udf(T.DoubleType())
def _chi2_tail(statistic: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [
            None if pd.isna(s) or pd.isna(d) else _upper_tail(float(s), int(d))
            for s, d in zip(statistic, df)
        ],
        dtype="float64",
    )


def chi2_upper_tail(statistic: Column, df: Column) -> Column:
    """P(X >= statistic); meant for one row per tested variable."""
    return _chi2_tail(statistic.cast("double"), df.cast("long"))
