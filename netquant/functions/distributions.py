"""Tail probabilities: the normal one stays in the JVM, Student's t runs vectorised over Arrow batches."""

from __future__ import annotations

import math
import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Workers need no installed copy of this module: its functions travel with the plan.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rational approximations of the error function by W. J. Cody (1969).
ERF_SMALL_NUM = [3.16112374387056560, 113.864154151050156, 377.485237685302021, 3209.37758913846947, 0.185777706184603153]
ERF_SMALL_DEN = [23.6012909523441209, 244.024637934444173, 1282.61652607737228, 2844.23683343917062]
ERFC_MID_NUM = [
    0.564188496988670089, 8.88314979438837594, 66.1191906371416295, 298.635138197400131, 881.952221241769090,
    1712.04761263407058, 2051.07837782607147, 1230.33935479799725, 2.15311535474403846e-8,
]
ERFC_MID_DEN = [
    15.7449261107098347, 117.693950891312499, 537.181101862009858, 1621.38957456669019,
    3290.79923573345963, 4362.61909014324716, 3439.36767414372164, 1230.33935480374942,
]
ERFC_FAR_NUM = [
    0.305326634961232344, 0.360344899949804439, 0.125781726111229246,
    0.0160837851487422766, 6.58749161529837803e-4, 0.0163153871373020978,
]
ERFC_FAR_DEN = [2.56852019228982242, 1.87295284992346725, 0.527905102951428412, 0.0605183413124413191, 0.00233520497626869185]


def _rational(x: Column, lead: float, num: list[float], den: list[float]) -> Column:
    """Both polynomials by Horner's rule; the denominator has a leading 1."""
    top = reduce(lambda acc, a: acc * x + F.lit(a), num, F.lit(lead))
    bottom = reduce(lambda acc, b: acc * x + F.lit(b), den, F.lit(1.0))
    return top / bottom


def upper_tail(z: Column) -> Column:
    """P(Z > z) for z >= 0 under the standard normal, as a codegen expression."""
    x = z / F.lit(math.sqrt(2.0))
    squared = x * x
    small = F.lit(1.0) - x * _rational(squared, ERF_SMALL_NUM[4], ERF_SMALL_NUM[:4], ERF_SMALL_DEN)
    middle = F.exp(-squared) * _rational(x, ERFC_MID_NUM[8], ERFC_MID_NUM[:8], ERFC_MID_DEN)
    inverse = F.lit(1.0) / F.greatest(squared, F.lit(1.0))
    series = inverse * _rational(inverse, ERFC_FAR_NUM[5], ERFC_FAR_NUM[:5], ERFC_FAR_DEN)
    far = F.exp(-squared) * (F.lit(1.0 / math.sqrt(math.pi)) - series) / F.greatest(x, F.lit(1.0))
    return F.lit(0.5) * F.when(x <= 0.46875, small).when(x <= 4.0, middle).otherwise(far)


def normal_cdf(z: Column) -> Column:
    return F.when(z > 0, F.lit(1.0) - upper_tail(z)).otherwise(upper_tail(-z))


def two_sided_normal_p(z: Column) -> Column:
    return F.lit(2.0) * upper_tail(F.abs(z))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after shifting the argument above 8."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8.0
        shift = np.where(low, shift + np.log(np.where(low, y, 1.0)), shift)
        y = np.where(low, y + 1.0, y)
    inv = 1.0 / (y * y)
    series = (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv * (1 / 1680 - inv * (1 / 1188))))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - shift


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Lentz's continued fraction of the incomplete beta function, all rows at once."""
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    total = d.copy()
    for m in range(1, 400):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1.0 + step / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            total = total * d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    return total


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function for 0 <= x <= 1."""
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q, y = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    inner = np.clip(y, 1e-300, 1.0 - 1e-16)
    front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(inner) + q * np.log1p(-inner)) / p
    part = np.where(y <= 0.0, 0.0, front * _beta_fraction(p, q, inner))
    return np.where(flip, 1.0 - part, part)


def student_p_values(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided P(|T| > |t|); NaN wherever t or df is unusable."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    p = np.full(t.shape, np.nan)
    usable = np.isfinite(t) & np.isfinite(df) & (df > 0)
    tt, dd = t[usable], df[usable]
    if tt.size:
        p[usable] = incomplete_beta(dd / 2.0, np.full(dd.shape, 0.5), dd / (dd + tt * tt))
    p[np.isinf(t) & (df > 0)] = 0.0
    return p


@F.pandas_udf(DoubleType())
def two_sided_student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(student_p_values(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))
