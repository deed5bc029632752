"""Statistics on Columns: correlation that survives ANSI mode, p-values, formatting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Aggregates over many columns are written as SQL text: one expression costs one call into the
# JVM, however long it is, where a Column tree costs one call per operator.


def numeric(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """``keep`` and ``columns``; the latter as doubles with NaN as null."""
    cells = [
        f"nanvl(CAST(`{c}` AS DOUBLE), CAST(NULL AS DOUBLE)) AS `{c}`" for c in dict.fromkeys(columns)
    ]
    return df.selectExpr(*[f"`{k}`" for k in keep or []], *cells)


def paired(x: str, y: str) -> tuple[str, str]:
    """SQL of both columns, null where the other one is."""
    return f"if(`{y}` IS NULL, NULL, `{x}`)", f"if(`{x}` IS NULL, NULL, `{y}`)"


def pearson(x: str, y: str, null_policy: str = "propagate") -> str:
    """SQL aggregate: Pearson r of two columns of ``numeric``; null where it is undefined.

    ``corr`` divides by zero on a constant column under ANSI rules, and an aggregate inside
    CASE is evaluated anyway, so r is put together from moments with ``try_divide``.

    ``propagate``: one missing value makes r null. ``pairwise``: missing pairs are skipped.
    """
    if null_policy == "pairwise":
        x, y = paired(x, y)
        defined = f"count({x}) > 1"
    elif null_policy == "propagate":
        x, y = f"`{x}`", f"`{y}`"
        defined = f"count(*) = count({x}) AND count(*) = count({y}) AND count(*) > 1"
    else:
        raise ValueError(f"null_policy must be 'propagate' or 'pairwise', not {null_policy!r}")
    return (
        f"CASE WHEN {defined} AND min({x}) <> max({x}) AND min({y}) <> max({y}) THEN greatest(-1D, "
        f"least(1D, try_divide(covar_pop({x}, {y}), stddev_pop({x}) * stddev_pop({y})))) END"
    )


def single_valued(c: str) -> str:
    """SQL aggregate: exactly one distinct non-null value. Same as a distinct count of one,
    without the extra shuffle that a distinct aggregate needs."""
    return f"coalesce(min(`{c}`) = max(`{c}`), false)"


def _ln_beta_half(a: np.ndarray) -> np.ndarray:
    """ln B(a, 1/2), without the cancellation of lgamma differences for large a."""
    small = np.array([math.lgamma(x) + math.lgamma(0.5) - math.lgamma(x + 0.5) for x in np.minimum(a, 50.0)])
    i = 1.0 / np.maximum(a, 50.0)
    ratio = 1.0 + i * (-1 / 8 + i * (1 / 128 + i * (5 / 1024 + i * (-21 / 32768 - i * 399 / 262144))))
    return np.where(a < 50.0, small, 0.5 * np.log(math.pi * i) - np.log(ratio))


def _beta_fraction(a: np.ndarray, b: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Continued fraction of the regularized incomplete beta function (modified Lentz), until
    it stands still in every row."""
    tiny = 1e-300

    def away(x: np.ndarray) -> np.ndarray:
        return np.where(np.abs(x) > tiny, x, tiny)

    c, d = np.ones_like(z), 1.0 / away(1.0 - (a + b) * z / (a + 1.0))
    total = d.copy()
    for m in range(1, 100_000):
        even = m * (b - m) * z / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * z / ((a + 2 * m) * (a + 2 * m + 1))
        for term in (even, odd):
            d = 1.0 / away(1.0 + term * d)
            c = away(1.0 + term / c)
            step = c * d
            total *= step
        if np.all(np.abs(step - 1.0) < 1e-16):
            break
    return total


def pearson_p_values(r: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided p of r under no correlation: I(1 - r^2; n/2 - 1, 1/2); NaN where undefined."""
    r, n = np.asarray(r, float), np.asarray(n, float)
    out = np.full(r.shape, np.nan)
    known = ~(np.isnan(r) | np.isnan(n)) & (n >= 2)
    out[known] = np.where(r[known] ** 2 >= 1.0, 0.0, 1.0)
    out[known & (n == 2)] = 1.0
    work = known & (n > 2) & (r * r > 0.0) & (r * r < 1.0)
    if work.any():
        a, r2 = n[work] / 2.0 - 1.0, r[work] ** 2
        each, where = np.unique(a, return_inverse=True)
        front = np.exp(a * np.log1p(-r2) + 0.5 * np.log(r2) - _ln_beta_half(each)[where])
        half = np.full_like(a, 0.5)
        near = 1.0 - r2 < (a + 1.0) / (a + 2.5)
        first, second = np.where(near, a, half), np.where(near, half, a)
        part = front * _beta_fraction(first, second, np.where(near, 1.0 - r2, r2)) / first
        out[work] = np.where(near, part, 1.0 - part)
    return out


def pearson_p_value(r: float | None, n: float | None) -> float | None:
    """The p-value of one coefficient; ``None`` where it is undefined."""
    if r is None or n is None:
        return None
    p = float(pearson_p_values(np.array([r]), np.array([n]))[0])
    return None if math.isnan(p) else p


@F.pandas_udf(T.DoubleType())
def p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    """p-values of a batch of coefficients; undefined ones are null."""
    p = pearson_p_values(r.to_numpy(float, na_value=np.nan), n.to_numpy(float, na_value=np.nan))
    return pd.Series(p).astype("Float64").mask(np.isnan(p))


def significance(p: Column | str) -> Column:
    """Stars at 0.001, 0.01 and 0.05; ``ns`` above and for a missing p."""
    p = F.nanvl(_col(p), F.lit(None).cast("double"))
    return (
        F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns")
    )


def three_decimals(c: Column | str) -> Column:
    """``0.1234`` -> ``0.123``; missing -> ``N/A``."""
    c = _col(c)
    return F.when(c.isNull() | F.isnan(c), "N/A").otherwise(F.format_string("%.3f", c))


def digamma(x: np.ndarray) -> np.ndarray:
    """Logarithmic derivative of the gamma function for x > 0: eight steps up by the recurrence,
    then the asymptotic series."""
    y = np.asarray(x, np.float64) + 8.0
    z = 1.0 / (y * y)
    series = z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))
    return np.log(y) - 0.5 / y - series - sum(1.0 / (x + i) for i in range(8))


def trigamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ``digamma``."""
    y = np.asarray(x, np.float64) + 8.0
    z = 1.0 / (y * y)
    series = (1.0 + 0.5 / y + z * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))) / y
    return series + sum(1.0 / (x + i) ** 2 for i in range(8))
