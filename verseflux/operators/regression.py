"""Least-squares lines of an outcome on features, with confidence bands."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseflux.functions.stats import numeric, paired
from verseflux.lineage import cut_lineage

NORMAL_975 = 1.959963984540054
GRID = 100


def regression_line(
    df: DataFrame, outcome: str, features: list[str], by: list[str] | None = None
) -> DataFrame:
    """``(by..., feature, n, slope, intercept, r2, x_mean, x_min, x_max, sxx, residual_se)``.

    One pass over the table for all features. Null where x is constant or pairs are missing.
    """
    keys = by or []

    def stat(feature: str) -> str:
        x, y = paired(feature, outcome)
        sxx, syy, sxy = (f"regr_{m}({y}, {x})" for m in ("sxx", "syy", "sxy"))
        left_over = f"greatest(0D, {syy} - try_divide({sxy} * {sxy}, {sxx}))"
        return f"""named_struct('n', count({x}), 'slope', regr_slope({y}, {x}),
            'intercept', regr_intercept({y}, {x}), 'r2', regr_r2({y}, {x}), 'x_mean', avg({x}),
            'x_min', min({x}), 'x_max', max({x}), 'sxx', {sxx},
            'residual_se', sqrt(try_divide({left_over}, count({x}) - 2))) AS `{feature}`"""

    rows = numeric(df, [outcome, *features], keys)
    wide = rows.groupBy(*keys).agg(*[F.expr(stat(f)) for f in features])
    return wide.unpivot(keys, features, "feature", "stat").select(*keys, "feature", "stat.*")


def _grid(lines: DataFrame, points: int) -> DataFrame:
    """One row per grid point between the smallest and the largest x of each line."""
    step = F.col("point") / F.lit(float(points - 1))
    return lines.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("x_min") + (F.col("x_max") - F.col("x_min")) * step
    )


def regression_band(
    df: DataFrame,
    outcome: str,
    features: list[str],
    by: list[str] | None = None,
    points: int = GRID,
    z: float = NORMAL_975,
) -> DataFrame:
    """``(by..., feature, point, x, fit, low, high)``: the line and its band on a grid of x.

    Closed form from the moments of one pass; at large n it is where the bootstrap converges.
    """
    keys = by or []
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    away = F.col("x") - F.col("x_mean")
    half = z * F.col("residual_se") * F.sqrt(
        F.try_divide(F.lit(1.0), F.col("n")) + F.try_divide(away * away, F.col("sxx"))
    )
    return _grid(regression_line(df, outcome, features, by), points).select(
        *keys, "feature", "point", "x", fit.alias("fit"), (fit - half).alias("low"),
        (fit + half).alias("high"),
    )


# Drawing by integers modulo a prime: any engine can repeat it, and no product overflows.
DRAW_PRIME = 2**31 - 1
DRAW_STEPS = (48271, 69621, 40692)
#: Rows and resamples of one product of weights and moments.
DRAW_ROWS, DRAW_RESAMPLES = 1024, 250


# Cumulated Poisson(1) probabilities; counts end at 12, beyond which lie 6e-11 of all draws.
_POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(12)])


def _weights(ids: np.ndarray, resamples: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) counts, a row per resample and a column per id, each fixed by (id, resample,
    seed)."""
    p, (a, b, c) = DRAW_PRIME, DRAW_STEPS
    mixed = ((ids % p) * a)[None, :] + (resamples * b + seed * c + 1)[:, None]
    mixed %= p
    for _ in range(3):
        mixed = (mixed * mixed % p * a + mixed * c + b) % p
    return np.searchsorted(_POISSON, mixed / float(p), side="right").astype(np.float64)


def bootstrap_band(
    df: DataFrame,
    id_col: str,
    outcome: str,
    features: list[str],
    resamples: int = 1000,
    points: int = GRID,
    seed: int = 0,
) -> DataFrame:
    """The same table for whole-number ids with the band taken from resampled lines (percentiles 2.5 and 97.5).

    Poisson bootstrap: a row's weight in a resample is a function of (id, resample, seed), so a
    recomputed task draws the same weights. A batch of rows is one product of its weights with
    its moments; one row per resample leaves each task, and no row is multiplied. Rows without
    an id take no part. The work is rows x ``resamples``; ``regression_band`` is its limit.
    """
    rows = cut_lineage(numeric(df, [outcome, *features], [id_col]))  # numbers only, read thrice
    lines = regression_line(rows, outcome, features)
    middle = rows.agg(*[F.expr(f"coalesce(avg({paired(f, outcome)[0]}), 0D) AS c{i}") for i, f in enumerate(features)]).first()
    centres = [middle[f"c{i}"] for i in range(len(features))]
    parts = ["w", "x", "y", "xx", "xy"]
    names = [f"{m}{i}" for i in range(len(features)) for m in parts]

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((resamples, len(names)))
        for batch in batches:
            for at in range(0, batch.num_rows, DRAW_ROWS):
                own = batch.slice(at, DRAW_ROWS)
                y = own.column(1).to_numpy(zero_copy_only=False)
                moments = []
                for i, centre in enumerate(centres):
                    x = own.column(2 + i).to_numpy(zero_copy_only=False) - centre
                    here = ~(np.isnan(x) | np.isnan(y))
                    x, z = np.where(here, x, 0.0), np.where(here, y, 0.0)
                    moments += [here.astype(float), x, z, x * x, x * z]
                table = np.stack(moments, axis=1)
                for first in range(0, resamples, DRAW_RESAMPLES):
                    some = np.arange(first, min(first + DRAW_RESAMPLES, resamples))
                    sums[some] += _weights(own.column(0).to_numpy(), some + 1, seed) @ table
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, resamples + 1, dtype=np.int32)), *map(pa.array, sums.T.copy())], names=["resample", *names])

    plain = rows.select(F.col(id_col).cast("long").alias("_id"), outcome, *features).where("_id IS NOT NULL")
    drawn = plain.mapInArrow(draw, ", ".join(["resample int", *[f"{n} double" for n in names]]))
    sums = drawn.groupBy("resample").agg(*[F.sum(n).alias(n) for n in names])
    each = [
        f"struct('{f}' AS feature, " + ", ".join(f"{m}{i} AS {m}" for m in parts) + f", {centres[i]!r}D AS centre)"
        for i, f in enumerate(features)
    ]
    sums = sums.selectExpr(f"inline(array({', '.join(each)}))")
    slope = F.try_divide(
        F.col("xy") - F.try_divide(F.col("x") * F.col("y"), F.col("w")),
        F.col("xx") - F.try_divide(F.col("x") * F.col("x"), F.col("w")),
    )
    resampled = sums.withColumn("b", slope).select(
        "feature",
        "b",
        (F.try_divide(F.col("y") - F.col("b") * F.col("x"), F.col("w"))).alias("a"),
        "centre",
    )
    grid = _grid(lines, points)
    fit = F.col("intercept") + F.col("slope") * F.col("x")
    drawn = F.col("a") + F.col("b") * (F.col("x") - F.col("centre"))
    return (
        grid.join(resampled, "feature")
        .groupBy("feature", "point")
        .agg(
            F.first("x").alias("x"),
            F.first(fit).alias("fit"),
            F.percentile(drawn, F.lit(0.025)).alias("low"),
            F.percentile(drawn, F.lit(0.975)).alias("high"),
        )
    )
