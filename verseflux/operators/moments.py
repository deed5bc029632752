"""Correlations from stored moments, so that new rows change a result without a rescan.

A batch of rows becomes one row of moments per group, outcome and feature. Moments of any
number of batches, in any order, merge into those of all their rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseflux.functions.stats import numeric, paired
from verseflux.operators.correlate import _finish


def feature_moments(
    df: DataFrame, outcomes: list[str], features: list[str], by: list[str] | None = None
) -> DataFrame:
    """``(by..., outcome, feature, n, y_low, y_high, pairs, mean_x, mean_y, m2_x, m2_y, c_xy,
    x_min, x_max, y_min, y_max)``: one pass, aggregated as columns of one row per group.

    ``n``, ``y_low`` and ``y_high`` are of all rows, the others of the complete pairs. Null and
    NaN are missing; of a group without a complete pair the moments are null. A null group is a
    group of its own. No rows give no groups; without ``by``, one row of zero rows.
    """
    keys = by or []

    def stat(y: str, f: str) -> str:
        a, b = paired(f, y)
        return (
            f"named_struct('outcome', '{y}', 'feature', '{f}', 'n', count(*), "
            f"'y_low', min(`{y}`), 'y_high', max(`{y}`), 'pairs', count({a}), "
            f"'mean_x', avg({a}), 'mean_y', avg({b}), "
            f"'m2_x', var_pop({a}) * count({a}), 'm2_y', var_pop({b}) * count({a}), "
            f"'c_xy', covar_pop({a}, {b}) * count({a}), "
            f"'x_min', min({a}), 'x_max', max({a}), 'y_min', min({b}), 'y_max', max({b}))"
        )

    cells = ", ".join(stat(y, f) for y in outcomes for f in features)
    wide = numeric(df, [*outcomes, *features], keys).groupBy(*keys)
    return wide.agg(F.expr(f"array({cells})").alias("_cells")).select(*keys, F.inline("_cells"))


def merge_moments(moments: DataFrame, by: list[str] | None = None) -> DataFrame:
    """One row per group, outcome and feature: the moments of all rows that went into ``moments``.

    The squares and products are moved to the mean of all before they are added, so that nothing
    cancels. The work is on the moments, of which a batch has one row per group and feature.
    """
    keys = [*(by or []), "outcome", "feature"]
    same = Window.partitionBy(*keys)
    off = {
        f"off_{c}": F.col(f"mean_{c}")
        - F.try_divide(
            F.sum(F.col("pairs") * F.col(f"mean_{c}")).over(same),
            F.sum(F.when(F.col(f"mean_{c}").isNotNull(), F.col("pairs"))).over(same).cast("double"),
        )
        for c in "xy"
    }
    return (
        moments.withColumns(off)
        .groupBy(*keys)
        .agg(
            F.sum("n").alias("n"),
            F.min("y_low").alias("y_low"),
            F.max("y_high").alias("y_high"),
            F.sum("pairs").alias("pairs"),
            *[F.expr(f"try_divide(sum(pairs * mean_{c}), CAST(sum(pairs) AS DOUBLE)) AS mean_{c}") for c in "xy"],
            *[F.expr(f"sum(m2_{c} + pairs * off_{c} * off_{c}) AS m2_{c}") for c in "xy"],
            F.expr("sum(c_xy + pairs * off_x * off_y) AS c_xy"),
            *[F.expr(f"{f}({c}_{f}) AS {c}_{f}") for c in "xy" for f in ("min", "max")],
        )
    )


def correlate_moments(
    moments: DataFrame,
    outcome: str,
    fallback: str | None = None,
    by: list[str] | None = None,
    null_policy: str = "propagate",
    sort: bool = True,
) -> DataFrame:
    """The result of ``correlate_features`` for all rows that went into ``moments``, in the same
    columns and by the same rules for missing values, constant columns and the fallback."""
    keys = by or []
    if null_policy not in ("propagate", "pairwise"):
        raise ValueError(f"null_policy must be 'propagate' or 'pairwise', not {null_policy!r}")
    defined = "pairs > 1 AND x_min <> x_max AND y_min <> y_max"
    if null_policy == "propagate":
        defined += " AND pairs = n"
    r = f"CASE WHEN {defined} THEN greatest(-1D, least(1D, try_divide(c_xy, sqrt(m2_x) * sqrt(m2_y)))) END"
    merged = merge_moments(moments, by).where(F.col("outcome").isin([outcome, *([fallback] if fallback else [])]))
    one = merged.select(
        *keys,
        "feature",
        F.struct(
            F.expr(f"{r} AS correlation"),
            *([F.col("pairs")] if null_policy == "pairwise" else []),
            F.col("n").alias("sample_size"),
            "outcome",
            F.expr("coalesce(y_low = y_high, false)").alias("flat"),
        ).alias("stat"),
    )

    def of(name: str) -> str:
        return f"max(stat) FILTER (WHERE stat.outcome = '{name}')"

    chosen = f"if({of(outcome)}.flat, {of(fallback)}, {of(outcome)})" if fallback else of(outcome)
    long = one.groupBy(*keys, "feature").agg(F.expr(chosen).alias("stat"))
    return _finish(long.select(*keys, "feature", "stat.*"), keys, sort)
