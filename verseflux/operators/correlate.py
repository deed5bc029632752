"""Correlation of an outcome with many features.

All features are aggregated in one pass over the table as columns of one row per group; the
long form is made from that small result. Rows are never multiplied by the number of features.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseflux.functions.stats import (
    numeric,
    p_value,
    paired,
    pearson,
    significance,
    single_valued,
    three_decimals,
)
from verseflux.lineage import cut_lineage

SMALL_SAMPLE = 10


def label_code(label: Column | str, codes: dict[str, int]) -> Column:
    """Numeric code of a label, null for an unknown one."""
    pairs = [F.lit(x) for pair in codes.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), F.col(label) if isinstance(label, str) else label)


def _finish(long: DataFrame, keys: list[str], sort: bool) -> DataFrame:
    n = "pairs" if "pairs" in long.columns else "sample_size"
    out = long.withColumn("_p", p_value("correlation", F.col(n).cast("double"))).selectExpr(
        *[f"`{k}`" for k in keys],
        "feature",
        "correlation",
        "if(correlation IS NULL, NULL, _p) AS p_value",
        "sample_size",
        "outcome",
        f"sample_size < {SMALL_SAMPLE} AS small_sample",
    )
    return out.orderBy(*keys, F.desc_nulls_last("correlation"), "feature") if sort else out


def _chosen(outcome: str, fallback: str | None) -> str:
    """SQL aggregate: name of the outcome column to use."""
    if fallback is None:
        return f"'{outcome}'"
    return f"if({single_valued(outcome)}, '{fallback}', '{outcome}')"


def correlate_features(
    df: DataFrame,
    outcome: str,
    features: list[str],
    fallback: str | None = None,
    by: list[str] | None = None,
    null_policy: str = "propagate",
    sort: bool = True,
) -> DataFrame:
    """``(by..., feature, correlation, p_value, sample_size, outcome, small_sample)``.

    ``fallback`` is the column used in place of ``outcome`` in groups where ``outcome`` has
    exactly one value. Undefined correlations are null and come last. With the ``pairwise``
    policy the p-value uses the number of complete pairs; ``sample_size`` counts all rows.
    """
    keys = by or []
    outcomes = [outcome] + ([fallback] if fallback else [])

    def stat(feature: str) -> str:
        def of(y: str) -> str:
            pairs = f"count({paired(feature, y)[0]})" if null_policy == "pairwise" else "count(*)"
            r = pearson(y, feature, null_policy)
            return f"named_struct('correlation', {r}, 'pairs', {pairs})"

        if fallback is None:
            return of(outcome)
        return f"if({single_valued(outcome)}, {of(fallback)}, {of(outcome)})"

    wide = numeric(df, [*outcomes, *features], keys).groupBy(*keys).agg(
        F.expr("count(*) AS sample_size"),
        F.expr(f"{_chosen(outcome, fallback)} AS outcome"),
        *[F.expr(f"{stat(f)} AS `{f}`") for f in features],
    )
    long = wide.unpivot([*keys, "sample_size", "outcome"], features, "feature", "stat")
    return _finish(long.select(*keys, "feature", "stat.*", "sample_size", "outcome"), keys, sort)


def choose_outcome(
    df: DataFrame, outcome: str, fallback: str, by: list[str] | None = None, label: str | None = None
) -> DataFrame:
    """Which outcome column a correlation would use, and why, per group."""
    columns = [
        f"{_chosen(outcome, fallback)} AS outcome",
        f"min(`{outcome}`) AS lowest",
        f"max(`{outcome}`) AS highest",
    ]
    if label:
        columns.append(f"if({single_valued(outcome)}, min(`{label}`), NULL) AS only_label")
    return df.groupBy(*(by or [])).agg(*[F.expr(c) for c in columns])


def correlate_joined(
    left: DataFrame,
    right: DataFrame,
    key: str,
    outcome: str,
    features: list[str],
    fallback: str | None = None,
    sort: bool = True,
) -> DataFrame:
    """The result of joining on ``key`` and then correlating, without building the join.

    A key with a rows on the left and b on the right stands for a*b joined rows. Each side is
    reduced to one row of counts, means and squared deviations per key before they meet, so
    hot keys neither multiply nor travel. The reduced table (one row per common key) is read
    twice, for the means and for the deviations from them, so it is written once to the
    checkpoint folder. Missing values make r null, as in ``correlate_features`` by default.
    """
    outcomes = [outcome] + ([fallback] if fallback else [])
    columns = [*outcomes, *features]
    both = cut_lineage(
        _moments(left, key, outcomes, "l_rows")
        .join(_moments(right, key, features, "r_rows"), key)
        .withColumn("weight", F.expr("CAST(l_rows AS DOUBLE) * r_rows"))
    )
    cells = ", ".join(
        f"'{c}', try_divide(sum(weight * `{c}`.mean), sum(weight))" for c in columns
    )
    means = both.agg(F.expr(f"named_struct({cells})")).scalar()
    # Per key and column: the distance of its mean from the overall mean, and its own squared
    # deviations times the rows that each of its rows meets on the other side.
    centred = both.withColumn("_means", means).selectExpr(
        "weight",
        *[f"`{c}`" for c in columns],
        *[f"`{c}`.mean - _means.`{c}` AS `off_{c}`" for c in columns],
        *[f"r_rows * `{c}`.m2 AS `own_{c}`" for c in outcomes],
        *[f"l_rows * `{c}`.m2 AS `own_{c}`" for c in features],
    )
    flat = "false"
    if fallback:
        flat = f"coalesce(min(`{outcome}`.low) = max(`{outcome}`.high), false)"

    def usable(c: str) -> str:
        return f"sum(`{c}`.gone) = 0 AND min(`{c}`.low) <> max(`{c}`.high)"

    def spread(c: str) -> str:
        return f"sqrt(sum(`own_{c}` + weight * `off_{c}` * `off_{c}`))"

    def r(y: str, x: str) -> str:
        value = f"try_divide(sum(weight * `off_{y}` * `off_{x}`), {spread(y)} * {spread(x)})"
        return f"CASE WHEN {usable(y)} AND {usable(x)} THEN greatest(-1D, least(1D, {value})) END"

    def chosen(x: str) -> str:
        return f"if({flat}, {r(fallback, x)}, {r(outcome, x)})" if fallback else r(outcome, x)

    wide = centred.agg(
        F.expr("CAST(coalesce(sum(weight), 0) AS BIGINT) AS sample_size"),
        F.expr(f"if({flat}, '{fallback}', '{outcome}') AS outcome"),
        *[F.expr(f"{chosen(f)} AS `{f}`") for f in features],
    )
    return _finish(
        wide.unpivot(["sample_size", "outcome"], features, "feature", "correlation"), [], sort
    )


def _moments(df: DataFrame, key: str, columns: list[str], rows: str) -> DataFrame:
    def stat(c: str) -> str:
        return (
            f"named_struct('mean', avg(`{c}`), 'm2', var_pop(`{c}`) * count(`{c}`), "
            f"'low', min(`{c}`), 'high', max(`{c}`), 'gone', count(*) - count(`{c}`)) AS `{c}`"
        )

    return numeric(df, columns, [key]).groupBy(key).agg(
        F.expr(f"count(*) AS {rows}"), *[F.expr(stat(c)) for c in columns]
    )


def add_significance(results: DataFrame) -> DataFrame:
    """Stars and the printed forms of r and p."""
    return results.select(
        "*",
        significance("p_value").alias("significance"),
        three_decimals("correlation").alias("correlation_text"),
        three_decimals("p_value").alias("p_value_text"),
    )


def compare_groups(
    df: DataFrame,
    group_col: str,
    outcome: str,
    features: list[str],
    fallback: str | None = None,
    groups: list[str] | None = None,
) -> DataFrame:
    """Correlations per group, side by side.

    Without ``groups``: long, one row per group and feature, for any number of groups. With
    ``groups``: one row per feature and columns ``{group}_correlation``, ``{group}_p_value``.
    """
    if group_col not in df.columns:
        raise ValueError(f"no column {group_col!r} to compare groups by")
    long = correlate_features(df, outcome, features, fallback, [group_col], sort=False)
    if groups is None:
        return long.select(group_col, "feature", "correlation", "p_value", "sample_size", "outcome")
    return (
        long.groupBy("feature")
        .pivot(group_col, groups)
        .agg(F.first("correlation").alias("correlation"), F.first("p_value").alias("p_value"))
    )


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(feature_a, feature_b, correlation)`` for all pairs, missing pairs skipped."""
    pairs = {(a, b): f"_r{i}" for i, (a, b) in enumerate(combinations(columns, 2))}
    own = {a: f"_d{i}" for i, a in enumerate(columns)}
    wide = numeric(df, columns).agg(
        *[F.expr(f"{pearson(a, b, 'pairwise')} AS {name}") for (a, b), name in pairs.items()],
        *[
            F.expr(f"CASE WHEN min(`{a}`) <> max(`{a}`) THEN 1D END AS {name}")
            for a, name in own.items()
        ],
    )
    cells = ", ".join(
        f"named_struct('feature_a', '{a}', 'feature_b', '{b}', 'correlation', "
        f"{own[a] if a == b else pairs.get((a, b)) or pairs[b, a]})"
        for a in columns
        for b in columns
    )
    return wide.selectExpr(f"inline(array({cells}))")
