"""The tables behind the plots: points and annotations. Lines, bands and the heat map come
from ``regression`` and ``correlate.correlation_matrix``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseflux.functions.stats import numeric, paired, pearson
from verseflux.functions.text import display_name


def scatter_long(
    df: DataFrame, outcome: str, features: list[str], keep: tuple[str, ...] = ()
) -> DataFrame:
    """``(keep..., feature, x, y)`` for every row and feature."""
    slim = df.selectExpr(
        *[f"`{k}`" for k in keep],
        f"CAST(`{outcome}` AS DOUBLE) AS y",
        *[f"CAST(`{f}` AS DOUBLE) AS `{f}`" for f in features],
    )
    return slim.unpivot([*keep, "y"], features, "feature", "x").select(*keep, "feature", "x", "y")


def plot_annotation(df: DataFrame, outcome: str, features: list[str]) -> DataFrame:
    """``(feature, x_label, title, annotation, x_std, y_std)`` per scatter plot.

    The printed correlation skips missing pairs and is ``nan`` if either side is constant.
    """

    def stat(f: str) -> str:
        r = pearson(outcome, f, "pairwise")
        return (
            f"named_struct('r', {r}, 'x_std', stddev_samp(`{f}`), "
            f"'y_std', stddev_samp(`{outcome}`)) AS `{f}`"
        )

    r = F.col("stat.r")
    text = F.when(r.isNull(), "nan").otherwise(F.format_string("%.2f", r))
    return (
        numeric(df, [outcome, *features])
        .agg(*[F.expr(stat(f)) for f in features])
        .unpivot([], features, "feature", "stat")
        .select(
            "feature",
            display_name("feature").alias("x_label"),
            F.concat(F.lit("Sentiment vs "), display_name("feature")).alias("title"),
            F.concat(F.lit("Correlation: "), text).alias("annotation"),
            F.col("stat.x_std").alias("x_std"),
            F.col("stat.y_std").alias("y_std"),
        )
    )


def density_grid(df: DataFrame, outcome: str, features: list[str], bins: int = 50) -> DataFrame:
    """``(feature, x_bin, y_bin, x_from, x_to, y_from, y_to, points)``: the scatter plot of every
    feature as counts on a grid of ``bins`` x ``bins`` cells that spans its points.

    At most ``bins`` x ``bins`` rows per feature, whatever the number of rows: cells are counted
    before they are shuffled. The largest value belongs to the last cell; a constant column is
    cell 0. Pairs with a missing or infinite value have no point; empty cells have no row.
    """
    if bins < 1:
        raise ValueError("need at least one bin")
    columns = list(dict.fromkeys([outcome, *features]))
    finite = numeric(df, columns).selectExpr(
        *[f"if(abs(`{c}`) = double('infinity'), NULL, `{c}`) AS `{c}`" for c in columns]
    )

    def ends(f: str) -> str:
        x, y = paired(f, outcome)
        return f"named_struct('x0', min({x}), 'x1', max({x}), 'y0', min({y}), 'y1', max({y})) AS `{f}`"

    def place(v: str, low: str, high: str) -> str:
        cell = f"floor(try_divide({v} - {low}, {high} - {low}) * {bins})"
        return f"CAST(least(coalesce({cell}, 0), {bins - 1}) AS INT)"  # least() skips nulls

    spans = finite.agg(*[F.expr(ends(f)) for f in features])
    cells = ", ".join(
        f"named_struct('feature', '{f}', 'x_bin', {place(f'`{f}`', f'_e.`{f}`.x0', f'_e.`{f}`.x1')}, "
        f"'y_bin', {place(f'`{outcome}`', f'_e.`{f}`.y0', f'_e.`{f}`.y1')}, "
        f"'here', `{f}` IS NOT NULL AND `{outcome}` IS NOT NULL)"
        for f in features
    )
    counted = (
        finite.withColumn("_e", spans.select(F.struct("*")).scalar())
        .selectExpr(f"inline(array({cells}))")
        .where("here")
        .groupBy("feature", "x_bin", "y_bin")
        .agg(F.count(F.lit(1)).alias("points"))
    )
    # One row per feature on the right side.
    spans = spans.unpivot([], features, "feature", "e").select("feature", "e.*")

    def edge(c: str, step: int) -> str:
        return f"{c}0 + ({c}_bin + {step}) * (({c}1 - {c}0) / {bins})"

    return counted.join(spans, "feature").selectExpr(
        "feature", "x_bin", "y_bin",
        f"{edge('x', 0)} AS x_from", f"{edge('x', 1)} AS x_to",
        f"{edge('y', 0)} AS y_from", f"{edge('y', 1)} AS y_to", "points",
    )
