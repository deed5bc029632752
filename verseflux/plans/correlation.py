"""Scored documents and signal features -> correlation report and chart tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from verseflux.functions.fixed import LABEL_CODES, SIGNAL_FEATURES
from verseflux.functions.text import canonical_title
from verseflux.operators.charts import plot_annotation, scatter_long
from verseflux.operators.correlate import (
    add_significance,
    compare_groups,
    correlate_features,
    correlate_joined,
    correlation_matrix,
    label_code,
)
from verseflux.operators.keys import join_canonical, one_row_per_key
from verseflux.operators.regression import regression_band, regression_line
from verseflux.schemas import SIGNAL_RESULTS, TEXT_RESULTS, require_columns
from verseflux.sources.tables import read_csv

OUTCOME, FALLBACK = "sentiment_numeric", "sentiment_score"


def load_results(spark: SparkSession, texts: str, signals: str) -> tuple[DataFrame, DataFrame]:
    """The two result tables from CSV."""
    return read_csv(spark, texts, TEXT_RESULTS), read_csv(spark, signals, SIGNAL_RESULTS)


def with_codes(texts: DataFrame) -> DataFrame:
    require_columns(texts, ["title", "sentiment", FALLBACK])
    return texts.withColumn(OUTCOME, label_code("sentiment", LABEL_CODES).cast("double"))


def correlation_report(
    texts: DataFrame,
    signals: DataFrame,
    features: list[str] = SIGNAL_FEATURES,
    dedupe_right: bool = False,
) -> DataFrame:
    """r, p and stars of sentiment with each feature over the joined titles.

    The join is never built: see ``correlate_joined``.
    """
    left = with_codes(texts).withColumn("title", canonical_title("title"))
    right = require_columns(signals, ["title", *features]).withColumn(
        "title", canonical_title("title")
    )
    if dedupe_right:
        right = one_row_per_key(right.select("title", *features), "title")
    return add_significance(correlate_joined(left, right, "title", OUTCOME, features, FALLBACK))


@dataclass(frozen=True)
class ChartTables:
    points: DataFrame
    lines: DataFrame
    bands: DataFrame
    annotations: DataFrame
    matrix: DataFrame


def chart_tables(joined: DataFrame, features: list[str] = SIGNAL_FEATURES) -> ChartTables:
    """Everything the scatter plots and the heat map show, for a joined table."""
    return ChartTables(
        points=scatter_long(joined, OUTCOME, features),
        lines=regression_line(joined, OUTCOME, features),
        bands=regression_band(joined, OUTCOME, features),
        annotations=plot_annotation(joined, OUTCOME, features),
        matrix=correlation_matrix(joined, [OUTCOME, *features]),
    )


def joined_table(texts: DataFrame, signals: DataFrame, dedupe_right: bool = False) -> DataFrame:
    return join_canonical(with_codes(texts), signals, "title", dedupe_right)


def group_report(
    joined: DataFrame, group_col: str = "source", features: list[str] = SIGNAL_FEATURES,
    groups: list[str] | None = None,
) -> DataFrame:
    return compare_groups(joined, group_col, OUTCOME, features, FALLBACK, groups)


def overall(joined: DataFrame, features: list[str] = SIGNAL_FEATURES) -> DataFrame:
    return correlate_features(joined, OUTCOME, features, FALLBACK)
