"""Correlations that follow a growing table: every micro-batch adds its moments to a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from verseflux.operators.moments import correlate_moments, feature_moments


def follow_correlations(
    rows: DataFrame,
    store: str,
    state: str,
    outcomes: list[str],
    features: list[str],
    by: list[str] | None = None,
) -> StreamingQuery:
    """Add the moments of the stream's new ``rows`` to Parquet folder ``store`` and stop.

    A micro-batch owns the folder of its number and overwrites it when it is repeated, so every
    row counts once. ``state`` is the streaming checkpoint folder; it belongs to ``store``, and
    both are shared storage on a cluster. No row is read again: a batch costs one aggregation
    of its own rows, and the store has one row per batch, group, outcome and feature.
    """

    def add(batch: DataFrame, number: int) -> None:
        moments = feature_moments(batch, outcomes, features, by)
        moments.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", state).trigger(availableNow=True).start()


def stored_correlations(
    spark: SparkSession,
    store: str,
    outcome: str,
    fallback: str | None = None,
    by: list[str] | None = None,
    null_policy: str = "propagate",
) -> DataFrame:
    """``correlate_features`` of all rows whose moments are in ``store``."""
    return correlate_moments(spark.read.parquet(store), outcome, fallback, by, null_policy)
