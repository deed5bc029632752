"""Table schemas and the column check used at the edges of a plan."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

SONGS = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("artist", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("lyrics", T.StringType()),
    ]
)

TEXT_RESULTS = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("artist", T.StringType()),
        T.StructField("year", T.IntegerType()),
        T.StructField("source", T.StringType()),
        T.StructField("sentiment", T.StringType()),
        T.StructField("sentiment_score", T.DoubleType()),
        T.StructField("topics", T.StringType()),
    ]
)

SIGNAL_RESULTS = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("tempo", T.DoubleType()),
        T.StructField("vocal_tone_quality", T.DoubleType()),
        T.StructField("sound_brightness", T.DoubleType()),
        T.StructField("musical_note_strength", T.DoubleType()),
        T.StructField("sound_loudness", T.DoubleType()),
    ]
)

CORRELATION_RESULTS = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("correlation", T.DoubleType()),
        T.StructField("p_value", T.DoubleType()),
        T.StructField("sample_size", T.LongType()),
    ]
)

# One row per piece of a signal: `samples` starts at the first sample of frame `first_frame`.
CHUNKS = T.StructType(
    [
        T.StructField("signal_id", T.StringType()),
        T.StructField("first_frame", T.LongType()),
        T.StructField("n_samples", T.LongType()),
        T.StructField("samples", T.ArrayType(T.FloatType(), containsNull=False)),
    ]
)


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Return ``df``, or raise ``ValueError`` naming the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; the table has {df.columns}")
    return df


def has_column(df: DataFrame, column: str) -> bool:
    return column in df.columns
