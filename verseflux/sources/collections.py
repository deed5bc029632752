"""Delimited text collections: one row per record, split by the file source itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseflux.functions.fixed import RECORD_SEPARATOR


def read_collections(
    spark: SparkSession, path: str | list[str], separator: str = RECORD_SEPARATOR
) -> DataFrame:
    """Records of all ``*.txt`` files directly in ``path``: ``(file_name, value)``.

    The separator is given to the file source as its line separator, so one huge file is
    split over many tasks and no file is ever held whole.
    """
    return _records(spark.read, path, separator)


def read_collections_stream(
    spark: SparkSession,
    path: str,
    separator: str = RECORD_SEPARATOR,
    max_files: int | None = None,
) -> DataFrame:
    """The same rows as a stream of newly arriving files, at most ``max_files`` per batch."""
    reader = spark.readStream
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _records(reader, path, separator)


def _records(reader, path, separator: str) -> DataFrame:
    return (
        reader.option("pathGlobFilter", "*.txt")
        .option("lineSep", separator)
        .text(path)
        .select(F.col("_metadata.file_name").alias("file_name"), "value")
    )


def explode_records(
    df: DataFrame, text_col: str = "value", separator: str = RECORD_SEPARATOR
) -> DataFrame:
    """Split texts that hold several records each; ``record`` is the position in the text."""
    parts = F.split(F.col(text_col), rf"\Q{separator}\E")
    keep = [c for c in df.columns if c != text_col]
    return df.select(*keep, F.posexplode(parts).alias("record", text_col))
