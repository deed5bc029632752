"""Waveform files -> features per title."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseflux.functions.fixed import SIGNAL_FEATURES
from verseflux.operators.describe import describe_features
from verseflux.operators.keys import file_lookup, file_missing
from verseflux.lineage import cut_lineage
from verseflux.operators.signal import Framing, TempoSettings, wave_features
from verseflux.schemas import require_columns
from verseflux.sources.media import list_media, read_media


#: The error of a title without a file.
NO_FILE = "no file"


@dataclass(frozen=True)
class SignalReport:
    features: DataFrame  # title and the five features
    missing: DataFrame  # titles without a file
    errors: DataFrame  # processed files that could not be decoded
    table: DataFrame  # all of these: a row per title with features or an error

    def summary(self) -> DataFrame:
        return describe_features(self.features, SIGNAL_FEATURES)


def extract_signal_features(
    spark: SparkSession,
    titles: DataFrame,
    root: str,
    framing: Framing = Framing(),
    settings: TempoSettings = TempoSettings(),
    extension: str = ".wav",
) -> SignalReport:
    """Features of the file named after each title, searched below ``root``.

    A file wanted by several titles is decoded once and its features are shared. Contents are
    read for wanted files only, at any number of titles; the planner broadcasts their paths if
    their measured size allows. ``errors`` lists wanted files.
    """
    require_columns(titles, ["title"])
    listing = list_media(spark, root, extension)
    found = file_lookup(titles, listing, extension=extension)
    wanted = found.select("path").distinct()
    contents = read_media(spark, root, extension).join(wanted, "path", "left_semi")
    files = contents.select(F.col("path").alias("signal_id"), "content")
    results = cut_lineage(wave_features(files, framing, settings).withColumnRenamed("signal_id", "path"))
    good = results.where("error IS NULL").drop("error")
    missing = file_missing(titles, listing, extension=extension).select("title")
    # One row per title: its features, or why it has none.
    table = found.join(results, "path", "left").select("title", "path", "duration", *SIGNAL_FEATURES, "error")
    table = table.unionByName(missing.withColumn("error", F.lit(NO_FILE)), allowMissingColumns=True)
    return SignalReport(
        features=found.join(good, "path").select("title", *SIGNAL_FEATURES),
        missing=missing,
        errors=results.where("error IS NOT NULL").select("path", "error"),
        table=table,
    )
