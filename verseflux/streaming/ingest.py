"""New text files -> song table, exactly once per file."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from verseflux.operators.parse import parse_collection
from verseflux.operators.scoring import Scorer, score_text
from verseflux.sources.collections import read_collections_stream


def ingest_new_files(
    spark: SparkSession,
    path: str,
    out: str,
    state: str,
    source: str = "human",
    compat: bool = False,
    scorer: Scorer | None = None,
    max_files: int | None = None,
) -> StreamingQuery:
    """Append the songs of files not seen before to Parquet folder ``out`` and stop.

    ``state`` is the streaming checkpoint folder, shared storage on a cluster. Parsing and
    scoring keep no state, so they are the batch operators. ``max_files`` sets the size of a
    micro-batch; all waiting files are processed either way.
    """
    records = read_collections_stream(spark, path, max_files=max_files)
    songs = parse_collection(records, source=source, compat=compat)
    if scorer is not None:
        songs = score_text(songs, "lyrics", scorer)
    return (
        songs.writeStream.format("parquet")
        .option("checkpointLocation", state)
        .trigger(availableNow=True)
        .start(out)
    )
