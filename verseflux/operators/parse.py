"""Records of a text collection -> typed song table. Projection and filters only: no shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseflux.functions.fixed import HEADER_PREFIX, TITLE_LINE
from verseflux.functions.once import compute_once
from verseflux.functions.text import preview, strip, unify_newlines

# `(?d)`: only \n ends a line, as in Python.
_TITLE_LINE = "(?d)" + TITLE_LINE


def _songs(records: DataFrame, text_col: str) -> DataFrame:
    """Stripped, non-blank, non-header records with their title line (empty if none)."""
    songs = compute_once(records, _song=strip(unify_newlines(text_col))).where(
        (F.col("_song") != "") & ~F.startswith("_song", F.lit(HEADER_PREFIX))
    )
    return compute_once(songs, _line=F.regexp_extract("_song", _TITLE_LINE, 0))


def parse_collection(
    records: DataFrame,
    text_col: str = "value",
    file_col: str = "file_name",
    source: str = "human",
    compat: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(title, artist, year, source, lyrics)`` for every record with a title line.

    ``year`` is the first run of four digits in the file name, null without one. ``lyrics``
    begin after the title line; with ``compat`` they begin after the first ``---`` found from
    the fourth character on, which differs when something precedes the title line.
    """
    line, song = F.col("_line"), F.col("_song")
    if compat:
        start = F.locate("---", song, 4) + 3
    else:
        start = F.instr(song, line) + F.length(line)
    year = F.regexp_extract(F.col(file_col), "[0-9]{4}", 0).try_cast("int")
    return _songs(records, text_col).where(line != "").select(
        *keep,
        F.regexp_extract(line, _TITLE_LINE, 1).alias("title"),
        F.regexp_extract(line, _TITLE_LINE, 2).alias("artist"),
        year.alias("year"),
        F.lit(source).alias("source"),
        strip(F.substring(song, start, F.length(song))).alias("lyrics"),
    )


def parse_rejects(
    records: DataFrame,
    text_col: str = "value",
    file_col: str = "file_name",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Records that have no title line: ``(file_name, preview)``."""
    return (
        _songs(records, text_col)
        .where(F.col("_line") == "")
        .select(*keep, F.col(file_col).alias("file_name"), preview("_song").alias("preview"))
    )
