"""Joins on titles and the lookup of files by title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseflux.functions.text import base_name, canonical_title, file_title


def one_row_per_key(df: DataFrame, key: str) -> DataFrame:
    """The smallest row of each key. A ``min`` of structs: combined before the shuffle, so a
    key with a third of all rows costs no more than any other."""
    rest = [c for c in df.columns if c != key]
    if not rest:
        return df.distinct()
    picked = df.groupBy(key).agg(F.min(F.struct(*rest)).alias("_row"))
    return picked.select(key, "_row.*")


def join_canonical(
    left: DataFrame,
    right: DataFrame,
    key: str = "title",
    dedupe_right: bool = False,
    match_nulls: bool = False,
) -> DataFrame:
    """Inner join on the canonical form of ``key``; the result holds that form.

    Repeated keys multiply. ``dedupe_right`` keeps one right row per key; ``match_nulls``
    pairs missing keys with each other. No side is broadcast by hint: the adaptive planner
    does so by measured size, and splits hot keys of a sort-merge join.
    """
    left = left.withColumn(key, canonical_title(key))
    right = right.withColumn(key, canonical_title(key))
    if dedupe_right:
        right = one_row_per_key(right, key)
    if not match_nulls:
        return left.join(right, key)
    renamed = right.withColumnRenamed(key, "_right_key")
    return left.join(renamed, F.col(key).eqNullSafe(F.col("_right_key"))).drop("_right_key")


def duplicate_keys(df: DataFrame, key: str = "title") -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return (
        df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)
    )


def files_by_name(files: DataFrame, path_col: str = "path") -> DataFrame:
    """``(file_name, path)``: one path per base name, the first in path order."""
    return (
        files.select(base_name(path_col).alias("file_name"), F.col(path_col).alias("path"))
        .groupBy("file_name")
        .agg(F.min("path").alias("path"))
    )


def file_lookup(
    titles: DataFrame,
    files: DataFrame,
    title_col: str = "title",
    path_col: str = "path",
    extension: str = ".wav",
) -> DataFrame:
    """Titles whose file exists, with ``file_name`` and ``path``. The match keeps case."""
    named = _named(titles, title_col, extension)
    return named.join(files_by_name(files, path_col), "file_name")


def file_missing(
    titles: DataFrame,
    files: DataFrame,
    title_col: str = "title",
    path_col: str = "path",
    extension: str = ".wav",
) -> DataFrame:
    """Titles without a file."""
    names = files.select(base_name(path_col).alias("file_name")).distinct()
    return _named(titles, title_col, extension).join(names, "file_name", "left_anti")


def _named(titles: DataFrame, title_col: str, extension: str) -> DataFrame:
    return titles.withColumn("file_name", F.concat(file_title(title_col), F.lit(extension)))


def coverage(
    expected: DataFrame, found: DataFrame, key: str, by: list[str] | None = None
) -> DataFrame:
    """Rows expected, rows found and their share, over all or per group."""
    marks = found.select(key).distinct().withColumn("_found", F.lit(1))
    joined = expected.join(marks, key, "left")
    total, hit = F.count(F.lit(1)), F.count("_found")
    return joined.groupBy(*(by or [])).agg(
        total.alias("total"),
        hit.alias("processed"),
        F.try_divide(hit, total).alias("share"),
    )
