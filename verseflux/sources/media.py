"""Listings of media files. File contents are never read for a listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _any_case(extension: str) -> str:
    letters = extension.lstrip(".")
    return "*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in letters)


def read_media(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """All files below ``root`` with the extension in any case, with ``content`` (lazy)."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", _any_case(extension))
        .load(root)
    )


def list_media(spark: SparkSession, root: str, extension: str) -> DataFrame:
    """``(path, length)`` only; column pruning keeps the contents unread."""
    return read_media(spark, root, extension).select("path", "length")


def media_manifest(
    files: DataFrame,
    in_root: str,
    out_root: str,
    src_ext: str = ".mp3",
    dst_ext: str = ".wav",
    path_col: str = "path",
) -> DataFrame:
    """Where each source file goes: same tree below ``out_root``, last extension swapped.

    Adds ``rel_dir`` (``.`` for the root itself), ``file_name``, ``target_dir`` and
    ``target_path``. Rows without the extension (any case) are left out.
    """
    path = F.col(path_col)
    if ":" not in in_root:  # listings of local files carry a `file:` scheme
        path = F.regexp_replace(path, "^file:(//)?", "")
    root = in_root.rstrip("/") + "/"
    name = F.substring_index(path, "/", -1)
    inside = F.substring(path, len(root) + 1, 1 << 30)
    folder = F.regexp_replace(inside, r"/?[^/]*$", "")
    new_name = F.concat(
        F.expr(f"left(file_name, length(file_name) - {len(src_ext)})"), F.lit(dst_ext)
    )
    target = F.concat_ws(
        "/", F.lit(out_root.rstrip("/")), F.when(F.col("rel_dir") != ".", F.col("rel_dir"))
    )
    return (
        files.where(F.startswith(path, F.lit(root)))
        .where(F.endswith(F.lower(path), F.lit(src_ext.lower())))
        .withColumn("file_name", name)
        .withColumn("rel_dir", F.when(folder == "", ".").otherwise(folder))
        .withColumn("target_dir", target)
        .withColumn("target_path", F.concat_ws("/", "target_dir", new_name))
    )
