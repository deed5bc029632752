"""Manifests, file lookup, title joins, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseflux.functions.text import canonical_title
from verseflux.operators.keys import (
    coverage,
    duplicate_keys,
    file_lookup,
    file_missing,
    join_canonical,
)
from verseflux.queries.registry import query, rounded, sql_rounded, table
from verseflux.sources.media import media_manifest

_SQL_PATHS = """
WITH files AS (
    SELECT page_id, 'audio_data/' || rtrim(regexp_replace(regexp_replace(url, '[?#].*$', ''),
        '^https?://', ''), '/') || CASE WHEN url LIKE 'https:%' THEN '.mp3' ELSE '.Mp3' END AS path
    FROM pages),
parts AS (
    SELECT *, regexp_extract(path, '[^/]*$') AS file_name,
        regexp_replace(substring(path, length('audio_data/') + 1), '/?[^/]*$', '') AS folder
    FROM files)
"""


@query(
    "media_manifest",
    _SQL_PATHS
    + """
SELECT page_id, path, file_name, CASE WHEN folder = '' THEN '.' ELSE folder END AS rel_dir,
    'wav_input' || CASE WHEN folder = '' THEN '' ELSE '/' || folder END AS target_dir,
    'wav_input' || CASE WHEN folder = '' THEN '' ELSE '/' || folder END || '/'
        || left(file_name, length(file_name) - 4) || '.wav' AS target_path
FROM parts""",
)
def media_manifest_query(spark: SparkSession, folder: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^https?://", "")
    ending = F.when(F.startswith("url", F.lit("https:")), ".mp3").otherwise(".Mp3")
    files = table(spark, folder, "pages").select(
        "page_id", F.concat(F.lit("audio_data/"), F.rtrim(bare, F.lit("/")), ending).alias("path")
    )
    return media_manifest(files, "audio_data", "wav_input")


# Titles: name and size of a part. Files: named after the parts, with capitals for one type, so
# that some titles have several files and some have none.
_SQL_FILES = """
WITH titles AS (SELECT p_partkey, p_name || ' ' || p_size AS title FROM part),
names AS (SELECT p_partkey, title, trim(replace(title, ' ', '_')) || '.wav' AS file_name FROM titles),
files AS (
    SELECT 'wav_input/' || p_brand || '/' || replace(
        CASE WHEN p_type = 'PROMO' THEN upper(p_name) ELSE p_name END, ' ', '_')
        || '_' || p_size || '.wav' AS path FROM part),
by_name AS (
    SELECT regexp_extract(path, '[^/]*$') AS file_name, min(path) AS path FROM files GROUP BY 1)
"""


def _titles_and_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, folder, "part")
    size = F.col("p_size").cast("string")
    titles = part.select("p_partkey", F.concat_ws(" ", "p_name", size).alias("title"))
    name = F.when(F.col("p_type") == "PROMO", F.upper("p_name")).otherwise(F.col("p_name"))
    path = F.concat(
        F.lit("wav_input/"), "p_brand", F.lit("/"), F.replace(name, F.lit(" "), F.lit("_")),
        F.lit("_"), size, F.lit(".wav"),
    )
    return titles, part.select(path.alias("path"))


@query(
    "file_lookup",
    _SQL_FILES + "SELECT p_partkey, title, file_name, path FROM names JOIN by_name USING (file_name)",
)
def file_lookup_query(spark: SparkSession, folder: str) -> DataFrame:
    return file_lookup(*_titles_and_files(spark, folder)).select(
        "p_partkey", "title", "file_name", "path"
    )


@query(
    "file_missing",
    _SQL_FILES
    + "SELECT p_partkey, title, file_name FROM names "
    "WHERE file_name NOT IN (SELECT file_name FROM by_name)",
)
def file_missing_query(spark: SparkSession, folder: str) -> DataFrame:
    return file_missing(*_titles_and_files(spark, folder)).select("p_partkey", "title", "file_name")


# Left: every part by name. Right: mean price per name and type, with the names in capitals, so
# each left row meets as many right rows as its name has types.
_SQL_SIDES = """
WITH l AS (SELECT p_partkey, trim(lower(replace(p_name, ' ', '_'))) AS title FROM part),
r AS (
    SELECT trim(lower(replace(upper(p_name), ' ', '_'))) AS title, p_type,
        avg(p_retailprice) AS price, count(*) AS parts
    FROM part GROUP BY p_name, p_type)
"""


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, folder, "part")
    right = part.groupBy(F.upper("p_name").alias("title"), "p_type").agg(
        F.avg("p_retailprice").alias("price"), F.count(F.lit(1)).alias("parts")
    )
    return part.select("p_partkey", F.col("p_name").alias("title")), right


@query(
    "join_canonical",
    _SQL_SIDES
    + f"SELECT p_partkey, title, p_type, {sql_rounded('price', 4)} AS price, parts "
    "FROM l JOIN r USING (title)",
)
def join_canonical_query(spark: SparkSession, folder: str) -> DataFrame:
    joined = join_canonical(*_sides(spark, folder))
    return joined.withColumn("price", rounded("price", 4))


@query(
    "join_canonical_dedupe",
    _SQL_SIDES
    + f""",
one AS (SELECT title, min(struct_pack(p_type, price, parts)) AS s FROM r GROUP BY title)
SELECT p_partkey, title, s.p_type AS p_type, {sql_rounded('s.price', 4)} AS price,
    s.parts AS parts
FROM l JOIN one USING (title)""",
)
def join_canonical_dedupe(spark: SparkSession, folder: str) -> DataFrame:
    joined = join_canonical(*_sides(spark, folder), dedupe_right=True)
    return joined.withColumn("price", rounded("price", 4))


@query(
    "duplicate_titles",
    "SELECT trim(lower(replace(p_name, ' ', '_'))) AS title, count(*) AS rows FROM part "
    "GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_titles(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    return duplicate_keys(part.select(canonical_title("p_name").alias("title")))


@query(
    "feature_coverage",
    """
SELECT d.source, count(*) AS total, count(l.doc_id) AS processed,
    round(count(l.doc_id) / count(*), 6) AS share
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)
GROUP BY d.source""",
)
def feature_coverage(spark: SparkSession, folder: str) -> DataFrame:
    result = coverage(
        table(spark, folder, "documents").select("doc_id", "source"),
        table(spark, folder, "labels"),
        "doc_id",
        by=["source"],
    )
    return result.withColumn("share", rounded("share"))
