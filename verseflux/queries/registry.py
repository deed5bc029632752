"""Name -> query function, name -> SQL text, and SQL fragments that several queries share."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verseflux.functions.fixed import CONTRACTIONS
from verseflux.functions.text import WHITE_SPACE, WHITE_SPACE_CLASS
from verseflux.session import ship_package
from verseflux.sources.tables import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function: Callable[[SparkSession, str], DataFrame]):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(ship_package(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return spread(df) if name == "documents" else df


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


# ---- SQL fragments ----------------------------------------------------------------------


def sql_rounded(expression: str, digits: int = 6) -> str:
    return f"(round({expression}, {digits}) + 0.0::double)"


def sql_strip(expression: str) -> str:
    return f"trim({expression}, '{WHITE_SPACE}')"


def sql_words(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]::varchar[]"


def sql_tokens(text: str, stop, min_len: int = 3) -> str:
    """List of clean tokens of a text expression."""
    cleaned = f"regexp_replace(lower({text}), '[^a-z{WHITE_SPACE_CLASS}]+', '', 'g')"
    for a, b in CONTRACTIONS:
        cleaned = f"regexp_replace({cleaned}, '\\b{a}{b}\\b', '{a} {b}', 'g')"
    return (
        f"list_filter(string_split_regex({cleaned}, '[{WHITE_SPACE_CLASS}]+'), "
        f"lambda t: length(t) >= {min_len} AND NOT list_contains({sql_words(stop)}, t))"
    )


def sql_pearson(y: str, x: str) -> str:
    """r, or null where it is undefined."""
    return (
        f"CASE WHEN count(*) <> count({x}) OR count(*) <> count({y}) OR count(*) < 2 "
        f"OR min({x}) = max({x}) OR min({y}) = max({y}) THEN NULL ELSE corr({y}, {x}) END"
    )


def sql_p_value(r: str, n: str, steps: int = 20000) -> str:
    """Two-sided p by integrating the density of r under no correlation (Simpson's rule over
    the arc sine of r, where the integrand is a smooth power of a cosine)."""
    top = f"asin(least(1.0, abs({r})))"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = (
        f"list_sum(list_transform(range(0, {steps + 1}), lambda i: {weight} * "
        f"pow(cos({top} * i / {steps}), {n} - 3))) * {top} / {3 * steps}.0"
    )
    scale = f"exp(lgamma(({n} - 1) / 2.0) - lgamma(({n} - 2) / 2.0)) / sqrt(pi())"
    return (
        f"CASE WHEN {r} IS NULL THEN NULL WHEN {n} = 2 THEN 1.0 "
        f"ELSE greatest(0.0, 1 - 2 * {scale} * {area}) END"
    )


def sql_stars(p: str) -> str:
    return (
        f"CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' "
        f"WHEN {p} < 0.05 THEN '*' ELSE 'ns' END"
    )
