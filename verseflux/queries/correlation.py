"""Correlation, regression, description and chart tables."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseflux.functions.fixed import LABEL_CODES
from verseflux.functions.text import letter_count, line_count, upper_count, word_count
from verseflux.operators.charts import density_grid, plot_annotation, scatter_long
from verseflux.operators.correlate import (
    add_significance,
    choose_outcome,
    compare_groups,
    correlate_features,
    correlate_joined,
    correlation_matrix,
    label_code,
)
from verseflux.operators.describe import describe_features
from verseflux.operators.moments import correlate_moments, feature_moments
from verseflux.operators.parse import parse_collection
from verseflux.operators.regression import (
    DRAW_PRIME,
    DRAW_STEPS,
    NORMAL_975,
    bootstrap_band,
    regression_band,
    regression_line,
)
from verseflux.queries.registry import (
    query,
    rounded,
    sql_p_value,
    sql_pearson,
    sql_rounded,
    sql_stars,
    table,
)
from verseflux.queries.texts import _SQL_SONGS, _LINE, collection_files
from verseflux.queries.registry import sql_strip
from verseflux.sources.collections import explode_records

TEXT_FEATURES = ["n_chars", "n_words", "mean_word_length", "n_lines", "upper_share"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_tax"]


def with_text_features(df: DataFrame, text_col: str) -> DataFrame:
    n, words = F.length(text_col), word_count(text_col)
    return (
        df.withColumn("n_chars", n)
        .withColumn("n_words", words)
        .withColumn("mean_word_length", F.try_divide(letter_count(text_col), words))
        .withColumn("n_lines", line_count(text_col))
        .withColumn("upper_share", F.try_divide(upper_count(text_col), n))
    )


def sql_text_features(text: str) -> str:
    words = f"len(regexp_extract_all({text}, '[^ \\t\\n\\r]+'))"
    letters = f"length(regexp_replace({text}, '[ \\t\\n\\r]+', '', 'g'))"
    capitals = f"length(regexp_replace({text}, '[^A-Z]+', '', 'g'))"
    return f"""length({text})::double AS n_chars, {words}::double AS n_words,
        CASE WHEN {words} > 0 THEN {letters} / {words} END AS mean_word_length,
        (length({text}) - length(replace({text}, chr(10), '')) + 1)::double AS n_lines,
        CASE WHEN length({text}) > 0 THEN {capitals} / length({text}) END AS upper_share"""


def with_outcome(df: DataFrame) -> DataFrame:
    """Sentiment from ``quality``: label, code, and a score that varies with ``toxic``."""
    label = F.when(F.col("quality") == 1, "POSITIVE").when(F.col("quality") == 0, "NEGATIVE")
    return (
        df.withColumn("sentiment", label)
        .withColumn("sentiment_numeric", label_code("sentiment", LABEL_CODES).cast("double"))
        .withColumn("sentiment_score", F.lit(1.0) - 0.25 * F.col("toxic"))
    )


def labelled_features(spark: SparkSession, folder: str) -> DataFrame:
    documents = with_text_features(table(spark, folder, "documents"), "text").drop("text")
    return with_outcome(documents.join(table(spark, folder, "labels"), "doc_id"))


_OUTCOME = """CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN -1.0 END::double AS sentiment_numeric,
        CASE quality WHEN 1 THEN 'POSITIVE' WHEN 0 THEN 'NEGATIVE' END AS sentiment,
        (1.0 - 0.25 * toxic)::double AS sentiment_score"""
_SQL_FEATURES = f"""
WITH base AS (
    SELECT doc_id, source, lang, {_OUTCOME}, {sql_text_features("text")}
    FROM documents JOIN labels USING (doc_id))
"""


def _sql_correlate(
    source: str, outcome: str, features: list[str], fallback: str | None = None, by: str = ""
) -> str:
    """CTE ``result`` with the columns of ``correlate_features`` (without rounding)."""
    flat = f"count(DISTINCT {outcome}) = 1" if fallback else "false"
    chosen = f"CASE WHEN {flat} THEN '{fallback}' ELSE '{outcome}' END"

    def r(feature: str) -> str:
        usual = sql_pearson(outcome, feature)
        if not fallback:
            return usual
        return f"CASE WHEN {flat} THEN {sql_pearson(fallback, feature)} ELSE {usual} END"

    key = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    rows = " UNION ALL ".join(
        f"SELECT {key}'{f}' AS feature, {r(f)} AS correlation, count(*) AS sample_size, "
        f"{chosen} AS outcome FROM {source} {group}"
        for f in features
    )
    return f""",
result AS (
    SELECT *, {sql_p_value("correlation", "sample_size")} AS p_value,
        sample_size < 10 AS small_sample FROM ({rows}))
"""


_RESULT = (
    f"feature, {sql_rounded('correlation')} AS correlation, {sql_rounded('p_value')} AS p_value, "
    "sample_size, outcome, small_sample"
)
_LINES = "WITH base AS (SELECT * FROM lineitem)"


def _round_result(df: DataFrame) -> DataFrame:
    return df.withColumn("correlation", rounded("correlation")).withColumn("p_value", rounded("p_value"))


@query(
    "correlate_features",
    _SQL_FEATURES
    + _sql_correlate("base", "sentiment_numeric", TEXT_FEATURES, "sentiment_score")
    + f"SELECT {_RESULT} FROM result",
)
def correlate_features_query(spark: SparkSession, folder: str) -> DataFrame:
    df = labelled_features(spark, folder)
    return _round_result(
        correlate_features(df, "sentiment_numeric", TEXT_FEATURES, "sentiment_score")
    )


@query(
    "correlate_lineitem",
    _LINES
    + _sql_correlate("base", "l_discount", LINE_FEATURES)
    + f"SELECT {_RESULT} FROM result",
)
def correlate_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return _round_result(correlate_features(table(spark, folder, "lineitem"), "l_discount", LINE_FEATURES))


@query(
    "correlate_by_source",
    _SQL_FEATURES
    + _sql_correlate("base", "sentiment_numeric", TEXT_FEATURES, "sentiment_score", "source")
    + f"SELECT source, {_RESULT} FROM result",
)
def correlate_by_source(spark: SparkSession, folder: str) -> DataFrame:
    df = labelled_features(spark, folder)
    return _round_result(
        correlate_features(df, "sentiment_numeric", TEXT_FEATURES, "sentiment_score", ["source"])
    )


# Order discount x part price, joined on the part: many lines per key and two rows per key on the
# right. The SQL builds the join, the query does not.
_SQL_JOINED = """
WITH features AS (
    SELECT p_partkey AS k, p_size::double AS size, p_retailprice AS price FROM part
    UNION ALL SELECT p_partkey, p_size + 1.0, p_retailprice * 2 FROM part),
base AS (
    SELECT l_discount, size, price FROM lineitem JOIN features ON l_partkey = k)
"""


@query(
    "correlate_joined",
    _SQL_JOINED
    + _sql_correlate("base", "l_discount", ["size", "price"])
    + f"SELECT {_RESULT} FROM result",
)
def correlate_joined_query(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    once = part.select(
        F.col("p_partkey").alias("k"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("price"),
    )
    twice = once.select("k", (F.col("size") + 1.0).alias("size"), (F.col("price") * 2).alias("price"))
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_partkey", "k")
    return _round_result(correlate_joined(lines, once.union(twice), "k", "l_discount", ["size", "price"]))


# The whole chain: collection files -> songs -> features per song; labels as the other table;
# both joined on the canonical title.
@query(
    "correlation_report",
    _SQL_SONGS
    + f""",
parsed AS (
    SELECT regexp_extract(line, '{_LINE}', 1) AS title,
        {sql_strip("substring(song, strpos(song, line) + length(line))")} AS lyrics
    FROM lines WHERE line <> ''),
features AS (
    SELECT lower(replace(title, ' ', '_')) AS title, {sql_text_features("lyrics")} FROM parsed),
scored AS (SELECT 'song_' || doc_id AS title, {_OUTCOME} FROM labels),
base AS (SELECT * FROM scored JOIN features USING (title))"""
    + _sql_correlate("base", "sentiment_numeric", TEXT_FEATURES, "sentiment_score")
    + f"SELECT {_RESULT}, {sql_stars('p_value')} AS significance FROM result",
)
def correlation_report_query(spark: SparkSession, folder: str) -> DataFrame:
    from verseflux.plans.correlation import correlation_report

    songs = parse_collection(explode_records(collection_files(table(spark, folder, "documents"))))
    features = with_text_features(songs, "lyrics").select("title", *TEXT_FEATURES)
    labels = table(spark, folder, "labels")
    titled = labels.withColumn("title", F.concat(F.lit("SONG "), F.col("doc_id").cast("string")))
    report = correlation_report(with_outcome(titled), features, TEXT_FEATURES)
    return _round_result(report).select(
        "feature", "correlation", "p_value", "sample_size", "outcome", "small_sample", "significance"
    )


@query(
    "choose_outcome",
    _SQL_FEATURES
    + """
SELECT source, CASE WHEN count(DISTINCT sentiment_numeric) = 1 THEN 'sentiment_score'
        ELSE 'sentiment_numeric' END AS outcome,
    min(sentiment_numeric) AS lowest, max(sentiment_numeric) AS highest,
    CASE WHEN count(DISTINCT sentiment_numeric) = 1 THEN min(sentiment) END AS only_label
FROM base GROUP BY source""",
)
def choose_outcome_query(spark: SparkSession, folder: str) -> DataFrame:
    df = labelled_features(spark, folder)
    return choose_outcome(df, "sentiment_numeric", "sentiment_score", ["source"], "sentiment")


@query(
    "significance",
    _LINES
    + _sql_correlate("base", "l_discount", LINE_FEATURES, by="l_returnflag")
    + f"""
SELECT l_returnflag, {_RESULT}, {sql_stars('p_value')} AS significance,
    CASE WHEN correlation IS NULL THEN 'N/A' ELSE printf('%.3f', correlation) END AS correlation_text,
    CASE WHEN p_value IS NULL THEN 'N/A' ELSE printf('%.3f', p_value) END AS p_value_text
FROM result""",
)
def significance_query(spark: SparkSession, folder: str) -> DataFrame:
    result = correlate_features(
        table(spark, folder, "lineitem"), "l_discount", LINE_FEATURES, by=["l_returnflag"]
    )
    return _round_result(add_significance(result))


@query(
    "compare_groups",
    _SQL_FEATURES
    + _sql_correlate("base", "sentiment_numeric", TEXT_FEATURES, "sentiment_score", "lang")
    + f"""
SELECT lang, feature, {sql_rounded('correlation')} AS correlation,
    {sql_rounded('p_value')} AS p_value, sample_size, outcome FROM result""",
)
def compare_groups_query(spark: SparkSession, folder: str) -> DataFrame:
    df = labelled_features(spark, folder)
    return _round_result(
        compare_groups(df, "lang", "sentiment_numeric", TEXT_FEATURES, "sentiment_score")
    )


_FLAGS = ["A", "N", "R"]


@query(
    "compare_groups_wide",
    _LINES
    + _sql_correlate("base", "l_discount", LINE_FEATURES, by="l_returnflag")
    + "SELECT feature, "
    + ", ".join(
        f"{sql_rounded(f'max({column}) FILTER (WHERE l_returnflag = {chr(39)}{flag}{chr(39)})')} "
        f"AS {flag.lower()}_{column}"
        for flag in _FLAGS
        for column in ("correlation", "p_value")
    )
    + " FROM result GROUP BY feature",
)
def compare_groups_wide(spark: SparkSession, folder: str) -> DataFrame:
    wide = compare_groups(
        table(spark, folder, "lineitem"), "l_returnflag", "l_discount", LINE_FEATURES, groups=_FLAGS
    )
    values = [c for c in wide.columns if c != "feature"]
    return wide.select("feature", *[rounded(c).alias(c.lower()) for c in values])


_MATRIX = ["l_discount", *LINE_FEATURES]


@query(
    "correlation_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {sql_rounded(f'corr({a}, {b})')} "
        "AS correlation FROM lineitem"
        for a in _MATRIX
        for b in _MATRIX
    ),
)
def correlation_matrix_query(spark: SparkSession, folder: str) -> DataFrame:
    result = correlation_matrix(table(spark, folder, "lineitem"), _MATRIX)
    return result.withColumn("correlation", rounded("correlation"))


def _sql_lines(source: str, y: str, features: list[str], key: str = "") -> str:
    group = f"GROUP BY {key}" if key else ""
    key = f"{key}, " if key else ""
    return " UNION ALL ".join(
        f"""SELECT {key}'{x}' AS feature, regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS slope,
        regr_intercept({y}, {x}) AS intercept, regr_r2({y}, {x}) AS r2, avg({x}) AS x_mean,
        min({x}) AS x_min, max({x}) AS x_max, regr_sxx({y}, {x}) AS sxx,
        sqrt(greatest(0, regr_syy({y}, {x}) - pow(regr_sxy({y}, {x}), 2) / regr_sxx({y}, {x}))
            / (count(*) - 2)) AS residual_se FROM {source} {group}"""
        for x in features
    )


@query(
    "regression_line",
    f"""
SELECT l_returnflag, feature, n, {sql_rounded('slope', 9)} AS slope,
    {sql_rounded('intercept')} AS intercept, {sql_rounded('r2', 9)} AS r2,
    {sql_rounded('residual_se')} AS residual_se
FROM ({_sql_lines('lineitem', 'l_discount', LINE_FEATURES, 'l_returnflag')})""",
)
def regression_line_query(spark: SparkSession, folder: str) -> DataFrame:
    lines = regression_line(
        table(spark, folder, "lineitem"), "l_discount", LINE_FEATURES, ["l_returnflag"]
    )
    return lines.select(
        "l_returnflag",
        "feature",
        "n",
        rounded("slope", 9).alias("slope"),
        rounded("intercept").alias("intercept"),
        rounded("r2", 9).alias("r2"),
        rounded("residual_se").alias("residual_se"),
    )


@query(
    "regression_band",
    f"""
WITH lines AS ({_sql_lines('lineitem', 'l_discount', LINE_FEATURES)}),
grid AS (
    SELECT *, x_min + (x_max - x_min) * (point / 99) AS x FROM lines, range(100) t(point)),
band AS (
    SELECT *, intercept + slope * x AS fit,
        {NORMAL_975} * residual_se * sqrt(1.0 / n + pow(x - x_mean, 2) / sxx) AS half FROM grid)
SELECT feature, point::int AS point, {sql_rounded('x', 4)} AS x, {sql_rounded('fit')} AS fit,
    {sql_rounded('fit - half')} AS low, {sql_rounded('fit + half')} AS high FROM band""",
)
def regression_band_query(spark: SparkSession, folder: str) -> DataFrame:
    band = regression_band(table(spark, folder, "lineitem"), "l_discount", LINE_FEATURES)
    return band.select(
        "feature",
        "point",
        rounded("x", 4).alias("x"),
        rounded("fit").alias("fit"),
        rounded("low").alias("low"),
        rounded("high").alias("high"),
    )


def _sql_bootstrap(resamples: int = 1000) -> str:
    p, (a, b, c) = DRAW_PRIME, DRAW_STEPS
    steps = f"SELECT doc_id, r, ((doc_id % {p}) * {a} + r * {b} + 1) % {p} AS m FROM base, range(1, {resamples + 1}) t(r)"
    for _ in range(3):
        steps = f"SELECT doc_id, r, (((m * m) % {p}) * {a} + m * {c} + {b}) % {p} AS m FROM ({steps})"
    bounds, total = [], 0.0
    for k in range(12):
        total += math.exp(-1.0) / math.factorial(k)
        bounds.append(f"{total!r}::double")
    pairs = " UNION ALL ".join(
        f"SELECT doc_id, '{x}' AS feature, {x} - avg({x}) OVER () AS x, avg({x}) OVER () AS centre, sentiment_numeric AS y "
        f"FROM base WHERE {x} IS NOT NULL AND sentiment_numeric IS NOT NULL"
        for x in TEXT_FEATURES
    )
    return (
        _SQL_FEATURES
        + f""",
draws AS (
    SELECT doc_id, r, len(list_filter([{", ".join(bounds)}], lambda z: z <= m / {p}::double))::double AS w
    FROM ({steps})),
pairs AS ({pairs}),
sums AS (
    SELECT feature, r, sum(w) AS w, sum(w * x) AS x, sum(w * y) AS y, sum(w * x * x) AS xx, sum(w * x * y) AS xy,
        any_value(centre) AS centre
    FROM pairs JOIN draws USING (doc_id) WHERE w > 0 GROUP BY feature, r),
slopes AS (SELECT *, (xy - x * y / w) / nullif(xx - x * x / w, 0) AS slope FROM sums),
lines AS ({_sql_lines('base', 'sentiment_numeric', TEXT_FEATURES)}),
grid AS (
    SELECT feature, point, x_min + (x_max - x_min) * (point / 99) AS x, slope, intercept
    FROM lines, range(100) t(point))
SELECT g.feature, point::int AS point, {sql_rounded('any_value(g.x)', 4)} AS x,
    {sql_rounded('any_value(g.intercept + g.slope * g.x)')} AS fit,
    {sql_rounded('quantile_cont((s.y - s.slope * s.x) / s.w + s.slope * (g.x - s.centre), 0.025)')} AS low,
    {sql_rounded('quantile_cont((s.y - s.slope * s.x) / s.w + s.slope * (g.x - s.centre), 0.975)')} AS high
FROM grid g JOIN slopes s ON g.feature = s.feature GROUP BY g.feature, point"""
    )


@query("bootstrap_band", _sql_bootstrap())
def bootstrap_band_query(spark: SparkSession, folder: str) -> DataFrame:
    df = labelled_features(spark, folder)
    band = bootstrap_band(df, "doc_id", "sentiment_numeric", TEXT_FEATURES)
    return band.select(
        "feature",
        "point",
        rounded("x", 4).alias("x"),
        rounded("fit").alias("fit"),
        rounded("low").alias("low"),
        rounded("high").alias("high"),
    )


def _sql_describe(source: str, features: list[str], digits: int = 4) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{x}' AS feature, count({x}) AS n, {sql_rounded(f'avg({x})', digits)} AS mean,
        {sql_rounded(f'stddev_samp({x})', digits)} AS std, {sql_rounded(f'min({x})', digits)} AS lowest,
        {sql_rounded(f'quantile_cont({x}, 0.25)', digits)} AS q25,
        {sql_rounded(f'quantile_cont({x}, 0.5)', digits)} AS q50,
        {sql_rounded(f'quantile_cont({x}, 0.75)', digits)} AS q75,
        {sql_rounded(f'max({x})', digits)} AS highest FROM {source}"""
        for x in features
    )


def _round_describe(df: DataFrame) -> DataFrame:
    numbers = [c for c in df.columns if c not in ("feature", "n")]
    return df.select("feature", "n", *[rounded(c, 4).alias(c) for c in numbers])


@query("describe_features", _sql_describe("lineitem", ["l_discount", *LINE_FEATURES]))
def describe_features_query(spark: SparkSession, folder: str) -> DataFrame:
    return _round_describe(
        describe_features(table(spark, folder, "lineitem"), ["l_discount", *LINE_FEATURES])
    )


@query("describe_events", _sql_describe("events", ["value"]))
def describe_events(spark: SparkSession, folder: str) -> DataFrame:
    return _round_describe(describe_features(table(spark, folder, "events"), ["value"]))


_TITLES = {f: f.replace("_", " ").title() for f in TEXT_FEATURES}


@query(
    "plot_annotation",
    _SQL_FEATURES
    + " UNION ALL ".join(
        f"""SELECT '{f}' AS feature, '{t}' AS x_label, 'Sentiment vs {t}' AS title,
        'Correlation: ' || coalesce(printf('%.2f', CASE WHEN min({f}) = max({f})
            OR min(sentiment_numeric) = max(sentiment_numeric) THEN NULL
            ELSE corr(sentiment_numeric, {f}) END), 'nan') AS annotation,
        {sql_rounded(f'stddev_samp({f})')} AS x_std,
        {sql_rounded('stddev_samp(sentiment_numeric)')} AS y_std FROM base"""
        for f, t in _TITLES.items()
    ),
)
def plot_annotation_query(spark: SparkSession, folder: str) -> DataFrame:
    result = plot_annotation(labelled_features(spark, folder), "sentiment_numeric", TEXT_FEATURES)
    return result.withColumn("x_std", rounded("x_std")).withColumn("y_std", rounded("y_std"))


@query(
    "scatter_long",
    _SQL_FEATURES
    + " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS feature, {sql_rounded(f)} AS x, sentiment_numeric AS y FROM base"
        for f in TEXT_FEATURES
    ),
)
def scatter_long_query(spark: SparkSession, folder: str) -> DataFrame:
    points = scatter_long(
        labelled_features(spark, folder), "sentiment_numeric", TEXT_FEATURES, ("doc_id",)
    )
    return points.withColumn("x", rounded("x"))


GRID_BINS = 40
GRID_FEATURES = ["l_quantity", "l_tax", "l_discount"]


def _sql_cells(f: str) -> str:
    def place(c: str) -> str:
        cell = f"floor(({c} - {c}0) / nullif({c}1 - {c}0, 0) * {GRID_BINS})"
        return f"least(coalesce({cell}, 0), {GRID_BINS - 1})::int"

    def edge(c: str, step: int) -> str:
        return sql_rounded(f"{c}0 + ({c}_bin + {step}) * (({c}1 - {c}0) / {GRID_BINS})", 4)

    return f"""SELECT '{f}' AS feature, x_bin, y_bin, {edge("x", 0)} AS x_from, {edge("x", 1)} AS x_to,
        {edge("y", 0)} AS y_from, {edge("y", 1)} AS y_to, count(*) AS points
    FROM (SELECT *, {place("x")} AS x_bin, {place("y")} AS y_bin
          FROM (SELECT *, min(x) OVER () AS x0, max(x) OVER () AS x1, min(y) OVER () AS y0, max(y) OVER () AS y1
                FROM (SELECT {f}::double AS x, l_extendedprice::double AS y FROM lineitem)
                WHERE x IS NOT NULL AND y IS NOT NULL))
    GROUP BY x_bin, y_bin, x0, x1, y0, y1"""


@query("density_grid", " UNION ALL ".join(map(_sql_cells, GRID_FEATURES)))
def density_grid_query(spark: SparkSession, folder: str) -> DataFrame:
    cells = density_grid(table(spark, folder, "lineitem"), "l_extendedprice", GRID_FEATURES, GRID_BINS)
    return cells.withColumns({c: rounded(c, 4) for c in ("x_from", "x_to", "y_from", "y_to")})


MOMENT_FEATURES = ["l_quantity", "l_tax", "l_discount"]


def _sql_whole(f: str) -> str:
    return f"""SELECT l_returnflag, '{f}' AS feature, {sql_pearson("y", f)} AS r, count(*) AS sample_size
        FROM (SELECT l_returnflag, l_extendedprice::double AS y, {f}::double AS {f} FROM lineitem)
        GROUP BY l_returnflag"""


@query(
    "correlate_increments",
    f"""SELECT l_returnflag, feature, {sql_rounded("r")} AS correlation, sample_size
    FROM ({" UNION ALL ".join(map(_sql_whole, MOMENT_FEATURES))})""",
)
def correlate_increments(spark: SparkSession, folder: str) -> DataFrame:
    """Moments per month of shipping, as increments would store them, merged per flag."""
    items = table(spark, folder, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate"))
    months = feature_moments(items, ["l_extendedprice"], MOMENT_FEATURES, ["l_returnflag", "month"])
    merged = correlate_moments(months, "l_extendedprice", by=["l_returnflag"], sort=False)
    return merged.select("l_returnflag", "feature", rounded("correlation").alias("correlation"), "sample_size")
