"""Topic models, with SQL that repeats their passes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from verseflux.functions.fixed import TOPICS_NONE
from verseflux.operators.textprep import clean_tokens, drop_tokenless
from verseflux.operators.topics import (
    START_PRIME,
    START_STEPS,
    TopicModel,
    assign_topics,
    fit_topics,
    topic_labels,
    topic_words,
)
from verseflux.plans.texts import analyze_documents
from verseflux.queries.registry import query, rounded, sql_rounded, table
from verseflux.queries.sentiment import lexicon
from verseflux.queries.texts import _SQL_VOCABULARY

SEED = 42


@dataclass(frozen=True)
class _Fit:
    """How a model is fitted: topics, passes, and steps of a document in a pass."""

    topics: int
    passes: int
    steps: int


#: ``top_topics`` shows the words of a short fit; documents get their topics from a whole one.
SHORT, WHOLE = _Fit(5, 3, 2), _Fit(10, 20, 5)


def _fitted(spark: SparkSession, folder: str, fit: _Fit) -> tuple[DataFrame, TopicModel]:
    docs = clean_tokens(table(spark, folder, "documents"), "text").select("doc_id", "tokens")
    return docs, fit_topics(docs, fit.topics, fit.passes, SEED, id_col="doc_id", steps=fit.steps)


# ---- SQL: the model is a row per term, the shares are windows over a document -------------


def _each(fit: _Fit, text: str, glue: str = ", ") -> str:
    return glue.join(text.replace("#", str(t)) for t in range(fit.topics))


def _sql_psi(x: str, power: int = 1) -> str:
    """Digamma (power 1) or trigamma (power 2), thirty steps up before the series."""
    low = f"list_sum(list_transform(range(30), lambda i: 1.0::double / pow({x} + i, {power})))"
    y = f"({x} + 30.0::double)"
    if power == 1:
        return f"(ln({y}) - 1 / (2 * {y}) - 1 / (12 * pow({y}, 2)) + 1 / (120 * pow({y}, 4)) - {low})"
    return f"({low} + 1 / {y} + 1 / (2 * pow({y}, 2)) + 1 / (6 * pow({y}, 3)) - 1 / (30 * pow({y}, 5)))"


def _sql_start(fit: _Fit) -> str:
    p, (a, b, c) = START_PRIME, START_STEPS
    mixed = f"((term_id % {p}) * {a} + ({b} * (# + 1) + {SEED * c + 1})) % {p}"
    ctes = f"start0 AS (SELECT term_id, {_each(fit, f'({mixed})::bigint AS m#')} FROM vocabulary),"
    for i in range(3):
        step = f"((m# * m# % {p}) * {a} + m# * {c} + {b}) % {p} AS m#"
        ctes += f"start{i + 1} AS (SELECT term_id, {_each(fit, step)} FROM start{i}),"
    return ctes + f"""
weights0 AS MATERIALIZED (SELECT term_id, {_each(fit, f"-ln((m# + 1) / {p + 1}.0::double) AS w#")} FROM start3),
alpha0 AS (SELECT {_each(fit, f"{1 / fit.topics!r}::double AS a#")})"""


def _sql_shares(fit: _Fit, name: str, weights: str, alpha: str, steps: int) -> str:
    """CTEs up to ``{name}_s{steps}(doc_id, term_id, tf, b#, g#, r#)``."""
    factor = f"exp({_sql_psi('w#')} - t#) AS b#"
    out = f"""
{name}_sums AS (SELECT {_each(fit, "sum(w#) AS v#")} FROM {weights}),
{name}_totals AS MATERIALIZED (SELECT {_each(fit, f"{_sql_psi('v#')} AS t#")} FROM {name}_sums),
{name}_base AS MATERIALIZED (SELECT term_id, {_each(fit, factor)} FROM {weights}, {name}_totals),
{name}_s0 AS (SELECT doc_id, term_id, tf, {_each(fit, "b#")}, {_each(fit, "1.0::double AS x#")} FROM bag JOIN {name}_base USING (term_id))"""
    for i in range(steps):
        whole = _each(fit, "b# * x#", " + ")
        out += f""",
{name}_p{i} AS (SELECT doc_id, term_id, tf, {_each(fit, "b#")}, {_each(fit, f"tf * b# * x# / ({whole}) AS r#")} FROM {name}_s{i}),
{name}_q{i} AS (SELECT p.*, {_each(fit, "a# + sum(r#) OVER (PARTITION BY doc_id) AS g#")} FROM {name}_p{i} p, {alpha}),
{name}_s{i + 1} AS MATERIALIZED (SELECT doc_id, term_id, tf, {_each(fit, "b#")}, {_each(fit, "g#")}, {_each(fit, "r#")},
    {_each(fit, f"exp({_sql_psi('g#')}) AS x#")} FROM {name}_q{i})"""
    return out


def _sql_fit(fit: _Fit) -> str:
    """CTEs up to ``weights{passes}`` and ``alpha{passes}``, after ``bag``."""
    out = _sql_start(fit)
    for n in range(fit.passes):
        s = f"f{n}_s{fit.steps}"
        whole = _sql_psi("(" + _each(fit, "g#", " + ") + ")")
        out += "," + _sql_shares(fit, f"f{n}", f"weights{n}", f"alpha{n}", fit.steps)
        out += f""",
weights{n + 1} AS MATERIALIZED (SELECT term_id, {_each(fit, f"sum(r#) + {1 / fit.topics!r} AS w#")} FROM {s} GROUP BY term_id),
logs{n} AS (SELECT {_each(fit, "avg(l#) AS l#")} FROM (SELECT doc_id, {_each(fit, f"any_value({_sql_psi('g#')} - {whole}) AS l#")}
    FROM {s} GROUP BY doc_id)),
slope{n} AS (SELECT {_each(fit, "a#")}, {_each(fit, f"{_sql_psi('(' + _each(fit, 'a#', ' + ') + ')')} - {_sql_psi('a#')} + l# AS s#")},
    {_each(fit, f"-{_sql_psi('a#', 2)} AS q#")}, {_sql_psi("(" + _each(fit, "a#", " + ") + ")", 2)} AS z FROM alpha{n}, logs{n}),
shift{n} AS (SELECT *, ({_each(fit, "s# / q#", " + ")}) / (1 / z + {_each(fit, "1 / q#", " + ")}) AS h FROM slope{n}),
moved{n} AS (SELECT *, least({_each(fit, "a# - (s# - h) / q#")}) > 0 AS fine FROM shift{n}),
alpha{n + 1} AS MATERIALIZED (SELECT {_each(fit, "CASE WHEN fine THEN a# - (s# - h) / q# ELSE a# END AS a#")} FROM moved{n})"""
    return out


def _sql_top(fit: _Fit, words: int) -> str:
    long = " UNION ALL ".join(f"SELECT {t} AS topic, term AS word, w{t} / (SELECT sum(w{t}) FROM weights{fit.passes}) AS weight FROM weights{fit.passes} JOIN vocabulary USING (term_id)" for t in range(fit.topics))
    return f"""top AS MATERIALIZED (
    SELECT topic, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 9) DESC, word) AS rank, word, weight
    FROM ({long}) QUALIFY rank <= {words})"""


_LABELS = "labels_ AS (SELECT topic, string_agg(word, ', ' ORDER BY rank) AS topics FROM top WHERE rank <= 7 GROUP BY topic)"


def _sql_assigned(fit: _Fit) -> str:
    """CTEs up to ``assigned(doc_id, topic)``, after the fit."""
    s = "inf_s10"
    best = "list_position(shares, list_max(shares))"
    shares = "[" + _each(fit, f"round(g# / ({_each(fit, 'g#', ' + ')}), 9)") + "]"
    return _sql_shares(fit, "inf", f"weights{fit.passes}", f"alpha{fit.passes}", 10) + f""",
shared AS (SELECT doc_id, any_value({shares}) AS shares FROM {s} GROUP BY doc_id),
assigned AS (SELECT doc_id, {best} - 1 AS topic FROM shared)"""


_BAG = """,
bag AS MATERIALIZED (SELECT doc_id, term_id, count(*) AS tf
    FROM (SELECT doc_id, unnest(tokens) AS term FROM docs) JOIN vocabulary USING (term) GROUP BY doc_id, term_id),
"""


def _sql_model(fit: _Fit) -> str:
    return _SQL_VOCABULARY + _BAG + _sql_fit(fit)


@query(
    "top_topics",
    f"""{_sql_model(SHORT)}, {_sql_top(SHORT, 10)}, {_LABELS}
SELECT topic, rank, word, {sql_rounded("weight")} AS weight, topics FROM top JOIN labels_ USING (topic)""",
)
def top_topics(spark: SparkSession, folder: str) -> DataFrame:
    _, model = _fitted(spark, folder, SHORT)
    words = topic_words(spark, model, 10)
    words = words.join(topic_labels(words, 7), "topic").withColumn("weight", rounded("weight"))
    return words.orderBy("topic", "rank")


@query(
    "document_topics",
    f"""{_sql_model(WHOLE)}, {_sql_top(WHOLE, 7)}, {_LABELS}, {_sql_assigned(WHOLE)}
SELECT doc_id, topic, coalesce(topics, '{TOPICS_NONE}') AS topics
FROM docs LEFT JOIN assigned USING (doc_id) LEFT JOIN labels_ USING (topic) WHERE len(tokens) > 0""",
)
def document_topics(spark: SparkSession, folder: str) -> DataFrame:
    docs, model = _fitted(spark, folder, WHOLE)
    assigned = assign_topics(drop_tokenless(docs), model, id_col="doc_id", blocks=model.blocks)
    return assigned.select("doc_id", "topic", "topics")


@query("document_analysis")
def document_analysis(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "text")
    result = analyze_documents(
        documents,
        lexicon(spark, folder),
        text_col="text",
        id_col="doc_id",
        lemmas="corpus",
    )
    return result.withColumn("sentiment_score", rounded("sentiment_score"))
