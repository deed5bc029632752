"""Scoring of texts and the label rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseflux.functions.fixed import LABEL_CODES
from verseflux.operators.bayes import bayes_scores, bayes_weights
from verseflux.operators.correlate import label_code
from verseflux.operators.scoring import (
    Lexicon,
    UserModel,
    build_lexicon,
    lexicon_terms,
    score_text,
    train_model,
)
from verseflux.operators.textprep import stopwords
from verseflux.queries.registry import query, rounded, sql_rounded, sql_tokens, table

LEXICON_WEIGHT = 0.02

SQL_LEXICON = f"""
WITH tokens AS (
    SELECT d.doc_id, l.quality, {sql_tokens("d.text", stopwords())} AS tokens
    FROM documents d LEFT JOIN labels l USING (doc_id)),
shares AS (
    SELECT term,
        sum(quality)::double / (SELECT sum(quality) FROM tokens)
        - sum(1 - quality)::double / (SELECT sum(1 - quality) FROM tokens) AS weight
    FROM (SELECT unnest(list_distinct(tokens)) AS term, quality FROM tokens
        WHERE quality IS NOT NULL)
    GROUP BY term),
up AS (SELECT term, weight FROM shares WHERE weight >= {LEXICON_WEIGHT}::double),
down AS (SELECT term, weight FROM shares WHERE weight <= -{LEXICON_WEIGHT}::double)
"""

SQL_SCORED = (
    SQL_LEXICON
    + """,
hits AS (
    SELECT doc_id,
        len(list_filter(tokens, lambda t: list_contains(ups, t))) AS u,
        len(list_filter(tokens, lambda t: list_contains(downs, t))) AS d
    FROM tokens, (SELECT list(term) AS ups FROM up), (SELECT list(term) AS downs FROM down)),
scored AS (
    SELECT doc_id, CASE WHEN u >= d THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
        1 / (1 + exp(-abs((u - d) / sqrt(u + d + 1)))) AS score
    FROM hits)
"""
)

_SQL_LABELLED = (
    SQL_SCORED
    + """,
inputs AS (
    SELECT 'scored' AS kind, doc_id AS id, text, label, score
    FROM scored JOIN documents USING (doc_id)
    UNION ALL SELECT 'failed', item_id, text, NULL, NULL FROM benchmark
    UNION ALL SELECT 'blank', doc_id, ' ' || chr(10), 'POSITIVE', 0.9 FROM labels),
labelled AS (
    SELECT kind, id,
        CASE WHEN kind = 'blank' THEN 'UNKNOWN' WHEN label IS NULL THEN 'ERROR'
            WHEN score < 0.6 THEN 'NEUTRAL' ELSE label END AS sentiment,
        CASE WHEN kind = 'blank' OR label IS NULL THEN 0.0
            WHEN score < 0.6 THEN 1 - score ELSE score END AS sentiment_score
    FROM inputs)
"""
)


def labelled_documents(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return documents.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")


def lexicon(spark: SparkSession, folder: str) -> Lexicon:
    return build_lexicon(labelled_documents(spark, folder), "text", "quality", LEXICON_WEIGHT)


def _no_model():
    """A classifier that fails on every text."""

    def classify(texts: list[str]):
        raise RuntimeError("no answer")

    return classify


def _sure_model():
    return lambda texts: [("POSITIVE", 0.9)] * len(texts)


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, texts that the scorer fails on, and blank texts, all scored."""
    documents = table(spark, folder, "documents").select(
        F.lit("scored").alias("kind"), F.col("doc_id").alias("id"), "text"
    )
    failed = table(spark, folder, "benchmark").select(
        F.lit("failed").alias("kind"), F.col("item_id").alias("id"), "text"
    )
    blank = table(spark, folder, "labels").select(
        F.lit("blank").alias("kind"), F.col("doc_id").alias("id"), F.lit(" \n").alias("text")
    )
    scored = score_text(documents, "text", lexicon(spark, folder))
    scored = scored.unionByName(score_text(failed, "text", UserModel(_no_model)))
    return scored.unionByName(score_text(blank, "text", UserModel(_sure_model)))


@query(
    "lexicon_terms",
    SQL_LEXICON
    + f"""
SELECT term, {sql_rounded('weight', 9)} AS weight, 'POSITIVE' AS side FROM up
UNION ALL SELECT term, {sql_rounded('weight', 9)}, 'NEGATIVE' FROM down""",
)
def lexicon_terms_query(spark: SparkSession, folder: str) -> DataFrame:
    terms = lexicon_terms(labelled_documents(spark, folder), "text", "quality", LEXICON_WEIGHT)
    return terms.withColumn("weight", rounded("weight", 9))


@query(
    "sentiment_lexicon",
    SQL_SCORED + f"SELECT doc_id, label, {sql_rounded('score')} AS score FROM scored",
)
def sentiment_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "text")
    scored = lexicon(spark, folder)(documents, "text")
    return scored.select("doc_id", "label", rounded("score").alias("score"))


@query(
    "sentiment_label",
    _SQL_LABELLED
    + f"SELECT kind, id, sentiment, {sql_rounded('sentiment_score')} AS sentiment_score FROM labelled",
)
def sentiment_label(spark: SparkSession, folder: str) -> DataFrame:
    labelled = _labelled(spark, folder)
    return labelled.select("kind", "id", "sentiment", rounded("sentiment_score").alias("sentiment_score"))


@query(
    "sentiment_numeric",
    _SQL_LABELLED
    + """
SELECT kind, id, sentiment, CASE sentiment WHEN 'POSITIVE' THEN 1 WHEN 'NEUTRAL' THEN 0
    WHEN 'NEGATIVE' THEN -1 END AS sentiment_numeric FROM labelled""",
)
def sentiment_numeric(spark: SparkSession, folder: str) -> DataFrame:
    labelled = _labelled(spark, folder)
    code = label_code("sentiment", LABEL_CODES)
    return labelled.select("kind", "id", "sentiment", code.alias("sentiment_numeric"))


@query("sentiment_trained")
def sentiment_trained(spark: SparkSession, folder: str) -> DataFrame:
    model = train_model(labelled_documents(spark, folder), "text", "quality")
    documents = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_text(documents, "text", model)
    return scored.select("doc_id", "sentiment", rounded("sentiment_score").alias("sentiment_score"))


@query(
    "sentiment_bayes",
    f"""
WITH tokens AS (
    SELECT d.doc_id, l.quality, {sql_tokens("d.text", stopwords())} AS tokens
    FROM documents d LEFT JOIN labels l USING (doc_id)),
counts AS (
    SELECT term, sum(quality)::double AS up, sum(1 - quality)::double AS down
    FROM (SELECT unnest(tokens) AS term, quality FROM tokens WHERE quality IS NOT NULL)
    GROUP BY term),
weights AS (
    SELECT term, ln((up + 1) / (down + 1)) - ln((sum(up) OVER () + count(*) OVER ())
        / (sum(down) OVER () + count(*) OVER ())) AS weight
    FROM counts),
prior AS (SELECT ln((sum(quality) + 1.0::double) / (sum(1 - quality) + 1)) AS p FROM tokens),
odds AS (
    SELECT t.doc_id, p + coalesce(s.total, 0) AS o
    FROM tokens t CROSS JOIN prior LEFT JOIN (
        SELECT doc_id, sum(weight) AS total
        FROM (SELECT doc_id, unnest(tokens) AS term FROM tokens) JOIN weights USING (term)
        GROUP BY doc_id) s ON t.doc_id = s.doc_id)
SELECT doc_id, CASE WHEN o >= 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label,
    {sql_rounded('1 / (1 + exp(-abs(o)))')} AS score
FROM odds""",
)
def sentiment_bayes(spark: SparkSession, folder: str) -> DataFrame:
    weights = bayes_weights(labelled_documents(spark, folder), "text", "quality")
    documents = table(spark, folder, "documents").select("doc_id", "text")
    scored = bayes_scores(documents, weights, "text")
    return scored.select("doc_id", "label", rounded("score").alias("score"))
