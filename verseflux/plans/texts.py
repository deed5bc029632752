"""Text collection -> song table -> sentiment and topics per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseflux.functions.fixed import TOPICS_DEFAULT
from verseflux.lineage import cut_lineage
from verseflux.operators.parse import parse_collection
from verseflux.operators.scoring import Scorer, score_text
from verseflux.operators.textprep import (
    clean_tokens,
    document_frequency,
    lemma_table,
    lemmatize_arrays,
)
from verseflux.operators.topics import TopicModel, assign_topics, fit_topics
from verseflux.schemas import require_columns
from verseflux.sources.collections import read_collections


def load_songs(
    spark: SparkSession, path: str, source: str = "human", compat: bool = False
) -> DataFrame:
    """All songs of the text files in a folder."""
    return parse_collection(read_collections(spark, path), source=source, compat=compat)


def topic_tokens(
    df: DataFrame,
    text_col: str,
    id_col: str | None = None,
    lemmas: DataFrame | str | None = None,
    stop: list[str] | None = None,
) -> DataFrame:
    """``df`` with ``tokens`` for topic modelling.

    ``lemmas``: a table ``(token, lemma)``; ``"corpus"`` to derive one by noun endings from the
    documents' own vocabulary; ``None`` to leave tokens as they are. With lemmas, ``id_col``
    must identify the rows, and only it and the tokens are in the result, of documents that
    have tokens; they are written once to the checkpoint folder since model fitting reads them
    several times. Texts are not shuffled.
    """
    docs = clean_tokens(df, text_col, stop)
    if lemmas is None:
        return docs
    if id_col is None:
        raise ValueError("lemmas need id_col")
    docs = docs.select(id_col, "tokens")
    if isinstance(lemmas, str):
        if lemmas != "corpus":
            raise ValueError(f"lemmas must be a table, 'corpus' or None, not {lemmas!r}")
        lemmas = lemma_table(document_frequency(docs).where("NOT is_total"))
    return cut_lineage(lemmatize_arrays(docs, lemmas, id_col))


def add_topics(
    docs: DataFrame,
    model: TopicModel | None,
    num_words: int = 7,
    id_col: str | None = None,
    blocks: DataFrame | None = None,
) -> DataFrame:
    """Add ``topics``; documents without tokens, or all without a model, get the default.
    ``id_col`` identifies the documents; without it they are written once with numbers."""
    default = F.lit(TOPICS_DEFAULT)
    if model is None:
        return docs.withColumn("topics", default)
    assigned = assign_topics(docs, model, num_words, id_col=id_col, blocks=blocks)
    return assigned.withColumn(
        "topics", F.when(F.size("tokens") > 0, F.col("topics")).otherwise(default)
    ).drop("topic")


def analyze_documents(
    df: DataFrame,
    scorer: Scorer,
    text_col: str = "lyrics",
    id_col: str | None = None,
    lemmas: DataFrame | str | None = None,
    stop: list[str] | None = None,
    k: int = 30,
    passes: int = 50,
    num_words: int = 7,
    seed: int = 42,
    **fit_options,
) -> DataFrame:
    """``df`` without its text, plus ``sentiment``, ``sentiment_score`` and ``topics``.

    Scoring is a projection over the scan. With ``id_col``, only ids and topic strings meet the
    scored rows; without it (and without lemmas) the documents are written once with numbers.
    With lemmas, topics are assigned to the lemmatized tokens.
    """
    require_columns(df, [text_col])
    filled = df.fillna({text_col: ""})
    kept = [c for c in df.columns if c != text_col]
    docs = topic_tokens(filled, text_col, id_col, lemmas, stop)
    if lemmas is None and id_col is None:
        docs = cut_lineage(docs.withColumn("_row", F.monotonically_increasing_id()))
        model = fit_topics(docs, k, passes, seed, id_col="_row", **fit_options)
        scored = score_text(add_topics(docs, model, num_words, "_row", model and model.blocks), text_col, scorer)
        return scored.select(*kept, "sentiment", "sentiment_score", "topics")
    docs = docs.select(id_col, "tokens")
    model = fit_topics(docs, k, passes, seed, id_col=id_col, **fit_options)
    scored = score_text(filled, text_col, scorer).select(*kept, "sentiment", "sentiment_score")
    topics = add_topics(docs, model, num_words, id_col, model and model.blocks)
    topics = topics.select(F.col(id_col).alias("_id"), "topics")
    met = scored.join(topics, F.col(id_col) == F.col("_id"), "left").drop("_id")
    return met.withColumn("topics", F.coalesce("topics", F.lit(TOPICS_DEFAULT)))
