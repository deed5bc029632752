"""Sentiment of texts: pluggable scorers with one output contract.

A scorer takes a DataFrame and its text column and adds ``label`` (POSITIVE or NEGATIVE, null
if the text could not be scored) and ``score`` (confidence in 0.5..1). Scorers here are
projections: texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verseflux.functions.once import explode_present
from verseflux.functions.text import is_blank
from verseflux.operators.textprep import clean_tokens

NEUTRAL_BELOW = 0.6
MODEL_WINDOW = 510  # characters read by a model with a fixed input window

Scorer = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Lexicon:
    """Two word lists; scores by counting hits inside each row."""

    positive: tuple[str, ...]
    negative: tuple[str, ...]
    stop: tuple[str, ...] | None = None

    def __call__(self, df: DataFrame, text_col: str) -> DataFrame:
        stop = list(self.stop) if self.stop is not None else None
        tokens = clean_tokens(df, text_col, stop, tokens_col="_tokens")

        def hits(words: tuple[str, ...]) -> Column:
            return F.size(F.filter("_tokens", lambda t: t.isin(list(words))))

        up, down = F.col("_up"), F.col("_down")
        logit = (up - down) / F.sqrt(up + down + 1)
        return (
            tokens.withColumn("_up", hits(self.positive))
            .withColumn("_down", hits(self.negative))
            .withColumn("label", F.when(up >= down, "POSITIVE").otherwise("NEGATIVE"))
            .withColumn("score", 1 / (1 + F.exp(-F.abs(logit))))
            .drop("_tokens", "_up", "_down")
        )


def lexicon_terms(
    labelled: DataFrame,
    text_col: str,
    label_col: str,
    min_weight: float,
    stop: list[str] | None = None,
) -> DataFrame:
    """``(term, weight, side)``: the terms over-represented in either class by ``min_weight``.

    The weight is the share of documents with the term among label 1, minus that among
    label 0. Shares of a class add up to the mean number of distinct terms per document, so at
    most that number / ``min_weight`` terms per class reach it, whatever the size of the corpus.
    Only partial counts per term are shuffled.
    """
    docs = clean_tokens(labelled, text_col, stop)
    terms = F.concat(F.array(F.lit("")), F.array_distinct("tokens"))
    counts = (
        explode_present(docs, terms, "term", [F.col(label_col).cast("int").alias("y")])
        .groupBy("term")
        .agg(
            F.sum("y").alias("up"),
            F.sum(1 - F.col("y")).alias("down"),
            F.bool_and(F.col("term") == "").alias("is_total"),  # see document_frequency
        )
    )
    whole = F.col("is_total")
    totals = counts.agg(
        F.struct(
            F.max(F.when(whole, F.col("up"))).alias("up"),
            F.max(F.when(whole, F.col("down"))).alias("down"),
        )
    ).scalar()
    weight = F.try_divide(F.col("up"), totals.getField("up")) - F.try_divide(
        F.col("down"), totals.getField("down")
    )
    weighted = counts.where(~whole).withColumn("weight", weight).select("term", "weight")
    side = F.when(F.col("weight") > 0, "POSITIVE").otherwise("NEGATIVE")
    return weighted.where(F.abs("weight") >= F.lit(float(min_weight))).withColumn("side", side)


def build_lexicon(
    labelled: DataFrame,
    text_col: str,
    label_col: str,
    min_weight: float = 0.02,
    stop: list[str] | None = None,
) -> Lexicon:
    """Fit a :class:`Lexicon`; the number of words is bounded as ``lexicon_terms`` says."""
    rows = lexicon_terms(labelled, text_col, label_col, min_weight, stop).collect()
    words = {s: tuple(sorted(r.term for r in rows if r.side == s)) for s in ("POSITIVE", "NEGATIVE")}
    return Lexicon(words["POSITIVE"], words["NEGATIVE"], tuple(stop) if stop is not None else None)


@dataclass(frozen=True)
class TrainedModel:
    """A fitted text classifier; the confidence is the larger class probability."""

    model: PipelineModel
    stop: tuple[str, ...] | None = None

    def __call__(self, df: DataFrame, text_col: str) -> DataFrame:
        stop = list(self.stop) if self.stop is not None else None
        tokens = clean_tokens(df, text_col, stop, tokens_col="_tokens")
        p = vector_to_array("_probability")[1]
        return (
            self.model.transform(tokens)
            .withColumn("label", F.when(p >= 0.5, "POSITIVE").otherwise("NEGATIVE"))
            .withColumn("score", F.greatest(p, 1 - p))
            .drop("_tokens", "_tf", "_rawPrediction", "_probability", "_prediction")
        )


def train_model(
    labelled: DataFrame,
    text_col: str,
    label_col: str,
    features: int = 1 << 16,
    max_iter: int = 20,
    reg: float = 0.01,
    stop: list[str] | None = None,
) -> TrainedModel:
    """Logistic regression on hashed term counts; labels are 0 and 1."""
    docs = clean_tokens(labelled, text_col, stop, tokens_col="_tokens").select(
        "_tokens", F.col(label_col).cast("double").alias("_y")
    )
    stages = [
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=features),
        LogisticRegression(
            featuresCol="_tf",
            labelCol="_y",
            maxIter=max_iter,
            regParam=reg,
            rawPredictionCol="_rawPrediction",
            probabilityCol="_probability",
            predictionCol="_prediction",
        ),
    ]
    model = Pipeline(stages=stages).fit(docs)
    return TrainedModel(model, tuple(stop) if stop is not None else None)


_RESULT = T.StructType(
    [T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())]
)


@dataclass(frozen=True)
class UserModel:
    """Any Python classifier, loaded once per worker process.

    ``load`` returns a function from a list of texts to a list of ``(label, confidence)``. If a
    batch fails it is retried text by text, and texts that fail alone get a null label.

    Whole texts are scored. ``window`` is the model's input size in characters: longer texts
    are cut into windows of that size, and the confidence in POSITIVE is averaged over the
    windows that were scored, by their length. ``None`` feeds each text in one piece.
    """

    load: Callable[[], Callable[[list[str]], list[tuple[str, float]]]]
    window: int | None = MODEL_WINDOW

    def __call__(self, df: DataFrame, text_col: str) -> DataFrame:
        load, window = self.load, self.window

        @F.pandas_udf(_RESULT)
        def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            classify = load()
            for texts in batches:
                results = _classify_whole(classify, list(texts), window)
                yield pd.DataFrame(results, columns=["label", "score"])

        text = F.coalesce(F.col(text_col), F.lit(""))
        return (
            df.withColumn("_result", predict(text))
            .withColumn("label", F.col("_result.label"))
            .withColumn("score", F.col("_result.score"))
            .drop("_result")
        )


def _classify_whole(
    classify, texts: list[str], window: int | None
) -> list[tuple[str | None, float | None]]:
    """One result per text; a text of one window keeps the model's own answer."""
    cuts = [
        [t[a : a + window] for a in range(0, max(1, len(t)), window)] if window else [t]
        for t in texts
    ]
    answers = iter(_classify(classify, [piece for own in cuts for piece in own]))
    results: list[tuple[str | None, float | None]] = []
    for own in cuts:
        found = [(piece, next(answers)) for piece in own]
        scored = [(len(p), a) for p, a in found if a[0] is not None and a[1] is not None]
        if len(own) == 1 or not scored:
            results.append(found[0][1] if len(own) == 1 else (None, None))
            continue
        total = sum(n for n, _ in scored)
        up = sum(n * (s if label == "POSITIVE" else 1 - s) for n, (label, s) in scored) / total
        results.append(("POSITIVE" if up >= 0.5 else "NEGATIVE", max(up, 1 - up)))
    return results


def _classify(classify, texts: list[str]) -> list[tuple[str | None, float | None]]:
    """Blank texts are not shown to the model; they are labelled UNKNOWN later on."""
    results: list[tuple[str | None, float | None]] = [(None, None)] * len(texts)
    filled = [i for i, text in enumerate(texts) if text.strip()]
    try:
        for i, result in zip(filled, classify([texts[i] for i in filled]), strict=True):
            results[i] = result
    except Exception:
        for i in filled:
            try:
                results[i] = classify([texts[i]])[0]
            except Exception:
                results[i] = (None, None)
    return results


def label_sentiment(
    df: DataFrame,
    text_col: str,
    label_col: str = "label",
    score_col: str = "score",
    threshold: float = NEUTRAL_BELOW,
) -> DataFrame:
    """Add ``sentiment`` and ``sentiment_score`` from a raw label and its confidence.

    Blank text: UNKNOWN, 0. No label: ERROR, 0. Confidence below the threshold: NEUTRAL with
    one minus the confidence. Otherwise POSITIVE stays and everything else is NEGATIVE.
    """
    blank, label, score = is_blank(text_col), F.col(label_col), F.col(score_col)
    failed = label.isNull() | score.isNull()
    sentiment = (
        F.when(blank, "UNKNOWN")
        .when(failed, "ERROR")
        .when(score < threshold, "NEUTRAL")
        .when(label == "POSITIVE", "POSITIVE")
        .otherwise("NEGATIVE")
    )
    value = F.when(blank | failed, 0.0).when(score < threshold, 1 - score).otherwise(score)
    return df.withColumn("sentiment", sentiment).withColumn("sentiment_score", value)


def score_text(
    df: DataFrame, text_col: str, scorer: Scorer, threshold: float = NEUTRAL_BELOW
) -> DataFrame:
    """``df`` with ``sentiment`` and ``sentiment_score``."""
    scored = label_sentiment(scorer(df, text_col), text_col, threshold=threshold)
    return scored.drop("label", "score")
