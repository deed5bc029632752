"""Naive Bayes on term counts: a trained scorer in closed form, by joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseflux.functions.once import explode_present
from verseflux.operators.textprep import clean_tokens, count_tokens


def bayes_weights(
    labelled: DataFrame,
    text_col: str,
    label_col: str,
    smooth: float = 1.0,
    stop: list[str] | None = None,
) -> DataFrame:
    """``(term, weight, is_prior)``: log odds of label 1 per occurrence of a term, and one row
    with the log odds of the labels themselves (with the empty term).

    Multinomial model: a term's share of all occurrences in a class, with ``smooth`` added to
    every count. Only partial counts per term are shuffled.
    """
    docs = clean_tokens(labelled, text_col, stop)
    terms = F.concat(F.array(F.lit("")), "tokens")
    counts = (
        explode_present(docs, terms, "term", [F.col(label_col).cast("int").alias("y")])
        .groupBy("term")
        .agg(
            F.sum("y").alias("up"),
            F.sum(1 - F.col("y")).alias("down"),
            F.bool_and(F.col("term") == "").alias("is_prior"),  # see document_frequency
        )
    )
    words = ~F.col("is_prior")
    totals = counts.agg(
        F.struct(
            F.sum(F.when(words, F.col("up"))).alias("up"),
            F.sum(F.when(words, F.col("down"))).alias("down"),
            F.count_if(words).alias("terms"),
        )
    ).scalar()
    room = totals.getField("terms") * smooth
    odds = (F.col("up") + smooth) / (F.col("down") + smooth)
    all_odds = (totals.getField("up") + room) / (totals.getField("down") + room)
    weight = F.ln(odds) - F.when(words, F.ln(all_odds)).otherwise(0.0)
    return counts.select("term", weight.alias("weight"), "is_prior")


def bayes_scores(
    docs: DataFrame,
    weights: DataFrame,
    text_col: str,
    id_col: str = "doc_id",
    stop: list[str] | None = None,
) -> DataFrame:
    """``(id, label, score)``: the likelier label and its probability. Terms that training has
    not met say nothing; a text without known terms gets the odds of the labels.

    Counts per document meet the weights, which grow with the vocabulary, in a join; texts are
    not shuffled.
    """
    tokens = clean_tokens(docs.select(id_col, text_col), text_col, stop)
    prior = weights.where("is_prior").agg(F.max("weight")).scalar()
    known = weights.where("NOT is_prior").select(F.col("term").alias("token"), "weight")
    sums = (
        count_tokens(tokens, id_col)
        .join(known, "token")
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.sum(F.col("tf") * F.col("weight")).alias("_sum"))
    )
    odds = F.coalesce("_sum", F.lit(0.0)) + prior
    joined = docs.select(id_col).join(sums, F.col(id_col) == F.col("_id"), "left").withColumn("_odds", odds)
    return joined.select(
        id_col,
        F.when(F.col("_odds") >= 0, "POSITIVE").otherwise("NEGATIVE").alias("label"),
        (1 / (1 + F.exp(-F.abs("_odds")))).alias("score"),
    )
