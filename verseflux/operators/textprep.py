"""Text -> tokens -> vocabulary and bag of words."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verseflux.functions.fixed import BASE_STOPWORDS, CONTRACTIONS, EXTRA_STOPWORDS, NOUN_ENDINGS
from verseflux.functions.once import compute_once, explode_present
from verseflux.lineage import cut_lineage

_SPLIT_WORDS = r"\b(?:" + "|".join(f"({a})({b})" for a, b in CONTRACTIONS) + r")\b"
_SPLIT_PARTS = " ".join(
    "".join(f"${2 * i + half}" for i in range(len(CONTRACTIONS))) for half in (1, 2)
)


def clean_word(word: str) -> str:
    """The cleaning of texts, for single words of a list."""
    return "".join(ch for ch in word.lower() if "a" <= ch <= "z")


def stopwords(
    base: Iterable[str] = BASE_STOPWORDS,
    extra: Iterable[str] = EXTRA_STOPWORDS,
    clean_base_list: bool = False,
) -> list[str]:
    """The stop list as a sorted Python list.

    By default the base list keeps its apostrophes, so ``don't`` never equals a cleaned
    token; ``clean_base_list`` applies the text cleaning to it first.
    """
    base = [clean_word(w) for w in base] if clean_base_list else base
    return sorted(set(base) | set(extra))


def stopword_table(
    spark: SparkSession,
    base: Iterable[str] = BASE_STOPWORDS,
    extra: Iterable[str] = EXTRA_STOPWORDS,
    more: DataFrame | None = None,
) -> DataFrame:
    """Distinct union of the word lists and, if given, of the one column of ``more``."""
    schema = T.StructType([T.StructField("word", T.StringType())])
    words = spark.createDataFrame([(w,) for w in [*base, *extra]], schema)
    if more is not None:
        words = words.union(more)
    return words.distinct()


# Anything but a-z and white space; after this, any run of other characters is white space.
_NOT_TEXT = r"[^a-z\p{IsWhite_Space}\x1C-\x1F]+"


def clean_tokens(
    df: DataFrame,
    text_col: str = "lyrics",
    stop: list[str] | None = None,
    min_len: int = 3,
    tokens_col: str = "tokens",
    drop_empty: bool = False,
) -> DataFrame:
    """Add the array of clean tokens: lower case, everything but letters a-z deleted, split at
    white space and inside the listed contractions; at least ``min_len`` letters and not a
    stop word.

    A projection: no shuffle. Null text gives an empty array. ``drop_empty`` removes
    documents with no token left.
    """
    stop = stopwords() if stop is None else stop
    letters = F.regexp_replace(F.lower(F.col(text_col)), _NOT_TEXT, "")
    # The contractions are rare, and a plain substring search is cheaper than the expression.
    found = reduce(
        Column.__or__, [F.contains("_letters", F.lit(a + b)) for a, b in CONTRACTIONS]
    )
    text = F.when(found, F.regexp_replace("_letters", _SPLIT_WORDS, _SPLIT_PARTS))
    words = F.split(text.otherwise(F.col("_letters")), "[^a-z]+")
    kept = F.filter(words, lambda t: (F.length(t) >= min_len) & ~t.isin(stop))
    none = F.array().cast("array<string>")
    out = (
        df.withColumn("_letters", letters)
        .withColumn(tokens_col, F.coalesce(kept, none))
        .drop("_letters")
    )
    return drop_tokenless(out, tokens_col) if drop_empty else out


def drop_tokenless(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Documents with at least one token."""
    return compute_once(docs, **{tokens_col: F.col(tokens_col)}).where(F.size(tokens_col) > 0)


def drop_stopwords(tokens: DataFrame, stop: DataFrame, token_col: str = "token") -> DataFrame:
    """Anti join of token rows with a stop table of any size (one column ``word``)."""
    return tokens.join(stop.withColumnRenamed("word", token_col), token_col, "left_anti")


def lemma_table(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """``(token, lemma)`` for terms whose noun ending comes off to give another term.

    The shortest such term wins, ties by spelling. Terms that stay as they are have no row.
    ``terms`` has one row per distinct term.
    """
    candidates = F.array(
        *[
            F.when(
                F.endswith(F.col(term_col), F.lit(ending))
                & (F.length(term_col) > len(ending)),
                F.concat(
                    F.expr(f"left(`{term_col}`, length(`{term_col}`) - {len(ending)})"),
                    F.lit(new),
                ),
            )
            for ending, new in NOUN_ENDINGS
        ]
    )
    stems = terms.select(
        F.col(term_col).alias("token"), F.explode(F.array_compact(candidates)).alias("lemma")
    )
    known = terms.select(F.col(term_col).alias("lemma"))
    return (
        stems.join(known, "lemma", "left_semi")
        .groupBy("token")
        .agg(F.min(F.struct(F.length("lemma").alias("n"), "lemma")).alias("best"))
        .select("token", F.col("best.lemma").alias("lemma"))
    )


def lemmatize(rows: DataFrame, lemmas: DataFrame, token_col: str = "token") -> DataFrame:
    """Add ``lemma`` to token rows; a token without a lemma keeps itself.

    The lemma table grows with the corpus vocabulary, so it is not broadcast by hint: the
    adaptive planner broadcasts it if its measured size allows and splits hot tokens if not.
    Count tokens per document first (``count_tokens``) to keep the shuffle small.
    """
    found = lemmas.select(F.col("token").alias(token_col), "lemma")
    return rows.join(found, token_col, "left").withColumn(
        "lemma", F.coalesce("lemma", F.col(token_col))
    )


#: Parts of a document's map of changed words: a look-up reads one part, entry by entry.
MAP_PARTS = 64


def lemmatize_arrays(
    docs: DataFrame, lemmas: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens"
) -> DataFrame:
    """``(id, tokens)`` with each token replaced by its lemma, in the same order.

    Only distinct tokens of a document meet the lemmas, and only those that change come back, as
    a map that is applied to the array in place; no token is a row of its own. Documents without
    tokens have no row in the result; ids are unique, and a null id keeps its tokens.
    """
    found = lemmas.select("token", "lemma").where("lemma <> token")
    terms = docs.select(F.col(id_col).alias("_id"), F.explode(F.array_distinct(tokens_col)).alias("token"))
    part = F.pmod(F.hash("token"), F.lit(MAP_PARTS)).alias("_part")
    # Both groupings use the one partitioning by document.
    changed = (
        terms.where("_id IS NOT NULL").join(found, "token").select("_id", part, "token", "lemma").repartition("_id")
        .groupBy("_id", "_part").agg(F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("_map"))
        .groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("_part", "_map"))).alias("_changed"))
    )
    own = drop_tokenless(docs.select(id_col, tokens_col), tokens_col)
    met = own.join(changed, F.col(id_col) == F.col("_id"), "left")

    def lemma(token: Column) -> Column:
        parts = F.try_element_at("_changed", F.pmod(F.hash(token), F.lit(MAP_PARTS)))
        return F.coalesce(F.try_element_at(parts, token), token)

    return met.select(id_col, F.when(F.col("_changed").isNull(), F.col(tokens_col)).otherwise(F.transform(tokens_col, lemma)).alias(tokens_col))


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens"
) -> DataFrame:
    """``(id, token, tf)``. Rows of one document start in one partition, so the partial
    aggregate already brings them down to the distinct tokens."""
    return (
        explode_present(docs, tokens_col, "token", [id_col])
        .groupBy(id_col, "token")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


def document_frequency(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """``(term, df, is_total)``: documents per term, and one row for all documents.

    The extra row has the empty term and spares a second pass over the texts. It is marked by
    an aggregate, ``is_total``: a filter on ``term`` would be pushed below the aggregate, and
    then plans that need both kinds of rows would compute the counts twice. One document is
    one row, so distinct terms are found inside the row and only partial counts are shuffled.
    """
    terms = F.concat(F.array(F.lit("")), F.array_distinct(tokens_col))
    return (
        explode_present(docs, F.when(F.size(tokens_col) > 0, terms), "term", [])
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.bool_and(F.col("term") == "").alias("is_total"))
    )


def vocabulary(
    docs: DataFrame,
    tokens_col: str = "tokens",
    no_below: int = 5,
    no_above: float = 0.5,
    keep_n: int | None = None,
) -> DataFrame:
    """``(term, term_id, df)``: terms in at least ``no_below`` documents and in at most the
    share ``no_above`` of them, numbered from the most frequent on, ties by spelling.

    ``keep_n`` asks for only so many of the most frequent terms; by default all are kept.
    """
    return frequent_terms(document_frequency(docs, tokens_col), no_below, no_above, keep_n)


def frequent_terms(counts: DataFrame, no_below: int, no_above: float, keep_n: int | None = None) -> DataFrame:
    """``vocabulary`` from document frequencies (``term, df, is_total``)."""
    n_docs = counts.agg(F.max(F.when(F.col("is_total"), F.col("df")))).scalar()
    kept = counts.where(~F.col("is_total") & (F.col("df") >= no_below)).where(
        F.col("df") <= F.floor(n_docs * F.lit(float(no_above)))
    )
    numbered = number_rows(kept.select("term", "df"), [F.desc("df"), F.asc("term")], "term_id")
    if keep_n is not None:
        numbered = numbered.where(F.col("term_id") < keep_n)
    return numbered.select("term", "term_id", "df")


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number the rows from 0 in ``order`` without bringing them into one task.

    Rows are sorted by ranges and written to the checkpoint folder once; a range's numbers
    begin after the rows of the ranges before it, of which there is one count each.
    """
    inside = F.monotonically_increasing_id()  # range number in the upper bits, row in the lower
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut_lineage(ranged.withColumn("_id", inside))
    part = F.shiftright("_id", 33).alias("_part")
    counts = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"))
    row = F.col("_id").bitwiseAND((1 << 33) - 1)
    return (
        ranged.withColumn("_part", part)
        .join(first, "_part")
        .withColumn(name, (F.col("_first") + row).cast("long"))
        .drop("_id", "_part", "_first")
    )


def bag_of_words(
    docs: DataFrame, vocab: DataFrame, id_col: str = "doc_id", tokens_col: str = "tokens"
) -> DataFrame:
    """``(id, term_id, term, tf)`` for the tokens in the vocabulary.

    No broadcast hint: the vocabulary grows with the corpus.
    """
    counts = count_tokens(docs, id_col, tokens_col).withColumnRenamed("token", "term")
    joined = counts.join(vocab.select("term", "term_id"), "term")
    return joined.select(id_col, "term_id", "term", "tf")
