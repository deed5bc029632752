"""Corpus pipeline: documents to tokens, in five stages.

Every stage takes the rows that the one before kept and, but for the last, returns rows with
the columns of ``documents``:

1. toxicity: documents whose score reaches the cutoff of their language are gone;
2. line dedup: lines that an earlier document holds are gone from the text;
3. near copies (sets of five words, similarity of 0.8 or more): one document of each group stays;
4. mixing: the words that each source gives to the mix, a row for every time it is read through;
5. BPE: token ids of every text, and what they decode to, as digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseflux.lineage import cut_lineage
from verseflux.llm.bpe import encode_decode
from verseflux.llm.common import prepare, release, table
from verseflux.llm.linededup import dedup_lines
from verseflux.llm.mixing import mix_documents
from verseflux.llm.nearcopies import drop_near_copies
from verseflux.llm.queries import tokenizer_path
from verseflux.llm.toxicity import learn, score_toxicity

#: No SQL can express the trained classifier.
ORACLE_SQL = None


def packed(docs: DataFrame, needed: list[str]) -> DataFrame:
    """The ``needed`` columns that ``docs`` has, and all others inside one column ``row``, where
    no name can meet an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(F.struct(*(rest or [F.lit(None).alias("none")])).alias("row"), *[c for c in needed if c in docs.columns])


def unpacked(done: DataFrame, columns: list[str], needed: list[str]) -> DataFrame:
    """The ``columns`` in their order, the needed ones as the operator left them."""
    return done.select(*[F.col(c) if c in needed else F.col(f"row.`{c}`").alias(c) for c in columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from ``labels``, does not reject.

    Null and empty texts are scored as texts without words. Repeated rows are scored alike and
    stay or go together; rows without an id are scored but teach nothing. Other columns are kept
    as they are, whatever their names; an empty table gives an empty one.
    """
    prepare(spark)
    net = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(packed(docs, ["text", "lang"]), net)
    return unpacked(scored.where("NOT rejected"), docs.columns, ["text", "lang"])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document of a smaller id holds.

    A null text stays null; an empty one stays empty. A null id is larger than all others;
    repeated rows lose the same lines. ``n_chars``, if there is one, is counted anew where lines
    are gone. Other columns are kept as they are, whatever their names; an empty table gives an
    empty one.
    """
    prepare(spark)
    needed = ["doc_id", "text"]
    done = dedup_lines(packed(docs, needed))
    changed = F.col("n_dropped") > 0
    done = done.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        chars = F.when(changed, F.length("text")).otherwise(F.col("row.n_chars")).cast(kind)
        done, needed = done.withColumn("n_chars", chars), [*needed, "n_chars"]
    return unpacked(done, docs.columns, needed)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies, the one of the smallest id.

    Texts without words are no copies of anything; of equal rows with one id one stays, and of
    a group without ids one row. Other columns are kept as they are, whatever their names; an
    empty table gives an empty one.
    """
    prepare(spark)
    needed = ["doc_id", "text"]
    return unpacked(drop_near_copies(packed(docs, needed)), docs.columns, needed)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes: a row per document and round of its source, so ids repeat.

    Null texts and texts without words take nothing and are gone; a null source is the last one,
    a null id the last of its source; repeated rows are taken from one by one. ``n_chars``, if
    there is one, is counted anew where a text is taken in part. Other columns are kept as they
    are, whatever their names; an empty table gives an empty one.
    """
    needed = ["doc_id", "source", "text", "n_chars"]
    return unpacked(mix_documents(packed(docs, needed)), docs.columns, needed)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of ``docs`` but the text, with ``n_tokens``, ``ids`` (little-endian 32-bit
    numbers) and the digests of the ids and of the text decoded from them.

    Null and empty texts have no ids. Rows are independent; columns named like a result are
    replaced; an empty table gives an empty one.
    """
    prepare(spark)
    done = encode_decode(packed(docs, ["text"]), tokenizer_path())
    made = {
        "n_tokens": F.expr("length(ids) div 4"),
        "ids": F.col("ids"),
        "ids_sha256": F.sha2("ids", 256),
        "decoded_sha256": F.sha2("decoded", 256),
    }
    kept = [c for c in docs.columns if c != "text" and c.lower() not in made]
    return done.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], *[x.alias(n) for n, x in made.items()])


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near copies", drop_copies),
    ("mixing", mix),
    ("bpe", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is written before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        release(spark)  # what a stage made on its way is garbage now
    return STAGES[-1][1](spark, docs, sf_dir)
