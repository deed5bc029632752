"""Collections, tokens, vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseflux.functions.fixed import (
    BASE_STOPWORDS,
    EXTRA_STOPWORDS,
    HEADER_PREFIX,
    NOUN_ENDINGS,
    RECORD_SEPARATOR,
    TITLE_LINE,
)
from verseflux.functions.text import truncate
from verseflux.operators.parse import parse_collection, parse_rejects
from verseflux.operators.scoring import MODEL_WINDOW
from verseflux.lineage import cut_lineage
from verseflux.operators.textprep import (
    bag_of_words,
    clean_tokens,
    count_tokens,
    document_frequency,
    lemma_table,
    lemmatize,
    lemmatize_arrays,
    stopword_table,
    stopwords,
    vocabulary,
)
from verseflux.queries.registry import query, sql_strip, sql_tokens, sql_words, table
from verseflux.sources.collections import explode_records

# ---- collection files made of the documents ---------------------------------------------
# Each document becomes a small collection file: a header record, a song record and a blank
# record. The layout of the song record depends on the language, so that every case of the
# grammar occurs: plain, with a preamble, with \r\n line ends, and without a title line.


def collection_files(docs: DataFrame) -> DataFrame:
    number = F.col("doc_id").cast("string")
    title = F.concat(F.lit("--- 'Song "), number, F.lit("' by "), F.col("source"), F.lit(" ---"))
    text = F.col("text")
    song = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("\nFirst a word.\n"), title, F.lit("\n"), text))
        .when(F.col("lang") == "de", F.concat(F.lit("\r\n"), title, F.lit("\r\n"), text, F.lit("\r\n")))
        .when(F.col("lang") == "es", F.concat(F.lit("\n"), text))
        .otherwise(F.concat(F.lit("\n"), title, F.lit("\n"), text, F.lit("\n")))
    )
    year = 2000 + F.regexp_extract("source", "[0-9]+", 0).cast("int")
    name = F.when(F.col("lang") == "de", "songs.txt").otherwise(
        F.concat(F.lit("lyrics_"), year.cast("string"), F.lit(".txt"))
    )
    line = F.lit(RECORD_SEPARATOR)
    value = F.concat(F.lit(HEADER_PREFIX + "\n"), F.col("source"), line, song, line, F.lit(" \n "))
    return docs.select("doc_id", name.alias("file_name"), value.alias("value"))


_NL, _CRLF = "chr(10)", "chr(13) || chr(10)"
_TITLE = "'--- ''Song ' || doc_id || ''' by ' || source || ' ---'"
_LINE = TITLE_LINE.replace("'", "''")
_SQL_SONGS = f"""
WITH files AS (
    SELECT doc_id,
        CASE WHEN lang = 'de' THEN 'songs.txt' ELSE 'lyrics_'
            || (2000 + regexp_extract(source, '[0-9]+')::int) || '.txt' END AS file_name,
        '{HEADER_PREFIX}' || {_NL} || source || '{RECORD_SEPARATOR}'
        || CASE lang
            WHEN 'fr' THEN {_NL} || 'First a word.' || {_NL} || {_TITLE} || {_NL} || text
            WHEN 'de' THEN {_CRLF} || {_TITLE} || {_CRLF} || text || {_CRLF}
            WHEN 'es' THEN {_NL} || text
            ELSE {_NL} || {_TITLE} || {_NL} || text || {_NL} END
        || '{RECORD_SEPARATOR}' || ' ' || {_NL} || ' ' AS value
    FROM documents),
records AS (
    SELECT doc_id, file_name, unnest(range(len(parts)))::int AS record, unnest(parts) AS part
    FROM (SELECT doc_id, file_name, string_split(value, '{RECORD_SEPARATOR}') AS parts FROM files)),
songs AS (
    SELECT doc_id, file_name, record,
        {sql_strip("regexp_replace(part, chr(13) || chr(10) || '?', chr(10), 'g')")} AS song
    FROM records),
lines AS (
    SELECT *, regexp_extract(song, '{_LINE}') AS line FROM songs
    WHERE song <> '' AND NOT starts_with(song, '{HEADER_PREFIX}'))
"""


@query(
    "parse_collection",
    _SQL_SONGS
    + f"""
SELECT doc_id, record, regexp_extract(line, '{_LINE}', 1) AS title,
    regexp_extract(line, '{_LINE}', 2) AS artist,
    try_cast(regexp_extract(file_name, '[0-9]{{4}}') AS int) AS year, 'human' AS source,
    {sql_strip("substring(song, strpos(song, line) + length(line))")} AS lyrics
FROM lines WHERE line <> ''""",
)
def parse_collection_query(spark: SparkSession, folder: str) -> DataFrame:
    records = explode_records(collection_files(table(spark, folder, "documents")))
    return parse_collection(records, keep=("doc_id", "record"))


@query(
    "parse_collection_compat",
    _SQL_SONGS
    + f"""
SELECT doc_id, regexp_extract(line, '{_LINE}', 1) AS title,
    {sql_strip(
        "substring(song, CASE WHEN strpos(substring(song, 4), '---') > 0 "
        "THEN strpos(substring(song, 4), '---') + 6 ELSE 3 END)"
    )} AS lyrics
FROM lines WHERE line <> ''""",
)
def parse_collection_compat(spark: SparkSession, folder: str) -> DataFrame:
    records = explode_records(collection_files(table(spark, folder, "documents")))
    return parse_collection(records, compat=True, keep=("doc_id",)).select(
        "doc_id", "title", "lyrics"
    )


@query(
    "parse_rejects",
    _SQL_SONGS
    + "SELECT doc_id, record, file_name, substring(song, 1, 50) AS preview "
    "FROM lines WHERE line = ''",
)
def parse_rejects_query(spark: SparkSession, folder: str) -> DataFrame:
    records = explode_records(collection_files(table(spark, folder, "documents")))
    return parse_rejects(records, keep=("doc_id", "record"))


@query(
    "union_collections",
    """
SELECT 'documents' AS collection, doc_id AS id, 0::bigint AS part, source AS origin, text
FROM documents
UNION ALL
SELECT 'conversations', conv_id, turn, role, text FROM conversations""",
)
def union_collections(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select(
        F.lit("documents").alias("collection"),
        F.col("doc_id").alias("id"),
        F.lit(0).cast("long").alias("part"),
        F.col("source").alias("origin"),
        "text",
    )
    turns = table(spark, folder, "conversations").select(
        "text",
        F.col("role").alias("origin"),
        F.col("turn").alias("part"),
        F.col("conv_id").alias("id"),
        F.lit("conversations").alias("collection"),
    )
    return documents.unionByName(turns)


@query(
    "truncate_text",
    f"""
SELECT doc_id, length(text) AS n_chars, substring(text, 1, {MODEL_WINDOW}) AS model_input,
    length(text) > {MODEL_WINDOW} AS is_cut
FROM documents""",
)
def truncate_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id",
        F.length("text").alias("n_chars"),
        truncate("text", MODEL_WINDOW).alias("model_input"),
        (F.length("text") > MODEL_WINDOW).alias("is_cut"),
    )


# ---- tokens ------------------------------------------------------------------------------

_STOP = stopwords()
SQL_DOC_TOKENS = f"""
WITH docs AS (SELECT doc_id, {sql_tokens("text", _STOP)} AS tokens FROM documents)
"""


@query(
    "tokens_clean",
    SQL_DOC_TOKENS
    + """
SELECT doc_id, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS tokens_text
FROM docs WHERE len(tokens) > 0""",
)
def tokens_clean(spark: SparkSession, folder: str) -> DataFrame:
    docs = clean_tokens(table(spark, folder, "documents"), "text", drop_empty=True)
    return docs.select(
        "doc_id",
        F.size("tokens").alias("n_tokens"),
        F.array_join("tokens", " ").alias("tokens_text"),
    )


@query(
    "stopword_union",
    f"""
WITH docs AS (SELECT {sql_tokens("text", [], 1)} AS tokens FROM documents),
common AS (
    SELECT term FROM (SELECT unnest(list_distinct(tokens)) AS term FROM docs)
    GROUP BY term HAVING count(*) >= 0.2::double * (SELECT count(*) FROM docs WHERE len(tokens) > 0))
SELECT unnest({sql_words([*BASE_STOPWORDS, *EXTRA_STOPWORDS])}) AS word
UNION SELECT term FROM common""",
)
def stopword_union(spark: SparkSession, folder: str) -> DataFrame:
    docs = clean_tokens(table(spark, folder, "documents"), "text", stop=[], min_len=1)
    counts = document_frequency(docs)
    n_docs = counts.agg(F.max(F.when(F.col("is_total"), F.col("df")))).scalar()
    common = counts.where(~F.col("is_total") & (F.col("df") >= F.lit(0.2) * n_docs))
    common = common.select(F.col("term").alias("word"))
    return stopword_table(spark, more=common)


_CANDIDATES = " UNION ALL ".join(
    f"SELECT term AS token, left(term, length(term) - {len(old)}) || '{new}' AS lemma FROM terms "
    f"WHERE ends_with(term, '{old}') AND length(term) > {len(old)}"
    for old, new in NOUN_ENDINGS
)


@query(
    "lemmatize",
    SQL_DOC_TOKENS
    + f""",
counts AS (
    SELECT doc_id, token, count(*) AS tf
    FROM (SELECT doc_id, unnest(tokens) AS token FROM docs) GROUP BY doc_id, token),
terms AS (SELECT DISTINCT token AS term FROM counts),
lemmas AS (
    SELECT token, first(lemma ORDER BY length(lemma), lemma) AS lemma FROM ({_CANDIDATES})
    WHERE lemma IN (SELECT term FROM terms) GROUP BY token)
SELECT c.doc_id, c.token, c.tf, coalesce(l.lemma, c.token) AS lemma
FROM counts c LEFT JOIN lemmas l USING (token)""",
)
def lemmatize_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = clean_tokens(table(spark, folder, "documents"), "text")
    counts = count_tokens(docs)
    lemmas = lemma_table(counts.select(F.col("token").alias("term")).distinct())
    return lemmatize(counts, lemmas).select("doc_id", "token", "tf", "lemma")


@query(
    "lemmatize_arrays",
    SQL_DOC_TOKENS
    + f""",
counts AS (SELECT DISTINCT doc_id, token FROM (SELECT doc_id, unnest(tokens) AS token FROM docs)),
terms AS (SELECT DISTINCT token AS term FROM counts),
lemmas AS (
    SELECT token, first(lemma ORDER BY length(lemma), lemma) AS lemma FROM ({_CANDIDATES})
    WHERE lemma IN (SELECT term FROM terms) GROUP BY token),
placed AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS place FROM docs)
SELECT doc_id, string_agg(coalesce(l.lemma, p.token), ' ' ORDER BY place) AS lemmas
FROM placed p LEFT JOIN lemmas l USING (token) GROUP BY doc_id""",
)
def lemmatize_arrays_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = cut_lineage(clean_tokens(table(spark, folder, "documents"), "text").select("doc_id", "tokens"))
    lemmas = lemma_table(docs.select(F.explode(F.array_distinct("tokens")).alias("term")).distinct())
    return lemmatize_arrays(docs, lemmas).select("doc_id", F.array_join("tokens", " ").alias("lemmas"))


_SQL_VOCABULARY = (
    SQL_DOC_TOKENS
    + """,
frequency AS (
    SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS term FROM docs)
    GROUP BY term),
vocabulary AS (
    SELECT term, row_number() OVER (ORDER BY df DESC, term) - 1 AS term_id, df FROM frequency
    WHERE df >= 5 AND df <= floor(0.5 * (SELECT count(*) FROM docs WHERE len(tokens) > 0))
)
"""
)


@query("vocabulary", _SQL_VOCABULARY + "SELECT term, term_id, df FROM vocabulary")
def vocabulary_query(spark: SparkSession, folder: str) -> DataFrame:
    return vocabulary(clean_tokens(table(spark, folder, "documents"), "text"))


@query(
    "bag_of_words",
    _SQL_VOCABULARY
    + """
SELECT doc_id, term_id, term, count(*) AS tf
FROM (SELECT doc_id, unnest(tokens) AS term FROM docs) JOIN vocabulary USING (term)
GROUP BY doc_id, term_id, term""",
)
def bag_of_words_query(spark: SparkSession, folder: str) -> DataFrame:
    docs = clean_tokens(table(spark, folder, "documents"), "text")
    return bag_of_words(docs, vocabulary(docs))
