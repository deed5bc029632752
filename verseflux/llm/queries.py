"""One query per operator, over its whole table, with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseflux.llm.ann import nearest
from verseflux.llm.bpe import encode_decode
from verseflux.llm.common import table
from verseflux.llm.language import identify, learn_profiles
from verseflux.llm.linededup import dedup_lines
from verseflux.llm.mixing import BLOCK_WORDS, mix_sizes
from verseflux.llm.nearcopies import near_copies
from verseflux.llm.quality import ERROR, GRID, RISK, RULES, STEP, STEPS, TERMS, quality_filter
from verseflux.llm.records import new_folder, public_id, read_records, remove_folder, write_records
from verseflux.llm.registry import ORACLES, QUERIES, query
from verseflux.llm.substrings import cut_repeats
from verseflux.llm.toxicity import learn, score_toxicity

__all__ = ["ORACLES", "QUERIES"]


def tokenizer_path() -> str:
    """The public byte-level BPE file that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")



SPACE_CHARS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINES_SQL = f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, {SPACE_CHARS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT k.doc_id, pos, line, f.first IS NOT NULL AND f.first <> k.doc_id AS gone
  FROM keyed k LEFT JOIN firsts f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


@query("op8_line_dedup", LINES_SQL)
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op3_bpe_automaton")
def op3_bpe_automaton(spark: SparkSession, folder: str) -> DataFrame:
    done = encode_decode(table(spark, folder, "documents").select("doc_id", "text"), tokenizer_path())
    return done.select(
        "doc_id",
        F.expr("length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op6_token_records")
def op6_token_records(spark: SparkSession, folder: str) -> DataFrame:
    files = new_folder(spark)
    write_records(table(spark, folder, "documents"), files, tokenizer_path())
    rows = read_records(spark, files)
    remove_folder(spark, files)  # what was read is in a checkpoint
    return rows.select(public_id("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


WORD_SQL = "[^\\x20\\x09-\\x0D]+"
MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD_SQL}')), 0)::bigint AS size FROM documents
), named AS (
  SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
  FROM sized GROUP BY source
), roomy AS (
  SELECT *, no % 3 + 1 AS weight, 3 * source_size AS most, 3 * source_size / (no % 3 + 1) AS room FROM named
), lefts AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY room, no
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_,
         sum(weight) OVER (ORDER BY room, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_
  FROM roomy
), first_ AS (
  SELECT room AS room_, no AS no_, left_ AS l, open_ AS o FROM lefts WHERE left_ <= room * open_ ORDER BY room, no LIMIT 1
), aimed AS (
  SELECT t.*, CASE WHEN (room, no) >= (room_, no_) THEN least(l::double * weight / o, most::double)
                   ELSE most::double END AS target
  FROM lefts t, first_
), cut1 AS (
  SELECT *, least(round(target)::bigint, most) AS words, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks
  FROM aimed
), cut2 AS (
  SELECT *, list_filter([1048573, 1048571, 1048559, 1048549], lambda p: blocks % p <> 0) AS fit,
         CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END AS rounds,
         source_size - (blocks - 1) * {BLOCK_WORDS} AS tail
  FROM cut1
), cut3 AS (
  SELECT *, fit[(no % len(fit) + 1)::int] AS mul, (no * 7919 + 104729) % greatest(blocks, 1) AS add_,
         words - rounds * source_size AS rest
  FROM cut2
), cut4 AS (
  SELECT *, ((blocks - 1) * mul + add_) % greatest(blocks, 1) AS tail_at,
         (rest + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS full_
  FROM cut3
), cut5 AS (
  SELECT *, CASE WHEN rest <= 0 THEN 0 WHEN tail_at >= full_ THEN full_
            ELSE (rest + 2 * {BLOCK_WORDS} - 1 - tail) // {BLOCK_WORDS} END AS rest_slots
  FROM cut4
), planned AS (
  SELECT *, CASE WHEN rest > 0 THEN rest_slots * {BLOCK_WORDS}
                 - CASE WHEN tail_at < rest_slots THEN {BLOCK_WORDS} - tail ELSE 0 END - rest ELSE 0 END AS cut
  FROM cut5
), placed AS (
  SELECT d.doc_id, d.size, p.*,
         coalesce(sum(d.size) OVER (PARTITION BY p.no ORDER BY d.doc_id % (2 * floor(sqrt(n.rows))::bigint + 1), d.doc_id
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start
  FROM sized d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source, (SELECT count(*) AS rows FROM sized) n
), spread AS (
  SELECT *, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS block
  FROM placed WHERE size > 0
), met AS (
  SELECT *, (block * mul + add_) % blocks AS index_, greatest(start - block * {BLOCK_WORDS}, 0) AS low,
         least(start + size - block * {BLOCK_WORDS}, {BLOCK_WORDS}) AS high,
         CASE WHEN block = blocks - 1 THEN tail ELSE {BLOCK_WORDS} END AS length
  FROM spread
), read_ AS (
  SELECT doc_id, no, start, sum(rounds * (high - low)
      + CASE WHEN index_ < rest_slots - 1 THEN high - low
             WHEN index_ = rest_slots - 1 THEN greatest(least(high, length - cut) - low, 0) ELSE 0 END)::bigint AS taken
  FROM met GROUP BY doc_id, no, start
)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(r.taken, 0) AS taken
FROM placed p LEFT JOIN read_ r ON p.doc_id = r.doc_id AND p.no = r.no AND p.start = r.start AND p.size > 0
"""


@query("op2_mix_sources", MIX_SQL)
def op2_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sizes(table(spark, folder, "documents"))


def _quality_sql() -> str:
    blank = SPACE_CHARS
    log_fact = "lgamma({} + 1.0)"
    tail = (
        f"{log_fact.format('n')} - {log_fact.format('k')} - {log_fact.format('(n - k)')}"
        f" + k * ln({RISK}::double) + (n - k) * ln(1 - {RISK}::double)"
        f" + ln("
        f"list_sum(list_transform(range(0, least(k, {TERMS}) + 1), lambda i: exp(lgamma(k + 1.0) - lgamma(k - i + 1.0)"
        f" + lgamma(n - k + 1.0) - lgamma(n - k + i + 1.0) + i * ln((1 - {RISK}::double) / {RISK}::double)))))"
    )
    ratio = {
        "symbols": "n_symbols::double / greatest(word_chars, 1)",
        "dup_lines": "n_dup_lines::double / greatest(n_lines, 1)",
        "repeats": "n_repeat_words::double / greatest(n_words, 1)",
        "capitals": "capitals::double / greatest(word_chars, 1)",
        "long_words": "word_chars::double / (greatest(n_words, 1) * 32)",
    }
    grid = "[" + ", ".join(f"{g!r}::double" for g in GRID) + "]"
    rules = ", ".join(f"{ratio[r]} AS r_{r}" for r in RULES)
    union = " UNION ALL ".join(f"SELECT lang, '{r}' AS rule, r_{r} AS value FROM others" for r in RULES)
    cuts = ", ".join(f"min(cutoff) FILTER (rule = '{r}' AND {STEP} * tail <= step * n) AS c_{r}" for r in RULES)
    rejects = " OR ".join(f"coalesce(r_{r} > c_{r}, false)" for r in RULES)
    return f"""
WITH plain AS (SELECT doc_id, lang, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(text, '{WORD_SQL}') AS w FROM plain)
), wins AS (
  SELECT doc_id, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS win
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), again AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) > 1 AS twice FROM wins WHERE win IS NOT NULL
), covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words
  FROM again, (SELECT unnest([0, 1, 2]) AS d) WHERE twice GROUP BY doc_id
), counted AS (
  SELECT doc_id, count(*) AS n_words, sum(length(word))::bigint AS word_chars FROM words GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM plain)
  WHERE trim(line, {blank}) <> '' GROUP BY doc_id
), based AS (
  SELECT doc_id, lang, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS capitals,
         coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM plain LEFT JOIN counted USING (doc_id) LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rules} FROM based
), good AS (
  SELECT * FROM rated WHERE NOT base_failed AND doc_id IN
    (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)
), others AS (
  SELECT * FROM rated WHERE NOT base_failed AND NOT coalesce(doc_id IN (SELECT doc_id FROM good), false)
), tails AS (
  SELECT lang, rule, cutoff, count(*) AS n, count(*) FILTER (value > cutoff) AS tail
  FROM ({union}), (SELECT unnest({grid}) AS cutoff) GROUP BY lang, rule, cutoff
), ladder AS (
  SELECT lang, step, {cuts} FROM tails, (SELECT unnest(range({STEPS})) AS step) GROUP BY lang, step
), tests AS (
  SELECT g.lang, step, count(*) AS n, count(*) FILTER ({rejects}) AS k
  FROM good g JOIN ladder l ON g.lang IS NOT DISTINCT FROM l.lang GROUP BY g.lang, step
), last_ AS (
  SELECT lang, max(step) AS step FROM tests
  WHERE k < n * {RISK}::double
    AND {tail} <= ln({ERROR}::double / (SELECT count(*) FROM (SELECT DISTINCT lang FROM good)))
  GROUP BY lang
), cuts AS (
  SELECT l.* FROM ladder l JOIN last_ t ON l.lang IS NOT DISTINCT FROM t.lang AND l.step = t.step
)
SELECT r.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({rejects}) AS kept
FROM rated r LEFT JOIN cuts c ON r.lang IS NOT DISTINCT FROM c.lang
"""


@query("op7_quality_rules", _quality_sql())
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    done = quality_filter(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return done.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


NEAREST_SQL = """
WITH usable AS (
  SELECT vec_id, embedding::double[] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)
SELECT q.vec_id AS query_id, row_number() OVER best AS rank, x.vec_id AS vec_id, list_inner_product(q.v, x.v) AS score
FROM usable q JOIN usable x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id
WINDOW best AS (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, x.v) DESC, x.vec_id)
QUALIFY row_number() OVER best <= 20
"""


@query("op4_nearest_blocks", NEAREST_SQL)
def op4_nearest_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return nearest(table(spark, folder, "embeddings"))


def held_out(id_col: str, parts: int, part: int):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part


@query("op10_language_profiles")
def op10_language_profiles(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(held_out("doc_id", 4, 2), F.lit(False)))
    profiles = learn_profiles(docs.where("NOT held_out"), "text", "lang")
    return identify(docs.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")


@query("op1_toxicity_cnn")
def op1_toxicity_cnn(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    labels = table(spark, folder, "labels").where(~held_out("doc_id", 5, 0))
    net = learn(docs, labels)
    scored = score_toxicity(docs, net)
    return scored.select(
        "doc_id",
        F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        "cutoff",
        "rejected",
    )


@query("op5_lsh_forest")
def op5_lsh_forest(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(table(spark, folder, "documents"), width=4)


@query("op9_repeated_bytes")
def op9_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    done = cut_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return done.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256")
    )


from verseflux.llm import queries_new  # noqa: E402, F401  (registers its queries)
