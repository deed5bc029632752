"""Queries of hard negatives, language-model scores and the conversation trie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseflux.llm.bond import hard_negatives
from verseflux.llm.common import table
from verseflux.llm.prefixtrie import conversation_trie
from verseflux.llm.queries import held_out
from verseflux.llm.registry import query
from verseflux.llm.suffixtree import score_texts

#: Unsigned crc32 of the text ``{0}``: the table comes from the polynomial, bit by bit.
CRC_TABLE = (
    "list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),"
    " lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"
)
CRC = (
    "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)),"
    " lambda a, b: xor(a >> 8, crc_table[(xor(a, b) & 255) + 1])), 4294967295)"
)

NEGATIVES_SQL = """
WITH usable AS (
  SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::double)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor_id, x.id AS id, a.label = x.label AS same, list_inner_product(a.v, x.v)::bigint AS score
  FROM usable a JOIN usable x ON a.id % 50 = 0 AND a.id <> x.id AND len(a.v) = len(x.v)
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER best AS rank, n.id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id)
QUALIFY row_number() OVER best <= 3
"""


@query("op11_bond_negatives", NEGATIVES_SQL)
def op11_bond_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    label = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    return hard_negatives(rows.withColumn("label", label))


TRIE_SQL = f"""
WITH crc AS (SELECT {CRC_TABLE} AS crc_table),
turns AS (
  SELECT conv_id AS c, strlen(coalesce(text, '')) AS bytes, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said, turn
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, said) AS pos FROM turns
), convs AS (
  SELECT c, n, c - c % 5 AS base, {CRC.format("c::varchar")} % 9 AS h FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), crc
), planned AS (
  SELECT v.*, least(v.h, coalesce(b.n, 0)) AS head FROM convs v LEFT JOIN convs b ON v.base = b.c
), rebuilt AS (
  SELECT v.c, p.pos AS depth, said, bytes FROM planned v JOIN placed p ON p.c = v.base AND p.pos <= v.h
  UNION ALL
  SELECT v.c, p.pos - v.h + v.head, said, bytes FROM planned v JOIN placed p ON p.c = v.c AND p.pos > v.h
), paths AS (
  SELECT c, depth, bytes, sha256(string_agg(said, '') OVER (PARTITION BY c ORDER BY depth)) AS node FROM rebuilt
  UNION ALL SELECT c, 0, 0, 'root' FROM convs
), stepped AS (
  SELECT *, lag(node) OVER w AS parent, lead(node) OVER w IS NULL AS ends FROM paths WINDOW w AS (PARTITION BY c ORDER BY depth)
), nodes AS (
  SELECT node, parent, depth, bytes, min(c) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(c::varchar, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM stepped GROUP BY node, parent, depth, bytes
), counted AS (
  SELECT n.*, (SELECT count(*) FROM nodes x WHERE x.parent = n.node) AS n_children FROM nodes n
), sums AS (
  SELECT s.node, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.bytes)::bigint AS saved_tokens
  FROM counted n JOIN stepped s ON s.c = n.conv_id AND s.depth <= n.depth GROUP BY s.node
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM counted n JOIN sums s USING (node) LEFT JOIN nodes p ON n.parent = p.node
"""


@query("op13_prefix_table", TRIE_SQL)
def op13_prefix_table(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_trie(table(spark, folder, "conversations"))


@query("op12_suffix_tree")
def op12_suffix_tree(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(held_out("doc_id", 7, 2), F.lit(False)))
    scored = score_texts(docs.withColumn("learned", ~F.col("held_out")), "learned")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
