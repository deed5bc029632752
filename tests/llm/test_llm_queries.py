"""The registered queries of the operators on the small tables: SQL, brute force, accuracy."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from compare import connect, difference, spark_result, sql_result

import __spark_entry__ as entry_file
import corpus_pipeline
from tests.llm.test_operators import copies_by_hand, cut_by_hand, lower  # noqa: F401
from verseflux.llm.queries import ORACLES, QUERIES, tokenizer_path

FOLDER = os.environ.get("VERSEFLUX_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    return [tuple(r) for r in rows]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark_result(QUERIES[name](spark, FOLDER)), sql_result(con, ORACLES[name])) is None


def test_registered():
    assert entry_file.queries().keys() >= {*QUERIES, "pipeline"}
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}


def test_token_queries(spark, docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    coded, framed, start = set(), set(), 0
    for i, t, *_ in sorted(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        back = library.decode(ids, skip_special_tokens=False).encode()
        coded.add((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(back).hexdigest()))
        framed.add((i, start, len(ids) + 1, zlib.crc32(raw + bytes(4))))
        start += len(ids) + 1
    assert {tuple(r) for r in QUERIES["op3_bpe_automaton"](spark, FOLDER).collect()} == coded
    assert {tuple(r) for r in QUERIES["op6_token_records"](spark, FOLDER).collect()} == framed


def test_near_copies_query(spark, docs):
    got = sorted(map(tuple, QUERIES["op5_lsh_forest"](spark, FOLDER).collect()), key=str)
    assert got == copies_by_hand(docs)


def test_repeated_bytes_query(spark, docs):
    got = sorted(map(tuple, QUERIES["op9_repeated_bytes"](spark, FOLDER).collect()), key=str)
    assert got == cut_by_hand(docs)


def test_language_query(spark, docs):
    lang = {i: g for i, _, g, _ in docs}
    rows = QUERIES["op10_language_profiles"](spark, FOLDER).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in rows} == set(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_toxicity_query(spark):
    rows = QUERIES["op1_toxicity_cnn"](spark, FOLDER).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    assert len({r.doc_id for r in rows}) == len(rows) == 200
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    learned = [r for r in rows if not r.held_out and r.doc_id in toxic]
    assert sum(r.predicted == toxic[r.doc_id] for r in learned) >= 0.9 * len(learned)


def test_pipeline(spark, docs, tmp_path):
    from verseflux.llm.mixing import mix_sizes

    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, FOLDER).write.parquet(str(tmp_path / str(k)))
        before, frame = frame, spark.read.parquet(str(tmp_path / str(k)))
        kept.append([tuple(r) for r in frame.select("doc_id", *(["text", "lang", "source"] if k < 4 else [])).collect()])
        if k < 4:
            assert frame.columns == columns
    clean, lines, single, mixed, tokens = kept
    assert {r[0] for r in clean} <= {d[0] for d in docs} and len(clean) >= 0.8 * len(docs)
    from tests.llm.test_operators import lines_by_hand

    assert sorted((r[0], r[1]) for r in lines) == sorted((i, t) for i, _, _, t in lines_by_hand(clean))
    assert {r[0] for r in single} == {r[0] for r in copies_by_hand(lines, width=5) if r[3]}
    taken = {r.doc_id: r.taken for r in mix_sizes(spark.read.parquet(str(tmp_path / "2"))).collect()}
    assert {r[0] for r in mixed} == {i for i, n in taken.items() if n}
    assert len(tokens) == len(mixed)
    assert before.count() == len(mixed)
