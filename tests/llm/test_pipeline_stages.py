"""Every stage of the pipeline on nulls, repeated rows, long texts, clashing and missing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.tables import ROWS, documents, empty

NAMES = ["row", "doc", "__doc", "__key", "__hash", "__alone", "n_lines", "kept_text", "n_dropped", "score", "rejected", "ids", "size", "part", "no", "a.b"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in ROWS if i is not None], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    plain = [r.asDict() for r in stage(spark, documents(spark), folder).collect()]
    assert plain and (k == 4 or set(plain[0]) == {"doc_id", "text", "lang", "source", "n_chars"})
    # Columns of any name stay as they are.
    rows = documents(spark)
    for i, n in enumerate(NAMES):
        rows = rows.withColumn(n, F.lit(-i))
    full = [r.asDict() for r in stage(spark, rows, folder).collect()]
    drop = {"ids"} if k == 4 else set()
    assert all(r[n] == -i for r in full for i, n in enumerate(NAMES) if n not in drop)
    key = lambda r: sorted((c, str(v)) for c, v in r.items() if c not in NAMES)
    assert sorted(map(key, full)) == sorted(map(key, plain))
    # Without a count of characters.
    short = [r.asDict() for r in stage(spark, documents(spark).drop("n_chars"), folder).collect()]
    assert sorted(str(sorted(r.items(), key=str)) for r in short) == sorted(
        str(sorted(((c, v) for c, v in r.items() if c != "n_chars"), key=str)) for r in plain
    )
    assert stage(spark, empty(spark), folder).count() == 0


def test_lines_and_copies_of_null_and_long_texts(spark, folder):
    lines = {r.doc_id: r for r in corpus_pipeline.drop_repeated_lines(spark, documents(spark), folder).collect()}
    assert lines[2].text is None and lines[3].text == "" and lines[7].text == ROWS[7][1]
    assert all(r.text is None or r.n_chars == len(r.text) for r in lines.values())
    kept = corpus_pipeline.drop_copies(spark, documents(spark), folder).collect()
    assert {r.doc_id for r in kept} >= {2, 3, 4, 7, 8} and 11 not in {r.doc_id for r in kept}
    assert sum(r.doc_id == 15 for r in kept) == 1
