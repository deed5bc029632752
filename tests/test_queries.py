"""Every registered query against its SQL in DuckDB, and shape checks for the rest."""

import importlib
import inspect
import os

import pytest
from compare import connect, difference, spark_result, sql_result

import __spark_entry__ as entry_file
from verseflux.queries import ORACLES, QUERIES

FOLDER = os.environ.get("VERSEFLUX_TEST_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark_result(QUERIES[name](spark, FOLDER)), sql_result(con, ORACLES[name])) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert entry_file.queries().keys() >= QUERIES.keys()
    assert entry_file.oracle_sql().items() >= ORACLES.items()


def test_topics(spark, con):
    labels = {r.topics for r in QUERIES["top_topics"](spark, FOLDER).collect()}
    assert len(labels) <= 10 and all(len(x.split(", ")) == 7 for x in labels)
    assigned = QUERIES["document_topics"](spark, FOLDER).collect()
    assert all((r.topic is None) == (r.topics == "N/A") for r in assigned)
    assert all(r.topic is None or 0 <= r.topic < 10 for r in assigned)


def test_document_analysis(spark, con):
    rows = QUERIES["document_analysis"](spark, FOLDER).collect()
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert {"text", "tokens", "label"}.isdisjoint(rows[0].asDict())
    for r in rows:
        if r.sentiment == "NEUTRAL":
            assert 0.4 < r.sentiment_score <= 0.5


@pytest.mark.parametrize("name,where,work", [
    ("document_topics", "verseflux.queries.models", {"k": 10, "passes": 20, "steps": 5}),
    ("document_analysis", "verseflux.plans.texts", {"k": 30, "passes": 50, "steps": 5}),
])
def test_topics_are_fitted_as_a_whole(spark, monkeypatch, name, where, work):
    # The numbers of the script that is followed, as it stands and as it is run.
    module = importlib.import_module(where)
    whole, asked = module.fit_topics, []

    def recorded(*args, **options):
        bound = inspect.signature(whole).bind(*args, **options)
        bound.apply_defaults()
        asked.append(bound.arguments)
        return whole(*args, **{**options, "no_below": 10**6})  # nothing to fit on

    monkeypatch.setattr(module, "fit_topics", recorded)
    try:
        QUERIES[name](spark, FOLDER).collect()
    except AttributeError:
        pass  # document_topics needs a model
    assert [{n: a[n] for n in work} for a in asked] == [work]
    assert (asked[0]["no_below"], asked[0]["no_above"], asked[0]["keep_n"]) == (5, 0.5, None)


def test_trained_scorer(spark, con):
    rows = QUERIES["sentiment_trained"](spark, FOLDER).collect()
    assert len(rows) == con.execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(0.4 <= r.sentiment_score <= 1.0 for r in rows if r.sentiment != "UNKNOWN")


def test_bootstrap_shape(spark):
    rows = QUERIES["bootstrap_band"](spark, FOLDER).collect()
    assert len({(r.feature, r.point) for r in rows}) == len(rows) == 500
    assert all(r.low <= r.high for r in rows)


def test_failed_texts_are_scored(spark, monkeypatch):
    # With a model that answers, the texts that fail otherwise get its label.
    from verseflux.queries import sentiment

    monkeypatch.setattr(sentiment, "_no_model", lambda: lambda texts: [("NEGATIVE", 0.8)] * len(texts))
    rows = QUERIES["sentiment_label"](spark, FOLDER).where("kind = 'failed'").collect()
    assert rows and {(r.sentiment, r.sentiment_score) for r in rows} == {("NEGATIVE", 0.8)}
