import math
import random
from collections import Counter
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verseflux.functions import text as tx
from verseflux.functions.fixed import BASE_STOPWORDS, EXTRA_STOPWORDS
from verseflux.operators.parse import parse_collection, parse_rejects
from verseflux.operators.scoring import (
    Lexicon,
    UserModel,
    build_lexicon,
    label_sentiment,
    score_text,
)
from verseflux.operators.textprep import (
    bag_of_words,
    clean_tokens,
    count_tokens,
    drop_stopwords,
    lemma_table,
    number_rows,
    lemmatize_arrays,
    stopword_table,
    stopwords,
    vocabulary,
)
from verseflux.functions.stats import digamma, trigamma
from verseflux.operators import topics as topics_module
from verseflux.operators.topics import _prior_step, _start, assign_topics, count_blocks, fit_topics
from verseflux.plans.texts import add_topics, analyze_documents, load_songs
from verseflux.schemas import SONGS, has_column, require_columns
from verseflux.sources.collections import read_collections
from verseflux.sources.tables import read_csv, write_csv, write_table
from verseflux.streaming.ingest import ingest_new_files

LINE = "=" * 50
PLAIN = "\n--- 'First' by A. Singer ---\nla la\nla\n"
BOOK = (
    f"LYRICS COLLECTION\nall of it\n{LINE}{PLAIN}{LINE}\n   \n{LINE}"
    f"\nA preamble\n--- 'It's a --- Day' by B & C ---\n\n  words here  \n"
    f"{LINE}\nno title line in this record, which is quite long, longer than fifty characters\n{LINE}"
    f"LYRICS COLLECTION\n--- 'Lost' by D ---\ndropped with its header"
)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in" / "nested").mkdir(parents=True)
    (tmp_path / "in" / "lyrics_2022.txt").write_text(BOOK, encoding="utf-8", newline="")
    (tmp_path / "in" / "songs.txt").write_text(f"{PLAIN}={LINE}{PLAIN}".replace("\n", "\r\n"), newline="")
    (tmp_path / "in" / "v120245.txt").write_text(PLAIN)
    (tmp_path / "in" / "other.TXT").write_text(PLAIN)
    (tmp_path / "in" / "nested" / "lyrics_1999.txt").write_text(PLAIN)
    return tmp_path


def test_parse_files(spark, folder):
    songs = load_songs(spark, str(folder / "in")).orderBy("title", "year", "lyrics").collect()
    assert [(r.title, r.artist, r.year, r.source, r.lyrics) for r in songs] == [
        ("First", "A. Singer", None, "human", "la la\nla"),
        ("First", "A. Singer", None, "human", "la la\nla"),
        ("First", "A. Singer", 1202, "human", "la la\nla"),
        ("First", "A. Singer", 2022, "human", "la la\nla"),
        ("It's a --- Day", "B & C", 2022, "human", "words here"),
    ]
    assert load_songs(spark, str(folder / "in")).schema.simpleString() == SONGS.simpleString()


def test_parse_compat_keeps_title_text(spark, folder):
    songs = parse_collection(read_collections(spark, str(folder / "in")), compat=True, source="AI")
    got = {(r.title, r.year): (r.lyrics, r.source) for r in songs.collect()}
    assert got["First", 2022] == ("la la\nla", "AI")
    # With a preamble, the first dashes found are those that open the title line.
    assert got["It's a --- Day", 2022][0] == "'It's a --- Day' by B & C ---\n\n  words here"


def test_rejects(spark, folder):
    rows = parse_rejects(read_collections(spark, str(folder / "in"))).collect()
    assert [r.file_name for r in rows] == ["lyrics_2022.txt"]
    assert rows[0].preview == "no title line in this record, which is quite long, longer"[:50]


def test_large_file_is_split(spark, tmp_path):
    (tmp_path / "big_2001.txt").write_text(
        LINE.join(f"\n--- 'T{i}' by A ---\n" + "x" * 500 for i in range(400))
    )
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        records = read_collections(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() > 5
        assert parse_collection(records).select("title").distinct().count() == 400
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_stream_equals_batch_and_takes_new_files_only(spark, folder):
    source, out, state = (str(folder / n) for n in ("in", "out", "state"))
    scorer = Lexicon(("words",), ("la",), stop=())
    for _ in range(2):
        assert ingest_new_files(spark, source, out, state, scorer=scorer, max_files=1).awaitTermination(120)
    batch = score_text(load_songs(spark, source), "lyrics", scorer)
    assert sorted(map(str, spark.read.parquet(out).collect())) == sorted(map(str, batch.collect()))
    (folder / "in" / "lyrics_2023.txt").write_text(PLAIN)
    ingest_new_files(spark, source, out, state, scorer=scorer).awaitTermination(120)
    assert spark.read.parquet(out).count() == batch.count() + 0 + 1


def test_strip_and_titles(spark):
    df = spark.createDataFrame([(" \t   A b \x1c\n",)], "t string")
    r = df.select(tx.strip("t").alias("s"), tx.canonical_title("t").alias("c"), tx.file_title("t").alias("f")).first()
    assert r.s == "A b"
    assert r.c == "_\t  _a_b_".strip() and r.c.startswith("_")
    assert r.f.endswith("_A_b_")
    blank = spark.createDataFrame([(None,), ("",), (" 　\n",), ("x",)], "t string")
    assert [x.b for x in blank.select(tx.is_blank("t").alias("b")).collect()] == [True, True, True, False]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("a/b/Some file.tar.wav", "né\U0001f600xyz")], "p string, t string")
    r = df.select(
        tx.base_name("p").alias("base"),
        tx.stem(tx.base_name("p")).alias("stem"),
        tx.truncate("t", 3).alias("cut"),
        tx.truncate("t", None).alias("whole"),
        tx.display_name(F.lit("sound_loudness")).alias("name"),
        tx.line_count(F.lit("a\nb\n")).alias("lines"),
    ).first()
    assert (r.base, r.stem) == ("Some file.tar.wav", "Some file.tar")
    assert (r.cut, r.whole, r.name, r.lines) == ("né\U0001f600", "né\U0001f600xyz", "Sound Loudness", 3)


def tokens_of(spark, text, **options):
    df = spark.createDataFrame([(text,)], "lyrics string")
    return clean_tokens(df, **options).first().tokens


def test_clean_tokens(spark):
    assert tokens_of(spark, "Don't STOP believin' café naïve x") == ["stop", "believin", "caf", "nave"]
    assert tokens_of(spark, "Gonna gimme lemme cannot", stop=[], min_len=1) == [
        "gon", "na", "gim", "me", "lem", "me", "can", "not"]
    assert tokens_of(spark, "gonnas", stop=[]) == ["gonnas"]
    assert tokens_of(spark, None) == [] and tokens_of(spark, "  ") == [] and tokens_of(spark, "the and of") == []


def test_stop_list(spark):
    assert len(BASE_STOPWORDS) == len(set(BASE_STOPWORDS)) == 179 and len(EXTRA_STOPWORDS) == 32
    assert "don't" in stopwords() and "couldnt" not in stopwords()
    assert "couldnt" in stopwords(clean_base_list=True)
    more = spark.createDataFrame([("love",), ("the",)], "word string")
    table = stopword_table(spark, more=more)
    assert table.count() == len(set(stopwords())) + 1
    rows = spark.createDataFrame([(1, "love"), (1, "song"), (2, "the")], "doc_id long, token string")
    assert [r.token for r in drop_stopwords(rows, table).collect()] == ["song"]


def test_lemmas_come_after_the_stop_list(spark):
    df = spark.createDataFrame([(1, "asses glasses men women ponies pony glass ass dogs dog bus woman")], "doc_id long, lyrics string")
    docs = clean_tokens(df)
    terms = count_tokens(docs).select(F.col("token").alias("term")).distinct()
    lemmas = {r.token: r.lemma for r in lemma_table(terms).collect()}
    assert lemmas == {"asses": "ass", "glasses": "glass", "women": "woman", "ponies": "pony", "dogs": "dog"}
    given = spark.createDataFrame([("asses", "as")], "token string, lemma string")
    out = lemmatize_arrays(docs, given).first().tokens
    assert out[0] == "as" and out[1:3] == ["glasses", "men"]  # order kept; short result stays


def docs_with_df(spark, counts, n):
    rows = [(i, [t for t, c in counts.items() if i < c] or ["rest"]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def test_vocabulary_bounds_are_inclusive(spark):
    docs = docs_with_df(spark, {"four": 4, "five": 5, "six": 6, "cinco": 5}, 10)
    docs = docs.union(spark.createDataFrame([(99, [])], "doc_id long, tokens array<string>"))
    got = [(r.term, r.term_id, r.df) for r in vocabulary(docs).orderBy("term_id").collect()]
    assert got == [("cinco", 0, 5), ("five", 1, 5)]
    assert [r.term for r in vocabulary(docs, no_below=1, no_above=1.0, keep_n=2).collect()] == ["six", "cinco"]


def test_bag_of_words_counts(spark):
    docs = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, ["zz"])], "doc_id long, tokens array<string>")
    vocab = vocabulary(docs, no_below=1, no_above=0.7)
    rows = {(r.doc_id, r.term): r.tf for r in bag_of_words(docs, vocab).collect()}
    assert rows == {(1, "a"): 2, (1, "b"): 1, (2, "b"): 1, (3, "zz"): 1}


def test_label_rules(spark):
    rows = [
        ("t", "POSITIVE", 0.95, "POSITIVE", 0.95),
        ("t", "NEGATIVE", 0.6, "NEGATIVE", 0.6),
        ("t", "POSITIVE", 0.59, "NEUTRAL", 0.41),
        ("t", "LABEL_7", 0.8, "NEGATIVE", 0.8),
        ("t", None, None, "ERROR", 0.0),
        (" \n", "POSITIVE", 0.9, "UNKNOWN", 0.0),
        (None, None, None, "UNKNOWN", 0.0),
    ]
    df = spark.createDataFrame(rows, "x string, label string, score double, want string, want_score double")
    for r in label_sentiment(df, "x").collect():
        assert r.sentiment == r.want and r.sentiment_score == pytest.approx(r.want_score)


def test_user_model(spark):
    def load():
        def classify(texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("cannot")
            return [("POSITIVE" if len(t) == 510 else "NEGATIVE", 0.9) for t in texts]

        return classify

    df = spark.createDataFrame([(1, "y" * 600), (2, "bad"), (3, ""), (4, None), (5, "short")], "id long, x string")
    got = {r.id: (r.sentiment, r.sentiment_score) for r in score_text(df.coalesce(1), "x", UserModel(load)).collect()}
    # 510 characters say POSITIVE, the other 90 say NEGATIVE.
    assert got.pop(1) == ("POSITIVE", pytest.approx((510 * 0.9 + 90 * 0.1) / 600))
    assert got == {2: ("ERROR", 0.0), 3: ("UNKNOWN", 0.0), 4: ("UNKNOWN", 0.0), 5: ("NEGATIVE", 0.9)}
    whole = UserModel(load, window=None)
    assert score_text(df.where("id = 1"), "x", whole).first().sentiment == "NEGATIVE"


def test_lexicon_is_learned(spark):
    rows = [(f"sunny happy word{i}", 1) for i in range(5)] + [(f"gloomy sad word{i}", 0) for i in range(5)]
    df = spark.createDataFrame(rows, "x string, y int")
    lexicon = build_lexicon(df, "x", "y", 0.5)
    assert lexicon.positive == ("happy", "sunny") and lexicon.negative == ("gloomy", "sad")
    scored = lexicon(spark.createDataFrame([("happy happy",), ("sad",), ("neither",)], "x string"), "x").collect()
    assert [r.label for r in scored] == ["POSITIVE", "NEGATIVE", "POSITIVE"] and scored[2].score == 0.5


def test_topics_of_nothing(spark):
    empty = spark.createDataFrame([(1, []), (2, [])], "doc_id long, tokens array<string>")
    assert fit_topics(empty, k=2, passes=1) is None
    assert {r.topics for r in add_topics(empty, None).collect()} == {"Preprocessing Skipped/Failed"}


def topic_docs(spark):
    words = {0: "river water boat fish", 1: "engine wheel road truck"}
    rows = [(i, f"T{i}", (words[i % 2] + " ") * 3 + ("" if i % 4 else "wide")) for i in range(40)]
    rows += [(100, "stop words only", "the and of"), (101, "unknown words", "zzzz qqqq"), (102, "null", None)]
    return spark.createDataFrame(rows, "doc_id long, title string, lyrics string")


def test_topics_repeat(spark):
    docs = clean_tokens(topic_docs(spark)).coalesce(1)
    models = [fit_topics(docs, k=2, passes=30) for _ in range(2)]
    runs = [{r.doc_id: (r.topic, r.topics) for r in assign_topics(docs, m, 4).collect()} for m in models]
    assert runs[0] == runs[1]
    assert runs[0][101] == (None, "N/A")
    assert models[0].terms.count() == 9 and len(models[0].words(4)) == 2
    labels = {topics for topic, topics in runs[0].values() if topic is not None}
    assert all(len(label.split(", ")) == 4 for label in labels)


@pytest.mark.parametrize("lemmas", [None, "corpus"])
def test_analysis_keeps_every_document(spark, lemmas):
    df = topic_docs(spark)
    scorer = Lexicon(("river",), ("engine",))
    rows = analyze_documents(df, scorer, id_col="doc_id", lemmas=lemmas, k=2, passes=5).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == 43 and "lyrics" not in rows[0].asDict()
    assert got[100].topics == got[102].topics == "Preprocessing Skipped/Failed"
    assert got[101].topics == "N/A" and got[102].sentiment == "UNKNOWN"
    assert got[0].sentiment == "POSITIVE" and got[1].sentiment == "NEGATIVE"
    with pytest.raises(ValueError):
        analyze_documents(df.drop("lyrics"), scorer)


def test_csv_round_trip(spark, tmp_path):
    rows = [("A \"quoted\" title, with comma", "X", 2024, "human", "line one\nline \"two\"\n"), ("NA", "n/a", None, "AI", "null")]
    df = spark.createDataFrame(rows, SONGS)
    write_csv(df, str(tmp_path / "csv"))
    back = {r.source: r for r in read_csv(spark, str(tmp_path / "csv"), SONGS, multi_line=True).collect()}
    assert tuple(back["human"]) == rows[0]
    assert back["AI"].title is None and back["AI"].artist is None and back["AI"].lyrics is None
    write_table(df, str(tmp_path / "table"), partition_by=["year"])
    assert spark.read.parquet(str(tmp_path / "table")).count() == 2
    with pytest.raises(ValueError):
        read_csv(spark, str(tmp_path / "csv"), T.StructType([T.StructField("absent", T.StringType())]))
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_csv(spark, str(tmp_path / "nowhere"), SONGS)


def test_column_checks(spark):
    df = spark.range(1)
    assert has_column(df, "id") and not has_column(df, "x")
    assert require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="x"):
        require_columns(df, ["id", "x"])


def test_bad_cells_are_listed(spark, tmp_path):
    (tmp_path / "t.csv").write_text("n,x\n1,a\nz,b\n,c\n")
    schema = T.StructType([T.StructField("n", T.IntegerType()), T.StructField("x", T.StringType())])
    rows = read_csv(spark, str(tmp_path), schema, bad_cells="bad").collect()
    assert sorted((r.x, r.n, tuple(r.bad)) for r in rows) == [("a", 1, ()), ("b", None, ("n",)), ("c", None, ())]


def test_numbers_follow_the_order(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 AS x", "cast(id % 3 AS string) AS y")
    rows = number_rows(df, [F.desc("x"), F.asc("y")], "k").collect()
    assert sorted((r.k, r.x) for r in rows) == [(k, 4999 - k) for k in range(5000)]


def test_topics_do_not_depend_on_partitions(spark):
    docs = clean_tokens(topic_docs(spark))
    seen = []
    for parts in (1, 4, 9):
        model = fit_topics(docs.repartition(parts), k=3, passes=6, id_col="doc_id")
        words = [[(w, round(x, 9)) for w, x in own] for own in model.words(9)]
        rows = assign_topics(docs.repartition(parts), model, 4, keep_distribution=True, id_col="doc_id").collect()
        shares = {r.doc_id: [round(x, 9) for x in r.distribution or []] for r in rows}
        seen.append((words, shares, [round(a, 9) for a in model.alpha]))
    assert seen[0] == seen[1] == seen[2]


def test_topics_against_plain_loops(spark):
    # The same passes by loops over documents, with the gamma function's own derivative.
    psi = lambda x: (math.lgamma(x * (1 + 1e-6)) - math.lgamma(x * (1 - 1e-6))) / (2e-6 * x)
    docs = clean_tokens(topic_docs(spark)).where("size(tokens) > 0").select("doc_id", "tokens")
    vocab = {r.term: r.term_id for r in vocabulary(docs).collect()}
    bags = [Counter(vocab[t] for t in r.tokens if t in vocab) for r in docs.collect()]
    bags = [b for b in bags if b]
    k, steps = 2, 3
    w = {r.term_id: [r.w0, r.w1] for r in _start(vocabulary(docs), k, 42).collect()}
    alpha = [1 / k] * k
    for _ in range(2):
        total = [sum(x[t] for x in w.values()) for t in range(k)]
        b = {i: [math.exp(psi(x[t]) - psi(total[t])) for t in range(k)] for i, x in w.items()}
        new, logs = {i: [1 / k] * k for i in w}, [0.0] * k
        for bag in bags:
            share = [1.0] * k
            for _ in range(steps):
                part = {i: [n * b[i][t] * share[t] / sum(x * y for x, y in zip(b[i], share)) for t in range(k)] for i, n in bag.items()}
                g = [alpha[t] + sum(x[t] for x in part.values()) for t in range(k)]
                share = [math.exp(psi(x)) for x in g]
            for i, x in part.items():
                new[i] = [p + q for p, q in zip(new[i], x)]
            logs = [x + (psi(y) - psi(sum(g))) / len(bags) for x, y in zip(logs, g)]
        w, alpha = new, list(_prior_step(np.array(alpha), np.array(logs)))
    model = fit_topics(docs, k=k, passes=2, id_col="doc_id", steps=steps)
    got = {r.term_id: [r.w0, r.w1] for r in model.terms.collect()}
    assert got.keys() == w.keys()
    for i, x in w.items():
        assert got[i] == pytest.approx(x, rel=1e-5)
    assert model.alpha == pytest.approx(alpha, rel=1e-5)


def counting_tokens(spark, docs):
    """Documents whose tokens come out of a function that counts its rows."""
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def tokens(ids: pd.Series) -> pd.Series:
        seen.add(len(ids))
        return ids.map(own)

    own = {r.doc_id: list(r.tokens) for r in docs.collect()}
    return spark.createDataFrame([(i,) for i in own], "doc_id long").withColumn("tokens", tokens("doc_id")), seen


def test_topics_read_documents_once(spark):
    docs, seen = counting_tokens(spark, clean_tokens(topic_docs(spark)).select("doc_id", "tokens"))
    fit_topics(docs, k=2, passes=3, id_col="doc_id")
    assert seen.value == 43


def test_blocks_of_documents(spark, monkeypatch):
    texts = {i: [f"w{(i * j) % 17}" for j in range(i)] for i in range(60)} | {60: ["w1", None, "w1"], 61: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, tokens array<string>").repartition(2)
    models, expected = [], {(i, t): n for i, ts in texts.items() for t, n in Counter(ts or []).items() if t}
    for tokens, cells in ((1 << 21, 1 << 15), (40, 7)):
        monkeypatch.setattr(topics_module, "BLOCK_TOKENS", tokens)
        monkeypatch.setattr(topics_module, "SLICE", cells)
        rows = count_blocks(docs, "doc_id").collect()
        ids = {r.block: r.ids for r in rows if r.ids is not None}
        found = [((ids[r.block][d], r.term), n) for r in rows if r.term is not None for d, n in zip(r.docs, r.tf, strict=True)]
        assert len(found) == len(expected) and dict(found) == expected
        assert len({(r.block, r.term) for r in rows}) == len(rows)
        assert sorted(i for x in ids.values() for i in x) == list(range(1, 61))
        assert len(ids) <= 2 if tokens > 40 else len(ids) > 30
        model = fit_topics(docs, k=3, passes=3, no_above=1.0, id_col="doc_id")
        shares = {r.doc_id: r.distribution for r in assign_topics(docs, model, 4, True, "doc_id").collect()}
        again = {r.doc_id: r.distribution for r in assign_topics(docs, model, 4, True, "doc_id", blocks=model.blocks).collect()}
        assert shares.keys() == again.keys() == texts.keys()
        assert all(shares[i] == pytest.approx(again[i], rel=1e-9) if shares[i] else again[i] is None for i in texts)
        models.append(({r.term: pytest.approx([r.w0, r.w1, r.w2], rel=1e-9) for r in model.terms.collect()}, shares))
    assert {t: x.expected for t, x in models[0][0].items()} == models[1][0]
    assert all(models[0][1][i] == pytest.approx(models[1][1][i], rel=1e-9) for i in texts if models[0][1][i])
    # A document cut off from its block's others has the same shares in slices of any size.
    rng = np.random.default_rng(5)
    tf = rng.integers(0, 4, (30, 25))
    doc, term = np.nonzero(tf)
    first = np.searchsorted(doc, np.arange(30))
    cells = topics_module._Cells(term, tf[doc, term].astype(float), first, np.bincount(doc), np.arange(30), np.arange(25), rng.random((3, 25)))
    few = topics_module._shares(cells, np.full(3, 0.3), 4)
    monkeypatch.setattr(topics_module, "SLICE", 1 << 15)
    for x, y in zip(few, topics_module._shares(cells, np.full(3, 0.3), 4), strict=True):
        assert x == pytest.approx(y, rel=1e-12)


def test_assigning_does_not_count_again(spark):
    docs, seen = counting_tokens(spark, clean_tokens(topic_docs(spark)).select("doc_id", "tokens"))
    model = fit_topics(docs, k=2, passes=2, id_col="doc_id")
    before = seen.value
    rows = assign_topics(docs, model, 4, id_col="doc_id", blocks=model.blocks).collect()
    assert len(rows) == 43 and seen.value == before + 43


def test_lemmas_read_documents_twice(spark):
    # Once for the distinct tokens, once for the arrays; the filter does not read them again.
    docs, seen = counting_tokens(spark, clean_tokens(topic_docs(spark)).select("doc_id", "tokens"))
    lemmas = spark.createDataFrame([("boat", "ship")], "token string, lemma string")
    assert len(lemmatize_arrays(docs, lemmas).collect()) == 41 and seen.value == 86


def test_analysis_counts_documents_once(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(topics_module, "count_blocks", lambda *a: calls.append(a) or count_blocks(*a))
    scorer = Lexicon(("river",), ("engine",))
    for id_col, lemmas in ((None, None), ("doc_id", "corpus")):
        rows = analyze_documents(topic_docs(spark), scorer, id_col=id_col, lemmas=lemmas, k=2, passes=2).collect()
        assert len(rows) == 43 and len(calls) == 1
        calls.clear()


def test_gamma_derivatives():
    x = np.array([1e-3, 0.1, 0.5, 1.0, 2.5, 30.0, 1e6])
    assert digamma(np.array([1.0]))[0] == pytest.approx(-0.5772156649015329, rel=1e-10)
    assert trigamma(np.array([1.0]))[0] == pytest.approx(math.pi**2 / 6, rel=1e-9)
    assert digamma(x + 1) - digamma(x) == pytest.approx(1 / x, rel=1e-8)
    assert trigamma(x) - trigamma(x + 1) == pytest.approx(1 / x**2, rel=1e-6)


def test_lemma_arrays_by_loops(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    given = {w: w[::-1] for w in words[::2]} | {"same": "same"}
    texts = {i: [rng.choice([*words, "same"]) for _ in range(rng.choice([0, 1, 40, 3000]))] for i in range(40)}
    rows = [*texts.items(), (None, ["w0", "w1"]), (90, []), (91, None)]
    docs = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    lemmas = spark.createDataFrame(list(given.items()), "token string, lemma string")
    got = {r.doc_id: r.tokens for r in lemmatize_arrays(docs, lemmas).collect()}
    expected = {i: [given.get(t, t) for t in ts] for i, ts in texts.items() if ts}
    assert got == expected | {None: ["w0", "w1"]}
    assert {r.doc_id: r.tokens for r in lemmatize_arrays(docs, lemmas.where("false")).collect()}[None] == ["w0", "w1"]
    assert lemmatize_arrays(docs.where("false"), lemmas).isEmpty()
