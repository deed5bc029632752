"""Operators against brute force on the hand-made rows, and their defined edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.tables import LONG, ROWS, clashing, documents, empty
from verseflux.llm import ann, bpe, language, linededup, lyndon, mixing, nearcopies, quality, records, substrings, toxicity
from verseflux.llm.linededup import dedup_lines
from verseflux.llm.queries import tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


# ---- line dedup -------------------------------------------------------------------------


def lines_by_hand(rows):
    key = lambda x: lower(x.strip(" \t\n\v\f\r"))
    last = 10**9
    held = {}
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                held.setdefault(key(x), set()).add(last if i is None else i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        own = last if i is None else i
        kept = [x for x in lines if not (len(held.get(key(x), ())) > 1 and min(held[key(x)]) != own)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [28, 13, 3])
def test_line_dedup(spark, bits):
    # 8 bits are so few that every key is suspected: the result is the same.
    done = dedup_lines(documents(spark), bits=bits).select("doc_id", "n_lines", "n_dropped", "kept_text")
    assert sorted(map(tuple, done.collect()), key=str) == lines_by_hand(ROWS)


def test_line_filters_are_merged_over_tasks(spark):
    lines = [f"a line of number {k}" for k in range(3000)]
    rows = [(k, "\n".join(lines[30 * k : 30 * k + 30] + [lines[(37 * k + 950) % 3000]])) for k in range(100)]
    held = Counter(x for _, t in rows for x in set(t.split("\n")))
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "id long, text string").repartition(parts)
        filter_, bits = linededup.seen_again(docs, 28, 10)
        assert bits == 16  # 3100 lines of 16 bits
        keys = sorted(held)
        found = linededup._held(filter_, linededup._places(linededup._hashes([k.encode() for k in keys]), bits))
        again = np.array([held[k] > 1 for k in keys])
        assert again.sum() >= 90 and found[again].all() and found[~again].mean() < 0.02


def test_line_dedup_edges(spark):
    assert dedup_lines(empty(spark)).count() == 0
    df = clashing(spark, "n_lines", "kept_text")
    done = dedup_lines(df)
    assert sorted(done.columns) == sorted([*df.columns, "n_dropped"])
    assert done.where("id = 'x' AND n_lines >= 1").count() == len(ROWS)


# ---- tokens -----------------------------------------------------------------------------


def test_bpe_equals_the_library(spark, library):
    done = bpe.encode_decode(clashing(spark, "ids", "decoded"), tokenizer_path())
    for r in done.select("text", "ids", "decoded").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == library.decode(ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty(spark), tokenizer_path()).count() == 0


def test_piece_cache_keeps_what_is_frequent(library, monkeypatch):
    from verseflux.llm import chunks

    monkeypatch.setattr(chunks, "CACHE_PIECES", 40)
    coder = records.LibraryCoder(tokenizer_path())
    rng = np.random.default_rng(2)
    for _ in range(30):
        rows = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 30) % 5000) + "  end" for _ in range(4)] + [""]
        ids, edges = coder.encode(rows)
        assert [ids[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == [
            library.encode(r, add_special_tokens=False).ids for r in rows
        ]
    coder.clear()
    assert coder.encode(["w1 w2"])[0].tolist() == library.encode("w1 w2", add_special_tokens=False).ids


def test_automaton_on_random_text(library):
    with open(tokenizer_path(), encoding="utf-8") as f:
        codec = bpe.Codec(f.read())
    rng = np.random.default_rng(3)
    alphabet = list("abetn  \n.,'<|é1 ") + ["<|endoftext|>", "日", "  ", "ing", "THE"]
    for _ in range(300):
        text = "".join(rng.choice(alphabet, rng.integers(0, 50)))
        ids, _ = codec.coder.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_records(spark, library):
    folder = records.new_folder(spark)
    records.write_records(documents(spark), folder, tokenizer_path(), file_bytes=20_000)
    rows = records.read_records(spark, folder).select(records.public_id("id").alias("i"), "start", "n_tokens", "ids_crc32")
    want, start = [], 0
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(want, key=str)
    shuffled = records.read_shuffled(spark, folder, 5).collect()
    assert Counter((len(r.ids) // 4, zlib.crc32(r.ids)) for r in shuffled) == Counter((w[2], w[3]) for w in want)
    assert [r.id for r in shuffled] != sorted(r.id for r in shuffled)
    records.remove_folder(spark, folder)


def test_records_of_nothing_and_damage(spark):
    folder = records.new_folder(spark)
    records.write_records(documents(spark, [(1, "a b", "en", "a")]), folder, tokenizer_path())
    assert records.read_records(spark, folder).count() == 1
    record = records.frame(b"payload")
    assert records.read_record(memoryview(record), 0) == (b"payload", len(record))
    for at in (0, 9, 13, len(record) - 2):
        broken = bytearray(record)
        broken[at] ^= 1
        with pytest.raises((ValueError, Exception)):
            records.read_record(memoryview(bytes(broken)), 0)


# ---- near copies ------------------------------------------------------------------------


def sets_by_hand(rows, width):
    out = []
    for i, t, *_ in rows:
        w = WORD.findall(lower(t or ""))
        s = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
        out.append((i, s))
    return out


def copies_by_hand(rows, width=4, percent=80):
    sets = sets_by_hand(rows, width)
    head = list(range(len(sets)))

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                head[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), 10**9), 10**9 if i is None else i)
    out = []
    for k, (i, s) in enumerate(sets):
        name = least[find(k)]
        own = 10**9 if i is None else i
        out.append((i, len(s), None if name == 10**9 else name, name == own))
    return sorted(out, key=str)


@pytest.mark.parametrize("tile", [100_000, 300])
def test_near_copies(spark, tile):
    # A tile of 300 shingles cuts the group of near copies into blocks that meet in pairs.
    done = nearcopies.near_copies(documents(spark), width=4, tile=tile)
    assert sorted(map(tuple, done.collect()), key=str) == copies_by_hand(ROWS)


def test_hub_of_near_copies(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(0, " ".join(base), "en", "a")]
    for k in range(1, 60):
        own = list(base)
        for j in range(k % 4 + 2):
            own[(7 * k + 29 * j) % 120] = f"x{k}_{j}"
        rows.append((k, " ".join(own), "en", "a"))
    want = copies_by_hand(rows)
    for region, tile in ((256, 100_000), (4, 100_000), (256, 900)):
        done = nearcopies.near_copies(documents(spark, rows), width=4, region=region, tile=tile)
        assert sorted(map(tuple, done.collect()), key=str) == want


def test_near_copies_of_a_large_tight_group(spark):
    # 300 texts of one changed word are the hot region; the last is at 0.8 from text 0 only and
    # shares the minima of single trees with it, but never those of two neighbouring trees.
    base = [f"w{k}" for k in range(400)]
    rows = [(0, " ".join(base), "en", "a")]
    rows += [(k, " ".join(base[:-1] + [f"x{k}"]), "en", "a") for k in range(1, 300)]
    rows.append((1000, " ".join(base[:177] + [f"y177_{j}" for j in range(41)] + base[218:]), "en", "a"))
    done = nearcopies.near_copies(documents(spark, rows), width=4)
    assert sorted(map(tuple, done.collect()), key=str) == copies_by_hand(rows)


def test_neighbours_by_prefix():
    head = np.array([5, 5, 5, 6, 9 << 16, (9 << 16) + 1, 1 << 32, (1 << 32) + 5, (1 << 32) + 9, 3 << 32], np.int64)
    tree = np.array([0] * 9 + [0])
    # 0-3 share three minima but the region may reach further; 4, 5 are a small region.
    assert nearcopies.neighbours(tree, head, 2).tolist() == [1, 2, 5]
    assert nearcopies.neighbours(tree, head, 3).tolist() == [1, 2, 5, 7, 8]
    assert nearcopies.neighbours(np.arange(10), head * 0, 3).tolist() == []
    assert nearcopies.neighbours(tree[:1], head[:1], 3).tolist() == []


def test_order_by_ranges_hands_on_the_edges(spark):
    rows = [(t, h, r, 100 * h + r) for t in (0, 1) for h in (1, 2, 3) for r in range(60)]
    df = spark.createDataFrame(rows, "tree byte, head long, rest long, node long").repartition(7)
    links = [tuple(r) for r in nearcopies.candidates(df, 1).collect()]
    assert sorted(links) == sorted((100 * h + r, 100 * h + r - 1) for h in (1, 2, 3) for r in range(1, 60))


def test_near_copies_edges(spark):
    assert nearcopies.near_copies(empty(spark)).count() == 0
    done = nearcopies.near_copies(clashing(spark, "n_shingles", "kept"), width=4)
    assert sorted(map(tuple, done.collect()), key=str) == copies_by_hand(ROWS)
    df = clashing(spark)
    kept = nearcopies.drop_near_copies(df, width=4)
    assert kept.columns == df.columns
    stay = {r[0] for r in copies_by_hand(ROWS) if r[3]}
    assert {r.doc_id for r in kept.collect()} == stay and kept.count() == len(stay)


def test_near_copies_of_null_and_repeated_ids(spark):
    def text(seed, *changed):
        own = [f"t{seed}_{k}" for k in range(120)]
        for k in changed:
            own[k] = "changed"
        return " ".join(own)

    rows = [
        (5, text(1), "en", "a"),
        (None, text(1, 7), "en", "a"),  # near copy of 5
        (None, text(2), "en", "a"),  # like nothing else
        (None, text(3), "en", "a"),  # three near copies without an id, one of them twice
        (None, text(3), "en", "a"),
        (None, text(3, 60), "en", "a"),
        (8, text(4), "en", "a"),  # an id with two texts, one a near copy of 6
        (8, text(5), "en", "a"),
        (6, text(4, 50), "en", "a"),
        (9, text(6), "en", "a"),  # near copies of each other under one id
        (9, text(6, 30), "en", "a"),
        (None, None, "en", "a"),
        (None, None, "en", "b"),
        (None, "", "en", "a"),
        (None, "", "en", "a"),
    ]
    df = documents(spark, rows)
    done = [tuple(r) for r in nearcopies.near_copies(df, width=4).collect()]
    assert Counter((i, c, k) for i, _, c, k in done) == Counter(
        [(5, 5, True), (None, 5, False), (None, None, True), (None, None, True), (None, None, False), (None, None, False)]
        + [(8, 6, False), (8, 8, True), (6, 6, True), (9, 9, True), (9, 9, False)]
        + 4 * [(None, None, True)]
    )
    kept = Counter((r.doc_id, r.text) for r in nearcopies.drop_near_copies(df, width=4).collect())
    assert sum(kept.values()) == 10
    assert kept[None, None] == kept[None, ""] == 2
    assert {(5, text(1)), (None, text(2)), (8, text(5)), (6, text(4, 50))} <= kept.keys()
    assert kept[None, text(3)] + kept[None, text(3, 60)] == kept[9, text(6)] + kept[9, text(6, 30)] == 1


# ---- repeated substrings ----------------------------------------------------------------


def cut_by_hand(rows, length=200):
    data = [(t or "").encode() for _, t, *_ in rows]
    seen = Counter(d[p : p + length] for d in data for p in range(len(d) - length + 1))
    out = []
    for (i, *_), d in zip(rows, data, strict=True):
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        out.append((i, len(d), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digests(done):
    rows = done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256))
    return sorted(map(tuple, rows.collect()), key=str)


@pytest.mark.parametrize("hot", [1000, 1])
def test_repeated_substrings(spark, hot, monkeypatch):
    # With hot = 1 all differing segments take the way of very frequent passages.
    monkeypatch.setattr(substrings.repeated_spans, "__defaults__", (200, 40, hot))
    assert digests(substrings.cut_repeats(documents(spark))) == cut_by_hand(ROWS)


def test_repeated_substrings_edges(spark):
    assert substrings.cut_repeats(empty(spark)).count() == 0
    done = substrings.cut_repeats(clashing(spark, "n_bytes", "doc", "begin"))
    assert digests(done) == cut_by_hand(ROWS)


def test_suffix_array():
    rng = np.random.default_rng(2)
    for n in range(60):
        for k in (1, 2, 4):
            text = "".join(map(chr, 97 + rng.integers(0, k, n)))
            assert lyndon.suffix_array(text) == sorted(range(n), key=lambda i: text[i:])


# ---- nearest neighbours -----------------------------------------------------------------


def product(a, b):
    """Part by part; sum() would compensate for rounding."""
    total = 0.0
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        total += x * y
    return total


def test_nearest(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[50:120] = v[50]
    rows = [(i, [float(x) for x in v[i]], 0) for i in range(300)]
    rows[40] = (40, None, 0)
    rows[60] = (60, [0.0] * 8, 0)
    rows[7] = (7, [1.0, None] + [0.0] * 6, 0)
    rows[8] = (8, [float("nan")] + [0.0] * 7, 0)
    rows[9] = (9, [float("inf")] + [0.0] * 7, 0)
    rows += [rows[100], (None, rows[1][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit("x"))
    got = ann.nearest(df, block=64, stripe=2).collect()
    good = {i: np.array(x, np.float64) for i, x, _ in rows if i is not None and i not in (7, 8, 9, 40, 60)}
    want = []
    for q in sorted(good):
        if q % 20 == 0:
            near = sorted((-product(good[q], good[x]), x) for x in good if x != q)
            want += [(q, k + 1, x, -s) for k, (s, x) in enumerate(near[:20])]
    assert sorted(map(tuple, got)) == sorted(want)
    assert ann.nearest(df.limit(0)).count() == 0
    few = ann.nearest(spark.createDataFrame(rows[:3], df.schema[:3]))
    assert [(r.query_id, r.vec_id) for r in few.orderBy("rank").collect()] and few.count() == 2


@pytest.mark.parametrize("dim", [64, 1536, 4096])
def test_nearest_in_many_dimensions(spark, dim):
    # Whole numbers whose codes are exact: no rounding error covers up a wrong product.
    rng = np.random.default_rng(dim)
    v = rng.integers(-127, 128, (300, dim)) + 0.0
    v[:, 0] = 127
    v[100:200] = v[100] * np.where(rng.random((100, dim)) < 0.01, 0, 1)
    v[100:200, 0] = 127
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    scores = v @ v.T
    want = []
    for q in range(0, 300, 20):
        near = sorted((-scores[q, x], x) for x in range(300) if x != q)[:20]
        want += [(q, k + 1, x, -s) for k, (s, x) in enumerate(near)]
    assert sorted(map(tuple, ann.nearest(df, block=64, stripe=2).collect())) == want


# ---- mixing -----------------------------------------------------------------------------


def test_mixing(spark):
    rows = mixing.mix_sizes(clashing(spark, "taken", "target")).collect()
    sizes = {i: len(WORD.findall(t or "")) for i, t, *_ in ROWS}
    assert all(r.size == sizes[r.doc_id] and 0 <= r.taken <= 3 * r.size for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix_sizes(documents(spark)).collect()), key=str)
    # Sources in order: a, b, c, é, null; c holds nearly all words, the others stop at 3 times.
    total = sum(len(WORD.findall(t or "")) for _, t, *_ in ROWS)
    source = {i: s for i, _, _, s in ROWS}
    by = {}
    for r in rows:
        own = by.setdefault(source[r.doc_id], [0, 0, r.target, r.source_size])
        own[0] += r.size
        own[1] += r.taken
    assert all(abs(taken - target) <= 1 and size == n for size, taken, target, n in by.values())
    assert sum(t for _, _, t, _ in by.values()) == pytest.approx(total)
    assert all(by[s][2] == 3 * by[s][0] for s in ("a", "b", "é", None))
    assert mixing.mix_sizes(empty(spark)).count() == 0
    assert [r.taken for r in mixing.mix_sizes(documents(spark, [(1, None, "en", "a"), (2, " ", "en", None)])).collect()] == [0, 0]


def test_mixed_texts(spark):
    df = clashing(spark)
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    taken = Counter()
    for r in out.collect():
        taken[r.doc_id] += len(WORD.findall(r.text))
        assert r.n_chars == len(r.text)
        whole = WORD.findall(next(t for i, t, *_ in ROWS if i == r.doc_id))
        own = WORD.findall(r.text)
        assert len(own) <= len(whole) and set(own) <= set(whole)
    assert taken == Counter({r[0]: n for r in mixing.mix_sizes(documents(spark)).groupBy("doc_id").sum("taken").collect() if (n := r[1])})
    assert mixing.mix_documents(empty(spark)).count() == 0


def test_slots_are_dealt_once(spark):
    docs = spark.range(400).selectExpr("id", "cast(id % 3 as string) AS source", "(id * 37) % 900 + 1 AS size")
    plan = mixing.source_plan(docs, 8)
    slots = mixing.shard_slots(plan, 16, 3)
    got = slots.groupBy("no").agg(F.count("*"), F.countDistinct("number"), F.min("number"), F.max("number")).collect()
    want = {r.no: r.slots for r in plan.collect()}
    assert {r[0]: (r[1], r[2], r[3], r[4]) for r in got} == {k: (n, n, 0, n - 1) for k, n in want.items()}


# ---- quality ----------------------------------------------------------------------------


def base_by_hand(text):
    w = WORD.findall(text or "")
    wins = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    n = Counter(wins)
    covered = {k + d for k, x in enumerate(wins) if n[x] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered),
    )


def test_quality_signals(spark):
    rows = [*ROWS, (20, "a b c a b c a b c", "en", "a"), (21, "x y x y x y\nq\nq\n q\n##", "en", "a"), (22, "w " * 5000, "en", "a")]
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (7, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    done = quality.quality_filter(documents(spark, rows).withColumn("kept", F.lit("x")), labels)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = sorted(((r.doc_id, *[r[n] for n in names], r.base_failed, r.kept) for r in done.collect()), key=str)
    want = []
    for i, t, *_ in rows:
        base = base_by_hand(t)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        want.append((i, *base, failed, not failed))
    assert got == sorted(want, key=str)
    assert quality.quality_filter(empty(spark), labels).count() == 0


def cutoffs_by_hand(good, everyone, risk, error):
    """``good`` and ``everyone``: (stratum, ratios) rows; the last step before the first failure."""
    import math

    def log_tail(k, n):
        terms = [math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(risk) + (n - j) * math.log1p(-risk) for j in range(k + 1)]
        return max(terms) + math.log(sum(math.exp(t - max(terms)) for t in terms))

    out = {}
    rest = Counter(everyone)
    rest.subtract(Counter(good))
    rest = list(rest.elements())
    strata = {g[0] for g in good}
    for s in strata:
        own, others = [g[1:] for g in good if g[0] == s], [r[1:] for r in rest if r[0] == s]
        for step in range(quality.STEPS if others else 0):
            cuts = [
                min((g for g in quality.GRID if quality.STEP * sum(o[j] > g for o in others) <= step * len(others)), default=None)
                for j in range(len(quality.RULES))
            ]
            k = sum(any(c is not None and v > c for v, c in zip(x, cuts, strict=True)) for x in own)
            if k >= risk * len(own) or log_tail(k, len(own)) > math.log(error / len(strata)):
                break
            out[s] = tuple(cuts)
    return out


def test_cutoffs_are_the_last_step_that_holds(spark):
    rng = np.random.default_rng(4)

    def made(stratum, n, spread):
        return [(stratum, *(float(rng.beta(1, b)) for b in spread)) for _ in range(n)]

    bad = [("en", 0.5, 0.0, 0.0, 0.0, 0.9)] * 20 + [("de", 0.0, 0.9, 0.0, 0.6, 0.0)] * 20
    good = made("en", 900, (8, 90, 60, 40, 30)) + made("de", 400, (40, 30, 30, 30, 200)) + made(None, 20, (9, 9, 9, 9, 9)) + made("fr", 300, (9,) * 5)
    everyone = good + bad + made("en", 1500, (8, 60, 60, 40, 30)) + made("de", 500, (40, 30, 30, 30, 200)) + made(None, 50, (9,) * 5)
    names = ["stratum", *quality.RULES]
    frames = [spark.createDataFrame(rows, names).repartition(5) for rows in (good, everyone)]
    cuts = {r.stratum: tuple(r)[1:] for r in quality.choose_cutoffs(*frames, 0.05, 0.05).collect()}
    assert cuts == cutoffs_by_hand(good, everyone, 0.05, 0.05)
    assert set(cuts) == {"en", "de"}  # 20 labels allow no rejection; "fr" has only documents that are held out
    for s in cuts:
        rejecting = [sum(x[j + 1] > c for x in everyone if x[0] == s) for j, c in enumerate(cuts[s]) if c is not None]
        assert sum(n > 0 for n in rejecting) >= 2
        mine = [x[1:] for x in good if x[0] == s]
        assert sum(any(c is not None and v > c for v, c in zip(x, cuts[s], strict=True)) for x in mine) < 0.05 * len(mine)


def test_rules_reject_nothing_without_labels(spark):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    done = quality.quality_filter(documents(spark, ROWS), nothing)
    assert done.where("kept = base_failed").count() == 0 and done.count() == len(ROWS)


# ---- language and toxicity --------------------------------------------------------------


def grams_by_hand(text):
    blank = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in " " + text.lower() + " "))
    out = Counter()
    for k in range(len(blank)):
        for n in (1, 2, 3):
            g = blank[k : k + n]
            if len(g) == n and any(map(str.isalpha, g)) and not (n == 3 and g[1] == " "):
                out[g] += 1
    return out


def test_grams_are_counted_whole():
    texts = ["Hello, big World", "", "été 12 x", "a", LONG, "--x--"]
    codes, owners = language.grams(texts)
    for k, t in enumerate(texts):
        want = grams_by_hand(t)
        got = Counter(codes[owners == k].tolist())
        assert sorted(got.values()) == sorted(want.values())


def test_language(spark):
    rows = []
    for k in range(40):
        rows += [(2 * k, f"the {k} quick brown foxes jump over the lazy dog and the hat", "en", "a")]
        rows += [(2 * k + 1, f"der {k} schnelle braune fuchs springt über den faulen hund und ich", "de", "a")]
    profiles = language.learn_profiles(documents(spark, [*rows, (99, None, "en", "a"), (98, "zz", None, "a")]), "text", "lang")
    assert list(profiles) == ["de", "en"]
    asked = [(1, "the dog", None, None), (2, "der hund", None, None), (3, None, None, None), (4, "12 !", None, None), (5, "", None, None), (6, "the lazy dog " * 20_000, None, None)]
    done = language.identify(documents(spark, asked).withColumn("score", F.lit("x")), profiles)
    assert {r.doc_id: r.lang_pred for r in done.collect()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "und", 6: "en"}
    assert all(0 <= r.score <= 1 and (r.score > 0 or r.lang_pred == "und") for r in done.collect())
    assert language.identify(documents(spark, asked), {}).where("lang_pred <> 'und'").count() == 0
    assert language.identify(empty(spark), profiles).count() == 0 and language.learn_profiles(empty(spark), "text", "lang") == {}


def test_toxicity_learns_a_word(spark):
    rng = np.random.default_rng(0)
    stock = [f"word{k}" for k in range(300)]
    sample = []
    for k in range(400):
        own = list(rng.choice(stock, rng.integers(5, 120)))
        toxic = k % 3 == 0
        if toxic:
            own[rng.integers(len(own))] = rng.choice(["BADword", "vile"])
        sample.append({"text": " ".join(own), "toxic": int(toxic), "lang": "en" if k % 2 else None})
    hashed = toxicity._hashed(toxicity.Hasher(), [s["text"] for s in sample])
    net = toxicity.train([s | {"words": d} for s, d in zip(sample, hashed, strict=True)])
    rows = [(k, s["text"], s["lang"], "a") for k, s in enumerate(sample)] + [(900, None, None, "a"), (901, "", "en", "a"), (902, LONG + " vile", "xx", "a"), (903, LONG, "xx", "a")]
    done = {r.doc_id: r for r in toxicity.score_toxicity(documents(spark, rows).withColumn("score", F.lit("x")), net).collect()}
    right = sum((done[k].score >= 0.5) == bool(s["toxic"]) for k, s in enumerate(sample))
    assert right >= 390
    assert done[900].score == done[901].score < 0.5 and done[902].score >= 0.5 > done[903].score
    assert done[902].cutoff == 0.5 and done[0].cutoff == net.cutoffs.get("", 0.5)
    assert toxicity.score_toxicity(empty(spark), net).count() == 0
    nothing = toxicity.learn(empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert nothing.cutoffs == {}
