"""Hard negatives, suffix tree and conversation trie against brute force, and their edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from tests.llm.tables import ROWS, clashing, documents, empty
from verseflux.llm import bond, prefixtrie, suffixtree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


# ---- hard negatives ---------------------------------------------------------------------


def negatives_by_hand(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256):
    fine = {
        (i, g, tuple(v)) for i, g, v in rows
        if i is not None and g is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    }
    fine = [(i, g, [math.floor(scale * x) for x in v]) for i, g, v in fine]
    out = []
    for i, g, v in fine:
        if i % every:
            continue
        others = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, h) for j, h, w in fine if j != i and len(w) == len(v)]
        for p, j, _ in sorted(x for x in others if x[2] == g)[:positives]:
            inside = sorted(x for x in others if x[2] != g and low * -p <= 100 * -x[0] <= high * -p)
            out += [(i, j, r + 1, k, -p, -s) for r, (s, k, _) in enumerate(inside[:negatives])]
    return sorted(out)


def vectors(seed, n, dim, labels=3, spread=1.0):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.uniform(-spread, spread) for _ in range(dim)]) for i in range(n)]


VECTOR_SCHEMA = "vec_id long, label int, embedding array<double>"


@pytest.mark.parametrize("dim,block,anchors,stripe", [(8, 16, 3, 2), (40, 7, 2, 1), (1, 64, 64, 8)])
def test_hard_negatives(spark, dim, block, anchors, stripe):
    rows = vectors(dim, 150, dim)
    rows += [rows[10], rows[50]]  # repeated rows count once
    rows += [(50, 1, rows[3][2]), (200, 0, rows[0][2]), (201, 0, rows[0][2]), (202, 1, rows[0][2])]  # ties, shared id
    rows += [(300, None, rows[1][2]), (350, 1, None), (None, 1, rows[2][2]), (400, 1, [None] * dim)]
    rows += [(450, 2, [float("nan")] * dim), (500, 2, [float("inf")] * dim), (550, 1, []), (551, 1, []), (552, 2, [])]
    rows += [(600, 1, [0.0] * dim), (601, 1, [0.5] * (dim + 1)), (650, 2, [0.25] * (dim + 1)), (651, 2, [0.25] * (dim + 1))]
    df = spark.createDataFrame(rows, VECTOR_SCHEMA).withColumn("block", F.lit("x")).withColumn("score", F.lit(1))
    done = bond.hard_negatives(df, block=block, anchors=anchors, stripe=stripe)
    assert sorted(map(tuple, done.collect())) == negatives_by_hand(rows)


def test_hard_negatives_large_numbers_and_many_labels(spark):
    # Sums beyond the exact range of both floating types; most labels stand once.
    rows = [(i, max(i, 40), v) for i, _, v in vectors(8, 120, 20, spread=2e6)]
    df = spark.createDataFrame(rows, VECTOR_SCHEMA)
    got = sorted(map(tuple, bond.hard_negatives(df, anchor_every=1, block=32, anchors=8).collect()))
    assert got == negatives_by_hand(rows, every=1) and got


def test_hard_negatives_of_nothing(spark):
    assert bond.hard_negatives(spark.createDataFrame([], VECTOR_SCHEMA)).count() == 0
    assert bond.hard_negatives(spark.createDataFrame([(50, 1, [1.0])], VECTOR_SCHEMA)).count() == 0


def test_scan_gives_up_early():
    rng = np.random.default_rng(5)
    numbers = rng.integers(-100, 100, (64, 500)).astype("<i4")
    numbers[:, 7] = 300
    block = bond._Block(64, np.arange(500).astype("<i8").tobytes(), np.zeros(500, "<i8").tobytes(), numbers.tobytes())
    anchor = np.r_[np.full(8, 50), np.full(56, 1)].astype(np.int64)
    looked = []

    def keep(low, high):
        looked.append(len(low))
        return high >= 100_000

    rows, scores = bond.scan(anchor, block, np.full(500, True), keep, step=8)
    assert rows.tolist() == [7] and scores.tolist() == [int(anchor @ numbers[:, 7].astype(np.int64))]
    assert looked[0] == 500 and looked[1] <= 5  # the large dimensions come first


# ---- conversation trie ------------------------------------------------------------------


def trie_by_hand(rows, group=5, mod=9):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            convs[c].append(((turn is not None, turn or 0), said, role, text))
    plain = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in convs.items()}
    made = {}
    for c in plain:
        base = c - int(math.fmod(c, group))
        h = zlib.crc32(str(c).encode()) % mod
        made[c] = tuple(plain.get(base, [])[:h] + plain[c][h:])
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(own) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if made[c] == p)))
        up = min(members[p[:-1]]) if p else None
        out.append((min(own), len(p), up, len(own), children[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONV_SCHEMA = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(3)
    rows = []
    for c in range(-12, 60):
        for t in range(rng.randint(1, 12)):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["", None, "a", "été", "b" * 30])))
    rows += [(1000 + k, t, "user", "same") for k in range(40) for t in range(6)]  # copies
    rows += [(2000, t, "user", f"turn {t % 3}") for t in range(70)]  # longer than a piece
    rows += [(2001, t, "user", f"turn {t % 3}") for t in range(65)]
    rows += [(3000, None, "user", "first"), (3000, None, "user", "null too"), (3000, 1, "x", "later"), (3000, 1, "x", "later")]
    rows += [(None, 0, "user", "nobody's"), (7001, 0, "user", "gone")]  # 7000 does not exist
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece,shard_rows", [(1024, 200_000), (4, 50), (1, 20)])
def test_trie(spark, piece, shard_rows):
    rows = conversations()
    df = spark.createDataFrame(rows, CONV_SCHEMA).repartition(5)
    for n in ("depth", "p1", "base", "range", "leaf", "shard"):
        df = df.withColumn(n, F.lit("x"))
    done = prefixtrie.conversation_trie(df, piece=piece, shard_rows=shard_rows)
    assert sorted(map(tuple, done.collect()), key=str) == trie_by_hand(rows)


def test_trie_of_nothing(spark):
    assert prefixtrie.conversation_trie(spark.createDataFrame([], CONV_SCHEMA)).count() == 0
    assert prefixtrie.conversation_trie(spark.createDataFrame([(None, 1, "a", "b")], CONV_SCHEMA)).count() == 0
    # A conversation whose turns all lie in its head, which no base has: it ends at the root.
    alone = next(c for c in range(1, 400) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1)
    rows = [(alone, 0, "user", "gone")]
    done = prefixtrie.conversation_trie(spark.createDataFrame(rows, CONV_SCHEMA)).collect()
    assert sorted(map(tuple, done), key=str) == trie_by_hand(rows)
    assert len(done) == 1 and done[0].n_leaves == 1


def test_perfect_hash():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 2**64, (5000, 2), np.uint64)
    table = prefixtrie.PerfectHash(keys[:, 0].copy(), keys[:, 1].copy())
    slots = table.find(keys[:, 0], keys[:, 1])
    assert sorted(slots.tolist()) == list(range(5000))
    assert (table.find(keys[:, 0], keys[:, 1] + np.uint64(1)) == -1).all()
    none = prefixtrie.PerfectHash(np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    assert none.find(keys[:2, 0], keys[:2, 1]).tolist() == [-1, -1]


# ---- suffix tree ------------------------------------------------------------------------


def model_by_hand(rows, order, weight, gain):
    """(tokens, known, base, score) per row (text, learned), by plain dictionaries."""
    tokens = [WORD.findall(lower(t or "")) + [None] for t, _ in rows]
    learned = [t for t, (_, flag) in zip(tokens, rows, strict=True) if flag]
    count = Counter(w for t in learned for w in t)
    total, kinds = sum(count.values()), len(count)
    tree = {}

    def p(context, a):
        if not context:
            return (count[a] + 1) / (total + kinds + 1)
        n, after = tree[context]
        return (after[a] + weight * p(context[1:], a)) / (n + weight)

    before = Counter({(w,): c for w, c in count.items()})
    for k in range(1, order + 1):
        grams = Counter()
        for t in learned:
            for i in range(k, len(t)):
                s = tuple(t[i - k : i])
                if (k == 1 or s[1:] in tree) and before[s] >= 2 and before[s[1:] + (t[i],)] >= 2:
                    grams[s + (t[i],)] += 1
        after = defaultdict(Counter)
        for g, n in grams.items():
            after[g[:-1]][g[-1]] = n
        for s, own in after.items():
            n = sum(own.values())
            gained = sum(m * (math.log(m - 1 + weight * p(s[1:], a)) - math.log(p(s[1:], a)) - math.log(n - 1 + weight)) for a, m in own.items())
            if n >= 2 and gained >= gain:
                tree[s] = n, own
        before = grams
    out = []
    for t in tokens:
        plain = score = 0.0
        for i, a in enumerate(t):
            k = 0
            while k < order and i > k and tuple(t[i - k - 1 : i]) in tree:
                k += 1
            plain += math.log10(p((), a))
            score += math.log10(p(tuple(t[i - k : i]), a))
        out.append((len(t), sum(count[w] > 0 for w in t), total, plain, score))
    return out, tree


@pytest.mark.parametrize("order,weight,block,keys", [(2, 4.0, 8_000_000, 2_000_000), (3, 1.0, 600, 300), (1, 64.0, 5000, 1000)])
def test_suffix_tree(spark, order, weight, block, keys):
    rng = random.Random(order)
    nouns, verbs = [f"n{i}" for i in range(12)], [f"v{i}" for i in range(6)]
    texts = [" ".join(f"The {(n := rng.choice(nouns))} {verbs[int(n[1:]) % 6]} the\t{rng.choice(nouns)}\n" for _ in range(rng.randint(0, 30))) for _ in range(80)]
    rows = [(t, i % 4 != 0) for i, t in enumerate(texts)] + [(None, True), ("", False), (" \n", None), (texts[5], True), ("unknown wörds", False)]
    rows += [(t, i is not None and i % 2 == 0) for i, t, *_ in ROWS if t is None or len(t) < 5000]
    df = spark.createDataFrame([(i, t, f) for i, (t, f) in enumerate(rows)], "no long, text string, learned boolean").repartition(3)
    df = df.withColumn("block", F.lit("x")).withColumn("n", F.lit(-1)).withColumn("score", F.lit("replaced"))
    done = suffixtree.score_texts(df, "learned", order=order, weight=weight, gain=3.0, block_bytes=block, shard_keys=keys)
    assert set(done.columns) == {"no", "learned", "block", "n", "n_tokens", "n_known", "train_tokens", "base_score", "score"}
    want, tree = model_by_hand(rows, order, weight, 3.0)
    assert {len(s) for s in tree} >= set(range(1, min(order, 2) + 1))
    got = sorted(done.collect(), key=lambda r: r.no)
    assert [(r.n_tokens, r.n_known, r.train_tokens) for r in got] == [w[:3] for w in want]
    assert all(r.block == "x" and r.n == -1 for r in got)
    np.testing.assert_allclose([r.base_score for r in got], [w[3] for w in want], rtol=1e-9)
    np.testing.assert_allclose([r.score for r in got], [w[4] for w in want], rtol=1e-9)
    assert sum(r.score for r in got if not r.learned) > sum(r.base_score for r in got if not r.learned)


def test_suffix_tree_holds_one_block(spark, monkeypatch):
    # However many blocks a task has, Python gets them one by one with their answers.
    plain = PandasCogroupedOps.applyInArrow

    def watched(self, func, schema):
        def one(rows, said):
            assert rows.num_rows == 1 and set(said["block"].to_pylist()) <= set(rows["block"].to_pylist())
            return func(rows, said)

        return plain(self, one, schema)

    df = spark.createDataFrame([(i, f"a b c a b {i % 3}") for i in range(40)], "no long, text string").coalesce(1)
    df = df.withColumn("learned", F.lit(True))
    want = suffixtree.score_texts(df, "learned").orderBy("no").collect()
    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", watched)
    assert suffixtree.score_texts(df, "learned", block_bytes=60, shard_keys=20).orderBy("no").collect() == want


def test_suffix_tree_edges(spark):
    docs = empty(spark).withColumn("learned", F.lit(True))
    assert suffixtree.score_texts(docs, "learned").count() == 0
    nothing = suffixtree.score_texts(documents(spark).withColumn("learned", F.lit(False)), "learned").collect()
    assert len(nothing) == len(ROWS) and all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in nothing)
    names = clashing(spark, "n_tokens", "codes", "rest", "docs", "lengths").withColumn("learned", F.lit(True))
    done = suffixtree.score_texts(names, "learned")
    assert done.where("rest = 'x' AND codes = 'x' AND id = 'x' AND n_tokens > 0").count() == len(ROWS)
