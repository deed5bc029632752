"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is a run of letters and digits, A-Z in lower case. Two independent hashes of it choose
one row each of two embedding tables, so that words that share one row still differ in the
other, and a hash of its first ``PREFIX`` bytes a row of a third, for compounds that training
has not met. The three rows together are its embedding. Filters over one, two and three words, the
largest value of each filter over the whole text, and a logistic unit give the score.

Training takes a bounded sample (``SAMPLE`` rows per label, those with the smallest hash of
their id); a fifth of it is kept to shift the score, so that 0.5 is its best cutoff, and to
calibrate a cutoff for each language. Scoring reads whole texts batch by batch; the model
(a few MB) is broadcast.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseflux.llm.common import add_arrow, texts

#: Labelled rows per label that are trained on and calibrated with, at most, and the longest
#: text (in bytes) among them.
SAMPLE = {1: 4000, 0: 6000}
SAMPLE_BYTES = 30_000
BUCKET_BITS = 16
PART = 8
TABLES = 3
PREFIX = 5
WIDTHS = (1, 2, 3)
FILTERS = 16
BATCH = 16
#: Batches that training aims at, and the least and most times that it reads the sample.
STEPS, EPOCHS = 2500, (5, 12)
_PAD = max(WIDTHS) - 1
#: Padding behind the last text, so that even a text without words has a place in every map.
_END = 1
_GROUP = 1_000_000


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15 | 1
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return (
            np.cumprod(np.r_[np.uint64(1), np.full(n, base, np.uint64)]),
            np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)]),
        )


def _mixed(hashes: np.ndarray) -> np.ndarray:
    hashes = (hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return hashes ^ (hashes >> np.uint64(32))


class Hasher:
    """Word hashes of many texts at once: the bytes of a word as a polynomial, from running sums."""

    def __init__(self):
        self.powers, self.inverses = _powers(0)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Table rows (words x tables) of the texts, and the number of words of each text."""
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        if len(self.powers) <= len(data):
            self.powers, self.inverses = _powers(2 * len(data))
        upper = (data >= 65) & (data <= 90)
        data = np.where(upper, data + 32, data)
        inside = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
        edge = np.diff(np.r_[False, inside].view(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[: len(data)])]
        whole = _mixed((sums[end] - sums[begin]) * self.inverses[begin])
        front = _mixed((sums[np.minimum(end, begin + PREFIX)] - sums[begin]) * self.inverses[begin])
        mask = np.uint64((1 << BUCKET_BITS) - 1)
        rows = np.stack([whole & mask, (whole >> np.uint64(32)) & mask, front & mask], axis=1).astype(np.int32)
        closes = np.cumsum([len(t) + 1 for t in texts])
        return rows, np.diff(np.r_[0, np.searchsorted(begin, closes)])


class ConvNet:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        rows, wide = (1 << BUCKET_BITS) + 1, TABLES * PART
        self.tables = [rng.normal(0, 0.05, (rows, PART)).astype(np.float32) for _ in range(TABLES)]
        for t in self.tables:
            t[-1] = 0  # padding
        self.weights = [rng.normal(0, 1 / np.sqrt(w * wide), (w, wide, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(-2.0)
        self.shift = 0.0
        self.cutoffs: dict[str, float] = {}

    @staticmethod
    def padded(rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Table rows with padding after every text, and where texts begin."""
        starts = np.r_[0, np.cumsum(counts + _PAD)[:-1]].astype(np.int64) if len(counts) else np.zeros(0, np.int64)
        out = np.full((int((counts + _PAD).sum()) + _END, TABLES), 1 << BUCKET_BITS, np.int32)
        out[np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(len(rows))] = rows
        return out, starts

    def features(self, rows: np.ndarray, starts: np.ndarray):
        x = np.concatenate([t[rows[:, i]] for i, t in enumerate(self.tables)], axis=1)
        total = len(x) - _END
        owner = np.r_[np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, total])), [-1] * _END]
        maps, tops = [], []
        for w, weight, bias in zip(WIDTHS, self.weights, self.biases, strict=True):
            z = x[: len(x) - w + 1] @ weight[0]
            for k in range(1, w):
                z += x[k : len(x) - w + 1 + k] @ weight[k]
            z += bias
            # Windows that reach into another text, or behind the last one, do not count.
            z[(owner[: len(z)] != owner[w - 1 :]) | (owner[w - 1 :] < 0)] = -np.inf
            maps.append(z)
            tops.append(np.maximum.reduceat(z, starts, axis=0))
        return x, maps, np.concatenate(tops, axis=1)

    def logits(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        tops = self.features(*self.padded(rows, counts))[2]
        return np.maximum(tops, 0) @ self.out + self.bias + self.shift

    def train(self, docs: list[np.ndarray], labels: np.ndarray, rate: float = 0.08, seed: int = 5) -> None:
        """Adagrad on the logistic loss; both labels weigh the same; a little weight decay."""
        rng = np.random.default_rng(seed)
        epochs = int(np.clip(STEPS * BATCH / max(1, len(docs)), *EPOCHS))
        share = labels.mean()
        weigh = np.where(labels == 1, 0.5 / max(share, 1e-3), 0.5 / max(1 - share, 1e-3))
        dense = [*self.weights, *self.biases, self.out]
        past = [np.full(p.shape, 1e-2, np.float32) for p in dense]
        past_bias, past_rows = 1e-2, [np.full((len(t), 1), 1e-2, np.float32) for t in self.tables]
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                counts = np.array([len(docs[i]) for i in own], np.int64)
                rows, starts = self.padded(np.concatenate([docs[i] for i in own]), counts)
                x, maps, tops = self.features(rows, starts)
                active = np.maximum(tops, 0)
                keep = (rng.random(active.shape) > 0.2).astype(np.float32) / 0.8
                score = 1 / (1 + np.exp(-np.clip((active * keep) @ self.out + self.bias, -30, 30)))
                slope = ((score - labels[own]) * weigh[own] / len(own)).astype(np.float32)
                grads = [np.zeros_like(p) for p in dense]
                grads[-1][:] = (active * keep).T @ slope + 1e-4 * self.out
                up = slope[:, None] * self.out[None, :] * keep * (tops > 0)
                ends = np.r_[starts[1:], len(x)]
                places, slopes = [], []
                for j, w in enumerate(WIDTHS):
                    z = maps[j]
                    pos = np.stack([s + z[s : min(e, len(z))].argmax(axis=0) for s, e in zip(starts, ends, strict=True)])
                    g = up[:, j * FILTERS : (j + 1) * FILTERS]
                    grads[len(WIDTHS) + j][:] = g.sum(axis=0)
                    for k in range(w):
                        grads[j][k] = np.einsum("bfd,bf->df", x[pos + k], g) + 1e-4 * self.weights[j][k]
                        places.append((pos + k).ravel())
                        slopes.append((g[:, :, None] * self.weights[j][k].T[None]).reshape(-1, TABLES * PART))
                where, change = np.concatenate(places), np.concatenate(slopes)
                for t, table in enumerate(self.tables):
                    touched, inverse = np.unique(rows[where, t], return_inverse=True)
                    total = np.zeros((len(touched), PART), np.float32)
                    np.add.at(total, inverse, change[:, t * PART : (t + 1) * PART])
                    total[touched == 1 << BUCKET_BITS] = 0
                    past_rows[t][touched] += np.square(total).mean(axis=1, keepdims=True)
                    table[touched] -= rate * total / np.sqrt(past_rows[t][touched])
                for p, g, h in zip(dense, grads, past, strict=True):
                    h += g * g
                    p -= rate * 0.5 * g / np.sqrt(h)
                g = float(slope.sum())
                past_bias += g * g
                self.bias -= np.float32(rate * 0.5 * g / np.sqrt(past_bias))


def best_cutoff(scores: np.ndarray, labels: np.ndarray) -> float | None:
    """In the middle of the gap that gives the best F1, the widest of equally good gaps; null
    unless there are five rows of each label."""
    if labels.sum() < 5 or (1 - labels).sum() < 5:
        return None
    values = np.unique(scores)
    cuts = (values[1:] + values[:-1]) / 2
    if not len(cuts):
        return None
    good, bad = np.sort(scores[labels == 1]), np.sort(scores[labels == 0])
    hit = len(good) - np.searchsorted(good, cuts)
    false = len(bad) - np.searchsorted(bad, cuts)
    f1 = 2 * hit / (2 * hit + false + (len(good) - hit))
    fine = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(cuts[fine[np.argmax(np.diff(values)[fine])]])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``mix`` (id hash), ``text``, ``toxic``, ``lang`` of a bounded sample. The ids are chosen from the labels
    alone; the documents meet a broadcast list of at most the sum of ``SAMPLE`` ids."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull())
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("mix", F.xxhash64("__id"))
    # A limit after an order keeps the first rows of every task, and of these the first.
    parts = [known.where(F.col("toxic") == y).orderBy("mix", "__id").limit(n) for y, n in SAMPLE.items()]
    chosen = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select(F.col(id_col), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.join(chosen, F.col(id_col) == F.col("__id")).where(f"octet_length(text) <= {SAMPLE_BYTES}")
    rows = rows.dropDuplicates(["__id"])
    return rows.select("mix", "text", "toxic", "lang")


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ConvNet:
    """A model from the bounded sample, trained in one task; only the model (some MB) reaches
    the driver. Without any labelled text it is untrained."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, rows = Hasher(), []
        for batch in batches:  # only the hashes of a batch's texts are kept
            found = batch.to_pylist()
            docs = _hashed(hasher, [r.pop("text") for r in found])
            rows += [r | {"words": d} for r, d in zip(found, docs, strict=True)]
        net = train(sorted(rows, key=lambda r: r["mix"]))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["model"])

    sample = labelled_sample(docs, labels, id_col, text_col, lang_col).repartition(1)
    models = sample.mapInArrow(run, "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else train([])


def _hashed(hasher: Hasher, all_texts: list[str]) -> list[np.ndarray]:
    docs: list[np.ndarray] = []
    for group in _byte_groups(t.encode() for t in all_texts):
        rows, counts = hasher(group)
        docs += [own.copy() for own in np.split(rows, np.cumsum(counts)[:-1])]
    return docs


def train(sample: list, seed: int = 5) -> ConvNet:
    """A model from sample rows (``words``: hashes), calibrated on every fifth of them."""
    net = ConvNet(seed)
    if not sample:
        return net
    docs = [r["words"] for r in sample]
    labels = np.array([1.0 if r["toxic"] == 1 else 0.0 for r in sample])
    held = np.arange(len(docs)) % 5 == 4
    net.train([d for d, h in zip(docs, held, strict=True) if not h], labels[~held], seed=seed)
    logits = np.array([net.logits(d, np.array([len(d)]))[0] for d in docs])
    middle = best_cutoff(logits[held], labels[held])
    net.shift = -middle if middle is not None else 0.0
    scores = 1 / (1 + np.exp(-np.clip(logits + net.shift, -30, 30)))
    langs = np.array([r["lang"] if r["lang"] is not None else "" for r in sample])
    for lang in np.unique(langs):
        own = held & (langs == lang)
        cut = best_cutoff(scores[own], labels[own])
        if cut is not None:
            net.cutoffs[str(lang)] = cut
    return net


def score_toxicity(df: DataFrame, net: ConvNet, text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """``df`` with ``score`` (0 to 1, from the text alone) and, with ``lang_col``, ``cutoff``
    (of the row's language, or 0.5 if it has none of its own) and ``rejected``.

    Null and empty texts get the score of a text without words. A null language has the cutoff
    of null languages in the sample, if any. Rows are independent; an empty table gives an
    empty one; columns named like a result are replaced.
    """
    sent = df.sparkSession.sparkContext.broadcast(net)

    def run(column: pa.Array, *lang: pa.Array) -> dict[str, pa.Array]:
        model, hasher = sent.value, Hasher()
        found = [np.zeros(0)]
        for group in _byte_groups(texts(column)):
            found.append(model.logits(*hasher(group)))
        score = 1 / (1 + np.exp(-np.clip(np.concatenate(found), -30, 30)))
        out = {"score": pa.array(score)}
        for names in lang:
            cutoff = np.array([model.cutoffs.get(n or "", 0.5) for n in names.to_pylist()], np.float64)
            out |= {"cutoff": pa.array(cutoff), "rejected": pa.array(score >= cutoff)}
        return out

    if lang_col is None:
        return add_arrow(df, [text_col], "score double", run)
    return add_arrow(df, [text_col, lang_col], "score double, cutoff double, rejected boolean", run)


def _byte_groups(all_texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    group, size = [], 0
    for t in all_texts:
        if group and size + len(t) > _GROUP:
            yield group
            group, size = [], 0
        group.append(t)
        size += len(t) + 1
    if group:
        yield group
