"""Language-model scores by a probabilistic suffix tree over words.

A context is a run of up to ``order`` words; the tree holds the contexts whose followers differ
from those of their suffix (the context without its first word). A text's probability is the
product over its tokens (words, then one end) of the smoothed probability after the longest
context that the tree holds.

* Smoothing: P(a | s) = (N(sa) + mu * P(a | suffix of s)) / (N(s) + mu); after the empty context
  P(a) = (c + 1) / (N + V + 1).
* Divergence test: the log-likelihood that N(s) followers gain by s over its suffix, every
  follower judged by the counts without itself, must reach ``gain`` nats. Contexts that only
  repeat their suffix, or were seen too rarely to tell, fail it.
* Growth: a context is looked at if its suffix is in the tree and it was counted twice as a
  sequence; a follower is counted if it was counted twice after the suffix.

Nothing of the model is held in one place. Texts are packed into blocks of words as 64-bit
hashes. A block asks shards of hash ranges about its distinct words, sequences and contexts (each
once, with what it adds to their counts), and a shard adds up and answers each block. A frequent
word or context is one key per block, not one row per occurrence. Sums are whole numbers, so
that results do not depend on how texts are dealt to blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verseflux.lineage import cut_lineage
from verseflux.llm.common import release, texts, without
from verseflux.llm.nearcopies import Shingler, mix64

#: Words of a context, at most; weight of the suffix; nats that a context must gain.
ORDER = 2
WEIGHT = 256.0
GAIN = 6.0
#: Bytes of text in a block, and keys of a shard on average, at most.
BLOCK_BYTES = 4_000_000
SHARD_KEYS = 1_000_000
#: Buckets of the table of blocks, at most (Spark's own limit).
MOST_BUCKETS = 100_000
#: Gains are summed as whole multiples of 2^-16 nats.
_UNIT = 1 << 16
#: Stands for the end of a text among the hashes of words.
_END = np.uint64(0x5851F42D4C957F2D)

_RESULT = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(values: np.ndarray) -> bytes:
    """Bytes of the numbers, first all first bytes, then all second ones, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).reshape(n)


def _blocks(docs: DataFrame, text_col: str, train_col: str, size: int) -> DataFrame:
    """Texts as blocks: distinct hashes of the words, their places, and the other columns."""
    rest = docs.drop(text_col)
    plain = docs.select(F.col(text_col).alias("__text"), F.col(train_col).alias("__train"), *[f"`{c}`" for c in rest.columns])

    def block(hashes: list, counts: list, train: list, rows: list) -> pa.RecordBatch:
        words, lengths = np.concatenate(hashes), np.concatenate(counts)
        ends = np.cumsum(lengths)
        tokens = np.insert(words, ends, _END)
        known, codes, times = np.unique(tokens, return_inverse=True, return_counts=True)
        rank = np.argsort(-times, kind="stable")  # frequent words get small numbers
        places = np.empty(len(known), np.uint32)
        places[rank] = np.arange(len(known), dtype=np.uint32)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema) as writer:
            for r in rows:
                writer.write_batch(r)
        values = [
            len(tokens), len(lengths), squeeze((lengths + 1).astype(np.int32)), squeeze(np.concatenate(train).astype(np.uint8)),
            known[rank].astype("<u8").tobytes(), squeeze(places[codes]), sink.getvalue().to_pybytes(),
        ]
        kinds = [pa.int64(), pa.int64()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)

    names = ["n", "docs", "lengths", "train", "words", "codes", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(1)
        held: tuple[list, list, list, list] = ([], [], [], [])
        full = 0
        for batch in batches:
            own = texts(batch.column(0))
            sizes = np.cumsum([len(t) for t in own])
            train = np.array([bool(t) for t in batch.column(1).to_pylist()])
            other = batch.select(batch.schema.names[2:])
            a = 0
            while a < len(own):
                before = sizes[a - 1] if a else 0
                b = max(a + 1, int(np.searchsorted(sizes, before + size // 4, "right")))
                hashes, counts = shingler.words(own[a:b])
                for column, value in zip(held, (hashes, counts, train[a:b], other.slice(a, b - a)), strict=True):
                    column.append(value)
                full += int(sizes[b - 1] - before)
                if full >= size:
                    yield block(*held)
                    held, full = ([], [], [], []), 0
                a = b
        if held[0]:
            yield block(*held)

    packed = plain.mapInArrow(run, "n long, docs long, lengths binary, train binary, words binary, codes binary, rest binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


class Ask:
    """Distinct keys of a block and the whole numbers it adds to each of them."""

    def __init__(self, keys: np.ndarray, *adds: np.ndarray):
        self.keys, self.adds = keys, adds

    def by_shard(self, shards: int) -> Iterator[tuple[int, bytes, list[bytes], int]]:
        """Per shard of key ranges: differences of the sorted keys, and the numbers."""
        order = np.argsort(self.keys)
        keys = self.keys[order]
        edges = np.searchsorted((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32), np.arange(shards + 1))
        for s in range(shards):
            a, b = edges[s], edges[s + 1]
            if a < b:
                steps = np.diff(np.r_[np.uint64(0), keys[a:b]])
                yield s, squeeze(steps), [squeeze(x[order[a:b]].astype(np.int64)) for x in self.adds], int(b - a)

    def read(self, answers: list[dict]) -> np.ndarray:
        """The answers of all shards, in the order of the keys."""
        out = np.zeros(len(self.keys), np.int64)
        order = np.argsort(self.keys)
        a = 0
        for answer in sorted(answers, key=lambda r: r["shard"]):
            n = answer["n"]
            out[order[a : a + n]] = unsqueeze(answer["found"], n, np.int64)
            a += n
        return out


def _kept(n: np.ndarray, gains: np.ndarray, weight: float, gain: float) -> np.ndarray:
    """The count of every context that passes the divergence test, 0 for the others."""
    gained = gains / _UNIT + n * (np.log(weight) - np.log(np.maximum(n - 1, 0) + weight))
    return np.where((n >= 2) & (gained >= gain), n, 0)


def _answers(asked: DataFrame, kind: int, weight: float, gain: float) -> DataFrame:
    """Every shard adds up what all blocks say of a key, and answers every block: the count, or
    where gains were sent (contexts) the count of those in the tree. A row of block -1 tells how
    many keys of the shard have a count."""

    def add(rows: pa.Table) -> pa.Table:
        ns = rows["n"].to_pylist()
        keys = np.concatenate([np.cumsum(unsqueeze(k, n, np.uint64)) for k, n in zip(rows["keys"].to_pylist(), ns, strict=True)])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.r_[True, keys[1:] != keys[:-1]]
        del keys
        starts = np.flatnonzero(first)

        def total(name: str) -> np.ndarray:
            adds = np.concatenate([unsqueeze(p, n, np.int64) for p, n in zip(rows[name].to_pylist(), ns, strict=True)])
            return np.add.reduceat(adds[order], starts)

        found = total("sums")
        if rows["gains"][0].is_valid:
            found = _kept(found, total("gains"), weight, gain)
        some = int((found > 0).sum())
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(first) - 1
        ends = np.cumsum(ns)
        packed = [squeeze(found[group[e - n : e]]) for e, n in zip(ends, ns, strict=True)]
        size = len(ns) + 1
        return pa.table(
            [pa.array(rows["block"].to_pylist() + [-1], pa.int64()), pa.array([rows["shard"][0].as_py()] * size, pa.int32()),
             pa.array(ns + [some], pa.int32()), pa.array(packed + [None], pa.binary())],
            names=["block", "shard", "n", "found"],
        )

    answers = asked.groupBy("shard").applyInArrow(add, "block long, shard int, n int, found binary")
    return cut_lineage(answers.withColumn("kind", F.lit(kind)))


class Block:
    """What a block knows of its texts with the answers it has so far."""

    def __init__(self, row: dict, order: int, weight: float):
        n, docs = row["n"], row["docs"]
        self.order, self.weight = order, weight
        self.lengths = unsqueeze(row["lengths"], docs, np.int32).astype(np.int64)
        self.words = np.frombuffer(row["words"], "<u8")
        self.codes = unsqueeze(row["codes"], n, np.uint32).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(unsqueeze(row["train"], docs, np.uint8).astype(bool), self.lengths)

    def advance(self, answers: list[list[dict]], total: int, distinct: int) -> Ask | tuple:
        """The next question, or (tokens known, logarithms of P(a) and of the tree's P) if all
        are answered. ``answers`` has the rows of every question so far."""
        asked = iter(answers)
        ask = Ask(self.words, np.bincount(self.codes[self.train], minlength=len(self.words)))
        if (rows := next(asked, None)) is None:
            return ask
        count = ask.read(rows)[self.codes]  # of what was last counted, at every token
        plain = (count + 1.0) / (total + distinct + 1.0)
        known, p = count > 0, plain.copy()
        token = self.words[self.codes]
        context = np.zeros(len(token), np.uint64)
        held = np.full(len(token), True)  # the context one shorter is in the tree
        place = np.arange(len(token)) - np.repeat(self.starts, self.lengths)
        before = lambda x: np.r_[x[:1], x[:-1]]
        for k in range(1, self.order + 1):
            # The word k places back is mixed in, with its place.
            word = np.r_[token[:k], token[: len(token) - k]] if len(token) > k else token
            context = mix64(context + mix64(word + np.uint64(k)))
            held = held & (place >= k) & (before(count) >= 2)
            counted = held & (count >= 2)
            at = np.flatnonzero(counted)
            keys, key = np.unique(mix64(context[at] * np.uint64(3) + token[at]), return_inverse=True)
            pairs = Ask(keys, np.bincount(key[self.train[at]], minlength=len(keys)))
            if (rows := next(asked, None)) is None:
                return pairs
            count = np.zeros(len(token), np.int64)
            count[at] = pairs.read(rows)[key]
            # What every follower gains, without itself, up to a term that only needs N(s).
            own = at[self.train[at] & (count[at] >= 2)]
            gained = np.log(count[own] - 1 + self.weight * p[own]) - np.log(p[own]) - np.log(self.weight)
            gains = np.zeros(len(token), np.int64)
            gains[own] = np.rint(gained * _UNIT).astype(np.int64)
            here = np.flatnonzero(held)
            keys, key = np.unique(context[here], return_inverse=True)
            once = (counted & self.train)[here]
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, key, gains[here])
            contexts = Ask(keys, np.bincount(key[once], minlength=len(keys)), sums)
            if (rows := next(asked, None)) is None:
                return contexts
            n = contexts.read(rows)[key]
            held = np.full(len(token), False)
            held[here] = n > 0
            some = here[n > 0]
            p[some] = (count[some] + self.weight * p[some]) / (n[n > 0] + self.weight)
        return known, np.log10(plain), np.log10(p)


def score_texts(
    df: DataFrame,
    train_col: str,
    text_col: str = "text",
    order: int = ORDER,
    weight: float = WEIGHT,
    gain: float = GAIN,
    block_bytes: int = BLOCK_BYTES,
    shard_keys: int = SHARD_KEYS,
) -> DataFrame:
    """``df`` without its text, with ``n_tokens``, ``n_known`` (tokens that training texts have),
    ``train_tokens`` (of all training texts), ``base_score`` (log10 probability of the text if
    its tokens were independent), ``score`` (by the tree).

    The tree learns from all rows whose ``train_col`` is true (null: false). Words are runs of
    anything but space and the controls 9 to 13, A-Z in lower case. A null text is empty and has
    one token, its end. Repeated rows are texts of their own. Whole texts of any length are
    read; an empty table gives an empty one; columns named like a result are replaced.
    """
    names = StructType.fromDDL(_RESULT).names
    docs = df.select(*[f"`{c}`" for c in without(df, names).columns])
    rest = docs.drop(text_col)
    spark = df.sparkSession
    blocks = _blocks(docs, text_col, train_col, block_bytes)
    name = f"suffixtree_blocks_{uuid.uuid4().hex}"
    # As a table with buckets the blocks meet their answers again and again without being shuffled.
    buckets = max(1, min(blocks.rdd.getNumPartitions(), MOST_BUCKETS))
    blocks.write.bucketBy(buckets, "block").saveAsTable(name)
    try:
        return cut_lineage(_scores(spark.table(name), rest.schema, order, weight, gain, shard_keys))
    finally:
        spark.sql(f"DROP TABLE {name}")


def _scores(blocks: DataFrame, rest: StructType, order: int, weight: float, gain: float, shard_keys: int) -> DataFrame:
    spark, names = blocks.sparkSession, StructType.fromDDL(_RESULT).names
    shards = max(1, -(-(blocks.agg(F.sum("n")).first()[0] or 0) // shard_keys))
    ddl = "block long, shard int, n int, keys binary, sums binary, gains binary"
    fields = StructType.fromDDL(ddl).names

    def rows_of(row: dict, ask: Ask) -> pa.Table:
        made = [
            (row["block"], s, n, keys, adds[0], adds[1] if len(adds) > 1 else None)
            for s, keys, adds, n in ask.by_shard(shards)
        ]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        columns = list(zip(*made, strict=True)) if made else [()] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=fields)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield from rows_of(row, Block(row, order, weight).advance([], 0, 0)).to_batches()

    state = ["block", "n", "docs", "lengths", "train", "words", "codes"]
    answers = _answers(blocks.select(*state).mapInArrow(first, ddl), 0, weight, gain)
    distinct = answers.where("block = -1").agg(F.sum("n")).first()[0] or 0
    total = _train_tokens(blocks)
    release(spark)

    def met(columns: list[str]):
        """Every block with its answers; only the answers are shuffled. A group is one block,
        so that what Python holds does not depend on how many blocks a task has."""
        return blocks.select(*columns).groupBy("block").cogroup(answers.where("block >= 0").groupBy("block"))

    def advanced(rows: pa.Table, said: pa.Table, asked: int) -> tuple[dict, Block, Ask | tuple]:
        (row,) = rows.to_pylist()
        given: list[list[dict]] = [[] for _ in range(asked)]
        for r in said.select(["shard", "n", "found", "kind"]).to_pylist():
            given[r["kind"]].append(r)
        block = Block(row, order, weight)
        return row, block, block.advance(given, total, distinct)

    def step(asked: int):
        def go(rows: pa.Table, said: pa.Table) -> pa.Table:
            row, _, ask = advanced(rows, said, asked)
            return rows_of(row, ask)

        return go

    for asked in range(1, 2 * order + 1):
        answers = answers.unionByName(_answers(met(state).applyInArrow(step(asked), ddl), asked, weight, gain))
        release(spark)

    def finish(rows: pa.Table, said: pa.Table) -> pa.Table:
        row, block, (known, plain, p) = advanced(rows, said, 2 * order + 1)
        others = pa.ipc.open_stream(row["rest"]).read_all()
        add = lambda x: np.add.reduceat(x, block.starts)
        made = [block.lengths, add(known.astype(np.int64)), np.full(len(block.lengths), total, np.int64), add(plain), add(p)]
        return pa.table(others.columns + [pa.array(m) for m in made], names=others.column_names + names)

    schema = StructType(list(rest.fields) + list(StructType.fromDDL(_RESULT).fields))
    return met([*state, "rest"]).applyInArrow(finish, schema)


def _train_tokens(blocks: DataFrame) -> int:
    """Tokens of all training texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for docs, lengths, train in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = unsqueeze(lengths, docs, np.int32).astype(np.int64)
                sums.append(int(own[unsqueeze(train, docs, np.uint8).astype(bool)].sum()))
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], names=["n"])

    return blocks.select("docs", "lengths", "train").mapInArrow(count, "n long").agg(F.sum("n")).first()[0] or 0
