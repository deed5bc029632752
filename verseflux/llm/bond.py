"""Hard negatives by a vertical scan of columnar blocks with bounds.

1. Vectors become integers and are packed into blocks, column by column, with the least and the
   largest number of every dimension and the labels of the rows.
2. An anchor reads the dimensions of a block in the order of its own magnitudes, largest first.
   After every few dimensions the partial products, plus the least and the largest that the rest
   can add, tell which rows may still matter; the bitmap of candidates shrinks, and what is left
   after the last dimension has its exact score.
3. First scan: the best rows of the anchor's own label, its positives, against the best found so
   far. Second scan: the rows of other labels inside the windows that the positives open.

A tile is a block of anchors with a stripe of blocks; the few best rows of each tile are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseflux.lineage import cut_lineage

#: Rows of a block, anchors of a block, blocks that meet the same anchors in one task.
BLOCK = 4096
ANCHORS = 512
STRIPE = 8
#: Dimensions that are read between two looks at the bounds.
STEP = 16

_BLOCK = "dim int, ids binary, labels binary, columns binary"


def _pack(rows: DataFrame, size: int, scale: int, key: str) -> DataFrame:
    """Rows (id, label, vector) as blocks of at most ``size`` rows, sorted by label and id."""

    def block(dim: int, ids: list, labels: list, vectors: list) -> pa.RecordBatch:
        columns = np.concatenate(vectors).T.astype("<i4")
        values = [dim, np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(labels).astype("<i8").tobytes(), columns.tobytes()]
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["dim", "ids", "labels", "columns"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list, list]] = {}
        for batch in batches:
            ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lengths = batch.column(2).value_lengths().to_numpy()
            flat = np.floor(batch.column(2).flatten().to_numpy() * scale).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                for a in range(0, len(own), size):
                    some = own[a : a + size]
                    held = waiting.setdefault(int(dim), ([], [], []))
                    room = size - sum(map(len, held[0]))
                    for part in (some[:room], some[room:]):
                        if not len(part):
                            continue
                        held[0].append(ids[part])
                        held[1].append(labels[part])
                        held[2].append(flat[starts[part][:, None] + np.arange(dim)])
                        if sum(map(len, held[0])) >= size:
                            yield block(int(dim), *held)
                            held = waiting[int(dim)] = ([], [], [])
        for dim, held in waiting.items():
            if held[0]:
                yield block(dim, *held)

    rows = rows.repartitionByRange("label", "id").sortWithinPartitions("label", "id")
    blocks = rows.mapInArrow(run, _BLOCK)
    return cut_lineage(blocks.withColumn(key, F.monotonically_increasing_id()))


class _Block:
    """Columns of a block in a type that holds all sums with the given anchors exactly."""

    def __init__(self, dim: int, ids: bytes, labels: bytes, columns: bytes):
        self.ids, self.labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
        self.numbers = np.frombuffer(columns, "<i4").reshape(dim, len(self.ids))
        empty = not self.numbers.size
        self.least = np.zeros(dim, np.int64) if empty else self.numbers.min(axis=1).astype(np.int64)
        self.most = np.zeros(dim, np.int64) if empty else self.numbers.max(axis=1).astype(np.int64)
        self.size = np.maximum(np.abs(self.least), np.abs(self.most))
        self.typed: dict = {}

    def columns(self, kind) -> np.ndarray:
        if kind not in self.typed:
            self.typed[kind] = self.numbers.astype(kind)
        return self.typed[kind]


def _kind(bound: float):
    """Sums below 2^24 are exact in single precision, below 2^53 in double precision."""
    if bound < 2.0**24:
        return np.float32
    if bound < 2.0**53:
        return np.float64
    return np.int64 if bound < 2.0**60 else object


def scan(anchor: np.ndarray, block: _Block, alive: np.ndarray, keep, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``alive`` that ``keep`` never gave up, and their exact scores.

    ``keep(low, high)`` says, from bounds of the scores, which rows may still matter.
    """
    order = np.argsort(-np.abs(anchor), kind="stable")
    a = anchor[order]
    kind = _kind(float(np.abs(a).astype(float) @ block.size[order].astype(float)))
    whole = object if kind is object else np.int64
    ends = np.stack([a.astype(whole) * block.least[order], a.astype(whole) * block.most[order]])
    # What all dimensions after the first k can add, at least and at most.
    low = np.r_[np.cumsum(ends.min(axis=0)[::-1])[::-1], 0]
    high = np.r_[np.cumsum(ends.max(axis=0)[::-1])[::-1], 0]
    columns, a = block.columns(kind), a.astype(kind)
    n = len(block.ids)
    rows = np.flatnonzero(alive)
    scores = np.zeros(len(rows), kind)
    dense = len(rows) * 3 > n
    partial = np.zeros(n, kind) if dense else None
    for k in range(0, len(a), step):
        if not len(rows):
            break
        dims = order[k : k + step]
        if dense:
            partial += a[k : k + step] @ columns[dims]
            scores = partial[rows]
        else:
            scores = scores + a[k : k + step] @ columns[np.ix_(dims, rows)]
        after = min(k + step, len(a))
        left = keep(scores.astype(whole) + low[after], scores.astype(whole) + high[after])
        rows, scores = rows[left], scores[left]
        dense = dense and len(rows) * 3 > n
    return rows, scores.astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))][:k]


class Positives:
    """The best ``k`` rows of the anchor's label so far."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def meet(self, anchor_id: int, label: int, anchor: np.ndarray, block: _Block) -> None:
        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            least = self.scores[-1] if len(self.scores) == self.k else None
            if len(low) > self.k:
                sure = np.partition(low, len(low) - self.k)[len(low) - self.k]
                least = sure if least is None else max(least, sure)
            return np.full(len(low), True) if least is None else high >= least

        rows, scores = scan(anchor, block, (block.labels == label) & (block.ids != anchor_id), keep)
        scores, ids = np.r_[self.scores, scores], np.r_[self.ids, block.ids[rows]]
        best = _best(scores, ids, self.k)
        self.scores, self.ids = scores[best], ids[best]


class Negatives:
    """The best ``k`` rows of other labels in every window so far; a window holds the scores
    from ``low`` to ``high``."""

    def __init__(self, k: int, windows: list[tuple[int, int]]):
        self.k, self.windows = k, windows
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]

    def meet(self, anchor_id: int, label: int, anchor: np.ndarray, block: _Block) -> None:
        if not self.windows:
            return
        floors = [s[-1] if len(s) == self.k else low for (low, _), (s, _) in zip(self.windows, self.found, strict=True)]
        tops = [high for _, high in self.windows]

        def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
            out = np.full(len(low), False)
            for floor, top in zip(floors, tops, strict=True):
                out |= (high >= floor) & (low <= top)
            return out

        rows, scores = scan(anchor, block, (block.labels != label) & (block.ids != anchor_id), keep)
        for i, (floor, top) in enumerate(zip(floors, tops, strict=True)):
            inside = (scores >= floor) & (scores <= top)
            s, ids = np.r_[self.found[i][0], scores[inside]], np.r_[self.found[i][1], block.ids[rows[inside]]]
            best = _best(s, ids, self.k)
            self.found[i] = s[best], ids[best]


def windows(scores: list[int], low: int, high: int) -> list[tuple[int, int]]:
    """Per positive score p, the whole numbers s with low * p <= 100 * s <= high * p."""
    return [(-((-low * p) // 100), (high * p) // 100) for p in scores]


def _tiles(asked: DataFrame, blocks: DataFrame, pairs: DataFrame):
    """Blocks of anchors and blocks of rows, grouped by (anchors, stripe)."""
    right = pairs.join(blocks, "block").groupBy("a_block", "stripe")
    wanted = pairs.select(F.col("a_block").alias("t_block"), F.col("stripe").alias("t_stripe")).distinct()
    left = wanted.join(asked, F.col("t_block") == F.col("a_block")).groupBy("t_block", "t_stripe")
    return left.cogroup(right)


_NAMES = ["dim", "ids", "labels", "columns"]


def _each(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[dict, _Block, list[int]]]:
    """Every block of anchors (one, as a rule) and the places of the blocks of its dimension."""
    for at in anchors.to_pylist():
        own = _Block(*[at[n] for n in _NAMES])
        yield at, own, [i for i in range(rows.num_rows) if rows["dim"][i].as_py() == at["dim"]]


def _row_block(rows: pa.Table, i: int) -> _Block:
    return _Block(*[rows[n][i].as_py() for n in _NAMES])


def hard_negatives(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: int = 256,
    block: int = BLOCK,
    anchors: int = ANCHORS,
    stripe: int = STRIPE,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``,
    ``negative_score``: for every anchor (id divisible by ``anchor_every``) and each of its first
    ``positives`` other rows of its label, the first ``negatives`` rows of other labels whose
    score lies between ``low`` and ``high`` percent of the positive's. All, if fewer.

    Components are floor(``scale`` * x); a score is the inner product of these whole numbers.
    Higher scores come first, ties go to the smaller id. Rows with a null id, label or vector, or
    a null or non-finite component take no part, nor do components beyond 31 bits; scores must fit
    a long; only vectors of one length meet. Equal rows count once; rows that share the anchor's id are neither its
    positives nor its negatives. Positives of negative score have no negatives. An empty table
    gives an empty one; other columns are not read.
    """
    most = float(2**31 - 1) / scale
    vector = F.col(vector_col).cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= most))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.when(fine, vector).alias("vector"))
    rows = cut_lineage(rows.dropna().dropDuplicates(["id", "label", "vector"]))
    blocks = _pack(rows, block, scale, "block")
    asked = _pack(rows.where(F.col("id") % anchor_every == 0), anchors, scale, "a_block")
    stripes = max(1, -(-blocks.count() // stripe))
    blocks = blocks.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)))

    # First scan: blocks that share a label (their rows are sorted by it, so they hold few).
    own = _labels(asked, "a_block").join(_labels(blocks, "block"), "label").select("a_block", "block").distinct()
    own = own.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(stripes)))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for at, mine, places in _each(left, right):
            best = [Positives(positives) for _ in mine.ids]
            vectors = mine.numbers.T.astype(np.int64)
            for i in places:
                x = _row_block(right, i)
                for j, found in enumerate(best):
                    found.meet(int(mine.ids[j]), int(mine.labels[j]), vectors[j], x)
            out += [(at["a_block"], j, int(i), int(s)) for j, b in enumerate(best) for i, s in zip(b.ids, b.scores, strict=True)]
        return _rows("a_block place id score", out)

    first = _tiles(asked, blocks.drop("stripe"), own).applyInArrow(near, "a_block long, place long, id long, score long")
    order = Window.partitionBy("a_block", "place").orderBy(F.col("score").desc(), "id")
    first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    opened = first.groupBy("a_block").agg(F.collect_list(F.struct("place", "rank", "id", "score")).alias("found"))
    asked = cut_lineage(asked.join(opened, "a_block"))

    # Second scan: all blocks, in stripes.
    every = asked.select("a_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(stripes - 1).cast("long"))).alias("stripe"))
    every = every.join(blocks.select("block", "stripe"), "stripe")
    names = "a_block place p_rank anchor_id positive_id positive_score negative_id negative_score"

    def far(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for at, mine, places in _each(left, right):
            vectors = mine.numbers.T.astype(np.int64)
            found: dict[int, list] = {}
            for f in at["found"]:
                found.setdefault(f["place"], []).append(f)
            open_ = []
            for place, own_found in sorted(found.items()):
                ranges = windows([f["score"] for f in own_found], low, high)
                real = [i for i, (a, b) in enumerate(ranges) if a <= b]
                open_.append((place, [own_found[i] for i in real], Negatives(negatives, [ranges[i] for i in real])))
            for i in places:
                x = _row_block(right, i)
                for place, _, best in open_:
                    best.meet(int(mine.ids[place]), int(mine.labels[place]), vectors[place], x)
            for place, own_found, best in open_:
                for f, (scores, ids) in zip(own_found, best.found, strict=True):
                    out += [
                        (at["a_block"], place, f["rank"], int(mine.ids[place]), f["id"], f["score"], int(i), int(s))
                        for i, s in zip(ids, scores, strict=True)
                    ]
        return _rows(names, out)

    second = _tiles(asked, blocks.drop("stripe"), every).applyInArrow(far, ", ".join(f"{n} long" for n in names.split()))
    order = Window.partitionBy("a_block", "place", "p_rank").orderBy(F.col("negative_score").desc(), "negative_id")
    second = second.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return second.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _rows(names: str, rows: list[tuple[int, ...]]) -> pa.Table:
    table = np.array(rows, np.int64).reshape(len(rows), len(names.split()))
    return pa.table({n: np.ascontiguousarray(table[:, i]) for i, n in enumerate(names.split())})


def _labels(blocks: DataFrame, key: str) -> DataFrame:
    """(block, label) for every label that stands in the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, labels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.unique(np.frombuffer(labels, "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array([at] * len(own), pa.int64()), pa.array(own)], names=[key, "label"])

    return blocks.select(key, "labels").mapInArrow(run, f"{key} long, label long")
