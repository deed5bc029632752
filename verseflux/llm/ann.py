"""Nearest neighbours by inner product: block matrix join of int8 tiles with error bounds.

1. Candidates and queries are packed into blocks: 8-bit codes with one scale per vector, the
   norms of vector and rounding error, and the vectors themselves.
2. Every block of queries meets every block of candidates in a tile. The product of the codes
   gives each inner product up to a bound made of the norms. What the bounds leave among the
   best ``k`` is computed again from the vectors, in double precision, and the best ``k`` per
   query go on as a sorted list.
3. The lists of a query are merged by a heap.

The search is exact. Rows of a tile share a group of candidate blocks (a stripe), so a query
block is sent once per stripe, and its tile bounds get tighter as the stripe goes on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseflux.lineage import cut_lineage

#: Vectors of a block, blocks of candidates that meet the same query block in one task.
BLOCK = 2048
STRIPE = 8
#: Dimensions whose products of codes are summed in single precision: 127 * 127 * 1024 < 2^24,
#: so these sums are exact.
CODE_DIMS = 1024
#: Pairs that are computed again at once.
PAIRS = 1 << 17


def usable(vector: str):
    """The vector as doubles where it may take part: no null, no non-finite part, not all zero."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine & F.exists(v, lambda x: x != 0), v)


def _packed(ids: np.ndarray, vectors: np.ndarray) -> dict:
    """Codes with scale, norm of the vector, norm of what rounding changed."""
    top = np.abs(vectors).max(axis=1)
    # Scaled before it is rounded, so that very small and very large parts stay finite.
    codes = np.rint(vectors / top[:, None] * 127).astype(np.int8)
    scale = top / 127
    with np.errstate(over="ignore"):
        norms = top * np.sqrt(np.square(vectors / top[:, None]).sum(axis=1))
        wrong = top * np.sqrt(np.square(vectors / top[:, None] - codes / 127).sum(axis=1))
    return {
        "ids": ids.astype("<i8").tobytes(),
        "codes": codes.tobytes(),
        "sizes": np.stack([scale, norms, wrong]).astype("<f8").tobytes(),
        "vectors": vectors.astype("<f8").tobytes(),
    }


class _Block:
    def __init__(self, ids: bytes, codes: bytes, sizes: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        n = len(self.ids)
        self.codes = np.frombuffer(codes, np.int8).reshape(n, -1).astype(np.float32)
        self.scale, self.norm, self.wrong = np.frombuffer(sizes, "<f8").reshape(3, n)
        self.vectors = np.frombuffer(vectors, "<f8").reshape(n, -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of codes, in any number of dimensions."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], CODE_DIMS):
        out += a[:, d : d + CODE_DIMS] @ b[:, d : d + CODE_DIMS].T
    return out


def blocks(vectors: DataFrame, size: int, out: str) -> DataFrame:
    """Rows (id, vector) of one length packed into blocks of at most ``size``, each inside a
    partition; the length of the vectors goes with the block."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def full(dim: int, ids: list, rows: list) -> pa.RecordBatch:
            made = _packed(np.concatenate(ids), np.concatenate(rows))
            names = ["dim", *made]
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32())] + [pa.array([v], pa.binary()) for v in made.values()], names=names
            )

        waiting: dict[int, tuple[list, list]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lists = batch.column(1)
            flat = lists.flatten().to_numpy()
            lengths = lists.value_lengths().to_numpy()
            starts = np.cumsum(lengths) - lengths
            for dim in np.unique(lengths):
                own = np.flatnonzero(lengths == dim)
                rows = flat[starts[own][:, None] + np.arange(dim)]
                held = waiting.setdefault(int(dim), ([], []))
                for a in range(0, len(own), size):
                    held[0].append(ids[own[a : a + size]])
                    held[1].append(rows[a : a + size])
                    if sum(map(len, held[0])) >= size:
                        yield full(int(dim), *held)
                        held = waiting[int(dim)] = ([], [])
        for dim, held in waiting.items():
            if held[0]:
                yield full(dim, *held)

    packed = vectors.mapInArrow(pack, "dim int, ids binary, codes binary, sizes binary, vectors binary")
    return cut_lineage(packed.withColumn(out, F.monotonically_increasing_id()))


def _exact(q: np.ndarray, x: np.ndarray, qi: np.ndarray, xi: np.ndarray) -> np.ndarray:
    """Inner products of pairs, part by part, so that equal vectors get equal numbers."""
    out = np.zeros(len(qi))
    for d in range(q.shape[1]):
        out += q[qi, d] * x[xi, d]
    return out


class Best:
    """The best ``k`` so far of every query of a block."""

    def __init__(self, block: _Block, k: int):
        self.block, self.k = block, k
        n = len(block.ids)
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max)

    def meet(self, x: _Block) -> None:
        q, k = self.block, self.k
        with np.errstate(over="ignore", invalid="ignore"):
            about = _products(q.codes, x.codes) * q.scale[:, None] * x.scale[None, :]
            # |q.x - about| <= |q| |x - x'| + |q - q'| |x'|, and some rounding of sums.
            off = q.norm[:, None] * x.wrong[None, :] + q.wrong[:, None] * (x.norm + x.wrong)[None, :]
            off += 1e-12 * q.norm[:, None] * x.norm[None, :]
            high, low = about + off, about - off
        high[np.isnan(high)], low[np.isnan(low)] = np.inf, -np.inf
        own = q.ids[:, None] == x.ids[None, :]
        high[own] = low[own] = -np.inf
        least = self.scores[:, -1]
        if low.shape[1] > k:
            least = np.maximum(least, np.partition(low, low.shape[1] - k, axis=1)[:, -k])
        qi, xi = np.nonzero((high >= least[:, None]) & ~own)
        edges = np.searchsorted(qi, np.arange(len(q.ids) + 1))
        a = 0
        while a < len(q.ids):
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + PAIRS, "right")) - 1)
            self._take(x, a, b, qi[edges[a] : edges[b]], xi[edges[a] : edges[b]])
            a = b

    def _take(self, x: _Block, a: int, b: int, qi: np.ndarray, xi: np.ndarray) -> None:
        k = self.k
        rows = np.r_[np.repeat(np.arange(a, b), k), qi]
        scores = np.r_[self.scores[a:b].ravel(), _exact(self.block.vectors, x.vectors, qi, xi)]
        ids = np.r_[self.ids[a:b].ravel(), x.ids[xi]]
        order = np.lexsort((ids, -scores, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(a, b))[rows - a]
        best = order[place < k]
        self.scores[a:b], self.ids[a:b] = scores[best].reshape(-1, k), ids[best].reshape(-1, k)


def nearest(
    df: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    query_every: int = 20,
    block: int = BLOCK,
    stripe: int = STRIPE,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: for every row whose id is
    divisible by ``query_every``, the ``k`` other rows of largest inner product, nearest first,
    ties to the smaller id; all others, if fewer.

    Vectors that are null, zero, or hold nulls or non-finite parts take no part, nor do rows
    without an id. Only vectors of one length are compared. A row is never its own neighbour;
    equal rows count once, and vectors that share an id are never neighbours. An empty table gives an empty one; other columns are not read.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), usable(vector_col).alias("vector"))
    rows = rows.where("id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    rows = cut_lineage(rows.dropDuplicates(["id", "vector"]))
    stripes = blocks(rows, block, "block")
    # Query blocks by a hash of the id, so that they fill up; the rows are a twentieth.
    asked = rows.where(F.col("id") % query_every == 0)
    n = asked.count()
    parts = max(1, -(-n // block))
    asked = blocks(asked.repartition(parts, F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30))), block, "q_block")
    groups = max(1, -(-stripes.count() // stripe))
    stripes = stripes.withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(groups)))
    asked = asked.withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    names = ["ids", "codes", "sizes", "vectors"]
    tiles = stripes.withColumnsRenamed({n: f"x_{n}" for n in names}).withColumnRenamed("dim", "x_dim")
    wanted = asked.select(F.col("stripe").alias("t_stripe"), F.col("q_block").alias("t_block"))
    tiles = tiles.join(wanted, F.col("stripe") == F.col("t_stripe")).drop("stripe", "block")
    left = asked.groupBy("q_block", "stripe")
    right = tiles.groupBy("t_block", "t_stripe")

    def search(q_rows: pa.Table, x_rows: pa.Table) -> pa.Table:
        q = q_rows.to_pylist()[0]
        best = Best(_Block(*[q[n] for n in names]), k)
        for i in range(x_rows.num_rows):
            if x_rows["x_dim"][i].as_py() == q["dim"]:
                best.meet(_Block(*[x_rows[f"x_{n}"][i].as_py() for n in names]))
        kept = best.scores > -np.inf
        counts = kept.sum(axis=1)
        offsets = pa.array(np.r_[0, np.cumsum(counts)], pa.int32())
        return pa.Table.from_arrays(
            [
                pa.array(best.block.ids),
                pa.ListArray.from_arrays(offsets, pa.array(best.ids[kept])),
                pa.ListArray.from_arrays(offsets, pa.array(best.scores[kept])),
            ],
            names=["query_id", "ids", "scores"],
        )

    lists = left.cogroup(right).applyInArrow(search, "query_id long, ids array<long>, scores array<double>")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by query: the lists of one query come in a row.
        def done(query: int, lists: list) -> tuple[list, list, list, list]:
            seen, first = set(), []
            for score, vec in heapq.merge(*lists):
                if (score, vec) in seen:
                    continue
                seen.add((score, vec))
                first.append((-score, vec))
                if len(first) == k:
                    break
            return [query] * len(first), list(range(1, len(first) + 1)), [f[1] for f in first], [f[0] for f in first]

        held, lists, out = None, [], ([], [], [], [])
        for batch in batches:
            for query, ids, scores in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if query != held and lists:
                    for a, b in zip(out, done(held, lists), strict=True):
                        a.extend(b)
                    lists = []
                held = query
                lists.append([(-s, i) for s, i in zip(scores, ids, strict=True)])
            if len(out[0]) > 50_000:
                yield _rows(out)
                out = ([], [], [], [])
        if lists:
            for a, b in zip(out, done(held, lists), strict=True):
                a.extend(b)
        yield _rows(out)

    ordered = lists.repartition("query_id").sortWithinPartitions("query_id")
    return ordered.mapInArrow(merge, "query_id long, rank int, vec_id long, score double")


def _rows(out: tuple[list, list, list, list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
    names = ["query_id", "rank", "vec_id", "score"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
