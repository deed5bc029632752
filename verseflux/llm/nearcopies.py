"""Near copies by an LSH forest, confirmed on full sets of word shingles.

1. Every text becomes its set of shingle hashes, a fingerprint of the set, and a signature of
   ``TREES`` x ``DEPTH`` minima. Texts with equal sets are one class from here on.
2. Each tree sorts the classes by their signature from its own ``DEPTH`` minima on, by ranges of
   rows. Neighbours in the order have the longest common prefixes: they are candidates if they
   share the tree's own minima, and with one minimum less where the region of that prefix is
   small, so the depth follows the region. All that share a tree's minima are neighbours of
   neighbours, however many they are; a pair at the limit of 0.8 shares some tree's minima but
   for three pairs in a million.
3. Candidates only say which classes must be looked at together: classes that are connected by
   them are compared exactly, all with all, on full sets. A connected group of more than
   ``TILE`` shingles is cut into blocks of like sizes; blocks whose sizes allow a link meet in
   tiles, and a tile gives a spanning forest of its links, not its pairs.
4. Components of the links. Classes are the nodes, numbered on their own; ids only name the
   components and choose the row that stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseflux.lineage import cut_lineage
from verseflux.llm.common import NO_ID, id_or_last, texts
from verseflux.llm.graph import components

TREES = 24
DEPTH = 4
#: Classes of a region that is looked at with one minimum less.
REGION = 8
#: Shingles of a tile's side, at most (a longer text is a side of its own).
TILE = 100_000
#: Classes of sizes: each reaches 5 % beyond the one before.
SIZE_STEP = 1.05
_GROUP = 1_000_000


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sets of hashes of the texts' word shingles, A-Z in lower case, words cut at white space."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, width: int):
        self.width = width
        self.powers = self.inverses = np.ones(1, np.uint64)

    def words(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        n = len(data)
        if len(self.powers) <= n:
            inverse = pow(self.BASE, -1, 1 << 64)
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, self.BASE, np.uint64)])
            self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(2 * n, inverse, np.uint64)])
        inside = (data != 32) & ((data < 9) | (data > 13))
        data = np.where((data >= 65) & (data <= 90), data + 32, data)
        edge = np.diff(np.r_[False, inside].view(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        # Bytes are spread before they are summed, so that a word is no plain polynomial.
        spread = mix64(data.astype(np.uint64) + np.uint64(self.BASE))
        sums = np.r_[np.uint64(0), np.cumsum(spread * self.powers[:n])]
        hashes = mix64((sums[end] - sums[begin]) * self.inverses[begin] + (end - begin).astype(np.uint64))
        closes = np.cumsum([len(t) + 1 for t in texts])
        return hashes, np.diff(np.r_[0, np.searchsorted(begin, closes)])

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        """Per text, the sorted set; a text of fewer words than a shingle is one shingle."""
        group, size = [], 0
        for t in texts:
            if group and size + len(t) > _GROUP:
                yield from self._sets(group)
                group, size = [], 0
            group.append(t)
            size += len(t) + 1
        if group:
            yield from self._sets(group)

    def _sets(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        words, counts = self.words(texts)
        w = self.width
        rows = np.zeros(max(0, len(words) - w + 1), np.uint64)
        for k in range(w):
            rows = mix64(rows * np.uint64(3) + words[k : k + len(rows)])
        at = 0
        for n in counts:
            if n >= w:
                yield np.unique(rows[at : at + n - w + 1])
            elif n:
                one = np.full(1, np.uint64(n))
                for k in range(n):
                    one = mix64(one * np.uint64(5) + words[at + k : at + k + 1])
                yield one
            else:
                yield rows[:0]
            at += n


class MinHash:
    def __init__(self, n: int):
        rng = np.random.default_rng(11)
        self.masks = rng.integers(0, 1 << 32, (n, 1), np.uint32)
        self.factors = rng.integers(0, 1 << 31, (n, 1), np.uint32) * np.uint32(2) + np.uint32(1)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        base = (shingles >> np.uint64(32)).astype(np.uint32)[None]
        best = None
        for a in range(0, base.shape[1], 2048):
            x = (base[:, a : a + 2048] ^ self.masks) * self.factors
            low = x.min(axis=1)
            best = low if best is None else np.minimum(best, low)
        # The order of the minima is all that counted; mixed, their 16 upper bits tell them apart.
        best = (best ^ (best >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        return ((best ^ (best >> np.uint32(12))) >> np.uint32(16)).astype(np.uint16)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """``id``, ``hash`` (of the text), ``n`` (size of the set), ``print`` (fingerprint), ``signature``; nulls if empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minhash = Shingler(width), MinHash(TREES * DEPTH)
        for batch in batches:
            sizes, prints, signatures = [], [], []
            for s in shingler(texts(batch.column(1))):
                sizes.append(len(s))
                prints.append(blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(minhash(s).astype(">u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(signatures, pa.binary())],
                names=["id", "hash", "n", "print", "signature"],
            )

    return docs.select("id", "text", "hash").mapInArrow(run, "id long, hash long, n long, print binary, signature binary")


def orders(classes: DataFrame) -> DataFrame:
    """``tree``, ``head`` (the tree's own minima), ``rest`` (those of the next tree), ``node``
    (number of the class): a row per tree, which sorts the classes by their signature from its
    own minima on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u8").reshape(batch.num_rows, TREES)
            rows = rows.astype(np.uint64).view(np.int64)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(rows), t, np.int8)),
                        pa.array(np.ascontiguousarray(rows[:, t])),
                        pa.array(np.ascontiguousarray(rows[:, (t + 1) % TREES])),
                        batch.column(0),
                    ],
                    names=["tree", "head", "rest", "node"],
                )

    return classes.select("node", "signature").mapInArrow(run, "tree byte, head long, rest long, node long")


def neighbours(tree: np.ndarray, head: np.ndarray, region: int) -> np.ndarray:
    """Places of the sorted rows that are candidates of the row before them.

    The row before is the neighbour of the longest common prefix on that side. It is a candidate
    if both share the ``DEPTH`` minima of the head, however many rows do. Where they share one
    minimum less, the region of that prefix counts if it holds at most ``region`` rows; a region
    that reaches the end of the given rows may be larger and does not.
    """
    same_tree = np.r_[False, tree[1:] == tree[:-1]]
    deep = same_tree & np.r_[False, head[1:] == head[:-1]]
    upper = head >> 16  # a minimum has 16 bits
    shallow = same_tree & np.r_[False, upper[1:] == upper[:-1]]
    starts = np.flatnonzero(~shallow)
    lengths = np.diff(np.r_[starts, len(tree)])
    small = lengths <= region
    small[[0, -1]] = False
    return np.flatnonzero(deep | shallow & np.repeat(small, lengths))


def candidates(rows: DataFrame, region: int) -> DataFrame:
    """Links (a, b) of classes that are neighbours in some tree's order.

    The orders are sorted by ranges, so that a region of any size spreads over several tasks; the
    first row of a range meets the last one of the range before it.
    """
    keys = ["tree", "head", "rest", "node"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [[c.to_numpy() for c in batch.columns] for batch in batches if batch.num_rows]  # one range
        if not whole:
            return
        part, tree, head, node = (np.concatenate(c) for c in zip(*whole, strict=True))
        at = neighbours(tree, head, region)
        ends = [0, len(node) - 1]
        out = [np.r_[node[at], node[ends]], np.r_[node[at - 1], [-1, -2]]]
        extra = [np.r_[np.zeros(len(at), np.int64), x[ends]] for x in (part.astype(np.int64), tree.astype(np.int64), head)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*out, *extra)], names=["a", "b", "part", "tree", "head"])

    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = ordered.select(F.spark_partition_id().alias("part"), "tree", "head", "node")
    found = cut_lineage(ordered.mapInArrow(run, "a long, b long, part long, tree long, head long"))
    # Two rows per range: its first (b = -1) and its last one (b = -2).
    before = Window.orderBy("part", F.col("b").desc())
    edges = found.where("b < 0").withColumns({n: F.lag(c).over(before) for n, c in (("l", "a"), ("t", "tree"), ("h", "head"), ("s", "b"))})
    handed = edges.where("b = -1 AND s = -2 AND t = tree AND h = head").select("a", F.col("l").alias("b"))
    return found.where("b >= 0").select("a", "b").union(handed).where("a <> b").distinct()


def spanning_links(ids: list[int], sets: list[np.ndarray], sides: np.ndarray | None, percent: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the graph of all pairs with
    100 x intersection >= percent x union; with ``sides``, of pairs from different sides."""
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    values = np.unique(np.concatenate(sets), return_inverse=True)[1]
    starts = np.cumsum(sizes) - sizes
    mark = np.zeros(int(values.max()) + 1, bool)
    waiting = np.arange(n)  # not reached yet
    found: list[tuple[int, int]] = []
    queue: list[int] = []
    done = np.zeros(n, bool)
    while len(waiting) or queue:
        if not queue:
            first, waiting = int(waiting[0]), waiting[1:]
            if done[first]:
                continue
            done[first] = True
            queue.append(first)
        a = queue.pop()
        waiting = waiting[~done[waiting]]
        own = sizes[waiting]
        fits = (100 * np.minimum(own, sizes[a]) >= percent * np.maximum(own, sizes[a]))
        if sides is not None:
            fits &= sides[waiting] != sides[a]
        columns = waiting[fits]
        if not len(columns):
            continue
        own = sizes[columns]
        ends = np.cumsum(own)
        gather = np.repeat(starts[columns] - (ends - own), own) + np.arange(int(ends[-1]))
        mine = values[starts[a] : starts[a] + sizes[a]]
        mark[mine] = True
        shared = np.add.reduceat(mark[values[gather]].astype(np.int32), ends - own)
        mark[mine] = False
        linked = columns[100 * shared >= percent * (own + sizes[a] - shared)]
        for b in linked:
            found.append((ids[a], ids[int(b)]))
        done[linked] = True
        queue.extend(linked.tolist())
    return found


def confirm(groups: DataFrame, docs: DataFrame, width: int, percent: int, tile: int) -> DataFrame:
    """Confirmed links (a, b) of nodes. ``groups``: ``node``, ``n``, ``component`` of the
    candidates, and ``id`` and ``hash`` of a row of ``docs`` that has the text; only one has both."""
    totals = groups.groupBy("component").agg(F.sum("n").alias("total"))
    groups = cut_lineage(groups.join(totals, "component"))
    # Small groups share tiles, several at once; their number follows the shingles in all.
    whole = groups.where(F.col("total") <= tile)
    all_small = whole.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    bundles = max(1, math.ceil(all_small / tile))
    small = whole.select(
        "node", "id", "hash", "component", F.pmod(F.xxhash64("component"), F.lit(bundles)).alias("tile"), F.lit(-1).cast("long").alias("pair"), F.lit(0).alias("side")
    )
    large = groups.where(F.col("total") > tile)
    large = large.withColumn("class", F.floor(F.log(F.col("n").cast("double")) / math.log(SIZE_STEP)))
    counts = large.groupBy("component", "class").agg(F.sum("n").alias("in_class"), F.max("n").alias("longest"))
    # At least half full blocks of at most a tile, but for texts that are longer.
    counts = counts.withColumn("parts", F.ceil(F.lit(2) * F.col("in_class") / F.greatest(F.lit(tile), F.col("longest"))))
    large = large.join(counts.select("component", "class", "parts"), ["component", "class"])
    large = cut_lineage(large.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).select("node", "id", "hash", "component", "class", "part"))
    blocks = counts.select("component", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    reach = math.ceil(math.log(100 / percent) / math.log(SIZE_STEP)) + 1
    other = blocks.select(F.col("component").alias("c2"), F.col("class").alias("class2"), F.col("part").alias("part2"))
    pairs = blocks.join(other, F.col("component") == F.col("c2")).where(
        (F.struct("class", "part") <= F.struct("class2", "part2")) & (F.col("class2") - F.col("class") <= reach)
    )
    pairs = pairs.withColumn("tile", F.xxhash64("component", "class", "part", "class2", "part2"))
    same = (F.col("class") == F.col("class2")) & (F.col("part") == F.col("part2"))
    one = "named_struct('class', class, 'part', part, 'side', {})"
    two = "named_struct('class', class2, 'part', part2, 'side', 1)"
    alone, both = f"array({one.format(-1)})", f"array({one.format(0)}, {two})"
    ends = pairs.withColumn("ends", F.when(same, F.expr(alone)).otherwise(F.expr(both)))
    ends = ends.select("component", "tile", F.inline("ends"))
    big = large.join(ends, ["component", "class", "part"]).select(
        "node", "id", "hash", "component", "tile", F.col("tile").alias("pair"), "side"
    )
    members = cut_lineage(small.unionByName(big))
    named = members.select("node", F.col("id").alias("m"), F.col("hash").alias("h"), "component", "tile", "pair", "side")
    own = (F.col("id") == F.col("m")) & (F.col("hash") == F.col("h"))
    rows = docs.join(named.hint("shuffle_hash"), own).select("node", "text", "component", "tile", "pair", "side")

    def compare(table: pa.Table) -> pa.Table:
        shingler = Shingler(width)
        ids = table["node"].to_pylist()
        sets = list(shingler(texts(table["text"].combine_chunks())))
        sides = np.array(table["side"].to_pylist(), np.int64)
        found: list[tuple[int, int]] = []
        order: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(table["component"].to_pylist(), table["pair"].to_pylist(), strict=True)):
            if len(sets[i]):
                order.setdefault(key, []).append(i)
        for (_, pair), own in order.items():
            two = sides[own] if pair != -1 and (sides[own] >= 0).any() else None
            found += spanning_links([ids[i] for i in own], [sets[i] for i in own], two, percent)
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return rows.groupBy("tile", "pair").applyInArrow(compare, "a long, b long")


def near_copies(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    region: int = REGION,
    tile: int = TILE,
) -> DataFrame:
    """One row per row of ``df``: the id, ``n_shingles``, ``component_id``, ``kept``.

    Two texts are linked if 100 x common shingles >= ``percent`` x all shingles of both, by
    sets of ``width`` words, A-Z in lower case; a text of fewer words is one shingle. The
    component is named by the smallest id that can be reached; ``kept`` is its own row. Null and
    empty texts, and texts without words, have no shingles and are linked with nothing. A null
    id is larger than all others and names no component (one of null ids alone is null, and one
    row of it stays). Rows that repeat an id are judged by their own texts; of different texts
    with the smallest id one stays. An empty table gives an empty one; other
    columns are not read. ``region`` is the largest region that is looked at with a prefix of one
    minimum less; regions of the whole prefix are looked at whatever their size.
    """
    docs, sketched = _sketched(df, id_col, text_col, width)
    out = _named(sketched, docs, width, percent, tile, region)
    return out.select(
        F.when(F.col("id") != NO_ID, F.col("id")).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(F.col("component") != NO_ID, F.col("component")).alias("component_id"),
        "kept",
    )


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """``df`` without the rows that ``near_copies`` does not keep; of equal rows with one id one
    stays. Rows without an id whose texts have no words all stay."""
    docs, sketched = _sketched(df, id_col, text_col, width)
    out = _named(sketched, docs, width, percent, TILE, REGION)
    gone = out.where("NOT text_kept").select(F.col("id").alias("__id"), F.col("hash").alias("__h")).distinct()
    marked = df.withColumn("__key", id_or_last(id_col)).withColumn("__hash", F.xxhash64(text_col))
    if _repeats(sketched.where((F.col("n") > 0) | (F.col("id") != NO_ID))):
        words = F.coalesce(F.col(text_col).rlike(r"[^\x09-\x0d\x20]"), F.lit(False))
        alone = F.when((F.col("__key") == NO_ID) & ~words, F.monotonically_increasing_id())
        marked = marked.withColumn("__alone", alone).dropDuplicates(["__key", "__hash", "__alone"])
    same = (F.col("__key") == F.col("__id")) & (F.col("__hash") == F.col("__h"))
    return marked.join(gone.hint("shuffle_hash"), same, "left_anti").drop("__key", "__hash", "__alone")


def _sketched(df: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """``id``, ``text``, ``hash`` of the rows, and their sketches, written and with a ``row`` number."""
    docs = df.select(id_or_last(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    return docs, cut_lineage(sketches(docs, width).withColumn("row", F.monotonically_increasing_id()))


def _repeats(sketched: DataFrame) -> bool:
    """Whether an id stands with the same text more than once."""
    return not sketched.groupBy("id", "hash").count().where("count > 1").isEmpty()


def _named(sketched: DataFrame, docs: DataFrame, width: int, percent: int, tile: int, region: int) -> DataFrame:
    """``sketched`` with ``component`` (the smallest id of the texts that are linked), ``text_kept``
    (whether the row's text is the one that stays under its id) and ``kept``.

    Of a component the smallest (id, print, hash) stays, and all its rows if it has an id: they are
    one document. Without an id its first row stays.
    """
    some = sketched.where("n > 0")
    if _repeats(some):
        docs = docs.dropDuplicates(["id", "hash"])
    classes = some.groupBy("print").agg(F.min(F.struct("id", "hash", "row", "n", "signature")).alias("first"))
    # Numbers of classes hold once they are written.
    classes = cut_lineage(classes.select("print", "first.*", F.monotonically_increasing_id().alias("node")))
    looked = components(candidates(orders(classes), region)).withColumnRenamed("node", "m")
    groups = looked.join(classes, F.col("node") == F.col("m")).select("node", "id", "hash", "n", "component")
    links = cut_lineage(confirm(groups, docs, width, percent, tile))
    joined = components(links).select(F.col("node").alias("m"), "component")
    named = classes.join(joined, F.col("node") == F.col("m"), "left").withColumn("group", F.coalesce("component", "node"))
    named = cut_lineage(named.select("print", "id", "hash", "row", "group"))
    stays = named.groupBy("group").agg(F.min(F.struct("id", "print", "hash", "row")).alias("stays"))
    named = named.select(F.col("print").alias("of"), "group").join(stays, "group").drop("group")
    out = sketched.join(named, F.col("print") == F.col("of"), "left")
    own = (F.col("id") == F.col("stays.id")) & (F.col("print") == F.col("stays.print")) & (F.col("hash") == F.col("stays.hash"))
    text_kept = F.col("stays").isNull() | own
    kept = F.col("stays").isNull() | own & ((F.col("id") != NO_ID) | (F.col("row") == F.col("stays.row")))
    component = F.coalesce("stays.id", "id")
    return out.select("id", "hash", "n", component.alias("component"), text_kept.alias("text_kept"), kept.alias("kept"))
