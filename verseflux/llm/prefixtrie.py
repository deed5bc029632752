"""Prefix trie of conversations in a node table addressed by a minimal perfect hash.

1. Turns are numbered and conversations rebuilt without a group per conversation: turns are
   sorted by ranges, a run is what one range holds of one conversation, and what a run must know
   of the runs before it (turns, digest) is summed over one row per run.
2. The digest of a prefix is the exclusive or of the digests of its (place, turn): a run gives
   its part on its own, and a parent's digest is the prefix's without its last turn.
3. Distinct prefix digests are the nodes. They are enumerated together with parent, depth and
   the digest of the last turn, so that two prefixes are never taken for one by chance.
4. Sums over subtrees: a node's own numbers belong to its smallest member, and the paths of
   conversations, in pieces of ``PIECE`` turns, are dealt to shards. A shard gives each distinct
   digest a slot by a minimal perfect hash (every slot holds its digest, and every look-up is
   compared with it), scatters the numbers into flat arrays, and adds them up through an array
   of parent slots, deepest first. As a shard has the whole path of its pieces, the sums of all
   shards add up to the sums over subtrees; what deeper pieces of a path hold enters a piece at
   its last turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseflux.lineage import cut_lineage

#: Turns of a piece of a path, and rows of a shard on average.
PIECE = 1024
SHARD_ROWS = 200_000
#: Members whose ids are joined to one text before they are hashed.
ID_RUN = 4096
#: Turns of the head that a conversation may take over, at most.
MOST_HEAD = 8

_NODE = ["p1", "p2"]


def _mix(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    h = a ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64((level * 0xD6E8FEB86659FD93) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class PerfectHash:
    """Slots 0 to n - 1 for n distinct keys of two 64-bit numbers.

    Every level has a bit for each place that exactly one of its keys falls on; the other keys
    go on to the next level. A slot is the rank of its bit over all levels. The keys are stored
    by slot, and ``find`` compares them: -1 for a key that has no slot.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        used, rest = 0, np.arange(len(a))
        while len(rest):
            size = max(64, 2 * len(rest))
            at = (_mix(a[rest], b[rest], len(self.levels)) % np.uint64(size)).astype(np.int64)
            bits = np.bincount(at, minlength=size) == 1
            self.levels.append((bits, used + np.cumsum(bits) - 1))
            used += int(bits.sum())
            rest = rest[~bits[at]]
        self.a = self.b = np.zeros(0, np.uint64)
        slots = self._slots(a, b)
        self.a, self.b = np.zeros(used, np.uint64), np.zeros(used, np.uint64)
        self.a[slots], self.b[slots] = a, b

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.full(len(a), -1)
        rest = np.arange(len(a))
        for level, (bits, ranks) in enumerate(self.levels):
            at = (_mix(a[rest], b[rest], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[rest[hit]] = ranks[at[hit]]
            rest = rest[~hit]
        return out

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slots = self._slots(a, b)
        if not len(self.a):
            return slots
        right = (slots >= 0) & (self.a[slots] == a) & (self.b[slots] == b)
        return np.where(right, slots, -1)


def subtree_sums(
    depth: np.ndarray,
    node: tuple[np.ndarray, np.ndarray],
    parent: tuple[np.ndarray, np.ndarray],
    own: np.ndarray,
    piece: int,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests (two arrays) of the distinct nodes and the sums of ``own`` (a row per number) over
    the subtree of each, as far as its piece goes and these rows tell."""
    order = np.lexsort(node[::-1])
    first = np.r_[True, (node[0][order][1:] != node[0][order][:-1]) | (node[1][order][1:] != node[1][order][:-1])]
    some = order[first[: len(order)]]
    table = PerfectHash(node[0][some], node[1][some])
    slots = table.find(*node)
    up = np.full(len(some), -1)
    level = np.zeros(len(some), np.int64)
    here = table.find(node[0][some], node[1][some])
    up[here] = table.find(parent[0][some], parent[1][some])
    level[here] = depth[some]
    up[level % piece == 0] = -1  # nothing leaves a piece here: it enters the next as a number
    sums = np.zeros((len(own), len(some)), np.int64)
    for k, numbers in enumerate(own):
        np.add.at(sums[k], slots, numbers)
    deepest = np.argsort(-level, kind="stable")
    edges = np.flatnonzero(np.r_[True, np.diff(level[deepest]) != 0, True]) if len(some) else np.zeros(0, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        children = deepest[a:b]
        children = children[up[children] >= 0]
        for k in range(len(own)):
            np.add.at(sums[k], up[children], sums[k][children])
    return table.a, table.b, sums


def _numbered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Turns with their place (from 1) in their conversation, and a row per conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    said = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    turns = df.select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        F.unhex(F.substring(said, 1, 32)).alias("said"),
        F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row"),
    ).where("conv IS NOT NULL")
    # Ranges of rows, not conversations, go to a task, however long one conversation is.
    turns = turns.repartitionByRange("conv", F.col("turn").asc_nulls_first(), "said", "row")
    turns = cut_lineage(turns.withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("conv", "range").orderBy(F.col("turn").asc_nulls_first(), "said", "row")
    turns = turns.select("conv", "range", "said", "bytes", F.row_number().over(inside).alias("at"))
    runs = cut_lineage(turns.groupBy("conv", "range").agg(F.count("*").alias("n")))
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("conv", "range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    turns = turns.join(starts, ["conv", "range"]).withColumn("at", F.col("at") + F.col("start")).drop("start")
    return turns, runs.groupBy("conv").agg(F.sum("n").alias("n"))


def _paths(turns: DataFrame, convs: DataFrame, group: int, head_mod: int) -> DataFrame:
    """Every prefix of every rebuilt conversation: ``conv``, ``depth``, digests of the prefix
    and of its parent, digest and bytes of its last turn, whether the conversation ends there."""
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % group)
    convs = convs.withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % head_mod)
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = convs.withColumn("length", F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = cut_lineage(convs.select("conv", "base", "h", "head", "length"))
    kept = ["conv", "range", "depth", "said", "bytes", "length"]
    tails = turns.join(convs, "conv").where("at > h").withColumn("depth", F.col("at") - F.col("h") + F.col("head"))
    # At most MOST_HEAD turns of a base, and 2 * group - 1 conversations that take them.
    heads = turns.where(f"conv % {group} = 0 AND at <= {head_mod - 1}").select(F.col("conv").alias("base"), "at", "said", "bytes")
    heads = heads.join(convs, "base").where("at <= h").withColumn("depth", F.col("at")).withColumn("range", F.lit(-1))
    rows = heads.select(*kept).unionByName(tails.select(*kept))
    rows = rows.withColumn("e1", F.xxhash64("depth", "said")).withColumn("e2", F.xxhash64("said", "depth"))
    rows = cut_lineage(rows)
    so_far = Window.partitionBy("conv", "range").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    runs = rows.groupBy("conv", "range").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    for x in ("x1", "x2"):
        runs = runs.withColumn(f"b{x}", F.coalesce(F.bit_xor(x).over(earlier), F.lit(0)))
    rows = rows.withColumn("l1", F.bit_xor("e1").over(so_far)).withColumn("l2", F.bit_xor("e2").over(so_far))
    rows = rows.join(runs.select("conv", "range", "bx1", "bx2"), ["conv", "range"])
    rows = rows.withColumn("p1", F.col("l1").bitwiseXOR(F.col("bx1"))).withColumn("p2", F.col("l2").bitwiseXOR(F.col("bx2")))
    rows = rows.select(
        "conv",
        F.col("depth").cast("long").alias("depth"),
        "p1",
        "p2",
        F.col("p1").bitwiseXOR(F.col("e1")).alias("q1"),
        F.col("p2").bitwiseXOR(F.col("e2")).alias("q2"),
        "said",
        "bytes",
        (F.col("depth") == F.col("length")).alias("ends"),
    )
    roots = convs.selectExpr(
        "conv", "0L AS depth", "0L AS p1", "0L AS p2", "0L AS q1", "0L AS q2",
        "CAST(NULL AS binary) AS said", "0L AS bytes", "length = 0 AS ends",
    )
    return cut_lineage(rows.unionByName(roots))


def _ends(paths: DataFrame) -> DataFrame:
    """Digest of the ids of the conversations that end at a node, in ascending order. Ids are
    joined in runs by ranges; one task then reads the runs of a node one after the other."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, ids = (c.to_numpy() for c in batch.columns)
            cuts = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(a)]
            starts = np.flatnonzero(cuts)
            starts = np.concatenate([np.arange(s, e, ID_RUN) for s, e in zip(starts, np.r_[starts[1:], len(a)], strict=True)]) if len(a) else starts
            text = [",".join(map(str, ids[s:e].tolist())) for s, e in zip(starts, np.r_[starts[1:], len(a)], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[starts]), pa.array(b[starts]), pa.array(ids[starts]), pa.array(text, pa.string())],
                names=["p1", "p2", "first", "ids"],
            )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sha = None, None
        out: tuple[list, list, list] = ([], [], [])

        def close() -> None:
            for column, value in zip(out, (*held, sha.hexdigest()), strict=True):
                column.append(value)

        for batch in batches:
            for a, b, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if held == (a, b):
                    sha.update(b"," + ids.encode())
                else:
                    if held is not None:
                        close()
                    held, sha = (a, b), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)
            out = ([], [], [])
        if held is not None:
            close()
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    names, kinds = ["p1", "p2", "ends_sha256"], [pa.int64(), pa.int64(), pa.string()]
    ids = paths.where("ends").select("p1", "p2", "conv")
    ids = ids.repartitionByRange("p1", "p2", "conv").sortWithinPartitions("p1", "p2", "conv")
    runs = ids.mapInArrow(join, "p1 long, p2 long, first long, ids string")
    runs = runs.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first")
    return runs.mapInArrow(digest, "p1 long, p2 long, ends_sha256 string")


def _subtrees(paths: DataFrame, nodes: DataFrame, piece: int, shard_rows: int) -> DataFrame:
    """Childless nodes and saved bytes in the subtree of every node."""
    shards = max(1, -(-paths.count() // shard_rows))
    part = F.expr(f"depth div {piece}")
    own = nodes.select("conv", "depth", *_NODE, "q1", "q2", "leaf", "saved")
    steps = paths.selectExpr("conv", "depth", "p1", "p2", "q1", "q2", "0L AS leaf", "0L AS saved")
    # What lies deeper on a path than a piece reaches enters the piece with its last turn.
    totals = own.groupBy("conv", part.alias("part")).agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    lasts = steps.where(f"depth % {piece} = {piece - 1}").withColumn("part", part)
    deeper = Window.partitionBy("conv").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    both = lasts.select("conv", "part", "leaf", "saved").unionByName(totals.select("conv", "part", "leaf", "saved"))
    both = both.groupBy("conv", "part").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    both = both.select("conv", "part", F.sum("leaf").over(deeper).alias("leaf"), F.sum("saved").over(deeper).alias("saved"))
    entering = lasts.drop("leaf", "saved").join(both, ["conv", "part"]).where("leaf > 0 OR saved > 0").drop("part")
    rows = steps.unionByName(own).unionByName(entering)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("conv", part), F.lit(shards))).drop("conv")

    def add(shard: pa.Table) -> pa.Table:
        depth, p1, p2, q1, q2, leaf, saved = (
            shard[n].to_numpy() for n in ("depth", "p1", "p2", "q1", "q2", "leaf", "saved")
        )
        unsigned = lambda x: x.view(np.uint64)
        a, b, sums = subtree_sums(
            depth, (unsigned(p1), unsigned(p2)), (unsigned(q1), unsigned(q2)), np.stack([leaf, saved]), piece
        )
        some = (sums != 0).any(axis=0)
        return pa.table({"p1": a[some].view(np.int64), "p2": b[some].view(np.int64), "leaf": sums[0][some], "saved": sums[1][some]})

    sums = rows.groupBy("shard").applyInArrow(add, "p1 long, p2 long, leaf long, saved long")
    return sums.groupBy(*_NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def conversation_trie(
    df: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    group: int = 5,
    head_mod: int = MOST_HEAD + 1,
    piece: int = PIECE,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """The trie of rebuilt conversations, a row per node: ``conv_id``, ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``.

    Conversation c takes the first crc32(c) % ``head_mod`` turns from conversation
    c - c % ``group`` (remainders have the sign of c), and goes on with its own turns after
    these places. Turns are ordered by ``turn_col``, nulls first, and turns with equal numbers by
    the digest of role and text; a row that is repeated is a turn each time. Null roles and texts
    are empty; rows without a conversation take no part. An empty table has no node. Other
    columns are not read.
    """
    turns, convs = _numbered(df, conv_col, turn_col, role_col, text_col)
    paths = _paths(turns, convs, group, head_mod)
    nodes = paths.groupBy("depth", *_NODE, "q1", "q2", "said", "bytes").agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs")
    )
    children = nodes.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    nodes = cut_lineage(nodes.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).drop("said", "bytes"))
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv").alias("parent"))
    nodes_up = nodes.join(parents, ["q1", "q2"], "left")
    done = nodes_up.join(_subtrees(paths, nodes, piece, shard_rows), _NODE, "left").join(_ends(paths), _NODE, "left")
    return done.select(
        F.col("conv").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
