"""Removal of repeated substrings by suffix arrays over grouped candidates.

A window is a string of ``length`` bytes. Two equal windows hold equal byte n-grams, so both
choose the same one by the smallest hash, their anchor; windows that follow each other mostly
choose the same one. A run of windows with one anchor is a segment.

1. All segments, as numbers: hash of the anchor, hash of all bytes of the run and the anchor's
   place in it. Anchors that stand once in the corpus drop out: their windows are unique.
2. Segments that are equal as a whole are repeats, all their windows; nothing more is read.
3. Where one anchor has different segments, one of each kind is fetched and cut into blocks of
   ``BLOCK`` bytes from the anchor to both sides. Buckets of such segments get a suffix array
   over blocks (``lyndon``). Suffixes that begin at blocks and agree as far as a window can
   reach are neighbours there; with the bytes before the block they give each window's answer.
   An anchor with more than ``HOT`` different segments (a passage in very many documents) is
   not put into one bucket: its windows are counted by 128-bit digests, of those block suffixes
   only whose common part is repeated at all.
4. What repeated windows cover is cut out of each document.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseflux.lineage import checkpoint_dir, cut_lineage
from verseflux.llm.common import add_arrow, id_or_last, texts, without
from verseflux.llm.lyndon import suffix_array
from verseflux.llm.nearcopies import mix64
from verseflux.llm.records import remove_folder

LENGTH = 200
ANCHOR = 40
BLOCK = 16
HOT = 1000
#: Bytes of segments per bucket, about.
BUCKET = 2_000_000
#: Bytes whose anchors are found at once; windows of a longer text go on in the next piece.
_PIECE = 700_000
_PLACE_BITS = 20
_BASE = 0x9E3779B97F4A7C15


class Anchors:
    def __init__(self, length: int, anchor: int):
        self.length, self.anchor = length, anchor
        n = 1 << _PLACE_BITS
        inverse = pow(_BASE, -1, 1 << 64)
        self.powers = np.cumprod(np.r_[np.uint64(1), np.full(n, _BASE, np.uint64)])
        self.inverses = np.cumprod(np.r_[np.uint64(1), np.full(n, inverse, np.uint64)])
        self.spread = mix64(np.arange(256, dtype=np.uint64) + np.uint64(_BASE))

    def __call__(self, pieces: list[bytes]):
        """Segments of all pieces: number of the piece, hash of the anchor, hash of the whole,
        first and last window, anchor; places count from the beginning of the piece."""
        length, g = self.length, self.anchor
        sizes = np.array([len(p) for p in pieces], np.int64)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        if n < length:
            return None
        starts = np.cumsum(sizes) - sizes
        sums = np.r_[np.uint64(0), np.cumsum(self.spread[data] * self.powers[:n])]
        hashes = mix64((sums[g:] - sums[:-g]) * self.inverses[: n - g + 1])
        places = np.arange(len(hashes), dtype=np.uint64)
        low = np.uint64((1 << _PLACE_BITS) - 1)
        keys = (hashes & ~low) | places
        # Smallest key of each run of w: the end of one block's minima and the start of the next.
        w = length - g + 1
        whole = np.r_[keys, np.full((-len(keys)) % w, np.iinfo(np.uint64).max, np.uint64)].reshape(-1, w)
        front = np.minimum.accumulate(whole, axis=1).ravel()
        back = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
        m = n - length + 1
        chosen = (np.minimum(back[:m], front[w - 1 : w - 1 + m]) & low).astype(np.int64)
        owner = np.repeat(np.arange(len(pieces)), sizes)
        inside = owner[:m] == owner[length - 1 :]
        new = np.r_[True, (chosen[1:] != chosen[:-1]) | (owner[1:m] != owner[: m - 1])]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], m] - 1
        # A piece's windows end before its own end: cut the last run, drop runs outside.
        last = np.minimum(last, starts[owner[first]] + sizes[owner[first]] - length)
        good = inside[first]
        first, last = first[good], last[good]
        at = chosen[first]
        bytes_ = mix64((sums[last + length] - sums[first]) * self.inverses[first])
        whole_hash = mix64(bytes_ + ((at - first) * 1024 + (last - first)).astype(np.uint64))
        own = owner[first]
        return own, hashes[at], whole_hash, first - starts[own], last - starts[own], at - starts[own]


def _pieces(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    if len(text) >= length:
        for a in range(0, len(text) - length + 1, _PIECE):
            yield a, text[a : a + _PIECE + length - 1]


def segments(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """``doc``, ``anchor`` and ``whole`` (hashes), ``first``, ``last``, ``at`` (places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Anchors(length, anchor)
        names = ["doc", "anchor", "whole", "first", "last", "at"]

        def found(docs: list[int], offsets: list[int], group: list[bytes]) -> Iterator[pa.RecordBatch]:
            made = finder(group)
            if made is not None:
                own, hashes, whole, first, last, at = made
                shift = np.array(offsets, np.int64)[own]
                columns = [np.array(docs, np.int64)[own], hashes.view(np.int64), whole.view(np.int64)]
                columns += [(c + shift).astype(np.int32) for c in (first, last, at)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for batch in batches:
            ids, offsets, group, size = [], [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                for a, piece in _pieces(text, length):
                    if group and size + len(piece) > _PIECE + length:
                        yield from found(ids, offsets, group)
                        ids, offsets, group, size = [], [], [], 0
                    ids.append(doc)
                    offsets.append(a)
                    group.append(piece)
                    size += len(piece)
            if group:
                yield from found(ids, offsets, group)

    return docs.mapInArrow(run, "doc long, anchor long, whole long, first int, last int, at int")


def repeated_windows(rows: list[tuple[bytes, int, int, int, bool]], length: int) -> list[tuple[int, np.ndarray]]:
    """For every row (bytes of a segment from its first window on, place of the last window, of
    the anchor, unused, whether it is asked for): row number and repeated window places."""
    symbols, lefts, valid = [], [], []  # blocks of all segments in a row
    where: list[tuple[int, int]] = []
    blocks: list[bytes] = []
    for r, (data, _, at, _, _) in enumerate(rows):
        begin = at % BLOCK
        cut = [data[k : k + BLOCK] for k in range(begin, len(data), BLOCK)]
        where.append((len(symbols) + len(blocks), begin))
        blocks.extend(cut)
        blocks.append(b"")
    n = len(blocks)
    sizes = np.fromiter(map(len, blocks), np.int64, n)
    table = np.frombuffer(b"".join(b.ljust(BLOCK, b"\0") for b in blocks), np.uint8).reshape(n, BLOCK)
    # Numbers of blocks in the order of their bytes; the end marks are smaller, later ones more so.
    keys = np.concatenate([table, sizes.astype(np.uint8)[:, None]], axis=1)
    raw = np.ascontiguousarray(keys).view(np.dtype((np.void, BLOCK + 1))).ravel()
    rank = np.unique(raw, return_inverse=True)[1].astype(np.int64)
    marks = np.flatnonzero(sizes == 0)
    rank += len(marks)
    rank[marks] = np.arange(len(marks))[::-1]
    order = np.array(suffix_array("".join(map(chr, rank.tolist()))), np.int64)
    # Common bytes of neighbours, as far as a window can tell.
    a, b = order[:-1], order[1:]
    common = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    padded = np.r_[rank, np.full(length // BLOCK + 2, -1)]
    for k in range(length // BLOCK + 1):
        same = (padded[a[live] + k] == padded[b[live] + k]) & (sizes[np.minimum(a[live] + k, n - 1)] == BLOCK)
        stop = live[~same]
        x, y = np.minimum(a[stop] + k, n - 1), np.minimum(b[stop] + k, n - 1)
        differ = table[x] != table[y]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), BLOCK)
        common[stop] = k * BLOCK + np.minimum(shared, np.minimum(sizes[x], sizes[y]))
        live = live[same]
    common[live] = length + BLOCK
    # Suffixes that some window ends in front of: block and row; bytes before it.
    row = np.repeat(np.arange(len(rows)), np.diff(np.r_[[w[0] for w in where], n]))
    inner = np.arange(n) - np.array([w[0] for w in where])[row]
    place = inner * BLOCK + np.array([w[1] for w in where])[row]  # of the block, from the first window
    last = np.array([x[1] for x in rows])[row]
    usable = (sizes > 0) & (place - BLOCK < last + 1)
    before = np.zeros((n, BLOCK - 1), np.uint8)
    for i in np.flatnonzero(usable):
        p = int(place[i])
        piece = rows[row[i]][0][max(0, p - BLOCK + 1) : p][::-1]
        before[i, : len(piece)] = np.frombuffer(piece, np.uint8)
    asked = np.array([x[4] for x in rows])
    found: dict[int, list[np.ndarray]] = {}
    use = usable[order]
    for left in range(BLOCK):
        # Runs of suffixes that agree on the window's bytes from the block on.
        run = np.r_[0, np.cumsum(common < length - left)]
        fine = use & (place[order] - left >= 0) & (place[order] - left <= last[order])
        members, runs = order[fine], run[fine]
        if not len(members):
            continue
        several = np.bincount(runs)[runs] > 1
        members, runs = members[several], runs[several]
        if not len(members):
            continue
        front = np.zeros((len(members), 16), np.uint8)
        front[:, :left] = before[members, :left]
        parts = front.view(np.uint64)
        sort = np.lexsort((parts[:, 1], parts[:, 0], runs))
        r, f = runs[sort], parts[sort]
        same = (r[1:] == r[:-1]) & (f[1:] == f[:-1]).all(axis=1)
        twice = np.r_[False, same] | np.r_[same, False]
        hit = members[sort[twice]]
        hit = hit[asked[row[hit]]]
        if len(hit):
            for x, p in zip(row[hit].tolist(), (place[hit] - left).tolist(), strict=True):
                found.setdefault(x, []).append(p)
    return [(x, np.unique(ps)) for x, ps in found.items()]


def _spans(places: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Covered spans of windows at ascending places."""
    gap = np.flatnonzero(np.diff(places) > length) if len(places) else []
    first = places[np.r_[0, np.array(gap, np.int64) + 1]]
    last = places[np.r_[np.array(gap, np.int64), len(places) - 1]]
    return list(zip(first.tolist(), (last + length).tolist(), strict=True))


def _in_buckets(fetched: DataFrame, buckets: int, length: int) -> DataFrame:
    def search(table: pa.Table) -> pa.Table:
        docs, first = table["doc"].to_pylist(), table["first"].to_pylist()
        data = texts(table["data"].combine_chunks())
        last, at, asked = table["last"].to_pylist(), table["at"].to_pylist(), table["alone"].to_pylist()
        rows = [(d, b - a, c - a, 0, q) for d, a, b, c, q in zip(data, first, last, at, asked, strict=True)]
        out: list[tuple[int, int, int]] = []
        for r, places in repeated_windows(rows, length):
            out.extend((docs[r], first[r] + a, first[r] + b) for a, b in _spans(places, length))
        return pa.table({n: pa.array([o[i] for o in out], t) for i, (n, t) in enumerate([("doc", pa.int64()), ("begin", pa.int64()), ("end", pa.int64())])})

    bucket = F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket")
    rows = fetched.select(bucket, "doc", "first", "last", "at", "alone", "data")
    return rows.groupBy("bucket").applyInArrow(search, "doc long, begin long, end long")


def _by_windows(fetched: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many segments, by digests of windows."""

    def digest(data: bytes) -> bytes:
        return blake2b(data, digest_size=16).digest()

    def grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            columns = [batch.column(n).to_pylist() for n in ("doc", "first", "last", "at", "alone", "copies")]
            for doc, first, last, at, alone, copies, data in zip(*columns, texts(batch.column("data")), strict=True):
                for p in range((at - first) % BLOCK, last - first + BLOCK, BLOCK):
                    low, high = max(0, p - BLOCK + 1), min(p, last - first)
                    if low <= high:
                        core = data[p : low + length] if p - low == BLOCK - 1 else data[p : p + length - BLOCK + 1]
                        row = (doc, first + low, high - low + 1, alone, copies, digest(core[: length - BLOCK + 1]), data[low : high + length])
                        for a, b in zip(out, row, strict=True):
                            a.append(b)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary(), pa.binary()]
            names = ["doc", "begin", "n", "alone", "copies", "core", "data"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for r in batch.to_pylist():
                for k in range(r["n"]):
                    for a, b in zip(out, (r["doc"], r["begin"] + k, r["alone"], r["copies"], digest(r["data"][k : k + length])), strict=True):
                        a.append(b)
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc", "begin", "alone", "copies", "key"])

    cells = cut_lineage(fetched.mapInArrow(grid, "doc long, begin long, n long, alone boolean, copies long, core binary, data binary"))
    cores = cells.groupBy("core").agg(F.count("*").alias("times")).where("times > 1").select(F.col("core").alias("c"))
    cells = cells.join(cut_lineage(cores), F.col("core") == F.col("c")).drop("c", "core")
    cells = cut_lineage(cells.withColumn("same", F.sha2("data", 256)))
    # Cells that are equal as a whole are repeats; one of them goes on, as a partner for others.
    kinds = cells.groupBy("same").agg(
        F.min(F.struct("doc", "begin")).alias("one"), F.sum("copies").alias("all"), F.count("*").alias("cells")
    )
    kinds = cut_lineage(kinds.select(F.col("same").alias("s"), F.col("one.doc").alias("d"), F.col("one.begin").alias("b"), "all", "cells"))
    equal = kinds.where("cells > 1").select("s")
    whole = cells.where("alone").join(equal, F.col("same") == F.col("s"))
    whole = whole.select("doc", "begin", (F.col("begin") + F.col("n") - 1 + length).alias("end"))
    single = (F.col("same") == F.col("s")) & (F.col("doc") == F.col("d")) & (F.col("begin") == F.col("b"))
    ones = cells.join(kinds, single).select(
        "doc", "begin", "n", (F.col("alone") & (F.col("cells") == 1)).alias("alone"), F.col("all").alias("copies"), "data"
    )
    keys = cut_lineage(ones.mapInArrow(windows, "doc long, begin long, alone boolean, copies long, key binary"))
    twice = keys.groupBy("key").agg(F.sum("copies").alias("times")).where("times > 1").select(F.col("key").alias("k"))
    hits = keys.where("alone").join(cut_lineage(twice), F.col("key") == F.col("k"))
    return whole.unionByName(hits.select("doc", "begin", (F.col("begin") + length).alias("end")))


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared checkpoint folder, which takes less room there than a
    checkpoint and is read by columns."""
    folder = f"{checkpoint_dir(df.sparkSession)}/substrings-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder), folder


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, hot: int = HOT) -> DataFrame:
    """``doc``, ``begin``, ``end`` (bytes) of what repeated windows cover; spans may overlap.
    ``docs``: ``doc`` (a number of its own for every id and text) and ``text``."""
    spark = docs.sparkSession
    all_, folder = _written(segments(docs, length, anchor))
    # Written out, so that the join deals both sides anew and hot anchors can be split.
    twice = all_.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select(F.col("anchor").alias("a"))
    twice, anchors = _written(twice)
    some, _ = _written(all_.join(twice, F.col("anchor") == F.col("a")).drop("a"))
    remove_folder(spark, folder)
    remove_folder(spark, anchors)
    kinds = some.groupBy("anchor", "whole").agg(
        F.count("*").alias("copies"), F.min(F.struct("doc", "first", "last", "at")).alias("one")
    )
    kinds = cut_lineage(kinds.select("anchor", "whole", "copies", "one.*"))
    equal = kinds.where("copies > 1").select(F.col("anchor").alias("a"), F.col("whole").alias("w"))
    full = some.join(equal, (F.col("anchor") == F.col("a")) & (F.col("whole") == F.col("w")))
    full = full.select("doc", F.col("first").cast("long").alias("begin"), (F.col("last") + length).cast("long").alias("end"))
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("copies").alias("fewest"))
    groups = groups.where("kinds > 1 AND fewest = 1").select(F.col("anchor").alias("a"), "kinds")
    wanted = kinds.join(groups, F.col("anchor") == F.col("a")).select(
        F.col("doc").alias("d"), "anchor", "first", "last", "at", (F.col("copies") == 1).alias("alone"),
        "copies", (F.col("kinds") > hot).alias("hot"),
    )
    wanted = cut_lineage(wanted)
    total = wanted.where("NOT hot").agg(F.coalesce(F.sum(F.col("last") - F.col("first") + length), F.lit(0))).first()[0]
    plain = docs.withColumn("bytes", F.col("text").cast("binary"))
    fetched = plain.join(wanted.hint("shuffle_hash"), F.col("doc") == F.col("d")).select(
        "doc", "anchor", "first", "last", "at", "alone", "copies", "hot",
        F.expr(f"substring(bytes, first + 1, last - first + {length})").alias("data"),
    )
    fetched, _ = _written(fetched)
    found = _in_buckets(fetched.where("NOT hot"), max(1, -(-total // BUCKET)), length)
    spans = found.unionByName(_by_windows(fetched.where("hot"), length)).unionByName(full)
    return spans


def _cut(column: pa.Array, spans: pa.Array) -> dict[str, pa.Array]:
    sizes, removed, numbers, kept = [], [], [], []
    for text, own in zip(texts(column), spans.to_pylist(), strict=True):
        runs: list[list[int]] = []
        for s in sorted((x["begin"], x["end"]) for x in own or ()):
            if runs and s[0] <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], s[1])
            else:
                runs.append([*s])
        rest, at = [], 0
        for a, b in runs:
            rest.append(text[at:a])
            at = b
        rest.append(text[at:])
        sizes.append(len(text))
        removed.append(sum(b - a for a, b in runs))
        numbers.append(len(runs))
        kept.append(b"".join(rest))
    return {
        "n_bytes": pa.array(sizes, pa.int64()),
        "n_removed": pa.array(removed, pa.int64()),
        "n_spans": pa.array(numbers, pa.int64()),
        "kept_bytes": pa.array(kept, pa.binary()),
    }


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_bytes``.

    Of every text as UTF-8, each byte goes that is covered by a string of ``length`` bytes that
    also starts anywhere else, in the same text or another; all copies go, and strings are
    judged on the input. Matches never cross texts. Null and empty texts have no bytes; texts
    shorter than ``length`` stay. Rows that repeat id and text are copies of each other and go
    whole; null ids are like any id. What stays may split a character, so it is binary. An
    empty table gives an empty one; columns named like a result are replaced.
    """
    added = ["n_bytes", "n_removed", "n_spans", "kept_bytes"]
    numbered = F.xxhash64(id_or_last(id_col), F.coalesce(F.col(text_col), F.lit("")))
    docs = df.select(numbered.alias("doc"), F.col(text_col).alias("text"))
    spans = repeated_spans(docs, length)
    lists = spans.groupBy(F.col("doc").alias("__of")).agg(F.collect_list(F.struct("begin", "end")).alias("__spans"))
    rows = without(df, added).withColumn("__doc", numbered)
    rows = rows.join(lists.hint("shuffle_hash"), F.col("__doc") == F.col("__of"), "left").drop("__doc", "__of")
    return add_arrow(rows, [text_col, "__spans"], "n_bytes long, n_removed long, n_spans long, kept_bytes binary", _cut)
