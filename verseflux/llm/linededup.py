"""Line dedup: two Bloom filters find suspected repeats, which alone shuffle for exact choice.

1. Every task fills two filters of its own, of the line keys it has seen once and of those it
   has seen again, and sends them in compressed slices. Slices are merged by OR; what two tasks
   have in "once" is put into "again". So a task sends some bits per key, and no hash. The size
   of the filters follows the number of lines, up to ``bits``, whatever the input.
2. The merged seen-again filter (at most 2**``bits`` / 8 bytes) is broadcast. Only keys that it
   holds are suspected; of these, 128-bit digests shuffle for the exact count of documents and
   the smallest id. Where the filter fills up, more keys are suspected and the result is the same.
3. What each document loses is joined to it by id, and its lines are written again.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verseflux.lineage import cut_lineage
from verseflux.llm.common import SPACES, add_arrow, id_or_last, texts, without

#: The most bits of each filter, as a power of two; 2**28 bits are 32 MB, the most that is broadcast.
FILTER_BITS = 28
#: Bits for each line that may have a key; probes for each key.
BITS_PER_KEY = 16
PROBES = 3
#: Filters travel in slices of so many bits, as a power of two, or whole where they are smaller.
SLICE_BITS = 18
MIN_POINTS = 10


def line_key(line: bytes) -> bytes:
    """The line without outer white space, A-Z in lower case."""
    return line.strip(SPACES).lower()


def _long_enough(key: bytes, points: int) -> bool:
    return len(key) >= points and (len(key) >= 4 * points or len(key.decode("utf-8", "replace")) >= points)


def document_keys(text: bytes, min_points: int) -> set[bytes]:
    keys = map(line_key, text.split(b"\n"))
    return {k for k in keys if _long_enough(k, min_points)}


def _hashes(keys) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))


def _places(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each hash in a filter of 2**``bits``."""
    out, rest = [], hashes
    for i in range(PROBES):
        rest = rest * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * i + 1)
        out.append((rest >> np.uint64(64 - bits)).astype(np.int64))
        rest ^= rest >> np.uint64(32)
    return out


def _held(filter_: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    found = np.ones(len(places[0]), bool)
    for p in places:
        found &= (filter_[p >> 3] >> (p & 7).astype(np.uint8) & 1).astype(bool)
    return found


def _put(filter_: np.ndarray, places: list[np.ndarray]) -> None:
    for p in places:
        np.bitwise_or.at(filter_, p >> 3, (1 << (p & 7)).astype(np.uint8))


def _pack(part: np.ndarray) -> bytes | None:
    return zlib.compress(part.tobytes(), 1) if part.any() else None


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8)


def filter_size(docs: DataFrame, most: int, min_points: int) -> int:
    """Bits of a filter for all keys, as a power of two: a key takes a line of ``min_points`` or more."""
    length = F.length("text")
    lines = length - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1
    keys = docs.agg(F.sum(F.least(lines, F.expr(f"CAST(length(text) div {max(1, min_points)} AS INT)")))).first()[0]
    keys = max(1, keys or 0)
    return max(3, min(most, math.ceil(math.log2(BITS_PER_KEY * keys))))


def seen_again(docs: DataFrame, most: int, min_points: int) -> tuple[np.ndarray, int]:
    """The filter of keys that two documents or more may hold, and its size as a power of two."""
    bits = filter_size(docs, most, min_points)
    slice_bytes = 1 << (min(bits, SLICE_BITS) - 3)

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = again = None
        for batch in batches:
            own = [_hashes(k) for t in texts(batch.column(0)) if (k := document_keys(t, min_points))]
            if not own:
                continue
            if once is None:
                once, again = np.zeros(1 << (bits - 3), np.uint8), np.zeros(1 << (bits - 3), np.uint8)
            values, counts = np.unique(np.concatenate(own), return_counts=True)
            places = _places(values, bits)
            repeated = (counts > 1) | _held(once, places)
            _put(once, places)
            _put(again, [p[repeated] for p in places])
        if once is None:
            return
        for k in range(len(once) // slice_bytes):
            part = slice(k * slice_bytes, (k + 1) * slice_bytes)
            if (packed := _pack(once[part])) is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([packed], pa.binary()), pa.array([_pack(again[part])], pa.binary())],
                    names=["slice", "once", "again"],
                )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        again: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, mine, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k not in once:
                    once[k], again[k] = np.zeros(slice_bytes, np.uint8), np.zeros(slice_bytes, np.uint8)
                mine = _unpack(mine)
                again[k] |= once[k] & mine
                once[k] |= mine
                if more is not None:
                    again[k] |= _unpack(more)
        for k, part in again.items():
            if (packed := _pack(part)) is not None:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k], pa.int32()), pa.array([packed], pa.binary())], names=["slice", "again"]
                )

    slices = docs.select("text").mapInArrow(filled, "slice int, once binary, again binary")
    rows = slices.repartition("slice").mapInArrow(merged, "slice int, again binary").collect()
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in rows:
        out[r["slice"] * slice_bytes : (r["slice"] + 1) * slice_bytes] = _unpack(r["again"])
    return out, bits


def _digest(key: bytes) -> bytes:
    return blake2b(key, digest_size=16).digest()


def repeats_to_drop(docs: DataFrame, bits: int, min_points: int) -> DataFrame:
    """``id`` and ``digests`` of the keys whose lines this document loses."""
    sc = docs.sparkSession.sparkContext
    filter_, size = seen_again(docs, bits, min_points)
    again = sc.broadcast(filter_)
    del filter_

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = again.value
        for batch in batches:
            ids, keys = [], []
            for i, t in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                own = document_keys(t, min_points)
                ids.extend([i] * len(own))
                keys.extend(own)
            if not keys:
                continue
            kept = np.flatnonzero(_held(filter_, _places(_hashes(keys), size)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[k] for k in kept], pa.int64()), pa.array([_digest(keys[k]) for k in kept], pa.binary())],
                names=["id", "digest"],
            )

    suspects = cut_lineage(docs.select("id", "text").mapInArrow(suspected, "id long, digest binary"))
    holders = suspects.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    # Written out, so that the join below deals both sides anew and hot digests can be split.
    repeated = cut_lineage(holders.where("first < last").select(F.col("digest").alias("key"), "first"))
    lost = suspects.join(repeated, (F.col("digest") == F.col("key")) & (F.col("id") > F.col("first")))
    return lost.groupBy("id").agg(F.collect_set("digest").alias("digests"))


def _rewrite(column: pa.Array, lost: pa.Array) -> dict[str, pa.Array]:
    totals, dropped, kept = [], [], []
    for text, digests in zip(texts(column), lost.to_pylist(), strict=True):
        lines = text.split(b"\n")
        totals.append(len(lines))
        if digests:
            gone = set(digests)
            rest = [x for x in lines if _digest(line_key(x)) not in gone]
            dropped.append(len(lines) - len(rest))
            text = b"\n".join(rest)
        else:
            dropped.append(0)
        kept.append(text)
    return {
        "n_lines": pa.array(totals, pa.int64()),
        "n_dropped": pa.array(dropped, pa.int64()),
        "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
    }


def dedup_lines(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = FILTER_BITS, min_points: int = MIN_POINTS
) -> DataFrame:
    """``df`` with ``n_lines``, ``n_dropped`` and ``kept_text``.

    A line's key is the line without outer white space, A-Z in lower case. A key of at least
    ``min_points`` code points that two or more ids hold loses all its lines but those of the
    smallest id. A null or empty text is one empty line and gives an empty text. A null id
    counts as one id that is larger than all others. Rows that repeat an id count as one
    document and lose the same keys. An empty table gives an empty table; columns of ``df``
    with a result's name are replaced.
    """
    names = ["n_lines", "n_dropped", "kept_text"]
    source = without(df, names)
    drops = repeats_to_drop(df.select(id_or_last(id_col).alias("id"), F.col(text_col).alias("text")), bits, min_points)
    drops = drops.select(F.col("id").alias("__id"), F.col("digests").alias("__lost"))
    joined = source.withColumn("__doc", id_or_last(id_col)).join(
        drops.hint("shuffle_hash"), F.col("__doc") == F.col("__id"), "left"
    )
    added = add_arrow(
        joined, [text_col, "__lost"], "n_lines long, n_dropped long, kept_text string", _rewrite
    )
    return added.drop("__doc", "__id", "__lost")
