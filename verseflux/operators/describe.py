"""Count, mean, standard deviation and exact quantiles of numeric columns at any size."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verseflux.functions.stats import numeric

QUARTILES = (0.25, 0.5, 0.75)
#: Bits of a key that one pass settles; four passes settle a double.
DIGIT = 16


@dataclass
class _Rank:
    """The value with ``rank`` values before it: what is known of its key, and how many values
    have a smaller one."""

    feature: int
    rank: int
    prefix: int = 0
    below: int = 0


def describe_features(
    df: DataFrame, features: list[str], quantiles: tuple[float, ...] = QUARTILES
) -> DataFrame:
    """``(feature, n, mean, std, lowest, q25, q50, q75, highest)``, missing values skipped.

    Quantiles interpolate linearly between neighbours and are exact. The built-in exact
    percentile gathers all values of a column in one buffer, so it is not used. Instead, the
    values are selected digit by digit: doubles as 64-bit keys of the same order, sixteen bits
    a pass, for all ranks of all columns at once. A pass reads only ``features``, a task counts
    digits in tables of fixed size, and what is shuffled is their sum; the number of passes does
    not depend on the values.
    """
    slim = numeric(df, features)
    base = _moments(slim, features)
    counts = {r["feature"]: r["n"] for r in base.select("feature", "n").collect()}
    places = [(i, f, q, q * (counts[f] - 1)) for i, f in enumerate(features) for q in quantiles if counts[f]]
    ranks: dict[tuple[int, int], _Rank] = {}
    for i, f, _, place in places:
        for r in (math.floor(place), min(math.floor(place) + 1, counts[f] - 1)):
            ranks.setdefault((i, r), _Rank(i, r))
    for level in range(64 // DIGIT):
        _settle(slim, list(ranks.values()), level)
    found = {key: _value(r.prefix) for key, r in ranks.items()}
    rows: dict[str, dict[float, float]] = {f: {} for f in features}
    for i, f, q, place in places:
        near, share = found[i, math.floor(place)], place - math.floor(place)
        far = found[i, min(math.floor(place) + 1, counts[f] - 1)]
        rows[f][q] = near + (far - near) * share if share > 0 else near
    names = [f"q{round(q * 100):02d}" for q in quantiles]
    schema = ", ".join(["feature string", *[f"{n} double" for n in names]])
    values = [(f, *[own.get(q) for q in quantiles]) for f, own in rows.items()]
    table = slim.sparkSession.createDataFrame(values, schema)
    return base.join(F.broadcast(table), "feature", "left").select(  # a row per feature
        "feature", "n", "mean", "std", "lowest", *names, "highest"
    )


def _keys(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles; zeros are one value."""
    bits = (x + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _value(key: int) -> float:
    bits = key & ~(1 << 63) if key >> 63 else ~key & (2**64 - 1)
    return float(np.uint64(bits).view(np.float64))


def _settle(slim: DataFrame, ranks: list[_Rank], level: int) -> None:
    """Find the next digit of every rank's key: one pass over the columns."""
    if not ranks:
        return
    left = np.uint64(64 - DIGIT * (level + 1))
    wanted: dict[int, list[int]] = {}
    for feature, prefix in sorted({(r.feature, r.prefix) for r in ranks}):
        wanted.setdefault(feature, []).append(prefix)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {(f, p): np.zeros(1 << DIGIT, np.int64) for f, own in wanted.items() for p in own}
        for batch in batches:
            for f, own in wanted.items():
                heads = _keys(batch.column(f).drop_null().to_numpy()) >> left
                for p in own:
                    digits = heads if level == 0 else heads[heads >> np.uint64(DIGIT) == np.uint64(p)]
                    tables[f, p] += np.bincount((digits & np.uint64((1 << DIGIT) - 1)).astype(np.int64), minlength=1 << DIGIT)
        for (f, p), table in tables.items():
            some = np.flatnonzero(table)
            place = np.full(len(some), number[f, p], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(place), pa.array(some.astype(np.int32)), pa.array(table[some])], names=["place", "digit", "n"]
            )

    number = {key: k for k, key in enumerate((f, p) for f, own in wanted.items() for p in own)}
    sums = slim.mapInArrow(count, "place int, digit int, n long").groupBy("place", "digit").agg(F.sum("n").alias("n"))
    # At most 2^16 digits per place.
    upto = F.sum("n").over(Window.partitionBy("place").orderBy("digit"))
    asked = [(k, number[r.feature, r.prefix], r.rank - r.below) for k, r in enumerate(ranks)]
    asked = slim.sparkSession.createDataFrame(asked, "k int, place int, rank long")
    met = sums.withColumn("upto", upto).join(F.broadcast(asked), "place")  # a row per rank
    for row in met.where("upto - n <= rank AND rank < upto").select("k", "digit", (F.col("upto") - F.col("n")).alias("less")).collect():
        r = ranks[row["k"]]
        r.prefix, r.below = r.prefix << DIGIT | row["digit"], r.below + row["less"]


def _moments(slim: DataFrame, features: list[str]) -> DataFrame:
    def stat(f: str):
        return F.struct(
            F.count(f).alias("n"),
            F.avg(f).alias("mean"),
            F.stddev_samp(f).alias("std"),
            F.min(f).alias("lowest"),
            F.max(f).alias("highest"),
        ).alias(f)

    wide = slim.agg(*[stat(f) for f in features])
    return wide.unpivot([], features, "feature", "s").select("feature", "s.*")
