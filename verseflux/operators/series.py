"""Event rows as signals: numbering, frames and frame statistics, all in SQL.

A signal may hold a large share of all rows, so nothing here sorts, numbers or collects a whole
signal in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_series(
    df: DataFrame,
    signal_col: str,
    order_cols: list[str],
    value_col: str,
    levels: list[Column],
) -> DataFrame:
    """``(signal_id, i, n, x)``: samples numbered from 0 in the given order; n per signal.

    ``levels`` are coarse-to-fine truncations of the order (say day, then minute of ``ts``).
    Rows are counted per finest level; a sample's number is the count before its coarsest
    level, plus the count before each finer level inside it, plus its place in its own level.
    So the largest sorted group is one signal within one finest level. The table is scanned
    twice, once for the counts. Rows without a signal or a level have no place and are left
    out.
    """
    names = [f"_l{i}" for i in range(len(levels))]
    order = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order_cols)]
    finest = ["signal_id", *names]
    # The filters that the joins below would infer, each on its own branch, are stated here for
    # all branches, so that the counts are one shared shuffle.
    rows = df.select(
        F.col(signal_col).alias("signal_id"),
        *order,
        F.col(value_col).cast("double").alias("x"),
        *[level.alias(name) for level, name in zip(levels, names, strict=True)],
    ).where(" AND ".join(f"{k} IS NOT NULL" for k in finest))
    counts = rows.groupBy(*finest).agg(F.count(F.lit(1)).alias("_n"))
    starts = _starts(counts, finest)
    place = F.row_number().over(
        Window.partitionBy(*finest).orderBy(*[f"_o{i}" for i in range(len(order))])
    )
    return (
        rows.withColumn("_place", place)
        .join(starts, finest)
        .select("signal_id", (F.col("_start") + F.col("_place") - 1).alias("i"), "n", "x")
    )


def _starts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys..., _start, n)``: rows of the signal before each group, and rows of the signal."""
    parent, level = keys[:-1], keys[-1]
    whole = Window.partitionBy(*parent)
    before = whole.orderBy(level).rowsBetween(Window.unboundedPreceding, -1)
    here = counts.select(
        *keys,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        *([F.sum("_n").over(whole).alias("n")] if len(parent) == 1 else []),
    )
    if len(parent) == 1:
        return here
    above = _starts(counts.groupBy(*parent).agg(F.sum("_n").alias("_n")), parent)
    above = above.withColumnRenamed("_start", "_above")
    return here.join(above, parent).select(
        *keys, (F.col("_above") + F.col("_start")).alias("_start"), "n"
    )


def frame_statistics(samples: DataFrame, frame: int, hop: int) -> DataFrame:
    """``(signal_id, frame, size, mean, rms)`` per full frame: frames of ``frame`` samples start
    every ``hop`` samples.

    Every sample enters one pane, whose length divides both ``hop`` and ``frame``; panes are
    summed once and frames are put together from the sums. The length of the signal comes with
    each sample, so frames that would run over its end are never generated. A missing value
    counts in ``size`` only.
    """
    if not 0 < hop <= frame:
        raise ValueError("need 0 < hop <= frame")
    x, width = F.col("x"), math.gcd(frame, hop)
    panes = samples.groupBy("signal_id", "n", F.floor(F.col("i") / width).alias("pane")).agg(
        F.count(F.lit(1)).alias("size"), F.count(x).alias("known"), F.sum(x).alias("s"), F.sum(x * x).alias("q")
    )
    start, n = F.col("pane") * width, F.col("n")
    first = F.greatest(F.lit(0), F.floor((start - frame + hop) / hop))
    last = F.least(F.floor(start / hop), F.floor((n - frame) / hop))
    frames = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    known = F.sum("known").cast("double")
    return (
        panes.select("signal_id", F.explode(frames).alias("frame"), "size", "known", "s", "q")
        .groupBy("signal_id", "frame")
        .agg(
            F.sum("size").alias("size"),
            F.try_divide(F.sum("s"), known).alias("mean"),
            F.sqrt(F.try_divide(F.sum("q"), known)).alias("rms"),
        )
    )


def mean_loudness(samples: DataFrame, frame: int, hop: int) -> DataFrame:
    """``(signal_id, frames, sound_loudness)``: RMS per frame, averaged over the frames."""
    return (
        frame_statistics(samples, frame, hop)
        .groupBy("signal_id")
        .agg(F.count(F.lit(1)).alias("frames"), F.avg("rms").alias("sound_loudness"))
    )


def series_duration(df: DataFrame, signal_col: str, rate: float) -> DataFrame:
    """``(signal_id, n_samples, duration)`` in seconds at ``rate`` samples per second."""
    n = F.count(F.lit(1))
    return df.groupBy(F.col(signal_col).alias("signal_id")).agg(
        n.alias("n_samples"), (n / F.lit(float(rate))).alias("duration")
    )
