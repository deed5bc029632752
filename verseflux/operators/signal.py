"""Signal features from chunks of samples.

A signal is cut into chunks of whole frames. Chunks of one signal overlap as far as frames
do, so each is processed alone; a long signal is spread over many tasks, and a task never
holds more than a chunk of it. Spark adds the pieces up again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verseflux.functions import dsp
from verseflux.functions.text import base_name
from verseflux.lineage import cut_lineage


@dataclass(frozen=True)
class Framing:
    """How signals are cut: sample rate, frame and hop in samples, zero padding by half a
    frame on both ends (``center``), mel bands, and frames per chunk.

    ``tuning`` is the deviation from A440 in semitones that the chroma filters assume; ``None``
    estimates it for each signal.
    """

    rate: float = 22050.0
    frame: int = 2048
    hop: int = 512
    center: bool = True
    bands: int = 128
    chunk_frames: int = 512
    tuning: float | None = None

    def __post_init__(self):
        if not 0 < self.hop <= self.frame:
            raise ValueError("need 0 < hop <= frame")

    @property
    def margin(self) -> int:
        return self.frame // 2 if self.center else 0

    @property
    def chunk_hop(self) -> int:
        return self.chunk_frames * self.hop

    def frames(self, n: int) -> int:
        n += 2 * self.margin
        return (n - self.frame) // self.hop + 1 if n >= self.frame else 0


@dataclass(frozen=True)
class TempoSettings:
    """Autocorrelation window in frames, and the log-normal prior on beats per minute."""

    window: int = 344  # about 8 seconds at 22,050 Hz and hop 512
    start_bpm: float = 120.0
    std_octaves: float = 1.0
    max_bpm: float = 320.0
    chunk_frames: int = 1024


def chunk_arrays(
    signals: DataFrame, framing: Framing, signal_col: str = "signal_id", samples_col: str = "samples"
) -> DataFrame:
    """Signals given as array columns -> ``(signal_id, first_frame, n_frames, samples, tuning,
    peak)``.

    The samples start one frame early (a lead-in) except in the first chunk. No shuffle: a whole
    signal is one row here, so what concerns all of it (``tuning``, ``peak``) is found in the
    row and travels with its chunks.
    """
    f = framing
    signals = _profiled(signals.select(signal_col, samples_col), f)
    x = F.col(samples_col).cast("array<float>")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), f.margin)
    padded = F.concat(zeros, x, zeros) if f.margin else x
    n = F.size(samples_col) + 2 * f.margin
    n_frames = F.greatest(F.lit(0), F.floor((n - f.frame) / f.hop) + 1)
    rows = signals.where(F.size(samples_col) > 0).select(
        F.col(signal_col).alias("signal_id"), padded.alias("_x"), n_frames.alias("n_frames"), "tuning", "peak"
    )
    rows = rows.where("n_frames > 0").withColumn(
        "first_frame",
        F.explode(F.sequence(F.lit(0), F.col("n_frames") - 1, F.lit(f.chunk_frames))),
    )
    lead = F.when(F.col("first_frame") > 0, 1).otherwise(0)
    start = ((F.col("first_frame") - lead) * f.hop + 1).cast("int")
    length = ((f.chunk_frames - 1 + lead) * f.hop + f.frame).cast("int")
    return rows.select(
        "signal_id",
        "first_frame",
        "n_frames",
        F.slice("_x", start, length).alias("samples"),
        "tuning",
        "peak",
    )


def _profiled(signals: DataFrame, framing: Framing) -> DataFrame:
    """Append ``tuning`` and ``peak`` to ``(signal, samples)`` rows."""
    f = framing

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mel = dsp.mel_weights(f.rate, f.frame, f.bands)
        for batch in batches:
            found = []
            for samples in batch.column(1):
                x = np.pad(_as_matrix(samples), f.margin) if samples.is_valid else np.empty(0)
                found.append(dsp.profile(x, f.frame, f.hop, f.rate, mel, f.tuning))
            for i, name in enumerate(("tuning", "peak")):
                batch = batch.append_column(name, pa.array([v[i] for v in found], pa.float64()))
            yield batch

    fields = [f"`{c}` {t}" for c, t in signals.dtypes]
    return signals.mapInArrow(work, ", ".join([*fields, "tuning double", "peak double"]))


def chunk_series(samples: DataFrame, framing: Framing) -> DataFrame:
    """Numbered sample rows (``index_series``) -> the same chunks, without centring and with a
    given tuning.

    A sample goes to the one or two chunks that need it; a group is one chunk.
    """
    f = framing
    if f.center:
        raise ValueError("series are framed without padding; use center=False")
    if f.tuning is None:
        raise ValueError("the tuning of a series is not estimated; give tuning=0.0")
    i, n = F.col("i"), F.col("n")
    n_frames = F.floor((n - f.frame) / f.hop) + 1
    # Chunk c > 0 covers the samples from (c * chunk_frames - 1) * hop on.
    reach = (f.chunk_frames - 1) * f.hop + f.frame
    first = F.greatest(F.lit(0), F.floor((i - reach + f.chunk_hop) / f.chunk_hop))
    last = F.least(
        F.floor((i + f.hop) / f.chunk_hop), F.floor((n_frames - 1) / f.chunk_frames)
    )
    chunks = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "x")))
    return (
        samples.where(n_frames > 0)
        .withColumn("n_frames", n_frames)
        .withColumn("chunk", F.explode(chunks))
        .groupBy("signal_id", "chunk", "n_frames")
        .agg(ordered["x"].cast("array<double>").alias("samples"))
        .select("signal_id", (F.col("chunk") * f.chunk_frames).alias("first_frame"), "n_frames", "samples")
    )


def unframed_arrays(
    signals: DataFrame, framing: Framing, signal_col: str = "signal_id", samples_col: str = "samples"
) -> DataFrame:
    """``(signal_id, reason)`` of the signals that ``chunk_arrays`` makes no chunk of."""
    n = F.coalesce(F.size(samples_col), F.lit(0))
    reason = F.when(n <= 0, "no samples").when(n + 2 * framing.margin < framing.frame, "shorter than a frame")
    rows = signals.select(F.col(signal_col).alias("signal_id"), reason.alias("reason"))
    return rows.where(F.col("reason").isNotNull())


def unframed_series(samples: DataFrame, framing: Framing) -> DataFrame:
    """``(signal_id, reason)`` of the numbered series that ``chunk_series`` makes no chunk of."""
    longest = samples.groupBy("signal_id").agg(F.max("n").alias("n"))
    short = longest.where(F.col("n") < framing.frame)
    return short.select("signal_id", F.lit("shorter than a frame").alias("reason"))


def keep_unframed(features: DataFrame, unframed: DataFrame) -> DataFrame:
    """``features`` with ``reason`` (null), and a row of null features per unframed signal."""
    rows = features.withColumn("reason", F.lit(None).cast("string"))
    return rows.unionByName(unframed, allowMissingColumns=True)


def decode_waveforms(files: DataFrame, framing: Framing) -> DataFrame:
    """Wav files ``(path, content)`` -> chunks, plus one row with ``error`` per bad file.

    Mono mix and resampling to ``framing.rate`` happen here. Columns: ``signal_id`` (base
    name without extension), ``path``, ``duration``, the chunk columns, ``error``.
    """
    f = framing

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mel = dsp.mel_weights(f.rate, f.frame, f.bands)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rate, x = dsp.decode_wav(content.as_py())
                    duration = len(x) / rate
                    x = dsp.resample(x, rate, int(f.rate))
                except Exception as e:  # a bad file is a row, not a failed task
                    yield _row(path, error=f"{type(e).__name__}: {e}")
                    continue
                x = np.pad(x, f.margin)
                n_frames = f.frames(len(x) - 2 * f.margin)
                if n_frames == 0:
                    yield _row(path, duration, error="no samples")
                tuning, peak = dsp.profile(x, f.frame, f.hop, f.rate, mel, f.tuning)
                for first in range(0, n_frames, f.chunk_frames):
                    lead = 1 if first else 0
                    start = (first - lead) * f.hop
                    end = (first + f.chunk_frames - 1) * f.hop + f.frame
                    yield _row(path, duration, first, n_frames, x[start:end], tuning, peak)

    def _row(path, duration=None, first=None, n_frames=None, samples=None, tuning=None, peak=None, error=None):
        samples = None if samples is None else samples.astype(np.float32)
        return pa.RecordBatch.from_pydict(
            {
                "path": pa.array([path], pa.string()),
                "duration": pa.array([duration], pa.float64()),
                "first_frame": pa.array([first], pa.int64()),
                "n_frames": pa.array([n_frames], pa.int64()),
                "samples": pa.array([samples], pa.list_(pa.float32())),
                "tuning": pa.array([tuning], pa.float64()),
                "peak": pa.array([peak], pa.float64()),
                "error": pa.array([error], pa.string()),
            }
        )

    schema = (
        "path string, duration double, first_frame long, n_frames long, "
        "samples array<float>, tuning double, peak double, error string"
    )
    decoded = files.select("path", "content").mapInArrow(decode, schema)
    name = F.regexp_replace(base_name("path"), r"\.[^.]*$", "")
    return decoded.select(name.alias("signal_id"), *decoded.columns)


def wave_spectra(files: DataFrame, framing: Framing) -> DataFrame:
    """Wav files ``(signal_id, content)`` -> ``duration`` and the rows of ``spectral_chunks`` per
    chunk, or one row with an ``error`` per bad file: a file is decoded once, and its samples
    stay in the task that decodes it."""
    f = framing
    arrays = ["rms", "centroid", "note", "timbre", "onset"]
    names = ["duration", "first_frame", "n_frames", *arrays, "peak", "error"]
    kinds = [pa.float64(), pa.int64(), pa.int64(), *[pa.list_(pa.float64())] * 5, pa.float64(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, mel = dsp.hann(f.frame), dsp.mel_weights(f.rate, f.frame, f.bands)
        chroma = lru_cache(maxsize=None)(lambda tuning: dsp.chroma_weights(f.rate, f.frame, tuning))

        def measured(content: bytes | None) -> Iterator[dict]:
            rate, x = dsp.decode_wav(b"" if content is None else content)
            if not len(x):
                raise ValueError("no samples")
            duration = len(x) / rate
            x = np.pad(dsp.resample(x, rate, int(f.rate)).astype(np.float64), f.margin)
            n_frames = f.frames(len(x) - 2 * f.margin)
            if n_frames == 0:
                raise ValueError("shorter than a frame")
            tuning, peak = dsp.profile(x, f.frame, f.hop, f.rate, mel, f.tuning)
            for first in range(0, n_frames, f.chunk_frames):
                lead = 1 if first else 0
                end = (first + f.chunk_frames - 1) * f.hop + f.frame
                frames = dsp.cut_frames(x[(first - lead) * f.hop : end], f.frame, f.hop)
                rms, centroid, note, decibels = dsp.frame_features(frames, f.rate, window, mel, chroma(tuning))
                found = [rms[lead:], centroid[lead:], note[lead:], *dsp.timbre_and_onset(decibels, peak, lead)]
                yield {"duration": duration, "first_frame": first, "n_frames": n_frames, "peak": peak} | dict(zip(arrays, found, strict=True))

        for batch in batches:
            for i in range(batch.num_rows):
                rows: list[dict] = []
                try:
                    rows += measured(batch.column(1)[i].as_py())
                except Exception as e:  # a bad file is a row, not a failed task
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                columns = [pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds, strict=True)]
                ids = batch.column(0).take(pa.array([i] * len(rows)))
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["signal_id", *names])

    plain = files.select("signal_id", "content")
    id_type = plain.schema["signal_id"].dataType.simpleString()
    fields = ", ".join(f"{c} array<double>" for c in arrays)
    return plain.mapInArrow(
        work, f"signal_id {id_type}, duration double, first_frame long, n_frames long, {fields}, peak double, error string"
    )


def wave_features(
    files: DataFrame, framing: Framing, settings: TempoSettings = TempoSettings()
) -> DataFrame:
    """``(signal_id, duration, five features, error)``: one row per wav file ``(signal_id,
    content)``, with features or with the reason why there are none. ``signal_id`` must
    identify the files."""
    spectra = cut_lineage(wave_spectra(files, framing))
    good = spectra.where("error IS NULL").drop("error")
    durations = good.where("first_frame = 0").select("signal_id", "duration")
    found = features_of_spectra(good.drop("duration"), framing, settings).join(durations, "signal_id")
    errors = spectra.where("error IS NOT NULL").select("signal_id", "error")
    rows = found.withColumn("error", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)
    return rows.select(
        "signal_id", "duration", "tempo", "vocal_tone_quality", "sound_brightness", "musical_note_strength", "sound_loudness", "error"
    )


def resample_arrays(
    signals: DataFrame, rate: int, target: int, signal_col: str = "signal_id", samples_col: str = "samples", chunk: int = 65536
) -> DataFrame:
    """Array columns at another rate: ``(signal_id, first, samples)``, a row per ``chunk`` output
    samples; each is made of its own inputs and what the filter needs of their neighbours. Null
    and empty arrays give no row."""
    bank = dsp.Resampler(rate, target)
    n = F.size(samples_col)
    length = F.floor((n * bank.up + bank.down - 1) / bank.down).cast("long")
    rows = signals.select(F.col(signal_col).alias("signal_id"), F.col(samples_col).cast("array<float>").alias("x"), length.alias("length"))
    rows = rows.where("length > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(chunk).cast("long"))))
    rows = rows.withColumn("count", F.least(F.lit(chunk), F.col("length") - F.col("first")))
    # The inputs that the outputs first .. first + count - 1 are made of, cut to the signal.
    low = F.greatest(F.lit(0), F.floor(F.col("first") * bank.down / bank.up) + 1 - bank.reach).cast("int")
    width = F.floor((F.col("count") - 1) * bank.down / bank.up).cast("int") + 2 * bank.reach + 2
    rows = rows.withColumn("at", low).withColumn("x", F.slice("x", low + 1, width))
    id_type = rows.schema["signal_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column("x"), batch.column("at").to_pylist(), batch.column("first").to_pylist(), batch.column("count").to_pylist())
            out = [bank.outputs(_as_matrix(x), at, first, count) for x, at, first, count in zip(*columns, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("signal_id"), batch.column("first"), pa.array(out, pa.list_(pa.float64()))], names=["signal_id", "first", "samples"]
            )

    plain = rows.select("signal_id", "first", "count", "at", "x")
    return plain.mapInArrow(work, f"signal_id {id_type}, first long, samples array<double>")


def _as_matrix(scalar: pa.ListScalar) -> np.ndarray:
    return scalar.values.to_numpy(zero_copy_only=False).astype(np.float64)


def spectral_chunks(chunks: DataFrame, framing: Framing) -> DataFrame:
    """Per chunk, arrays with one entry per frame: ``rms``, ``centroid``, ``note`` and, where the
    chunks carry the ``peak`` of their signal, ``timbre`` and ``onset``.

    Without it, instead: the mel decibels ``mel`` (row by row, lead-in frame first) and their
    largest value ``peak``, for ``timbre_chunks``. The tuning is that of the chunk's row, else
    that of ``framing``.
    """
    f = framing
    whole = "peak" in chunks.columns
    if "tuning" not in chunks.columns:
        chunks = chunks.withColumn("tuning", F.lit(float(f.tuning or 0.0)))
    if not whole:
        chunks = chunks.withColumn("peak", F.lit(None).cast("double"))
    id_type = chunks.schema["signal_id"].dataType.simpleString()
    arrays = ["rms", "centroid", "note", *(["timbre", "onset"] if whole else ["mel"])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = dsp.hann(f.frame)
        mel = dsp.mel_weights(f.rate, f.frame, f.bands)
        # At most one matrix per step of the tuning.
        chroma = lru_cache(maxsize=None)(lambda tuning: dsp.chroma_weights(f.rate, f.frame, tuning))
        for batch in batches:
            out: dict[str, list] = {c: [] for c in (*arrays, "peak")}
            for first, samples, tuning, peak in zip(
                batch.column("first_frame").to_pylist(),
                batch.column("samples"),
                batch.column("tuning").to_pylist(),
                batch.column("peak").to_pylist(),
                strict=True,
            ):
                lead = 1 if first else 0
                frames = dsp.cut_frames(_as_matrix(samples), f.frame, f.hop)
                rms, centroid, note, decibels = dsp.frame_features(
                    frames, f.rate, window, mel, chroma(tuning)
                )
                found = [rms[lead:], centroid[lead:], note[lead:]]
                if whole:
                    found += dsp.timbre_and_onset(decibels, peak, lead)
                else:
                    found += [decibels.ravel()]
                for name, values in zip(arrays, found, strict=True):
                    out[name].append(values)
                out["peak"].append(float(decibels.max()))
            columns = {c: batch.column(c) for c in ("signal_id", "first_frame", "n_frames")}
            for c in arrays:
                columns[c] = pa.array(out[c], pa.list_(pa.float64()))
            columns["peak"] = pa.array(out["peak"], pa.float64())
            yield pa.RecordBatch.from_pydict(columns)

    given = ["signal_id", "first_frame", "n_frames", "samples", "tuning", "peak"]
    fields = ", ".join(f"{c} array<double>" for c in arrays)
    return chunks.select(*given).mapInArrow(
        work, f"signal_id {id_type}, first_frame long, n_frames long, {fields}, peak double"
    )


def frame_table(spectra: DataFrame) -> DataFrame:
    """``(signal_id, frame, rms, centroid, note)``, one row per frame."""
    zipped = F.arrays_zip("rms", "centroid", "note")
    return spectra.select(
        "signal_id", "first_frame", F.posexplode(zipped).alias("_k", "_v")
    ).select("signal_id", (F.col("first_frame") + F.col("_k")).alias("frame"), "_v.*")


def _total(c: str) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x)


def signal_means(spectra: DataFrame) -> DataFrame:
    """``(signal_id, n_frames, sound_brightness, musical_note_strength, sound_loudness, peak)``.

    Chunks are summed inside the row, so one short row per chunk enters the aggregate.
    """
    frames = F.sum(F.size("rms"))
    return spectra.groupBy("signal_id").agg(
        frames.alias("n_frames"),
        (F.sum(_total("centroid")) / frames).alias("sound_brightness"),
        (F.sum(_total("note")) / frames).alias("musical_note_strength"),
        (F.sum(_total("rms")) / frames).alias("sound_loudness"),
        F.max("peak").alias("peak"),
    )


def timbre_chunks(spectra: DataFrame, peaks: DataFrame, framing: Framing) -> DataFrame:
    """Per chunk: ``timbre`` (first cepstral coefficient) and ``onset`` arrays.

    Decibels are floored under the peak of the whole signal, hence the join with ``peaks``
    (one row per signal; broadcast by the planner if its measured size allows, else the
    sort-merge join splits hot signals).
    """
    bands = framing.bands
    id_type = spectra.schema["signal_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            timbres, onsets = [], []
            for first, mel, peak in zip(
                batch.column("first_frame").to_pylist(),
                batch.column("mel"),
                batch.column("peak").to_pylist(),
                strict=True,
            ):
                decibels = _as_matrix(mel).reshape(-1, bands)
                timbre, onset = dsp.timbre_and_onset(decibels, peak, 1 if first else 0)
                timbres.append(timbre)
                onsets.append(onset)
            arrays = {c: batch.column(c) for c in ("signal_id", "first_frame", "n_frames")}
            arrays["timbre"] = pa.array(timbres, pa.list_(pa.float64()))
            arrays["onset"] = pa.array(onsets, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(arrays)

    return (
        spectra.drop("peak")
        .join(peaks.select("signal_id", "peak"), "signal_id")
        .select("signal_id", "first_frame", "n_frames", "mel", "peak")
        .mapInArrow(
            work,
            f"signal_id {id_type}, first_frame long, n_frames long, timbre array<double>, "
            "onset array<double>",
        )
    )


def mean_timbre(timbre: DataFrame) -> DataFrame:
    """``(signal_id, vocal_tone_quality)``."""
    return timbre.groupBy("signal_id").agg(
        (F.sum(_total("timbre")) / F.sum(F.size("timbre"))).alias("vocal_tone_quality")
    )


def onset_envelope(timbre: DataFrame, framing: Framing) -> DataFrame:
    """``(signal_id, frame, n_frames, onset)``: mean rise of the mel decibels since the frame
    before; 0 in the first frame. With centred frames the envelope is moved later by half a
    frame, and what runs over the end is cut."""
    shift = framing.frame // (2 * framing.hop) if framing.center else 0
    rows = timbre.select(
        "signal_id", "first_frame", "n_frames", F.posexplode("onset").alias("_k", "onset")
    ).withColumn("frame", F.col("first_frame") + F.col("_k") + shift)
    return rows.where(F.col("frame") < F.col("n_frames")).select(
        "signal_id", "frame", "n_frames", "onset"
    )


def tempo(
    envelope: DataFrame,
    framing: Framing,
    settings: TempoSettings = TempoSettings(),
    signals: DataFrame | None = None,
) -> DataFrame:
    """``(signal_id, tempo, lag)``: the lag that scores best in autocorrelation and prior.

    ``signals`` has one row ``(signal_id, n_frames)`` per signal; without it the signals are
    those with an envelope.

    Around each frame, a Hann window of the envelope is autocorrelated and scaled to one; the
    results are averaged over the frames. Past its last frame the envelope falls linearly to
    zero over half a window. Windows overlap, so the envelope is cut into overlapping pieces,
    which keeps every group small.
    """
    s = settings
    half, piece = s.window // 2, s.chunk_frames
    id_type = envelope.schema["signal_id"].dataType.simpleString()
    # The tail after the last frame.
    k = F.explode(
        F.when(
            F.col("frame") == F.col("n_frames") - 1, F.sequence(F.lit(0), F.lit(half - 1))
        ).otherwise(F.array(F.lit(0)))
    )
    rows = envelope.where("onset > 0").withColumn("_k", k).select(
        "signal_id",
        "n_frames",
        (F.col("frame") + F.col("_k")).alias("e"),
        (F.col("onset") * (half - F.col("_k")) / half).alias("v"),
    )
    # Piece c holds windows of frames c*piece .. (c+1)*piece - 1: places from c*piece - half on.
    place = F.col("e") + half
    first = F.greatest(F.lit(0), F.floor((place - (piece + s.window - 2) + piece - 1) / piece))
    last = F.least(F.floor(place / piece), F.floor((F.col("n_frames") - 1) / piece))
    pieces = (
        rows.withColumn("_first", first)
        .withColumn("_last", last)
        .where("_first <= _last")
        .withColumn("piece", F.explode(F.sequence("_first", "_last")))
        .groupBy("signal_id", "piece", "n_frames")
        .agg(
            F.collect_list((place - F.col("piece") * piece).cast("int")).alias("places"),
            F.collect_list("v").alias("values"),
        )
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = dsp.hann(s.window)
        for batch in batches:
            sums = []
            for c, n, places, values in zip(
                batch.column("piece").to_pylist(),
                batch.column("n_frames").to_pylist(),
                batch.column("places"),
                batch.column("values"),
                strict=True,
            ):
                own = min(piece, n - c * piece)
                dense = np.zeros(own + s.window - 1)
                at = places.values.to_numpy(zero_copy_only=False)
                fits = at < len(dense)
                dense[at[fits]] = values.values.to_numpy(zero_copy_only=False)[fits]
                windows = dsp.cut_frames(dense, s.window, 1) * window
                sums.append(dsp.local_autocorrelation(windows).sum(axis=0))
            yield pa.RecordBatch.from_pydict(
                {
                    "signal_id": batch.column("signal_id"),
                    "sums": pa.array(sums, pa.list_(pa.float64())),
                }
            )

    sums = pieces.mapInArrow(work, f"signal_id {id_type}, sums array<double>")
    if signals is None:
        signals = envelope.groupBy("signal_id").agg(F.max("n_frames").alias("n_frames"))
    by_lag = (
        sums.select("signal_id", F.posexplode("sums").alias("lag", "v"))
        .groupBy("signal_id", "lag")
        .agg(F.sum("v").alias("v"))
    )
    lags = F.sequence(F.lit(0), F.lit(s.window - 1))
    every = signals.select("signal_id", "n_frames", F.explode(lags).alias("lag"))
    bpm = F.lit(60.0 * framing.rate / framing.hop) / F.col("lag")
    prior = -0.5 * F.pow(F.log2(F.col("bpm") / s.start_bpm) / s.std_octaves, F.lit(2.0))
    strength = F.greatest(F.lit(0.0), F.coalesce("v", F.lit(0.0)) / F.col("n_frames"))
    scored = (
        every.where("lag > 0")
        .join(by_lag, ["signal_id", "lag"], "left")
        .withColumn("bpm", bpm)
        .where(F.col("bpm") < s.max_bpm)
        .withColumn("score", F.log1p(1e6 * strength) + prior)
    )
    best = F.max(F.struct("score", (-F.col("lag")).alias("neg"), "bpm")).alias("best")
    return scored.groupBy("signal_id").agg(best).select(
        "signal_id", F.col("best.bpm").alias("tempo"), (-F.col("best.neg")).alias("lag")
    )


def signal_features(
    chunks: DataFrame, framing: Framing, settings: TempoSettings = TempoSettings()
) -> DataFrame:
    """``(signal_id, tempo, vocal_tone_quality, sound_brightness, musical_note_strength,
    sound_loudness)`` for signals given as chunks.

    Chunks that carry the peak of their signal (files, arrays) take one narrow pass, and only a
    few numbers per frame leave it. For others (series) the spectra are written, their peaks
    aggregated and joined back. What several branches read is written once to the checkpoint
    folder.
    """
    return features_of_spectra(cut_lineage(spectral_chunks(chunks, framing)), framing, settings)


def features_of_spectra(
    spectra: DataFrame, framing: Framing, settings: TempoSettings = TempoSettings()
) -> DataFrame:
    """The same from the rows of ``spectral_chunks`` or ``wave_spectra``, which are read by
    several branches."""
    means = signal_means(spectra)
    timbre = spectra
    if "timbre" not in spectra.columns:
        timbre = cut_lineage(timbre_chunks(spectra, means, framing))
    beats = tempo(onset_envelope(timbre, framing), framing, settings, means)
    return (
        means.join(mean_timbre(timbre), "signal_id")
        .join(beats.select("signal_id", "tempo"), "signal_id")
        .select(
            "signal_id",
            "tempo",
            "vocal_tone_quality",
            "sound_brightness",
            "musical_note_strength",
            "sound_loudness",
        )
    )
