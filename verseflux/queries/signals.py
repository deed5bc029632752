"""Signals: event values per user, and embeddings as ready-made sample arrays."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verseflux.functions import dsp
from verseflux.lineage import cut_lineage
from verseflux.operators.series import (
    frame_statistics,
    index_series,
    mean_loudness,
    series_duration,
)
from verseflux.operators.signal import (
    Framing,
    TempoSettings,
    chunk_arrays,
    chunk_series,
    frame_table,
    keep_unframed,
    mean_timbre,
    onset_envelope,
    resample_arrays,
    signal_features,
    signal_means,
    spectral_chunks,
    tempo,
    timbre_chunks,
    unframed_arrays,
    unframed_series,
    wave_features,
)
from verseflux.queries.registry import query, rounded, sql_rounded, table

FRAME, HOP, RATE, BANDS = 8, 4, 8.0, 4
FRAMING = Framing(
    rate=RATE, frame=FRAME, hop=HOP, center=False, bands=BANDS, chunk_frames=256, tuning=0.0
)
TEMPO = TempoSettings(window=8, start_bpm=40.0, max_bpm=320.0, chunk_frames=256)
ARRAY_FRAMING = Framing(
    rate=64.0, frame=16, hop=4, center=True, bands=8, chunk_frames=256, tuning=0.0
)
ARRAY_TEMPO = TempoSettings(window=8, start_bpm=240.0, max_bpm=1000.0, chunk_frames=256)


def samples(spark: SparkSession, folder: str) -> DataFrame:
    return index_series(
        table(spark, folder, "events"),
        "user_id",
        ["ts", "event_id"],
        "value",
        levels=[F.date_trunc("day", "ts"), F.date_trunc("minute", "ts")],
    )


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_series(samples(spark, folder), FRAMING)


def _rows(name: str, matrix) -> str:
    cells = ", ".join(
        f"({b}, {k}, {float(w)!r}::double)" for b, row in enumerate(matrix) for k, w in enumerate(row)
    )
    return f"{name}(b, k, w) AS (VALUES {cells})"


def sql_spectra(source: str, framing: Framing) -> str:
    """CTEs up to ``spectrum``, ``decibels`` and ``floored`` from ``source(id, i, n, x)``."""
    f = framing
    window = ", ".join(repr(float(w)) for w in dsp.hann(f.frame))
    angle = f"2 * pi() * k * s / {f.frame}"
    mel = dsp.mel_weights(f.rate, f.frame, f.bands)
    chroma = dsp.chroma_weights(f.rate, f.frame)
    return f"""
WITH ev AS ({source}),
framed AS (
    SELECT id, f, i - f * {f.hop} AS s, x, ([{window}])[i - f * {f.hop} + 1] * x AS wx
    FROM (SELECT *, unnest(range(greatest(0, i // {f.hop} - {f.frame // f.hop}), i // {f.hop} + 1)) AS f
        FROM ev)
    WHERE i - f * {f.hop} < {f.frame} AND f * {f.hop} + {f.frame} <= n),
loudness AS (SELECT id, f, sqrt(avg(x * x)) AS rms FROM framed GROUP BY id, f),
spectrum AS (
    SELECT id, f, k, pow(sum(wx * cos({angle})), 2) + pow(sum(wx * sin({angle})), 2) AS power
    FROM framed, range({f.frame // 2 + 1}) t(k) GROUP BY id, f, k),
centroid AS (
    SELECT id, f, CASE WHEN sum(sqrt(power)) > 0 THEN sum(sqrt(power) * k * {f.rate / f.frame!r})
        / sum(sqrt(power)) ELSE 0 END AS centroid FROM spectrum GROUP BY id, f),
{_rows("mel", mel)},
{_rows("chroma", chroma)},
pitch AS (SELECT id, f, b, sum(power * w) AS v FROM spectrum JOIN chroma USING (k) GROUP BY id, f, b),
notes AS (
    SELECT id, f, CASE WHEN max(v) > 0 THEN max(v) FILTER (WHERE b = 0) / max(v) ELSE 0 END AS note
    FROM pitch GROUP BY id, f),
decibels AS (
    SELECT id, f, b, 10 * log10(greatest(1e-10, sum(power * w))) AS db
    FROM spectrum JOIN mel USING (k) GROUP BY id, f, b),
floored AS (
    SELECT id, f, b, greatest(db, max(db) OVER (PARTITION BY id) - 80) AS db FROM decibels),
rises AS (
    SELECT id, f, coalesce(greatest(0, db - lag(db) OVER (PARTITION BY id, b ORDER BY f)), 0) AS rise
    FROM floored),
raw_onset AS (SELECT id, f, avg(rise) AS onset FROM rises GROUP BY id, f),
sizes AS (SELECT id, max(f) + 1 AS n_frames FROM loudness GROUP BY id)
"""


def sql_tempo(framing: Framing, settings: TempoSettings) -> str:
    """CTEs ``envelope`` and ``beats(id, tempo)``, after ``sql_spectra``."""
    f, s = framing, settings
    shift = f.frame // (2 * f.hop) if f.center else 0
    half = s.window // 2
    window = ", ".join(repr(float(w)) for w in dsp.hann(s.window))
    per_lag = 60.0 * f.rate / f.hop
    return f""",
envelope AS (
    SELECT id, f + {shift} AS f, n_frames, onset FROM raw_onset JOIN sizes USING (id)
    WHERE f + {shift} < n_frames),
padded AS (
    SELECT id, f AS e, onset AS v FROM envelope
    UNION ALL
    SELECT id, f + k, onset * ({half} - k) / {half} FROM envelope, range(1, {half}) t(k)
    WHERE f = n_frames - 1),
windows AS (
    SELECT z.id, t.t, j.j, coalesce(p.v, 0) * ([{window}])[j.j + 1] AS v
    FROM sizes z, unnest(range(n_frames)) t(t), range({s.window}) j(j)
    LEFT JOIN padded p ON p.id = z.id AND p.e = t.t + j.j - {half}),
products AS (
    SELECT a.id, a.t, b.j - a.j AS lag, sum(a.v * b.v) AS v
    FROM windows a JOIN windows b ON a.id = b.id AND a.t = b.t AND b.j >= a.j
    GROUP BY a.id, a.t, b.j - a.j),
scaled AS (
    SELECT id, lag, v / CASE WHEN max(v) OVER (PARTITION BY id, t) > 0
        THEN max(v) OVER (PARTITION BY id, t) ELSE 1 END AS v FROM products),
scores AS (
    SELECT id, lag, {per_lag!r} / lag AS bpm,
        ln(1 + 1e6 * avg(v)) - 0.5 * pow(log2({per_lag!r} / lag / {s.start_bpm!r}) / {s.std_octaves!r}, 2)
        AS score
    FROM scaled WHERE lag > 0 AND {per_lag!r} / lag < {s.max_bpm!r} GROUP BY id, lag),
beats AS (SELECT id, arg_max(bpm, score) AS tempo FROM scores GROUP BY id)
"""


_EVENTS = """
    SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i,
        count(*) OVER (PARTITION BY user_id) AS n, value AS x FROM events"""
_SQL_EVENTS = sql_spectra(_EVENTS, FRAMING)
_PAD = ARRAY_FRAMING.frame // 2
_ARRAYS = f"""
    SELECT vec_id AS id, unnest(range(len(e) + {2 * _PAD})) AS i, len(e) + {2 * _PAD} AS n,
        unnest(list_concat(list_concat([0.0 FOR z IN range({_PAD})], e::double[]),
            [0.0 FOR z IN range({_PAD})])) AS x
    FROM (SELECT vec_id, embedding AS e FROM embeddings)"""
_SQL_ARRAYS = sql_spectra(_ARRAYS, ARRAY_FRAMING)
_SQL_ALL = f"""
SELECT b.id AS signal_id, {sql_rounded('any_value(b.tempo)')} AS tempo,
    {sql_rounded('any_value(m.v)')} AS vocal_tone_quality,
    {sql_rounded('any_value(c.v)')} AS sound_brightness,
    {sql_rounded('any_value(n.v)')} AS musical_note_strength,
    {sql_rounded('any_value(l.v)')} AS sound_loudness
FROM beats b
JOIN (SELECT id, sum(db) / sqrt({{bands}}) / count(DISTINCT f) AS v FROM floored GROUP BY id) m USING (id)
JOIN (SELECT id, avg(centroid) AS v FROM centroid GROUP BY id) c USING (id)
JOIN (SELECT id, avg(note) AS v FROM notes GROUP BY id) n USING (id)
JOIN (SELECT id, avg(rms) AS v FROM loudness GROUP BY id) l USING (id)
GROUP BY b.id"""


@query(
    "signal_index",
    "SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 "
    "AS i, count(*) OVER (PARTITION BY user_id) AS n, value AS x FROM events",
)
def signal_index(spark: SparkSession, folder: str) -> DataFrame:
    return samples(spark, folder)


@query(
    "signal_frames",
    _SQL_EVENTS
    + f"""
SELECT id AS signal_id, f AS frame, count(*) AS size, {sql_rounded('avg(x)')} AS mean,
    {sql_rounded('sqrt(avg(x * x))')} AS rms FROM framed GROUP BY id, f""",
)
def signal_frames(spark: SparkSession, folder: str) -> DataFrame:
    frames = frame_statistics(samples(spark, folder), FRAME, HOP)
    return frames.withColumn("mean", rounded("mean")).withColumn("rms", rounded("rms"))


@query(
    "signal_rms",
    _SQL_EVENTS
    + f"""
SELECT id AS signal_id, count(*) AS frames, {sql_rounded('avg(rms)')} AS sound_loudness
FROM loudness GROUP BY id""",
)
def signal_rms(spark: SparkSession, folder: str) -> DataFrame:
    result = mean_loudness(samples(spark, folder), FRAME, HOP)
    return result.withColumn("sound_loudness", rounded("sound_loudness"))


@query(
    "signal_duration",
    f"SELECT user_id AS signal_id, count(*) AS n_samples, {sql_rounded(f'count(*) / {RATE}::double')} "
    "AS duration FROM events GROUP BY user_id",
)
def signal_duration(spark: SparkSession, folder: str) -> DataFrame:
    result = series_duration(table(spark, folder, "events"), "user_id", RATE)
    return result.withColumn("duration", rounded("duration"))


@query(
    "signal_frame_table",
    _SQL_EVENTS
    + f"""
SELECT id AS signal_id, f AS frame, {sql_rounded('rms')} AS rms,
    {sql_rounded('centroid')} AS centroid, {sql_rounded('note')} AS note
FROM loudness JOIN centroid USING (id, f) JOIN notes USING (id, f)""",
)
def signal_frame_table(spark: SparkSession, folder: str) -> DataFrame:
    frames = frame_table(spectral_chunks(chunks(spark, folder), FRAMING))
    return frames.select("signal_id", "frame", *[rounded(c).alias(c) for c in ("rms", "centroid", "note")])


@query(
    "signal_centroid",
    _SQL_EVENTS
    + f"SELECT id AS signal_id, {sql_rounded('avg(centroid)')} AS sound_brightness FROM centroid GROUP BY id",
)
def signal_centroid(spark: SparkSession, folder: str) -> DataFrame:
    means = signal_means(spectral_chunks(chunks(spark, folder), FRAMING))
    return means.select("signal_id", rounded("sound_brightness").alias("sound_brightness"))


@query(
    "signal_chroma0",
    _SQL_EVENTS
    + f"SELECT id AS signal_id, {sql_rounded('avg(note)')} AS musical_note_strength FROM notes GROUP BY id",
)
def signal_chroma0(spark: SparkSession, folder: str) -> DataFrame:
    means = signal_means(spectral_chunks(chunks(spark, folder), FRAMING))
    return means.select("signal_id", rounded("musical_note_strength").alias("musical_note_strength"))


def _timbre(spark: SparkSession, folder: str) -> DataFrame:
    spectra = cut_lineage(spectral_chunks(chunks(spark, folder), FRAMING))
    return timbre_chunks(spectra, signal_means(spectra), FRAMING)


@query(
    "signal_mfcc0",
    _SQL_EVENTS
    + f"""
SELECT id AS signal_id, {sql_rounded(f'sum(db) / sqrt({BANDS}) / count(DISTINCT f)')}
    AS vocal_tone_quality FROM floored GROUP BY id""",
)
def signal_mfcc0(spark: SparkSession, folder: str) -> DataFrame:
    result = mean_timbre(_timbre(spark, folder))
    return result.withColumn("vocal_tone_quality", rounded("vocal_tone_quality"))


@query(
    "signal_onset",
    _SQL_EVENTS
    + f"""
SELECT id AS signal_id, f AS frame, n_frames, {sql_rounded('onset')} AS onset
FROM raw_onset JOIN sizes USING (id)""",
)
def signal_onset(spark: SparkSession, folder: str) -> DataFrame:
    result = onset_envelope(_timbre(spark, folder), FRAMING)
    return result.withColumn("onset", rounded("onset"))


@query(
    "signal_tempo",
    _SQL_EVENTS
    + sql_tempo(FRAMING, TEMPO)
    + f"SELECT id AS signal_id, {sql_rounded('tempo')} AS tempo FROM beats",
)
def signal_tempo(spark: SparkSession, folder: str) -> DataFrame:
    timbre = cut_lineage(_timbre(spark, folder))
    result = tempo(onset_envelope(timbre, FRAMING), FRAMING, TEMPO)
    return result.select("signal_id", rounded("tempo").alias("tempo"))


def _round_features(df: DataFrame) -> DataFrame:
    return df.select("signal_id", *[rounded(c).alias(c) for c in df.columns if c != "signal_id"])


@query(
    "signal_features",
    _SQL_EVENTS + sql_tempo(FRAMING, TEMPO) + _SQL_ALL.replace("{bands}", str(BANDS)),
)
def signal_features_query(spark: SparkSession, folder: str) -> DataFrame:
    return _round_features(signal_features(chunks(spark, folder), FRAMING, TEMPO))


@query(
    "signal_features_arrays",
    _SQL_ARRAYS
    + sql_tempo(ARRAY_FRAMING, ARRAY_TEMPO)
    + _SQL_ALL.replace("{bands}", str(ARRAY_FRAMING.bands)),
)
def signal_features_arrays(spark: SparkSession, folder: str) -> DataFrame:
    cut = chunk_arrays(table(spark, folder, "embeddings"), ARRAY_FRAMING, "vec_id", "embedding")
    return _round_features(signal_features(cut, ARRAY_FRAMING, ARRAY_TEMPO))


_SQL_KEPT = """
SELECT *, NULL::varchar AS reason FROM ({framed})
UNION ALL SELECT {id}, NULL, NULL, NULL, NULL, NULL, {reason} FROM {rest}"""


@query(
    "signal_features_all",
    _SQL_EVENTS
    + sql_tempo(FRAMING, TEMPO)
    + _SQL_KEPT.format(
        framed=_SQL_ALL.replace("{bands}", str(BANDS)),
        id="user_id",
        reason="'shorter than a frame'",
        rest=f"events GROUP BY user_id HAVING count(*) < {FRAME}",
    ),
)
def signal_features_all(spark: SparkSession, folder: str) -> DataFrame:
    """``signal_features`` and a row with a reason for every signal shorter than a frame."""
    numbered = samples(spark, folder)
    features = _round_features(signal_features(chunk_series(numbered, FRAMING), FRAMING, TEMPO))
    return keep_unframed(features, unframed_series(numbered, FRAMING))


@query(
    "signal_features_arrays_all",
    sql_spectra(_ARRAYS + " WHERE len(e) > 0", ARRAY_FRAMING)
    + sql_tempo(ARRAY_FRAMING, ARRAY_TEMPO)
    + _SQL_KEPT.format(
        framed=_SQL_ALL.replace("{bands}", str(ARRAY_FRAMING.bands)),
        id="vec_id",
        reason="CASE WHEN coalesce(len(embedding), 0) = 0 THEN 'no samples' ELSE 'shorter than a frame' END",
        rest=f"embeddings WHERE coalesce(len(embedding), 0) = 0 OR len(embedding) + {2 * _PAD} < {ARRAY_FRAMING.frame}",
    ),
)
def signal_features_arrays_all(spark: SparkSession, folder: str) -> DataFrame:
    """``signal_features_arrays`` and a row with a reason for every array without a frame."""
    arrays = table(spark, folder, "embeddings")
    cut = chunk_arrays(arrays, ARRAY_FRAMING, "vec_id", "embedding")
    features = _round_features(signal_features(cut, ARRAY_FRAMING, ARRAY_TEMPO))
    return keep_unframed(features, unframed_arrays(arrays, ARRAY_FRAMING, "vec_id", "embedding"))


# ---- wav files made of the embeddings ----------------------------------------------------
# Width by vec_id % 3 (8, 16, 24 bits), stereo for odd ids, and some files that are no good.

_WIDTH = "(vec_id % 3 + 1)"
_STEREO = "vec_id % 2 = 1"
_SCALE = "CASE vec_id % 3 WHEN 0 THEN 127 WHEN 1 THEN 32767 ELSE 8388607 END"
_FULL = "CASE vec_id % 3 WHEN 0 THEN 128 WHEN 1 THEN 32768 ELSE 8388608 END"
_NO_WAV, _NO_SAMPLES, _NO_PCM = ("vec_id % 17 = 3", "vec_id % 17 = 5", "vec_id % 17 = 7")


def _little(number: str, size: int) -> str:
    """Hex digits of a whole number as little-endian bytes."""
    return " || ".join(f"lpad(hex(shiftright({number}, {8 * k}) & 255), 2, '0')" for k in range(size))


def _sample(number: str) -> str:
    by_width = " ".join(f"WHEN {w - 1} THEN {_little(f'{number} + 128' if w == 1 else number, w)}" for w in (1, 2, 3))
    return f"CASE vec_id % 3 {by_width} END"


def wav_files(embeddings: DataFrame) -> DataFrame:
    """``(signal_id, content)``: a wav file per embedding that has one."""
    numbers = f"transform(embedding, x -> CAST(floor(CAST(x AS double) * {_SCALE} + 0.5D) AS bigint))"
    right = "CASE WHEN vec_id % 3 = 2 THEN q ELSE CAST(floor(q / 2D) AS bigint) END"
    frames = f"array_join(transform(numbers, q -> {_sample('q')} || CASE WHEN {_STEREO} THEN {_sample(right)} ELSE '' END), '')"
    text = lambda t: t.encode().hex()
    rate = int(ARRAY_FRAMING.rate)
    rows = embeddings.where("embedding IS NOT NULL").withColumn("numbers", F.expr(numbers))
    rows = rows.withColumn("data", F.expr(f"CASE WHEN {_NO_SAMPLES} THEN '' ELSE {frames} END"))
    rows = rows.withColumn("channels", F.expr(f"CASE WHEN {_STEREO} THEN 2L ELSE 1L END"))
    rows = rows.withColumn("size", F.expr("CAST(length(data) div 2 AS bigint)")).withColumn("kind", F.expr(f"CASE WHEN {_NO_PCM} THEN 3L ELSE 1L END"))
    head = [
        f"'{text('RIFF')}'", _little("(size + 36)", 4), f"'{text('WAVEfmt ')}'", _little("16L", 4), _little("kind", 2), _little("channels", 2),
        _little(f"{rate}L", 4), _little(f"({rate}L * channels * {_WIDTH})", 4), _little(f"(channels * {_WIDTH})", 2), _little(f"(8 * {_WIDTH})", 2),
        f"'{text('data')}'", _little("size", 4),
    ]
    content = f"CASE WHEN {_NO_WAV} THEN '{text('RIFX, no wave')}' ELSE {' || '.join(head)} || data END"
    return rows.select(F.col("vec_id").alias("signal_id"), F.unhex(F.expr(content)).alias("content"))


_SQL_WAVES = f"""
    SELECT id, unnest(range(len(e) + {2 * _PAD})) AS i, len(e) + {2 * _PAD} AS n,
        unnest(list_concat(list_concat([0.0 FOR z IN range({_PAD})], e), [0.0 FOR z IN range({_PAD})])) AS x
    FROM (
        SELECT vec_id AS id, [CASE WHEN {_STEREO} AND vec_id % 3 < 2 THEN (q + floor(q / 2)) / 2 ELSE q END / ({_FULL}) FOR q IN
            [floor(v::double * ({_SCALE}) + 0.5) FOR v IN embedding]] AS e
        FROM embeddings WHERE embedding IS NOT NULL AND NOT ({_NO_WAV}) AND NOT ({_NO_SAMPLES}) AND NOT ({_NO_PCM}))"""


@query(
    "wave_features",
    sql_spectra(_SQL_WAVES, ARRAY_FRAMING)
    + sql_tempo(ARRAY_FRAMING, ARRAY_TEMPO)
    + f"""
SELECT f.*, {sql_rounded(f"len(embedding) / {ARRAY_FRAMING.rate!r}::double")} AS duration, NULL::varchar AS error
FROM ({_SQL_ALL.replace("{bands}", str(ARRAY_FRAMING.bands))}) f JOIN embeddings ON vec_id = signal_id
UNION ALL
SELECT vec_id, NULL, NULL, NULL, NULL, NULL, NULL, 'ValueError: ' || CASE WHEN {_NO_WAV} THEN 'not a wav file'
    WHEN {_NO_PCM} THEN 'format 3 with ' || (8 * {_WIDTH}) || ' bits and ' || (vec_id % 2 + 1) || ' channels is not supported' ELSE 'no samples' END
FROM embeddings WHERE embedding IS NOT NULL AND ({_NO_WAV} OR {_NO_SAMPLES} OR {_NO_PCM})""",
)
def wave_features_query(spark: SparkSession, folder: str) -> DataFrame:
    """Features of wav files of several formats, and an error for each that cannot be read."""
    result = wave_features(wav_files(table(spark, folder, "embeddings")), ARRAY_FRAMING, ARRAY_TEMPO)
    numbers = [c for c in result.columns if c not in ("signal_id", "error")]
    return result.select("signal_id", *[rounded(c).alias(c) for c in numbers], "error")


# ---- resampling --------------------------------------------------------------------------

RATES = (64, 48)
_UP, _DOWN = RATES[1] // math.gcd(*RATES), RATES[0] // math.gcd(*RATES)
_CUT = min(1.0, RATES[1] / RATES[0])
_REACH = math.ceil(dsp.RESAMPLE_REACH / _CUT)


@query(
    "signal_resample",
    f"""
WITH outputs AS (
    SELECT vec_id, embedding AS e, unnest(range((len(embedding) * {_UP} + {_DOWN - 1}) // {_DOWN})) AS i FROM embeddings),
taps AS (
    SELECT vec_id, i, e, j, i * {_DOWN} / {_UP}::double - j AS t
    FROM outputs, range(1 - {_REACH}, {_REACH} + 1) r(d), LATERAL (SELECT i * {_DOWN} // {_UP} + d AS j)),
weights AS (
    SELECT *, CASE WHEN abs(t) < {_REACH} THEN (0.5 + 0.5 * cos(pi() * t / {_REACH}))
        * CASE WHEN t = 0 THEN 1 ELSE sin(pi() * {_CUT!r} * t) / (pi() * {_CUT!r} * t) END ELSE 0 END AS w FROM taps)
SELECT vec_id AS signal_id, i, {sql_rounded("sum(w * CASE WHEN j BETWEEN 0 AND len(e) - 1 THEN e[j + 1]::double ELSE 0 END) / sum(w)", 5)} AS x
FROM weights GROUP BY vec_id, i""",
)
def signal_resample(spark: SparkSession, folder: str) -> DataFrame:
    """The embeddings as signals at 48 instead of 64 samples per second."""
    result = resample_arrays(table(spark, folder, "embeddings"), *RATES, "vec_id", "embedding", chunk=20)
    return result.select("signal_id", F.posexplode("samples").alias("k", "x"), "first").select(
        "signal_id", (F.col("first") + F.col("k")).alias("i"), rounded("x", 5).alias("x")
    )
