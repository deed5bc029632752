import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from verseflux.functions import dsp
from verseflux.operators.keys import duplicate_keys, file_lookup, file_missing, join_canonical
from verseflux.operators.series import frame_statistics, index_series, mean_loudness
from verseflux.operators.signal import (
    Framing,
    TempoSettings,
    chunk_arrays,
    chunk_series,
    decode_waveforms,
    frame_table,
    keep_unframed,
    onset_envelope,
    resample_arrays,
    signal_features,
    signal_means,
    spectral_chunks,
    tempo,
    timbre_chunks,
    unframed_arrays,
    unframed_series,
)
from verseflux.plans.signals import extract_signal_features
from verseflux.sources.waves import read_wave_ranges
from verseflux.sources.media import list_media, media_manifest, read_media

RATE = 22050


def wav_bytes(x, rate=RATE, channels=1, width=2):
    scaled = np.clip(np.asarray(x), -1, 1)
    if width == 1:
        raw = ((scaled * 127) + 128).astype(np.uint8).tobytes()
    elif width == 3:
        whole = (scaled * (2**23 - 1)).astype("<i4")
        raw = whole.view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    else:
        raw = (scaled * (2 ** (8 * width - 1) - 1)).astype(f"<i{width}").tobytes()
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(raw)
    return out.getvalue()


def tone(hz, seconds, rate=RATE, volume=0.5):
    return volume * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def clicks(bpm, seconds):
    x = np.random.default_rng(0).normal(size=int(seconds * RATE)) * 1e-4
    for start in np.arange(0, seconds, 60 / bpm):
        at = int(start * RATE)
        x[at : at + 400] += np.hanning(400)[: len(x) - at] * 0.8
    return x


def arrays(spark, signals):
    rows = [(name, [float(v) for v in x]) for name, x in signals.items()]
    return spark.createDataFrame(rows, "signal_id string, samples array<float>")


def test_features_of_known_signals(spark):
    signals = {"c": tone(261.63, 3), "a": tone(440.0, 3), "quiet": tone(440.0, 3, volume=0.05), "silent": np.zeros(RATE), "beat": clicks(120, 20)}
    framing = Framing(chunk_frames=64)
    got = {r.signal_id: r for r in signal_features(chunk_arrays(arrays(spark, signals), framing), framing).collect()}
    bin_hz = RATE / 2048
    frames = {r.signal_id: r for r in frame_table(spectral_chunks(chunk_arrays(arrays(spark, signals), framing), framing)).where("frame = 40").collect()}
    for name, hz in (("c", 261.63), ("a", 440.0)):
        assert abs(frames[name].centroid - hz) < bin_hz  # away from the padded ends
        assert got[name].sound_loudness == pytest.approx(0.5 / np.sqrt(2), rel=0.03)
    assert got["c"].musical_note_strength > 0.9 > 0.2 > got["a"].musical_note_strength
    assert got["quiet"].vocal_tone_quality < got["a"].vocal_tone_quality
    silent = got["silent"]
    assert silent.sound_brightness == silent.sound_loudness == silent.musical_note_strength == 0
    assert silent.vocal_tone_quality == pytest.approx(-100 * np.sqrt(128))
    allowed = [60 * RATE / 512 / k for k in range(1, 344)]
    for r in got.values():
        assert min(abs(r.tempo - b) for b in allowed) < 1e-9 and r.tempo < 320
    assert abs(got["beat"].tempo - 120) < 4


def test_chunk_size_does_not_matter(spark):
    rng = np.random.default_rng(1)
    signals = {"x": rng.normal(size=5000), "y": rng.normal(size=700), "z": rng.normal(size=3)}
    results = []
    for chunk, piece in ((1, 1), (7, 5), (512, 1024)):
        framing = Framing(rate=1000.0, frame=64, hop=16, bands=8, chunk_frames=chunk)
        settings = TempoSettings(window=20, max_bpm=3000.0, chunk_frames=piece)
        df = chunk_arrays(arrays(spark, signals), framing)
        rows = signal_features(df, framing, settings).orderBy("signal_id").collect()
        results.append(np.array([[*r][1:] for r in rows], dtype=float))
        assert [r.signal_id for r in rows] == ["x", "y", "z"]
    for other in results[1:]:
        np.testing.assert_allclose(other, results[0], rtol=1e-9)


def plain_tempo(onset, rate, hop, s):
    """Tempo by looping over frames, for one envelope."""
    n, half = len(onset), s.window // 2
    ramp = onset[-1] * np.arange(half - 1, -1, -1) / half
    padded = np.concatenate([np.zeros(half), onset, ramp])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(s.window) / s.window)
    total = np.zeros(s.window)
    for t in range(n):
        w = padded[t : t + s.window] * window
        ac = np.array([np.dot(w[: s.window - k], w[k:]) for k in range(s.window)])
        total += ac / (ac.max() if ac.max() > 0 else 1)
    lags = np.arange(1, s.window)
    bpm = 60 * rate / (hop * lags)
    score = np.log1p(1e6 * total[1:] / n) - 0.5 * (np.log2(bpm / s.start_bpm) / s.std_octaves) ** 2
    score[bpm >= s.max_bpm] = -np.inf
    return bpm[np.argmax(score)]


@pytest.mark.parametrize("window", [20, 21])
def test_tempo_against_plain_loops(spark, window):
    rng = np.random.default_rng(5)
    framing = Framing(rate=1000.0, frame=64, hop=16, bands=8, chunk_frames=9)
    settings = TempoSettings(window=window, start_bpm=300.0, max_bpm=2000.0, chunk_frames=11)
    signals = {f"s{i}": rng.normal(size=400 + 300 * i) * (rng.random(400 + 300 * i) > 0.8) for i in range(5)}
    chunks = chunk_arrays(arrays(spark, signals), framing)
    envelope = onset_envelope(spectral_chunks(chunks, framing), framing).cache()
    # Chunks that do not know the peak of their signal lead to the same values.
    spectra = spectral_chunks(chunks.drop("peak"), framing)
    joined = onset_envelope(timbre_chunks(spectra, signal_means(spectra), framing), framing)
    a, b = ({(r.signal_id, r.frame): r.onset for r in d.collect()} for d in (envelope, joined))
    assert a.keys() == b.keys() and all(b[k] == pytest.approx(v, abs=1e-9) for k, v in a.items())
    found = {r.signal_id: r.tempo for r in tempo(envelope, framing, settings).collect()}
    for name in signals:
        rows = envelope.where(F.col("signal_id") == name).collect()
        dense = np.zeros(rows[0].n_frames)
        for r in rows:
            dense[r.frame] = r.onset
        assert found[name] == pytest.approx(plain_tempo(dense, 1000.0, 16, settings))


def test_short_signal_still_has_a_tempo(spark):
    framing = Framing()
    rows = signal_features(chunk_arrays(arrays(spark, {"one": [0.1] * 600}), framing), framing).collect()
    assert len(rows) == 1 and abs(rows[0].tempo - 120) < 4


def test_filters():
    mel = dsp.mel_weights(22050, 2048, 128)
    assert mel.shape == (128, 1025) and (mel >= 0).all() and (mel.sum(axis=1) > 0).all()
    peaks = mel.argmax(axis=1)
    assert (np.diff(peaks) >= 0).all()
    # Wide filters have unit area.
    assert mel[100:].sum(axis=1) * 22050 / 2048 == pytest.approx(1.0, rel=0.02)
    chroma = dsp.chroma_weights(22050, 2048)
    for note, hz in enumerate(261.6256 * 2 ** (np.arange(12) / 12)):
        high = round(hz * 4 / (22050 / 2048))
        assert chroma[:, high].argmax() == note
    assert dsp.hz_to_mel(1000.0) == pytest.approx(15.0)
    assert float(dsp.mel_to_hz(np.array(dsp.hz_to_mel(4321.0)))) == pytest.approx(4321.0)


@pytest.mark.parametrize("semitones", [-0.42, -0.1, 0.0, 0.25])
def test_tuning(semitones):
    x = sum(tone(440.0 * 2 ** ((n + semitones) / 12), 2, volume=0.2) for n in (-5, 0, 3, 7))
    mel = dsp.mel_weights(RATE, 2048, 128)
    tuning, peak = dsp.profile(x, 2048, 512, RATE, mel, None)
    assert abs(tuning - semitones) <= 0.08  # the parabola is not exact
    assert dsp.profile(x, 2048, 512, RATE, mel, 0.3) == (0.3, peak)
    for nothing in (np.zeros(RATE), np.zeros(10)):
        assert dsp.profile(nothing, 2048, 512, RATE, mel, None) == (0.0, -100.0)


def test_tuning_is_used(spark):
    low_c = {"x": tone(261.63 * 2 ** (-0.4 / 12), 2) + tone(523.25 * 2 ** (-0.4 / 12), 2)}
    notes = {}
    for tuning in (None, 0.0, -0.4):
        framing = Framing(tuning=tuning)
        spectra = spectral_chunks(chunk_arrays(arrays(spark, low_c), framing), framing)
        notes[tuning] = signal_means(spectra).first().musical_note_strength
    assert notes[None] == pytest.approx(notes[-0.4], abs=0.01)
    assert notes[None] >= notes[0.0]


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_formats(width):
    x = tone(440, 0.1)
    rate, y = dsp.decode_wav(wav_bytes(x, width=width))
    assert rate == RATE and np.abs(y - x).max() < (0.02 if width == 1 else 1e-3)
    both = np.stack([x, np.zeros_like(x)], axis=1).ravel()
    _, mono = dsp.decode_wav(wav_bytes(both, channels=2, width=width))
    assert np.abs(mono - x / 2).max() < 0.02


def test_resampling_keeps_the_tone_and_drops_what_is_too_high():
    x = tone(440, 1, 44100) + tone(15000, 1, 44100)
    y = dsp.resample(x, 44100, 22050)
    assert len(y) == 22050
    middle = slice(1000, -1000)
    assert np.abs(y[middle] - tone(440, 1)[middle]).max() < 0.02
    assert len(dsp.resample(x, 44100, 48000)) == 48000


@pytest.fixture
def media(tmp_path):
    root = tmp_path / "wav_input"
    (root / "b").mkdir(parents=True)
    (root / "a").mkdir()
    (root / "b" / "My_Song.wav").write_bytes(wav_bytes(tone(440, 1)))
    (root / "a" / "My_Song.wav").write_bytes(wav_bytes(tone(880, 1)))
    (root / "Other.WAV").write_bytes(wav_bytes(tone(440, 1)))
    (root / "Broken.wav").write_bytes(b"not audio")
    (root / "notes.txt").write_text("x")
    return root


def test_listing(spark, media):
    rows = list_media(spark, str(media), ".wav")
    assert sorted(r.path.rsplit("/", 1)[1] for r in rows.collect()) == [
        "Broken.wav", "My_Song.wav", "My_Song.wav", "Other.WAV"]
    assert rows.columns == ["path", "length"]
    manifest = media_manifest(rows, str(media), "/out", ".wav", ".mp3")
    got = {r.target_path: r.rel_dir for r in manifest.collect()}
    assert got == {"/out/a/My_Song.mp3": "a", "/out/b/My_Song.mp3": "b", "/out/Other.mp3": ".", "/out/Broken.mp3": "."}


def test_manifest_swaps_only_the_last_extension(spark):
    files = spark.createDataFrame([("in/x.mp3/y.mp3.MP3",), ("in/z.wav",), ("elsewhere/q.mp3",)], "path string")
    rows = media_manifest(files, "in", "out").collect()
    assert [(r.target_path, r.target_dir) for r in rows] == [("out/x.mp3/y.mp3.wav", "out/x.mp3")]


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_features_per_title(spark, media, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        check_features_per_title(spark, media)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def check_features_per_title(spark, media):
    titles = spark.createDataFrame([("My Song",), ("My Song",), ("Broken",), ("other",), ("Gone",)], "title string")
    report = extract_signal_features(spark, titles, str(media), Framing(chunk_frames=16))
    rows = report.features.collect()
    assert [r.title for r in rows] == ["My Song", "My Song"] and rows[0] == rows[1]
    assert rows[0].sound_brightness > 800  # the first path wins: folder a
    assert sorted(r.title for r in report.missing.collect()) == ["Gone", "other"]
    errors = report.errors.collect()
    assert len(errors) == 1 and errors[0].path.endswith("Broken.wav")
    assert {r.feature: r.n for r in report.summary().collect()}["tempo"] == 2


def test_one_row_per_title(spark, media):
    titles = spark.createDataFrame([("My Song",), ("My Song",), ("Broken",), ("Gone",)], "title string")
    rows = extract_signal_features(spark, titles, str(media), Framing(chunk_frames=16)).table.collect()
    assert sorted((r.title, r.error) for r in rows if r.error) == [("Broken", "ValueError: not a wav file"), ("Gone", "no file")]
    assert [(r.title, r.duration) for r in rows if not r.error] == [("My Song", 1.0)] * 2
    assert all((r.tempo is None) == (r.error is not None) for r in rows)


@pytest.mark.parametrize("channels,width", [(1, 1), (2, 2), (1, 3), (2, 4)])
def test_ranges_of_a_file_join_up(spark, tmp_path, channels, width):
    x = np.repeat(tone(440, 0.5), channels)
    (tmp_path / "long.wav").write_bytes(wav_bytes(x, channels=channels, width=width) + b"tail of another chunk")
    (tmp_path / "bad.wav").write_bytes(b"RIFF....WAVEnothing")
    (tmp_path / "empty.WAV").write_bytes(wav_bytes(x[:0], channels=channels, width=width))
    (tmp_path / "other.txt").write_text("x")
    whole = dsp.decode_wav((tmp_path / "long.wav").read_bytes())[1]
    rows = read_wave_ranges(spark, str(tmp_path), lead=7, tail=30, range_bytes=5000)
    assert rows.rdd.getNumPartitions() >= (len(x) * width) // 5000
    found = rows.collect()
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in found if r.error}
    assert errors == {"bad.wav": "ValueError: no samples", "empty.WAV": "no samples"}
    good = sorted((r for r in found if not r.error), key=lambda r: r.first)
    assert len(good) > 2 and sum(r.own for r in good) == len(whole) and {r.n for r in good} == {len(whole)}
    for r in good:
        a, b = max(0, r.first - 7), min(len(whole), r.first + r.own + 30)
        assert r.lead == r.first - a and np.array_equal(np.array(r.samples, np.float32), whole[a:b])
    assert read_wave_ranges(spark, str(tmp_path / "long.wav")).count() == 1
    (tmp_path / "none").mkdir()
    assert read_wave_ranges(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("rate,target", [(44100, 22050), (22050, 44100), (48000, 44100), (8000, 11025)])
def test_resampling_chunk_by_chunk(spark, rate, target):
    x = np.random.default_rng(rate).normal(size=3000).astype(np.float32)
    whole = dsp.resample(x, rate, target)
    df = spark.createDataFrame([("a", x.tolist()), ("b", []), ("c", None), ("d", [1.0])], "signal_id string, samples array<float>")
    rows = resample_arrays(df, rate, target, chunk=333).collect()
    parts = sorted((r.first, r.samples) for r in rows if r.signal_id == "a")
    assert len(parts) == -(-len(whole) // 333)
    np.testing.assert_allclose(np.concatenate([p for _, p in parts]), whole, atol=1e-6)
    assert {r.signal_id for r in rows} == {"a", "d"}
    # By plain sums, for some outputs.
    bank = dsp.Resampler(rate, target)
    for m in (0, 1, 777, len(whole) - 1):
        p = m * rate / target
        taps = {j: np.sinc(bank.cut * (p - j)) * (0.5 + 0.5 * np.cos(np.pi * (p - j) / bank.reach)) for j in range(-200, 3200) if abs(p - j) < bank.reach}
        want = sum(w * x[j] for j, w in taps.items() if 0 <= j < len(x)) / sum(taps.values())
        assert whole[m] == pytest.approx(want, abs=1e-5)


def test_decoding_equals_arrays(spark, media):
    framing = Framing(chunk_frames=10)
    files = read_media(spark, str(media / "b"), ".wav")
    decoded = decode_waveforms(files, framing)
    x = dsp.decode_wav((media / "b" / "My_Song.wav").read_bytes())[1]
    given = chunk_arrays(arrays(spark, {"My_Song": x}), framing)
    got, want = (
        {r.first_frame: (r.n_frames, r.samples, r.tuning, r.peak) for r in d.collect()}
        for d in (decoded, given)
    )
    assert got == want and decoded.first().duration == pytest.approx(1.0)


def test_lookup_keeps_case_and_duplicates(spark):
    files = spark.createDataFrame([("z/A_b.wav",), ("a/A_b.wav",), ("a/c.wav",)], "path string")
    titles = spark.createDataFrame([("A b",), ("A b",), ("a b",), (" c",)], "title string")
    assert [r.path for r in file_lookup(titles, files).collect()] == ["a/A_b.wav"] * 2
    assert sorted(r.title for r in file_missing(titles, files).collect()) == [" c", "a b"]


def test_title_join_multiplies(spark):
    left = spark.createDataFrame([("Houd ini", 1), ("houd_INI", 2), (None, 3), ("solo", 4)], "title string, l int")
    right = spark.createDataFrame([("HOUD INI", 2.0), ("houd ini", 1.0), (None, 9.0)], "title string, r double")
    assert join_canonical(left, right).count() == 4
    once = join_canonical(left, right, dedupe_right=True).collect()
    assert sorted((x.l, x.r) for x in once) == [(1, 1.0), (2, 1.0)]
    assert join_canonical(left, right, match_nulls=True).count() == 5
    assert join_canonical(left, right, dedupe_right=True, match_nulls=True).count() == 3
    from verseflux.functions.text import canonical_title

    dup = duplicate_keys(left.withColumn("title", canonical_title("title")))
    assert [(x.title, x.rows) for x in dup.collect()] == [("houd_ini", 2)]


def events(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(900):  # one signal holds a third, many samples share a time
        user = 0 if i % 3 == 0 else int(rng.integers(1, 12))
        rows.append((user, int(rng.integers(0, 5000)), i, float(rng.normal())))
    df = spark.createDataFrame(rows, "u int, t int, e int, v double")
    return rows, df


def test_numbering_by_levels(spark):
    rows, df = events(spark)
    wanted = {}
    for user in {r[0] for r in rows}:
        for i, r in enumerate(sorted(x[1:] for x in rows if x[0] == user)):
            wanted[user, i] = r[2]
    for levels in ([F.expr("t div 1000")], [F.expr("t div 1000"), F.expr("t div 10")], [F.expr("t div 2000"), F.expr("t div 100"), F.col("t")]):
        got = index_series(df, "u", ["t", "e"], "v", levels).collect()
        assert {(r.signal_id, r.i): r.x for r in got} == wanted
        assert all(r.n == sum(1 for k in wanted if k[0] == r.signal_id) for r in got)


@pytest.mark.parametrize(("frame", "hop"), [(8, 4), (8, 8), (5, 2), (1, 1)])
def test_series_frames(spark, frame, hop):
    _, df = events(spark)
    samples = index_series(df, "u", ["t", "e"], "v", [F.expr("t div 1000")]).cache()
    signals = {}
    for r in samples.collect():
        signals.setdefault(r.signal_id, {})[r.i] = r.x
    wanted = {}
    for name, values in signals.items():
        x = np.array([values[i] for i in range(len(values))])
        for f in range(0, max(0, (len(x) - frame) // hop + 1)):
            wanted[name, f] = np.sqrt(np.mean(x[f * hop : f * hop + frame] ** 2))
    got = {(r.signal_id, r.frame): r for r in frame_statistics(samples, frame, hop).collect()}
    assert got.keys() == wanted.keys()
    assert all(r.size == frame and r.rms == pytest.approx(wanted[k]) for k, r in got.items())
    means = {r.signal_id: r.sound_loudness for r in mean_loudness(samples, frame, hop).collect()}
    assert means[0] == pytest.approx(np.mean([v for k, v in wanted.items() if k[0] == 0]))
    if frame > 1:
        for chunk in (1, 3, 100):
            framing = Framing(8.0, frame, hop, center=False, bands=2, chunk_frames=chunk, tuning=0.0)
            table = frame_table(spectral_chunks(chunk_series(samples, framing), framing)).collect()
            assert {(r.signal_id, r.frame) for r in table} == wanted.keys()
            assert all(r.rms == pytest.approx(wanted[r.signal_id, r.frame]) for r in table)


def test_framing_is_checked(spark):
    with pytest.raises(ValueError):
        Framing(frame=4, hop=8)
    _, df = events(spark)
    samples = index_series(df, "u", ["t", "e"], "v", [F.expr("t div 1000")])
    for bad in (Framing(), Framing(center=False)):
        with pytest.raises(ValueError):
            chunk_series(samples, bad)


@pytest.mark.parametrize("n", [10, 100, 1000, 5000])
def test_low_pass_at_any_length(n):
    x = np.sin(2 * np.pi * 20_000 * np.arange(n) / 44_100).astype(np.float32)
    y = dsp.resample(x, 44_100, 22_050)
    assert len(y) == n // 2
    # Only what is near the ends, where the filter reaches beyond the signal, is left.
    assert np.sqrt(np.mean(y[len(y) // 4 : -len(y) // 4 or None] ** 2)) < 0.3
    if n >= 1000:
        assert np.sqrt(np.mean(y[100:-100] ** 2)) < 0.01


def test_short_signals_are_kept_with_a_reason(spark):
    framing = Framing(frame=64, hop=16, center=False, tuning=0.0)
    rows = [("a", [0.5] * 5), ("b", [float(np.sin(k / 3)) for k in range(900)]), ("c", []), ("d", None)]
    signals = spark.createDataFrame(rows, "signal_id string, samples array<double>")
    features = signal_features(chunk_arrays(signals, framing), framing)
    got = {r.signal_id: r for r in keep_unframed(features, unframed_arrays(signals, framing)).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        "a": "shorter than a frame", "b": None, "c": "no samples", "d": "no samples",
    }
    assert got["a"].sound_loudness is None and got["b"].sound_loudness > 0
    numbered = spark.createDataFrame([("x", 0, 3), ("y", 0, 64)], "signal_id string, i long, n long")
    assert [tuple(r) for r in unframed_series(numbered, framing).collect()] == [("x", "shorter than a frame")]


def test_queries_keep_unframed_signals(spark, tmp_path):
    from compare import connect, difference, spark_result, sql_result

    from verseflux.queries import ORACLES, QUERIES

    events = "id event_id, 7 + id % 2 * (id div 20) user_id, timestamp_seconds(id * 30) ts, sin(id) value"
    spark.range(23).selectExpr(*events.split(", ")).coalesce(1).write.parquet(str(tmp_path / "made.parquet"))
    rows = [(1, [float(np.sin(k)) for k in range(64)]), (2, []), (3, None), (4, [0.5])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "vectors.parquet"))
    folder = tmp_path / "tables"
    folder.mkdir()
    for made, name in (("made", "events"), ("vectors", "embeddings")):
        part = next((tmp_path / f"{made}.parquet").glob("part-*.parquet"))
        (folder / f"{name}.parquet").write_bytes(part.read_bytes())
    con = connect(str(folder))
    want = {"signal_features_all": {7: None, 8: "shorter than a frame"}}
    want["signal_features_arrays_all"] = {1: None, 2: "no samples", 3: "no samples", 4: None}
    for name, reasons in want.items():
        done = QUERIES[name](spark, str(folder))
        assert difference(spark_result(done), sql_result(con, ORACLES[name])) is None
        assert {r.signal_id: r.reason for r in done.collect()} == reasons
