"""Numeric kernels on numpy arrays, called per chunk of a signal inside Spark tasks.

Conventions are those of common audio libraries: Slaney mel scale with area-normalized
filters, 12 chroma bins starting at C, periodic Hann window, decibels of power relative to 1.
"""

from __future__ import annotations

import io
import math
import struct
from dataclasses import dataclass

import numpy as np

POWER_FLOOR = 1e-10
TOP_DB = 80.0
CHROMA_BINS = 12

# The Slaney mel scale is linear up to 1000 Hz and logarithmic above.
MEL_HZ_LINEAR = 200.0 / 3.0
MEL_BREAK_HZ = 1000.0
MEL_LOG_STEP = math.log(6.4) / 27.0

# Chroma filters peak around this octave, with this width.
CHROMA_OCTAVE = 5.0
CHROMA_OCTAVE_WIDTH = 2.0


# Which spectral peaks count for tuning, and its resolution.
PEAK_SHARE = 0.1
PEAK_BAND = (150.0, 4000.0)
TUNING_STEPS = 100


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    knee = MEL_BREAK_HZ / MEL_HZ_LINEAR
    curved = MEL_BREAK_HZ * np.exp(MEL_LOG_STEP * (np.maximum(mel, knee) - knee))
    return np.where(mel < knee, MEL_HZ_LINEAR * mel, curved)


def hz_to_mel(hz: float) -> float:
    if hz < MEL_BREAK_HZ:
        return hz / MEL_HZ_LINEAR
    return MEL_BREAK_HZ / MEL_HZ_LINEAR + math.log(hz / MEL_BREAK_HZ) / MEL_LOG_STEP


def mel_weights(rate: float, frame: int, bands: int) -> np.ndarray:
    """Triangles between neighbouring mel points, each of unit area: ``(bands, bins)``."""
    hz = np.arange(frame // 2 + 1) * (rate / frame)
    edges = mel_to_hz(np.linspace(0.0, hz_to_mel(rate / 2.0), bands + 2))
    low, peak, high = (edges[i : bands + i, None] for i in range(3))
    triangle = np.minimum((hz - low) / (peak - low), (high - hz) / (high - peak))
    return np.maximum(0.0, triangle) * (2.0 / (high - low))


def chroma_weights(rate: float, frame: int, tuning: float = 0.0) -> np.ndarray:
    """Gaussian bumps around each pitch class, per spectrum bin: ``(12, bins)``."""
    hz = np.arange(1, frame) * (rate / frame)
    c0 = 27.5 * 2.0 ** (tuning / CHROMA_BINS)  # the A that starts octave 0
    pitch = CHROMA_BINS * np.log2(hz / c0)
    pitch = np.insert(pitch, 0, pitch[0] - 1.5 * CHROMA_BINS)  # stands in for 0 Hz
    width = np.append(np.maximum(np.diff(pitch), 1.0), 1.0)
    half = CHROMA_BINS // 2
    away = pitch - np.arange(CHROMA_BINS)[:, None]
    away = np.mod(away + half, CHROMA_BINS) - half
    bumps = np.exp(-0.5 * (2.0 * away / width) ** 2)
    bumps /= np.sqrt((bumps**2).sum(axis=0))
    bumps *= np.exp(-0.5 * ((pitch / CHROMA_BINS - CHROMA_OCTAVE) / CHROMA_OCTAVE_WIDTH) ** 2)
    from_c = np.roll(bumps, -3, axis=0)  # row 0 is C instead of A
    return from_c[:, : frame // 2 + 1]


def cut_frames(samples: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """All full frames, as a view."""
    if len(samples) < frame:
        return np.empty((0, frame))
    return np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop]


def frame_features(
    frames: np.ndarray, rate: float, window: np.ndarray, mel: np.ndarray, chroma: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per frame: loudness (RMS), spectral centroid, share of the C bin, mel decibels."""
    rms = np.sqrt(np.mean(frames**2, axis=1))
    magnitude = np.abs(np.fft.rfft(frames * window, axis=1))
    hz = np.arange(magnitude.shape[1]) * (rate / frames.shape[1])
    total = magnitude.sum(axis=1)
    centroid = (magnitude @ hz) / np.where(total > 0, total, 1.0)
    power = magnitude**2
    pitch = power @ chroma.T
    top = pitch.max(axis=1)
    note = pitch[:, 0] / np.where(top > 0, top, 1.0)
    decibels = 10.0 * np.log10(np.maximum(POWER_FLOOR, power @ mel.T))
    return rms, centroid, note, decibels


def spectral_peaks(power: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and heights of the peaks of all frames, between bins by a parabola.

    A peak stands out from its neighbours, reaches ``PEAK_SHARE`` of its frame's largest bin,
    and lies in ``PEAK_BAND``.
    """
    hz_per_bin = rate / (2 * (power.shape[1] - 1))
    strong = np.where(power > PEAK_SHARE * power.max(axis=1, keepdims=True), power, 0.0)
    below, at, above = power[:, :-2], power[:, 1:-1], power[:, 2:]
    slope, bend = (above - below) / 2.0, above + below - 2.0 * at
    is_peak = (strong[:, 1:-1] > strong[:, :-2]) & (strong[:, 1:-1] >= strong[:, 2:])
    hz = np.arange(1, power.shape[1] - 1) * hz_per_bin
    is_peak &= (hz >= PEAK_BAND[0]) & (hz < PEAK_BAND[1])
    frames, bins = np.nonzero(is_peak)
    slope, bend, at = slope[frames, bins], bend[frames, bins], at[frames, bins]
    inside = np.abs(slope) < np.abs(bend)
    shift = np.where(inside, -slope / np.where(inside, bend, 1.0), 0.0)
    return (bins + 1 + shift) * hz_per_bin, at + 0.5 * slope * shift


def estimate_tuning(hz: np.ndarray, height: np.ndarray) -> float:
    """Deviation from A440 in semitones (-0.5..0.5, steps of 0.01): the most frequent one among
    the peaks that are at least as high as the median peak."""
    if len(hz) == 0:
        return 0.0
    semitones = CHROMA_BINS * np.log2(hz[height >= np.median(height)] / 27.5)
    off = np.mod(semitones, 1.0)
    off = np.where(off >= 0.5, off - 1.0, off)
    counts, edges = np.histogram(off, np.linspace(-0.5, 0.5, TUNING_STEPS + 1))
    return float(edges[np.argmax(counts)])


def profile(
    samples: np.ndarray, frame: int, hop: int, rate: float, mel: np.ndarray, tuning: float | None
) -> tuple[float, float]:
    """What later steps must know of a whole signal: its tuning, estimated unless given, and
    its largest mel decibel. Works through blocks of frames."""
    window, peaks, top = hann(frame), [(np.empty(0), np.empty(0))], 0.0
    frames = cut_frames(samples, frame, hop)
    for start in range(0, len(frames), 512):
        power = np.abs(np.fft.rfft(frames[start : start + 512] * window, axis=1)) ** 2
        top = max(top, float((power @ mel.T).max()))
        if tuning is None:
            peaks.append(spectral_peaks(power, rate))
    if tuning is None:
        tuning = estimate_tuning(*(np.concatenate(parts) for parts in zip(*peaks, strict=True)))
    return tuning, 10.0 * math.log10(max(POWER_FLOOR, top))


def timbre_and_onset(decibels: np.ndarray, peak: float, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """First cepstral coefficient and spectral flux of the frames after the ``lead`` ones,
    with decibels floored ``TOP_DB`` under the peak of the whole signal."""
    floored = np.maximum(decibels, peak - TOP_DB)
    timbre = floored[lead:].sum(axis=1) / math.sqrt(decibels.shape[1])
    rise = np.maximum(0.0, np.diff(floored, axis=0)).mean(axis=1)
    return timbre, rise if lead else np.insert(rise, 0, 0.0)


def local_autocorrelation(windows: np.ndarray) -> np.ndarray:
    """Autocorrelation of each row by lag, scaled to a largest value of one."""
    n = windows.shape[1]
    spectrum = np.fft.rfft(windows, 2 * n, axis=1)
    lags = np.fft.irfft(np.abs(spectrum) ** 2, 2 * n, axis=1)[:, :n]
    top = np.abs(lags).max(axis=1, keepdims=True)
    return lags / np.where(top > np.finfo(float).tiny, top, 1.0)


@dataclass(frozen=True)
class WavFormat:
    """Where the samples of a PCM file stand, and how: ``start`` is the byte of the first one,
    ``frames`` the number of samples per channel that are really there."""

    rate: int
    channels: int
    width: int
    start: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.width


def wav_format(file: io.IOBase, size: int) -> WavFormat:
    """The format of a wav file of ``size`` bytes; only the chunk heads before the samples are
    read. What is no PCM file is a ``ValueError``."""
    head = file.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise ValueError("not a wav file")
    at, form = 12, None
    while True:
        file.seek(at)
        head = file.read(8)
        if len(head) < 8:
            raise ValueError("no samples")
        name, length = struct.unpack("<4sI", head)
        if name == b"data":
            break
        if name == b"fmt ":
            form = struct.unpack("<HHIIHH", file.read(16))
        at += 8 + length + length % 2
    if form is None:
        raise ValueError("no format before the samples")
    kind, channels, rate, _, _, bits = form
    if kind not in (1, 0xFFFE) or bits not in (8, 16, 24, 32) or channels < 1 or rate < 1:
        raise ValueError(f"format {kind} with {bits} bits and {channels} channels is not supported")
    width = bits // 8
    frames = min(length, size - at - 8) // (channels * width)
    return WavFormat(rate, channels, width, at + 8, frames)


def pcm_samples(raw: bytes, form: WavFormat) -> np.ndarray:
    """Whole frames of PCM bytes -> mono samples in -1..1."""
    if form.width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128.0) / 128.0
    elif form.width == 3:
        parts = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        whole = (parts[:, 0] << 8) | (parts[:, 1] << 16) | (parts[:, 2] << 24)
        x = (whole / 2.0**31).astype(np.float32)
    else:
        x = np.frombuffer(raw, f"<i{form.width}") / np.float32(2.0 ** (8 * form.width - 1))
    return x.reshape(-1, form.channels).mean(axis=1, dtype=np.float32)


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """PCM bytes -> (sample rate, mono samples in -1..1)."""
    form = wav_format(io.BytesIO(content), len(content))
    return form.rate, pcm_samples(content[form.start : form.start + form.frames * form.frame_bytes], form)


#: Zero crossings of the sinc on each side of a tap's centre.
RESAMPLE_REACH = 16


class Resampler:
    """Polyphase filter bank from ``rate`` to ``target``.

    Output m stands at the place m * down / up of the input (the rates over their greatest
    common divisor). It is a sum over the inputs around that place, weighted by a sinc that cuts
    off at the lower of both Nyquist frequencies, under a Hann window of ``RESAMPLE_REACH``
    crossings; the weights of each of the ``up`` phases add up to one. Beyond the ends the input
    is zero.
    """

    def __init__(self, rate: int, target: int):
        common = math.gcd(rate, target)
        self.up, self.down = target // common, rate // common
        self.cut = min(1.0, target / rate)
        self.reach = math.ceil(RESAMPLE_REACH / self.cut)
        offsets = np.arange(1 - self.reach, self.reach + 1)
        away = offsets[None, :] - np.arange(self.up)[:, None] / self.up
        inside = np.abs(away) < self.reach
        taps = np.sinc(self.cut * away) * np.where(inside, 0.5 + 0.5 * np.cos(np.pi * away / self.reach), 0.0)
        self.taps = taps / taps.sum(axis=1, keepdims=True)

    def length(self, n: int) -> int:
        return -(-n * self.up // self.down)

    def needs(self, first: int, count: int) -> tuple[int, int]:
        """The range of inputs that outputs ``first`` to ``first + count - 1`` are made of."""
        return first * self.down // self.up + 1 - self.reach, (first + count - 1) * self.down // self.up + self.reach + 1

    def outputs(self, x: np.ndarray, at: int, first: int, count: int) -> np.ndarray:
        """Outputs from ``first`` on, from inputs that begin with number ``at``; inputs that are
        not given count as zero."""
        low, high = self.needs(first, count)
        padded = np.zeros(high - low)
        a, b = max(low, at), min(high, at + len(x))
        if a < b:
            padded[a - low : b - low] = x[a - at : b - at]
        out = np.empty(count)
        windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * self.reach)
        for k in range(0, count, 65536):
            places = (first + np.arange(k, min(k + 65536, count))) * self.down
            taps = self.taps[places % self.up]
            out[k : k + len(places)] = np.einsum("ij,ij->i", windows[places // self.up + 1 - self.reach - low], taps)
        return out


def resample(x: np.ndarray, rate: int, target: int) -> np.ndarray:
    """A whole signal at another rate."""
    if rate == target or len(x) == 0:
        return x
    bank = Resampler(rate, target)
    return bank.outputs(x, 0, 0, bank.length(len(x))).astype(np.float32)
