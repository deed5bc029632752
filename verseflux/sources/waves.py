"""Wav files as a Spark data source whose partitions are ranges of a file.

A file is a row of ``binaryFile`` only up to 2 GB, and one task's work whatever its size. Here the
planner lists the files, and every range of ``rangeBytes`` bytes is a partition of its own: it reads
the head of the file, and then its own samples with what its neighbours need of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from verseflux.functions.dsp import WavFormat, pcm_samples, wav_format

#: Bytes of a range, and the largest gap it may leave to its neighbours' samples.
RANGE_BYTES = 16_000_000
_SCHEMA = "path string, rate int, n long, first long, lead int, own int, samples array<float>, error string"


@dataclass
class _Range(InputPartition):
    path: str
    size: int
    number: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.extension = options.get("extension", ".wav").lower()
        self.bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.lead, self.tail = int(options.get("lead", 0)), int(options.get("tail", 0))

    def partitions(self) -> list[_Range]:
        fs, path = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.File:
            found = [info]
        else:
            found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
        files = [f for f in found if f.type == pafs.FileType.File and f.path.lower().endswith(self.extension)]
        out = [_Range(f.path, f.size, k) for f in sorted(files, key=lambda f: f.path) for k in range(max(1, -(-f.size // self.bytes)))]
        return out or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        fs, _ = pafs.FileSystem.from_uri(self.path)
        try:
            with fs.open_input_file(part.path) as file:
                form = wav_format(file, part.size)
                row = self._samples(file, form, part)
        except Exception as e:  # a bad file is one row, not a failed task
            if part.number == 0:
                yield self._row(part.path, error=f"{type(e).__name__}: {e}")
            return
        if row is not None:
            yield self._row(part.path, form.rate, form.frames, *row)
        elif part.number == 0:
            yield self._row(part.path, form.rate, form.frames, error="no samples")

    def _samples(self, file: pa.NativeFile, form: WavFormat, part: _Range):
        """First own sample, lead-in samples before it, own samples, and all of them; the own
        samples of a range are those whose first byte lies in it, the header's bytes apart."""
        per = max(1, self.bytes // form.frame_bytes)
        first, end = part.number * per, (part.number + 1) * per
        if (part.number + 1) * self.bytes >= part.size:
            end = form.frames  # the last range
        end = min(end, form.frames)
        if first >= end:
            return None
        a, b = max(0, first - self.lead), min(form.frames, end + self.tail)
        file.seek(form.start + a * form.frame_bytes)
        raw = file.read((b - a) * form.frame_bytes)
        return first, first - a, end - first, pcm_samples(raw, form)

    def _row(self, path, rate=None, n=None, first=None, lead=None, own=None, samples=None, error=None) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.string()]
        names = ["path", "rate", "n", "first", "lead", "own", "samples", "error"]
        samples = None if samples is None else samples.astype(np.float32)
        values = [path, rate, n, first, lead, own, samples, error]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=names)


class WavRanges(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wavranges"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_wave_ranges(
    spark: SparkSession, path: str, lead: int = 0, tail: int = 0, range_bytes: int = RANGE_BYTES, extension: str = ".wav"
) -> DataFrame:
    """``(path, rate, n, first, lead, own, samples, error)``: mono samples of all files below
    ``path`` (a local path or a URI that Arrow can open), a row per range of ``range_bytes``.

    A row's own samples are those from ``first`` on, ``own`` of them; ``samples`` also holds up
    to ``lead`` samples before and ``tail`` samples after them. ``n`` is the length of the file. A
    file that is no PCM wav, or has no samples, is one row with an ``error``.
    """
    spark.dataSource.register(WavRanges)
    options = {"lead": lead, "tail": tail, "rangeBytes": range_bytes, "extension": extension}
    uri = path if "://" in path else f"file://{path}"
    return spark.read.format("wavranges").options(**options).load(uri)
