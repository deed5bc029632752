"""Token ids as files of length-delimited binary records, with an offset index.

A file is a row of records::

    length    8 bytes, little-endian, of the payload
    checksum  4 bytes, masked CRC-32 of the length
    payload   8 bytes id, 1 byte width of a token id, then the token ids, all little-endian
    checksum  4 bytes, masked CRC-32 of the payload
    end       one newline byte

A masked checksum is the CRC rotated right by 15 bits plus 0xA282EAD8, so that a checksum over
bytes that hold checksums stays sound. Files of kind ``data`` hold the records; for each there
is a file of kind ``index`` with the 8-byte offset of each record and a newline, for shuffled
reads. ``roll`` parts keep a file near ``file_bytes``. Both kinds come from Spark's own
committed writer: a task that is run again leaves no second copy, and any file system works.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verseflux.lineage import checkpoint_dir, cut_lineage
from verseflux.llm.bpe import ship_file
from verseflux.llm.chunks import PieceCoder, flattened, groups, put_together
from verseflux.llm.common import NO_ID, id_or_last

FILE_BYTES = 32_000_000
#: Formats of a length with its checksum, a checksum, the head of a payload, an offset.
_HEAD, _SUM, _OWN, _PLACE = "<QI", "<I", "<qB", "<Q"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack(_SUM, masked(length)) + payload + struct.pack(_SUM, masked(payload)) + b"\n"


def read_record(data: memoryview, at: int) -> tuple[bytes, int]:
    """Payload of the record at an offset, and where the next one begins."""
    length, check = struct.unpack_from(_HEAD, data, at)
    if masked(bytes(data[at : at + 8])) != check:
        raise ValueError(f"damaged length at offset {at}")
    payload = bytes(data[at + 12 : at + 12 + length])
    if len(payload) != length or masked(payload) != struct.unpack_from(_SUM, data, at + 12 + length)[0]:
        raise ValueError(f"damaged record at offset {at}")
    return payload, at + 12 + length + 5


def unpack(payload: bytes) -> tuple[int, np.ndarray]:
    doc, width = struct.unpack_from(_OWN, payload)
    return doc, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_OWN))


class LibraryCoder(PieceCoder):
    """Pieces encoded by the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        size = self.library.get_vocab_size()
        begins = [(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(size)]
        self.begins = np.array(begins)
        self.width = 2 if size <= 1 << 16 else 4
        super().__init__(self._together, added)

    def _alone(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _together(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of a space and a spaceless rest are encoded in long rows: each begins with
        the only token of its ids that begins with a space."""
        plain = [p[0] == " " and len(p) > 1 and " " not in p[1:] and not p[1].isspace() for p in pieces]
        alone = np.flatnonzero(~np.array(plain))
        rest = np.flatnonzero(plain)
        parts = []
        step = 500
        joined = self._alone(["".join([pieces[i] for i in rest[k : k + step]]) for k in range(0, len(rest), step)])
        for k, ids in enumerate(joined):
            places = rest[k * step : (k + 1) * step]
            flat = np.array(ids, np.int64)
            cuts = np.flatnonzero(self.begins[flat])
            if len(cuts) == len(places):
                parts.append((places, flat, np.diff(np.r_[cuts, len(flat)])))
            else:
                alone = np.r_[alone, places]
        parts.append((alone, *flattened(self._alone([pieces[i] for i in alone]))))
        return put_together(parts, len(pieces))


@lru_cache(maxsize=2)
def _library(name: str) -> LibraryCoder:
    return LibraryCoder(SparkFiles.get(name))


def write_records(
    df: DataFrame,
    folder: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 0,
    file_bytes: int = FILE_BYTES,
) -> None:
    """Encode every whole text, append ``end_id``, and write the records in ascending order of
    ids into ``folder`` (shared by all machines).

    Null and empty texts give records with the end id alone. A null id comes last. Rows that
    repeat an id each give a record, in an order fixed by their texts. An empty table gives no
    records. Columns other than the two named are not read.
    """
    name = ship_file(df.sparkSession, tokenizer)
    rows = df.select(id_or_last(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    # Ranges of ids, by a sample of the plain scan; encoding runs after the shuffle, once.
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie", "text")

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _library(name)
        kind = np.dtype(f"<u{coder.width}")
        roll = at = number = 0
        for batch in batches:
            places, values, rolls = [], [], []
            doc_ids = iter(batch.column(0).to_pylist())
            for group in groups("" if t is None else t for t in batch.column(1).to_pylist()):
                flat, edges = coder.encode(group)
                flat = flat.astype(kind)
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    ids = flat[a:b].tobytes() + end_id.to_bytes(coder.width, "little")
                    record = frame(struct.pack(_OWN, next(doc_ids), coder.width) + ids)
                    if at and at + len(record) > file_bytes:
                        roll, at = roll + 1, 0
                    rolls.append(roll)
                    places.append(struct.pack(_PLACE, at))
                    values.append(record)
                    at += len(record)
            n = len(values)
            seq = list(range(number, number + n))
            number += n
            for what, own in (("data", [v[:-1] for v in values]), ("index", places)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([what] * n), pa.array(rolls, pa.int32()), pa.array(seq, pa.int64()), pa.array(own, pa.binary())],
                    names=["kind", "roll", "seq", "value"],
                )
        coder.clear()  # the worker outlives the task

    made = ordered.select("id", "text").mapInArrow(frames, "kind string, roll int, seq long, value binary")
    made = made.sortWithinPartitions("kind", "roll", "seq")
    made.select("kind", "roll", F.col("value").cast("string").alias("value")).write.partitionBy("kind", "roll").text(folder)


def _files(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """``task``, ``roll`` (ascending in the order of the records) and ``content``."""
    path = F.col("path")
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "part-*")
        .load(f"{folder}/kind={kind}")
        .select(
            F.regexp_extract(path, r"/part-(\d+)-", 1).cast("long").alias("task"),
            F.regexp_extract(path, r"/roll=(\d+)/", 1).cast("long").alias("roll"),
            "content",
        )
    )


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Per record, from the files: ``id``, ``start`` (token ids of all records before it),
    ``n_tokens`` and ``ids_crc32`` (over the ids as 32-bit little-endian numbers). All
    checksums are verified; a damaged file is an error."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = memoryview(batch.column(2)[i].as_buffer())
                docs, counts, sums, at = [], [], [], 0
                while at < len(data):
                    payload, at = read_record(data, at)
                    doc, ids = unpack(payload)
                    docs.append(doc)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.astype("<u4").tobytes()))
                n = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([batch.column(0)[i].as_py()] * n, pa.int64()),
                        pa.array([batch.column(1)[i].as_py()] * n, pa.int64()),
                        pa.array(docs, pa.int64()),
                        pa.array(np.cumsum(counts) - np.array(counts, np.int64), pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["task", "roll", "id", "inside", "n_tokens", "ids_crc32"],
                )

    # One file per task-sized piece: a whole file is one row.
    spec = "task long, roll long, id long, inside long, n_tokens long, ids_crc32 long"
    rows = cut_lineage(_files(spark, folder, "data").mapInArrow(scan, spec))
    totals = rows.groupBy("task", "roll").agg(F.sum("n_tokens").alias("n"))
    # One row per file of some 32 MB.
    before = Window.orderBy("task", "roll").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("task", "roll", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(totals, ["task", "roll"]).select(
        "id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """``id`` and ``ids`` (little-endian, 32 bits each) of all records in an order drawn from
    ``seed``: files in a drawn order, and inside a file by its offset index."""
    data = _files(spark, folder, "data")
    index = _files(spark, folder, "index").withColumnRenamed("content", "places")
    both = data.join(index, ["task", "roll"]).withColumn("rank", F.xxhash64("task", "roll", F.lit(seed)))
    both = both.repartitionByRange("rank").sortWithinPartitions("rank").select("rank", "content", "places")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = memoryview(batch.column(1)[i].as_buffer())
                raw = batch.column(2)[i].as_py()
                places = np.frombuffer(raw, np.dtype([("at", "<u8"), ("end", "u1")]))["at"]
                rng = np.random.default_rng([seed & 0xFFFFFFFF, batch.column(0)[i].as_py() & 0xFFFFFFFF])
                found = [unpack(read_record(data, int(at))[0]) for at in rng.permutation(places)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1].astype("<u4").tobytes() for f in found], pa.binary()),
                    ],
                    names=["id", "ids"],
                )

    return both.mapInArrow(fetch, "id long, ids binary")


def new_folder(spark: SparkSession) -> str:
    """A folder of its own inside the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/records-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    jvm, sc = spark._jvm, spark.sparkContext
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def public_id(column: str):
    return F.when(F.col(column) != NO_ID, F.col(column))
