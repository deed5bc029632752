"""Helpers that several operators share: tables, Arrow plumbing, small constants."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from verseflux.lineage import release  # noqa: F401
from verseflux.session import ship_package

#: Bytes that separate words: space and the five ASCII controls from tab to carriage return.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Stands for a null id where ids are compared: it is larger than any id in use.
NO_ID = 2**63 - 1
#: Rows of an Arrow batch.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, and keep batches of whole texts small: a batch is held
    by the JVM and by Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return ship_package(spark)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_or_last(column: str):
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


def without(df: DataFrame, names) -> DataFrame:
    """``df`` without the named columns, in any case; columns to be added replace them."""
    clash = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in clash]
    return df if len(kept) == len(df.columns) else df.select(*[f"`{c}`" for c in kept])


def add_arrow(
    df: DataFrame,
    needs: list[str],
    added: str,
    function: Callable[..., dict[str, pa.Array]],
    close: Callable[[], None] | None = None,
) -> DataFrame:
    """``df`` and the columns of the schema text ``added``, computed batch by batch.

    ``function`` gets the columns ``needs`` as Arrow arrays and returns one array per added
    column. Columns of ``df`` with an added name are replaced; needed columns whose name begins
    with two underscores are helpers and do not stay. ``close`` runs at the end of a task: Python
    workers outlive tasks, and what they hold counts against the next stage.
    """
    schema = StructType.fromDDL(added)
    names = schema.names
    rest = without(df, names)
    rest = rest.select(*[f"`{c}`" for c in rest.columns if c not in needs or not c.startswith("__")])
    width = len(rest.columns)
    plain = df.select(*[f"`{c}`" for c in rest.columns], *[F.col(n).alias(f"__{i}") for i, n in enumerate(needs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                made = function(*[batch.column(width + i) for i in range(len(needs))])
                columns = batch.columns[:width] + [made[n] for n in names]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:width] + names)
        finally:
            if close is not None:
                close()

    return plain.mapInArrow(run, StructType(list(rest.schema.fields) + list(schema.fields)))


def texts(column: pa.Array) -> list[bytes]:
    """Whole texts as UTF-8 bytes; a null is an empty text."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
