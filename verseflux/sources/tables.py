"""CSV and Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verseflux.schemas import require_columns

# Cell texts that stand for a missing value in CSV input.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Both ways: by default the writer would trim white space from the cells.
CSV_OPTIONS = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "encoding": "UTF-8",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a table that arrives in fewer partitions than there are cores.

    For expensive per-row work on an input that is one file with one row group. A scan of many
    files already has more partitions, and then nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    missing: list[str] | None = None,
    multi_line: bool = False,
    bad_cells: str | None = None,
) -> DataFrame:
    """CSV with header and doubled quotes, typed by ``schema``.

    Columns are matched by header name, in any order; absent ones raise ``ValueError``.
    Texts listed in ``missing`` (default: the usual ones) become null, and so do cells that are
    not of their column's type; ``bad_cells`` names a column that lists the columns of such
    cells. ``multi_line`` is for cells with line breaks, such as song texts: a file is then read
    by one task.
    """
    missing = MISSING if missing is None else missing
    raw = spark.read.options(multiLine=multi_line, **CSV_OPTIONS).csv(path)
    require_columns(raw, schema.fieldNames())
    cells, bad = [], []
    for field in schema.fields:
        text = F.when(~F.col(field.name).isin(missing), F.col(field.name))
        cell = text.try_cast(field.dataType)
        cells.append(cell.alias(field.name))
        bad.append(F.when(text.isNotNull() & cell.isNull(), F.lit(field.name)))
    if bad_cells is not None:
        cells.append(F.array_compact(F.array(*bad)).alias(bad_cells))
    return raw.select(*cells)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header row in folder ``path``, one per partition, no index column."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_table(
    df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None
) -> None:
    """Parquet, the exchange format between plans. Keeps '' apart from null, unlike CSV."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
