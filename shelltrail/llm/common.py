"""Small helpers that the operators of this folder share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from shelltrail.session import stage

# Rows, and about bytes, that travel to a Python worker at once.
BATCH_ROWS = 512
BATCH_BYTES = 1 << 23


def bound_batches(spark: SparkSession) -> None:
    """Bound a worker's memory, also for long texts, in the jobs that the session runs from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``doc_id`` and ``text``, a null text as an empty one; other columns cannot clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))


def give_back() -> None:
    """Return free memory of a Python worker, which later stages use again, to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def with_column(
    df: DataFrame, name: str, kind: DataType, text_col: str, make: Callable[[], Callable[[pa.Array], pa.Array]]
) -> DataFrame:
    """``df`` with one more column, computed from the batches of a text column.

    All rows and columns stay; a column that has the name already, in any case of its letters, is an
    error. ``make`` is called once in each task and gives the function from texts (null as empty) to values.
    """
    if name.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"there is a column {name} already")
    rest = df

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = make()
        for batch in batches:
            text = pc.fill_null(batch.column(text_col), "")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, values(text)], names=[*batch.schema.names, name]
            )
        del values
        give_back()

    return rest.mapInArrow(run, StructType([*rest.schema.fields, StructField(name, kind)]))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a compressed table in the shared folder, and read back."""
    return df.sparkSession.read.schema(df.schema).parquet(stage(df, name, "zstd"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column without nulls, and the n + 1 offsets of its rows."""
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def learned_fold(id_col: str, folds: int, held_out: int):
    """True for the rows whose labels may be learned, by crc32 of the id as text."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds != held_out
