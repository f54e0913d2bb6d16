"""Ordered work on histories of any length.

A window over a whole history would put that history into one task. Here a
history is cut by ``number`` into chunks of at most ``CHUNK_ROWS`` numbers, so
that (history_id, chunk) is a bounded key. Windows run inside a chunk; what
crosses a seam travels through a table with one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 18
# The chunk comes first, so that rows sorted for a window are also sorted by chunk.
KEYS = ["chunk", "history_id"]


def with_chunk(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return df.withColumn("chunk", F.expr(f"number div {chunk_rows}L"))


def in_chunk() -> WindowSpec:
    return W.partitionBy(*KEYS).orderBy("number")


def before_row() -> WindowSpec:
    return in_chunk().rowsBetween(W.unboundedPreceding, -1)


def up_to_row() -> WindowSpec:
    return in_chunk().rowsBetween(W.unboundedPreceding, 0)


def over_chunks() -> WindowSpec:
    """Order of the chunks of a history, for tables with one row per chunk."""
    return W.partitionBy("history_id").orderBy("chunk")


def earlier_chunks() -> WindowSpec:
    return over_chunks().rowsBetween(W.unboundedPreceding, -1)


def has_seams(df: DataFrame, chunk_rows: int = CHUNK_ROWS) -> bool:
    """Whether any history is longer than a chunk: one pass over one number column."""
    top = df.agg(F.min("number"), F.max("number")).first()
    if top[1] is None:
        return False
    return top[0] // chunk_rows != top[1] // chunk_rows


def with_previous(
    df: DataFrame, columns: list[str], chunk_rows: int = CHUNK_ROWS, seams: bool | None = None
) -> DataFrame:
    """Add ``previous``, a struct of the columns in the row before (null in the first row)."""
    if seams is None:
        seams = has_seams(df, chunk_rows)
    state = F.struct(*columns)
    rows = with_chunk(df, chunk_rows).withColumn("previous", F.lag(state).over(in_chunk()))
    if seams:
        last = rows.groupBy(*KEYS).agg(F.max_by(state, "number").alias("last"))
        last = last.select(*KEYS, F.lag("last").over(over_chunks()).alias("seam"))
        rows = rows.join(last, KEYS, "left").withColumn("previous", F.coalesce("previous", "seam"))
    return rows.select(*df.columns, "previous")
