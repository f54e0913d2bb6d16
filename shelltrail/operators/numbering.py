"""Numbering of ordered rows, without sorting a whole history in one task.

Rows are counted per block of bounded size, the block counts are summed up in
order, and a row's number is the sum before its block plus its place in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrail.operators.chunks import CHUNK_ROWS
from shelltrail.session import staged

# Rows that one task sorts when rows are put in order.
PIECE_ROWS = 1 << 21

MAX_LONG = 9223372036854775807

# Fixed value: format of a history line.
LINE_FORMAT = r"^: ([0-9]+):[0-9]+;([^\n]*)\z"


def with_offsets(blocks: DataFrame, keys: list[str], block: str) -> DataFrame:
    """``rows_before``: rows of the same keys in earlier blocks, from a ``rows`` count per block."""
    earlier = W.partitionBy(*keys).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn("rows_before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))


def parse_lines(lines: DataFrame) -> DataFrame:
    """Keep the lines that hold a command and take them apart.

    One carriage return at the end belongs to the line break. A time too large
    for a long becomes the largest long.
    """
    value = F.regexp_replace("value", F.lit(r"\r\z"), F.lit(""))
    rest = [c for c in lines.columns if c != "value"]
    fits = F.regexp_extract("v", LINE_FORMAT, 1).try_cast("bigint")
    return (
        lines.select(*rest, value.alias("v"))
        .where(F.rlike("v", F.lit(LINE_FORMAT)))
        .select(
            *rest,
            F.coalesce(fits, F.lit(MAX_LONG)).alias("epoch_s"),
            F.lit(True).alias("has_time"),
            F.regexp_extract("v", LINE_FORMAT, 2).alias("command"),
        )
    )


def number_commands(parsed: DataFrame, block_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number parsed lines from 1 per history, in the order of their unique ``pos``."""
    rows = parsed.withColumn("block", F.expr(f"pos div {block_rows}L"))
    blocks = rows.groupBy("history_id", "block").agg(F.count("*").alias("rows"))
    offsets = with_offsets(blocks, ["history_id"], "block").drop("rows")
    place = F.row_number().over(W.partitionBy("history_id", "block").orderBy("pos"))
    return (
        rows.withColumn("place", place)
        .join(offsets, ["history_id", "block"])
        .select(
            "history_id",
            (F.col("rows_before") + F.col("place")).cast("bigint").alias("number"),
            "epoch_s",
            "has_time",
            "command",
        )
    )


def number_in_order(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Number rows from 1 per ``key`` in the order of any columns.

    ``order`` must be unique within ``key``. A range partitioning cuts long keys
    into pieces of even size. Its cut points come from a sample, so the pieces are
    written once before anything is derived from them.
    """
    count = rows.count() // PIECE_ROWS + 1
    count = max(count, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pieces = staged(
        rows.repartitionByRange(count, key, *order)
        .sortWithinPartitions(key, *order)
        .withColumn("piece", F.spark_partition_id())
        .withColumn("seq", F.monotonically_increasing_id()),
        name,
    )
    counts = pieces.groupBy(key, "piece").agg(
        F.count("*").alias("rows"), F.min("seq").alias("first_seq")
    )
    offsets = with_offsets(counts, [key], "piece").drop("rows")
    numbered = pieces.join(offsets, [key, "piece"]).withColumn(
        "number", (F.col("rows_before") + F.col("seq") - F.col("first_seq") + 1).cast("bigint")
    )
    return numbered.drop("piece", "seq", "first_seq", "rows_before")


def check_range(first: int, last: int) -> None:
    if first > last:
        raise ValueError("invalid range: the first number must not be above the last")


def number_range(commands: DataFrame, first: int, last: int) -> DataFrame:
    """Commands with a number from ``first`` to ``last``, both included."""
    check_range(first, last)
    return commands.where(F.col("number").between(first, last))


def range_status(histories: DataFrame, selected: DataFrame) -> DataFrame:
    """Per history: commands in the selection and ``ok`` or ``empty``."""
    counts = selected.groupBy("history_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return (
        histories.select("history_id")
        .join(counts, "history_id", "left")
        .select(
            "history_id",
            n.alias("commands"),
            F.when(n > 0, "ok").otherwise("empty").alias("status"),
        )
    )


def positions(commands: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``idx``, the 0-based place of a command among those of its history."""
    rows = commands.withColumn("block", F.expr(f"number div {chunk_rows}L"))
    blocks = rows.groupBy("history_id", "block").agg(F.count("*").alias("rows"))
    offsets = with_offsets(blocks, ["history_id"], "block").drop("rows")
    place = F.row_number().over(W.partitionBy("history_id", "block").orderBy("number"))
    return (
        rows.withColumn("place", place)
        .join(offsets, ["history_id", "block"])
        .withColumn("idx", (F.col("rows_before") + F.col("place") - 1).cast("bigint"))
        .drop("block", "place", "rows_before")
    )
