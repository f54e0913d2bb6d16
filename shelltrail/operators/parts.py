"""Long texts in parts.

A text that belongs to a key (a history, a step, a prompt) is laid out as pieces with a place
``(number, seq)`` and joined in their order. A key may hold more text than fits into one row, so
it is cut into parts: a part spans fewer than ``part_rows`` numbers, counted from the first piece
of the key, and at most ``part_bytes`` bytes, unless a single piece is longer than that. In detail,
with the bytes of all pieces of the key before a piece as its start, a part begins at the first piece,
where ``(number - first) div part_rows`` differs from that of the piece before, and in a key of more than
``part_bytes`` bytes where ``start div (part_bytes div 2)`` differs too, and before and behind a piece of
more than ``part_bytes div 2`` bytes. Parts are numbered from 0 without gaps.

Starts are running sums over chunks of a key, with a table of one row per chunk that carries sums
over the seams; no window or group holds a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrail.operators.chunks import CHUNK_ROWS
from shelltrail.session import staged

PART_ROWS = 1 << 18
PART_BYTES = 1 << 26

# Places where parts begin travel to all tasks up to this many of them.
MAX_BROADCAST_CUTS = 100_000


def _place() -> Column:
    return F.struct(F.col("number").cast("bigint").alias("number"), F.col("seq").cast("int").alias("seq"))


def part_cuts(
    sizes: DataFrame,
    keys: list[str],
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame | None:
    """Where parts begin: a row for each chunk of the keys with several parts; None if there is none.

    ``sizes`` has the keys, ``number``, ``seq`` and ``size`` (bytes) of all pieces. The result has
    ``chunk``, ``base`` (parts that begin in earlier chunks, the first part not counted) and
    ``cuts`` (places in the chunk where a part begins). One pass over ``sizes`` decides
    whether anything is to be cut.
    """
    half = max(1, part_bytes // 2)
    narrow = sizes.select(*keys, "number", "seq", F.col("size").cast("bigint").alias("size"))
    rows_apart = F.expr(f"(high - low) div {part_rows}L > 0")
    spans = narrow.groupBy(*keys).agg(
        F.min("number").alias("low"), F.max("number").alias("high"), F.sum("size").alias("bytes")
    )
    if spans.where(rows_apart | (F.col("bytes") > part_bytes)).isEmpty():
        return None

    narrow = narrow.withColumn("chunk", F.expr(f"number div {chunk_rows}L"))
    table = narrow.groupBy(*keys, "chunk").agg(
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.sum("size").alias("bytes"),
        F.max_by("size", _place()).alias("last_size"),
    )
    over = W.partitionBy(*keys).orderBy("chunk")
    earlier = over.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(*keys)
    table = table.withColumns(
        {
            "before": F.coalesce(F.sum("bytes").over(earlier), F.lit(0)),
            "first": F.min("low").over(every),
            "last": F.max("high").over(every),
            "total": F.sum("bytes").over(every),
        }
    )

    def state(number: Column, start: Column, size: Column) -> Column:
        """Pieces with different states, or long ones, are in different parts."""
        block = F.call_function("div", number - F.col("first"), F.lit(part_rows).cast("bigint"))
        large = F.col("total") > part_bytes
        slot = F.when(large, F.call_function("div", start, F.lit(half).cast("bigint")))
        return F.struct(
            block.alias("block"), F.coalesce(slot, F.lit(0)).alias("slot"), (large & (size > half)).alias("long")
        )

    end = state(F.col("high"), F.col("before") + F.col("bytes") - F.col("last_size"), F.col("last_size"))
    table = table.withColumn("seam", F.lag(end).over(over))
    long = F.expr(f"(last - first) div {part_rows}L > 0") | (F.col("total") > part_bytes)
    table = table.where(long).select(*keys, "chunk", "before", "first", "total", "seam")

    inside = W.partitionBy(*keys, "chunk").orderBy("number", "seq")
    sums = F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = narrow.join(table, [*keys, "chunk"]).withColumn("start", F.col("before") + sums)
    rows = rows.withColumn("state", state(F.col("number"), F.col("start"), F.col("size")))
    rows = rows.withColumn("earlier", F.coalesce(F.lag("state").over(inside), F.col("seam")))
    begins = (F.col("state") != F.col("earlier")) | F.col("state.long") | F.col("earlier.long")
    place = F.when(F.col("earlier").isNotNull() & begins, _place())
    cuts = rows.groupBy(*keys, "chunk").agg(F.array_sort(F.collect_list(place)).alias("cuts"))
    base = F.coalesce(F.sum(F.size("cuts")).over(earlier), F.lit(0)).cast("bigint")
    return staged(cuts.withColumn("base", base), "part-cuts")


def with_part(
    pieces: DataFrame, cuts: DataFrame | None, keys: list[str], chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Add ``part_no`` to rows with the keys, ``number`` and ``seq``."""
    if cuts is None:
        return pieces.withColumn("part_no", F.lit(0).cast("bigint"))
    if cuts.agg(F.sum(F.size("cuts") + 1)).first()[0] <= MAX_BROADCAST_CUTS:
        cuts = F.broadcast(cuts)
    rows = pieces.withColumn("chunk", F.expr(f"number div {chunk_rows}L")).withColumn("place", _place())
    begun = F.size(F.filter("cuts", lambda c: c <= F.col("place")))
    part = F.coalesce(F.col("base") + begun, F.lit(0)).cast("bigint")
    return (
        rows.join(cuts, [*keys, "chunk"], "left")
        .withColumn("part_no", part)
        .drop("chunk", "place", "cuts", "base")
    )


def joined(
    pieces: DataFrame,
    keys: list[str],
    name: str,
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Concatenate the pieces of each key and part in order: the keys, ``part_no`` and ``name``.

    ``pieces`` has ``text`` and, where another size than that of the text is to decide, ``size``.
    """
    size = F.col("size") if "size" in pieces.columns else F.octet_length("text")
    sizes = pieces.select(*keys, "number", "seq", size.alias("size"))
    cuts = part_cuts(sizes, keys, part_rows, part_bytes, chunk_rows)
    ordered = F.sort_array(F.collect_list(F.struct("number", "seq", "text")))
    return (
        with_part(pieces.select(*keys, "number", "seq", "text"), cuts, keys, chunk_rows)
        .groupBy(*keys, "part_no")
        .agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias(name))
    )
