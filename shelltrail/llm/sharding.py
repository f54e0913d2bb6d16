"""Reproducible shuffle and sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 to n-1 in the order of (id, size, checksum). A balanced Feistel
network permutes the smallest even-bit domain that holds n; a value outside of 0 to n-1
is encrypted again until it falls inside (cycle walking), which makes the network a
permutation of exactly the row numbers. The place of a row after the shuffle is a
formula: ``shard = place % shards`` and ``slot = place // shards``, so shard sizes differ
by one row at most (law ``rows``) whatever the keys, sources or copies are. The inverse
gives the row number that sits in a slot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrail.llm.common import staged, table

ROUNDS = 6
SEED = 20240229
SHARDS = 8


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(1, 2**32, rounds)]


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    """A 32-bit mixing function of half a block."""
    x = ((x ^ np.uint64(key)) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
    x ^= x >> np.uint64(15)
    x = (x * np.uint64(0x85EBCA6B)) & np.uint64(0xFFFFFFFF)
    return x ^ (x >> np.uint64(13))


def _network(x: np.ndarray, half: int, keys: list[int], inverse: bool) -> np.ndarray:
    mask, width = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> width, x & mask
    for key in reversed(keys) if inverse else keys:
        if inverse:
            left, right = right ^ (_mix(left, key) & mask), left
        else:
            left, right = right, left ^ (_mix(right, key) & mask)
    return (left << width) | right


def permute(rows: np.ndarray, total: int, seed: int = SEED, inverse: bool = False) -> np.ndarray:
    """Places of row numbers below ``total`` (at most 2**62), or row numbers of places."""
    half, keys = max(1, ((total - 1).bit_length() + 1) // 2), round_keys(seed)
    out = _network(np.asarray(rows, np.uint64), half, keys, inverse)
    outside = np.flatnonzero(out >= total)
    while len(outside):
        out[outside] = _network(out[outside], half, keys, inverse)
        outside = outside[out[outside] >= total]
    return out.astype(np.int64)


def row_at(shard: int, slot: int, total: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The row number that the shuffle puts into a slot of a shard."""
    return int(permute(np.array([slot * shards + shard]), total, seed, inverse=True)[0])


def number_rows(rows: DataFrame, order: list[str]) -> DataFrame:
    """``row`` from 0 in the order of columns, and ``total``; rows equal in them are alike.

    Range partitions are numbered by themselves and shifted by the rows before them. The
    row id in the range key lets equal rows spread over partitions. The pieces are written
    once, because the cut points come from a sample.
    """
    pieces = staged(
        rows.withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange(*order, "tie")
        .sortWithinPartitions(*order, "tie")
        .drop("tie")
        .withColumn("seq", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("piece", F.shiftright("seq", 33))
    # one row for each range partition
    counts = pieces.groupBy("piece").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    earlier = W.orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(
        "piece",
        (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(W.partitionBy()).alias("total"),
    )
    return (
        pieces.join(offsets, "piece")
        .withColumn("row", F.col("seq") + F.col("shift"))
        .drop("piece", "seq", "shift")
    )


def shard_rows(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, row, position, shard, slot.

    A null text has no bytes: size 1 and checksum 0. Null and repeated ids and repeated rows
    each get a place of their own; of rows with the same id, size and checksum it is left
    open which gets which, and the result is the same either way. An empty table gives an
    empty result. Other columns do not travel: join them by id. Texts, however long, only give their
    size and checksum.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(text_col, F.lit(""))
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )

    @F.pandas_udf("bigint")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for row, total in batches:
            yield pd.Series(permute(row.to_numpy(), int(total.iloc[0]), seed) if len(row) else [])

    return (
        number_rows(rows, ["doc_id", "size", "text_crc32"])
        .withColumn("position", place("row", "total"))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            (F.col("position") % shards).cast("int").alias("shard"),
            F.expr(f"position div {shards}").alias("slot"),
            "row",
            "position",
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
        "position",
    )
