"""Predicates on neighbouring commands, each usable on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrail.functions.text import (
    edit_distance,
    is_superseded,
    is_typo,
    longer_after,
    trim_space,
)
from shelltrail.operators.chunks import CHUNK_ROWS, with_previous
from shelltrail.operators.dedup import TIME_GAP_S


def neighbours(commands: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each command but the first with the one before: trimmed texts ``a``, ``b`` and both times."""
    rows = with_previous(commands, ["command", "epoch_s", "has_time"], chunk_rows)
    return rows.where(F.col("previous").isNotNull()).select(
        "history_id",
        "number",
        trim_space("previous.command").alias("a"),
        trim_space("command").alias("b"),
        F.struct("previous.epoch_s", "previous.has_time").alias("before"),
        F.struct("epoch_s", "has_time").alias("now"),
    )


def consecutive_duplicates(pairs: DataFrame, time_gap_s: int = TIME_GAP_S) -> DataFrame:
    """Commands equal to the one before; ``intentional`` if a longer pause lies between."""
    late = (
        F.col("before.has_time")
        & F.col("now.has_time")
        & longer_after(F.col("before.epoch_s"), F.col("now.epoch_s"), time_gap_s)
    )
    return pairs.where(F.col("a") == F.col("b")).select(
        "history_id", "number", F.coalesce(late, F.lit(False)).alias("intentional")
    )


def typo_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(is_typo("a", "b")).select("history_id", "number", "a", "b")


def distances(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        "history_id", "number", edit_distance("a", "b").cast("bigint").alias("distance")
    )


def superseded_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where(is_superseded("a", "b")).select("history_id", "number", "a", "b")
