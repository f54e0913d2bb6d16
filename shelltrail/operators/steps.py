"""Cutting a history into steps.

A step ends where the tool changes to an unrelated one, after a pause, or where a
recognised intent ends. The intent of a step always equals that of its latest
command, so the cut depends on the row before only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrail.functions.catalogue import (
    Workflow,
    intent_of,
    relation_key,
    tool_title,
    workflow_title,
)
from shelltrail.functions.text import longer_after, step_tool
from shelltrail.operators.chunks import (
    CHUNK_ROWS,
    KEYS,
    earlier_chunks,
    has_seams,
    in_chunk,
    over_chunks,
    up_to_row,
    with_chunk,
)

THRESHOLD_S = 60

_STATE = ("related", "intent", "epoch_s", "has_time")


def with_tool_and_intent(commands: DataFrame, workflows: Sequence[Workflow] = ()) -> DataFrame:
    return commands.withColumn("tool", step_tool("command")).withColumn(
        "intent", intent_of(F.col("command"), tuple(workflows))
    )


def _cut(before: Column, now: Column, threshold_s: int) -> Column:
    """Whether a step starts here; ``before`` and ``now`` are structs of ``_STATE``."""
    later = longer_after(before["epoch_s"], now["epoch_s"], threshold_s)
    pause = before["has_time"] & now["has_time"] & later
    ended = (before["intent"] != "") & (before["intent"] != now["intent"])
    return (before["related"] != now["related"]) | pause | ended


def cut_steps(
    rows: DataFrame,
    threshold_s: int = THRESHOLD_S,
    chunk_rows: int = CHUNK_ROWS,
    seams: bool | None = None,
) -> DataFrame:
    """Add ``starts`` and ``step_no`` to rows with a tool and an intent."""
    if seams is None:
        seams = has_seams(rows, chunk_rows)
    columns = rows.columns
    rows = with_chunk(rows, chunk_rows).withColumn("related", relation_key(F.col("tool")))
    state = F.struct(*_STATE)
    before = F.lag(state).over(in_chunk())
    # the first row of a chunk is decided by the seam
    starts = F.when(before.isNull(), F.lit(None if seams else True)).otherwise(
        _cut(before, state, threshold_s)
    )
    rows = rows.withColumn("starts", starts)
    if seams:
        rows = rows.join(_seams(rows, threshold_s), KEYS, "left").withColumn(
            "starts", F.coalesce("starts", "seam_starts")
        )
    else:
        rows = rows.withColumn("seam_steps", F.lit(0))
    step = F.col("seam_steps") + F.sum(F.col("starts").cast("bigint")).over(up_to_row())
    return rows.select(*columns, "starts", step.cast("bigint").alias("step_no"))


def _seams(rows: DataFrame, threshold_s: int) -> DataFrame:
    """Per chunk: whether its first row starts a step, and the steps before the chunk."""
    state = F.struct(*_STATE)
    table = rows.groupBy(*KEYS).agg(
        F.sum(F.coalesce(F.col("starts").cast("bigint"), F.lit(0))).alias("inner_starts"),
        F.min_by(state, "number").alias("first"),
        F.max_by(state, "number").alias("last"),
    )
    before = F.lag("last").over(over_chunks())
    first_starts = F.when(before.isNull(), F.lit(True)).otherwise(
        _cut(before, F.col("first"), threshold_s)
    )
    table = table.withColumn("seam_starts", first_starts)
    steps = F.col("inner_starts") + F.col("seam_starts").cast("bigint")
    return table.withColumn("steps", steps).select(
        *KEYS,
        "seam_starts",
        F.coalesce(F.sum("steps").over(earlier_chunks()), F.lit(0)).alias("seam_steps"),
    )


def step_commands(
    commands: DataFrame,
    workflows: Sequence[Workflow] = (),
    threshold_s: int = THRESHOLD_S,
    chunk_rows: int = CHUNK_ROWS,
    seams: bool | None = None,
) -> DataFrame:
    """Commands with their ``tool``, ``intent`` and ``step_no``.

    This is the content of the steps. It stays one row per command, because a
    single step may hold a large part of all commands.
    """
    rows = with_tool_and_intent(commands, workflows)
    return cut_steps(rows, threshold_s, chunk_rows, seams)


def summarise(stepped: DataFrame, workflows: Sequence[Workflow] = ()) -> DataFrame:
    """One row per step: title, intent, size and number range.

    Commands are counted per tool and intent before steps are formed. All tools of
    a step are related and it has at most one intent, so that leaves a handful of
    rows per step however long it is. The main tool is the most frequent one, the
    earlier one on a tie.
    """
    workflows = tuple(workflows)
    step = ["history_id", "step_no"]
    counted = stepped.groupBy(*step, "tool", "intent").agg(
        F.count("*").alias("n"),
        F.min("number").alias("first_number"),
        F.max("number").alias("last_number"),
    )
    # one exchange serves both groupings below
    per_tool = (
        counted.repartition(*step)
        .groupBy(*step, "tool")
        .agg(
            F.max("intent").alias("intent"),
            F.sum("n").alias("n"),
            F.min("first_number").alias("first_number"),
            F.max("last_number").alias("last_number"),
        )
    )
    used = F.when(F.col("tool") != "", F.struct("n", -F.col("first_number")))
    steps = per_tool.groupBy(*step).agg(
        F.max("intent").alias("intent"),
        F.max_by("tool", used).alias("main_tool"),
        F.sum("n").cast("bigint").alias("commands"),
        F.min("first_number").alias("first_number"),
        F.max("last_number").alias("last_number"),
    )
    title = F.coalesce(workflow_title(F.col("intent"), workflows), tool_title(F.col("main_tool")))
    return steps.select(
        "history_id",
        "step_no",
        title.alias("title"),
        F.lit("").alias("description"),
        "intent",
        "commands",
        "first_number",
        "last_number",
    )
