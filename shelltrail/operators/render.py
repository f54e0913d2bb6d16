"""Rendering of steps and guides as markdown.

A history may be too long for one string. Text is therefore laid out as pieces
(heading, command, closing), each with its place in the history, and joined into
parts of bounded rows and bytes (:mod:`shelltrail.operators.parts`). The parts of a history
in the order of ``part_no`` are its document; a shorter history has exactly one,
wherever its numbers begin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrail.functions.catalogue import intent_phrase, prerequisite_of
from shelltrail.functions.text import required_tool
from shelltrail.operators.parts import PART_BYTES, PART_ROWS, joined
from shelltrail.session import shuffled

# Wording of a guide.
NO_COMMANDS = "This runbook contains no commands."
COVERS = "This runbook covers: %s."
CONTAINS = "It contains %d steps with %d commands total."
DEFAULT_TITLE = "Runbook"
RANGE_TEXT = "commands #%d to #%d"

# order of the pieces that share a number
HEADER, HEADING, COMMAND, CLOSING, NOTES = range(5)


def clock(epoch_s: Column) -> Column:
    """Time of day in UTC."""
    day = F.pmod(epoch_s, F.lit(86400))
    hour, minute = F.floor(day / 3600), F.floor(F.pmod(day, F.lit(3600)) / 60)
    return F.format_string("%02d:%02d:%02d", hour, minute, F.pmod(day, F.lit(60)))


def step_pieces(stepped: DataFrame, steps: DataFrame, timestamps: bool = False) -> DataFrame:
    """Pieces of all steps. Headings and closings come from ``steps``, so commands need no join."""
    heading = F.concat(
        F.format_string("### Step %d: %s\n\n", "step_no", "title"),
        F.when(F.col("description") != "", F.concat("description", F.lit("\n\n"))).otherwise(""),
        F.lit("```bash\n"),
    )
    why = F.when(F.col("intent") != "", F.concat(F.lit("\n**Why:** "), "intent", F.lit("\n")))
    closing = F.concat(F.lit("```\n"), F.coalesce(why, F.lit("")))
    frame = steps.select(
        "history_id",
        "step_no",
        F.inline(
            F.array(
                _piece(F.col("first_number"), HEADING, heading),
                _piece(F.col("last_number"), CLOSING, closing),
            )
        ),
    )
    line = F.concat("command", F.lit("\n"))
    if timestamps:
        stamp = F.concat(F.lit("# "), clock(F.col("epoch_s")), F.lit("\n"))
        line = F.concat(F.when(F.col("has_time"), stamp).otherwise(""), line)
    lines = stepped.select(
        "history_id",
        "step_no",
        "number",
        F.lit(COMMAND).alias("seq"),
        line.alias("text"),
    )
    return frame.unionByName(lines)


def _piece(number: Column, seq: int, text: Column) -> Column:
    return F.struct(number.alias("number"), F.lit(seq).alias("seq"), text.alias("text"))


def step_markdown(
    stepped: DataFrame,
    steps: DataFrame,
    timestamps: bool = False,
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Markdown per step, in one part unless the step is very long.

    Both tables are read twice: stage them first if they are costly.
    """
    pieces = step_pieces(stepped, steps, timestamps)
    return joined(pieces, ["history_id", "step_no"], "markdown", part_rows, part_bytes)


def overview(histories: DataFrame, steps: DataFrame) -> DataFrame:
    """One paragraph per history; intents in the order in which they first appear."""
    per_intent = steps.groupBy("history_id", "intent").agg(
        F.min("step_no").alias("step_no"),
        F.count("*").alias("n"),
        F.sum("commands").alias("commands"),
    )
    named = F.when(F.col("intent") != "", F.struct("step_no", "intent"))
    counts = per_intent.groupBy("history_id").agg(
        F.sort_array(F.collect_list(named)).alias("covered"),
        F.sum("n").cast("bigint").alias("steps"),
        F.sum("commands").cast("bigint").alias("commands"),
    )
    covered = F.array_join(F.transform("covered", lambda x: intent_phrase(x["intent"])), ", ")
    text = F.when(F.col("steps").isNull(), F.lit(NO_COMMANDS)).otherwise(
        F.concat_ws(
            " ",
            F.when(F.size("covered") > 0, F.format_string(COVERS, covered)),
            F.format_string(CONTAINS, "steps", "commands"),
        )
    )
    return (
        histories.select("history_id")
        .join(shuffled(counts), "history_id", "left")
        .select("history_id", text.alias("overview"))
    )


def prerequisites(stepped: DataFrame) -> DataFrame:
    """What a history needs, with the number of the first command that needs it."""
    return (
        stepped.select(
            "history_id", "number", prerequisite_of(required_tool("command")).alias("prerequisite")
        )
        .where(F.col("prerequisite").isNotNull())
        .groupBy("history_id", "prerequisite")
        .agg(F.min("number").alias("first_number"))
    )


def prerequisite_lists(needed: DataFrame) -> DataFrame:
    """Prerequisites per history as an array, in order of first appearance."""
    ordered = F.sort_array(F.collect_list(F.struct("first_number", "prerequisite")))
    return needed.groupBy("history_id").agg(
        F.transform(ordered, lambda x: x["prerequisite"]).alias("prerequisites")
    )


def documents(
    heads: DataFrame,
    stepped: DataFrame,
    steps: DataFrame,
    generated_at: str,
    title: str = DEFAULT_TITLE,
    range_text: str = "",
    timestamps: bool = False,
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Guides as ``history_id, part_no, markdown``.

    ``heads`` has one row per history: ``overview``, ``prerequisites`` (array or
    null) and ``redactions``.
    """
    ends = steps.groupBy("history_id").agg(
        F.min("first_number").alias("first_number"), F.max("last_number").alias("last_number")
    )
    needs = F.when(
        F.size("prerequisites") > 0,
        F.concat(
            F.lit("## Prerequisites\n\n- "),
            F.array_join("prerequisites", "\n- "),
            F.lit("\n\n"),
        ),
    )
    header = F.concat(
        F.lit(f"# {title}\n\n## Overview\n\n"),
        F.col("overview"),
        F.lit("\n\n"),
        F.coalesce(needs, F.lit("")),
        F.lit("## Steps\n\n"),
    )
    notes = F.concat(
        F.lit(f"## Notes\n\n- Generated from bash history on {generated_at}\n"),
        F.lit(f"- Time range: {range_text}\n" if range_text else ""),
        F.when(
            F.col("redactions") > 0, F.format_string("- Commands sanitized: %d\n", "redactions")
        ).otherwise(""),
    )
    # a guide without steps has both pieces at number 0
    first = F.coalesce("first_number", F.lit(0)).cast("bigint")
    last = F.coalesce("last_number", F.lit(0)).cast("bigint")
    frame = heads.join(shuffled(ends), "history_id", "left").select(
        "history_id",
        F.inline(F.array(_piece(first, HEADER, header), _piece(last, NOTES, notes))),
    )
    body = step_pieces(stepped, steps, timestamps)
    body = body.select(
        "history_id",
        "number",
        "seq",
        F.when(F.col("seq") == CLOSING, F.concat("text", F.lit("\n"))).otherwise(F.col("text")).alias("text"),
    )
    return joined(frame.unionByName(body), ["history_id"], "markdown", part_rows, part_bytes)
