"""Tables around a language model: prompts out, responses in.

The call itself is not part of this package. Prompts are tables to be sent by
whatever serves the model, responses are a table with one row per history, kind and
part of the prompt; the parts of an answer are put together in their order, and the
parts that were asked (:func:`prompt_parts`) tell whether all have arrived. Prompt
text is redacted before it leaves; a command that would be removed keeps its line as
a placeholder, so that indices stay those of the commands. Parts of prompts are measured by
the text before redaction, so that the parts that were asked can be told without it.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrail.functions.rules import Rule
from shelltrail.operators.chunks import CHUNK_ROWS, KEYS, with_chunk
from shelltrail.operators.dedup import (
    TIME_GAP_S,
    crosses_chunks,
    dedup,
    dedup_short,
    history_spans,
)
from shelltrail.operators.numbering import positions
from shelltrail.operators.parts import PART_BYTES, PART_ROWS, joined, part_cuts, with_part
from shelltrail.operators.redact import redact
from shelltrail.operators.render import CLOSING, COMMAND, HEADING
from shelltrail.session import shuffled, staged

# Keys of the two response formats. Their case does not matter.
DEDUP_KEYS = ("groups", "representative", "indices", "reason")
EXPLAIN_KEYS = ("overview", "prerequisites", "steps", "title", "description", "why", "notes")


# Bytes that a line of a prompt counts beside its command.
LINE_BYTES = 24


def _line_size() -> Column:
    return (F.octet_length("command") + LINE_BYTES).alias("size")


def dedup_prompt(
    commands: DataFrame,
    extra: Sequence[Rule] = (),
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """One line ``index: command`` per command, joined per history and part."""
    line = F.concat(F.col("idx").cast("string"), F.lit(": "), redact("command", extra), F.lit("\n"))
    pieces = positions(commands).select(
        "history_id", "number", F.lit(COMMAND).alias("seq"), line.alias("text"), _line_size()
    )
    return joined(pieces, ["history_id"], "prompt", part_rows, part_bytes)


def _group_frame(steps: DataFrame) -> DataFrame:
    """Headings and closings of the steps as pieces."""
    title = F.when(F.col("title") != "", F.concat(F.lit(": "), "title")).otherwise("")
    heading = F.concat(F.format_string("## Group %d", "step_no"), title, F.lit("\n"))

    def piece(number: str, seq: int, text: Column) -> Column:
        return F.struct(F.col(number).alias("number"), F.lit(seq).alias("seq"), text.alias("text"))

    frame = steps.select(
        "history_id",
        F.inline(
            F.array(piece("first_number", HEADING, heading), piece("last_number", CLOSING, F.lit("\n")))
        ),
    )
    return frame.withColumn("size", F.octet_length("text"))


def explain_prompt(
    stepped: DataFrame,
    steps: DataFrame,
    extra: Sequence[Rule] = (),
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """A heading per step and its commands below, joined per history and part.

    Commands are redacted here; rows that are redacted already stay as they are.
    """
    lines = stepped.select(
        "history_id",
        "number",
        F.lit(COMMAND).alias("seq"),
        F.concat(F.lit("  $ "), redact("command", extra), F.lit("\n")).alias("text"),
        _line_size(),
    )
    pieces = _group_frame(steps).unionByName(lines)
    return joined(pieces, ["history_id"], "prompt", part_rows, part_bytes)


def whole_history_prompt(
    commands: DataFrame,
    extra: Sequence[Rule] = (),
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """All commands of a history as one group without a title."""
    groups = commands.groupBy("history_id").agg(
        F.min("number").alias("first_number"), F.max("number").alias("last_number")
    )
    groups = groups.withColumns({"step_no": F.lit(1).cast("bigint"), "title": F.lit("")})
    return explain_prompt(commands, groups, extra, part_rows, part_bytes)


_ASKED = "history_id string, asked array<struct<part_no: bigint, first_step: bigint, steps: bigint>>"


def prompt_parts(
    rows: DataFrame,
    steps: DataFrame | None = None,
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``history_id, asked``: the prompt parts of every history whose prompt has several.

    ``asked`` lists ``part_no``, the first step whose heading stands in the part, and the number
    of such steps, in the order of ``part_no``. ``rows`` are those of the prompt, ``steps`` the
    steps of an explain prompt. Histories that are not in the table were asked in one part.
    """
    sizes = rows.select("history_id", "number", F.lit(COMMAND).alias("seq"), _line_size())
    if steps is not None:
        sizes = sizes.unionByName(_group_frame(steps).drop("text"))
    cuts = part_cuts(sizes, ["history_id"], part_rows, part_bytes)
    if cuts is None:
        return rows.sparkSession.createDataFrame([], _ASKED)
    last = cuts.groupBy("history_id").agg(F.sum(F.size("cuts")).alias("last"))
    parts = last.select("history_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("part_no"))
    if steps is None:
        none = F.lit(None).cast("bigint")
        parts = parts.withColumns({"first_step": none, "steps": none})
    else:
        headings = steps.join(last, "history_id", "left_semi").select(
            "history_id", "step_no", F.col("first_number").alias("number"), F.lit(HEADING).alias("seq")
        )
        headings = with_part(headings, cuts, ["history_id"])
        headings = headings.groupBy("history_id", "part_no").agg(
            F.min("step_no").alias("first_step"), F.count("*").alias("steps")
        )
        parts = parts.join(shuffled(headings), ["history_id", "part_no"], "left")
    asked = F.array_sort(F.collect_list(F.struct("part_no", "first_step", "steps")))
    return parts.groupBy("history_id").agg(asked.alias("asked"))


def response_json(body: Column | str, keys: Sequence[str]) -> Column:
    """The text from the first ``{`` to the last ``}`` as a variant; null if it is not JSON."""
    text = F.regexp_extract(body, r"(?s)(\{.*\})", 1)
    for key in keys:
        text = F.regexp_replace(text, rf'(?<!\\)"(?i:{key})"(\s*:)', f'"{key}"$1')
    # the parser stops behind the first value; as items of an array all of the text counts
    items = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>"
    )
    return F.when(F.size(items) == 1, F.get(items, F.lit(0)))


@contextlib.contextmanager
def _last_key_wins(rows: DataFrame) -> Iterator[None]:
    """Of repeated keys of a JSON object the last one counts, in plans made inside the block."""
    conf, key = rows.sparkSession.conf, "spark.sql.variant.allowDuplicateKeys"
    before = conf.get(key)
    conf.set(key, "true")
    try:
        yield
    finally:
        conf.set(key, before)


def _parsed(responses: DataFrame, kind: str, keys: Sequence[str]) -> DataFrame:
    part = F.coalesce("part_no", F.lit(0)) if "part_no" in responses.columns else F.lit(0)
    rows = responses.where(F.col("kind") == kind).select(
        "history_id", "status", part.cast("bigint").alias("part_no"), "body"
    )
    # a fixed number of tasks: bodies are small, reading them is not
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    with _last_key_wins(responses):
        return rows.select("history_id", "status", "part_no", response_json("body", keys).alias("v"))


def _together(parts: DataFrame, asked: DataFrame | None, **merged: Column) -> DataFrame:
    """One row per history from the rows of its parts ``p``.

    Failed unless every part is ``ok`` and there once. With the parts that were ``asked`` all of
    them must be there, and readable if there are several; a failed history then has empty columns.
    """
    names = [c for c in parts.columns if c not in ("history_id", "part_no")]
    table = parts.groupBy("history_id").agg(
        F.array_sort(F.collect_list(F.struct("part_no", *names))).alias("p")
    )
    numbers = F.transform("p", lambda x: x["part_no"])
    whole = F.forall("p", lambda x: x["status"].eqNullSafe("ok"))
    whole = whole & (F.size("p") == F.size(F.array_distinct(numbers)))
    if asked is not None:
        table = table.join(shuffled(asked), "history_id", "left")
        wanted = F.coalesce(
            F.transform("asked", lambda x: x["part_no"]), F.array(F.lit(0).cast("bigint"))
        )
        readable = F.col("asked").isNull() | F.forall("p", lambda x: x["readable"])
        whole = whole & (numbers == wanted) & readable
    table = table.withColumn("whole", whole)
    if asked is not None:
        table = table.withColumn("p", F.filter("p", lambda x: F.col("whole")))
    return table.select(
        "history_id",
        F.when(F.col("whole"), "ok").otherwise("failed").alias("status"),
        *[column.alias(name) for name, column in merged.items()],
    )


def _type(value: Column, path: str = "$") -> Column:
    """Type of a member: ``VOID`` when missing or null."""
    return F.coalesce(
        F.schema_of_variant(F.try_variant_get(value, path, "variant")), F.lit("VOID")
    )


def _items(value: Column, path: str, kind: str) -> Column:
    return F.coalesce(
        F.try_variant_get(value, path, f"array<{kind}>"), F.array().cast(f"array<{kind}>")
    )


def parse_dedup_responses(responses: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``groups`` per history; empty unless the whole body has the expected types.

    ``asked`` are the :func:`prompt_parts`; without them a missing part is not noticed.
    """
    value = F.col("v")

    def well_typed(g: Column) -> Column:
        return (
            _type(g).rlike("^(OBJECT<|VOID)")
            & _type(g, "$.representative").isin("BIGINT", "VOID")
            & _type(g, "$.indices").isin("ARRAY<BIGINT>", "ARRAY<VOID>", "VOID")
            & _type(g, "$.reason").isin("STRING", "VOID")
        )

    def group(g: Column) -> Column:
        return F.struct(
            F.coalesce(F.try_variant_get(g, "$.representative", "bigint"), F.lit(0))
            .cast("bigint")
            .alias("representative"),
            F.transform(
                _items(g, "$.indices", "bigint"), lambda i: F.coalesce(i, F.lit(0).cast("bigint"))
            ).alias("indices"),
            F.coalesce(F.try_variant_get(g, "$.reason", "string"), F.lit("")).alias("reason"),
        )

    items = _items(value, "$.groups", "variant")
    valid = _type(value, "$.groups").rlike("^(ARRAY<|VOID)") & F.forall(items, well_typed)
    groups = F.transform(items, group)
    none = "array<struct<representative:bigint,indices:array<bigint>,reason:string>>"
    parts = (
        _parsed(responses, "dedup", DEDUP_KEYS)
        .select(
            "history_id",
            "part_no",
            "status",
            F.when(value.isNotNull() & valid, groups)
            .otherwise(F.array().cast(none))
            .alias("groups"),
            F.coalesce(value.isNotNull() & valid, F.lit(False)).alias("readable"),
        )
    )
    return _together(parts, asked, groups=F.flatten(F.transform("p", lambda x: x["groups"])))


def parse_explain_responses(responses: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """``overview``, ``prerequisites`` and ``steps`` per history; empty unless well typed.

    ``asked`` are the :func:`prompt_parts`: the steps of a part count from the first heading in
    it, and those beyond its headings are left out. Without them missing parts are not noticed,
    and the steps of all parts count as one list.
    """
    value = F.col("v")
    texts = ("title", "description", "why", "notes")

    def well_typed(s: Column) -> Column:
        ok = _type(s).rlike("^(OBJECT<|VOID)")
        for name in texts:
            ok = ok & _type(s, f"$.{name}").isin("STRING", "VOID")
        return ok

    def step(s: Column) -> Column:
        return F.struct(
            *[
                F.coalesce(F.try_variant_get(s, f"$.{name}", "string"), F.lit("")).alias(name)
                for name in texts
            ]
        )

    items = _items(value, "$.steps", "variant")
    valid = (
        value.isNotNull()
        & _type(value, "$.overview").isin("STRING", "VOID")
        & _type(value, "$.prerequisites").isin("ARRAY<STRING>", "ARRAY<VOID>", "VOID")
        & _type(value, "$.steps").rlike("^(ARRAY<|VOID)")
        & F.forall(items, well_typed)
    )
    needs = F.transform(
        _items(value, "$.prerequisites", "string"), lambda p: F.coalesce(p, F.lit(""))
    )
    none = "array<struct<title:string,description:string,why:string,notes:string>>"
    parts = (
        _parsed(responses, "explain", EXPLAIN_KEYS)
        .withColumn("valid", valid)
        .select(
            "history_id",
            "part_no",
            "status",
            F.when(
                F.col("valid"),
                F.coalesce(F.try_variant_get(value, "$.overview", "string"), F.lit("")),
            )
            .otherwise("")
            .alias("overview"),
            F.when(F.col("valid"), needs)
            .otherwise(F.array().cast("array<string>"))
            .alias("prerequisites"),
            F.when(F.col("valid"), F.transform(items, step))
            .otherwise(F.array().cast(none))
            .alias("steps"),
            F.coalesce("valid", F.lit(False)).alias("readable"),
        )
    )
    said = F.filter(F.transform("p", lambda x: x["overview"]), lambda x: x != "")

    def numbered(said: Column, first: Column) -> Column:
        return F.transform(said, lambda s, i: s.withField("step_no", (first + i).cast("bigint")))

    all_steps = numbered(F.flatten(F.transform("p", lambda x: x["steps"])), F.lit(1))
    if asked is not None:
        # the parts of a whole answer are those that were asked, in the same order
        by_part = F.zip_with(
            "p",
            "asked",
            lambda x, a: numbered(
                F.slice(x["steps"], 1, F.coalesce(a["steps"], F.lit(0)).cast("int")),
                a["first_step"],
            ),
        )
        several = F.col("asked").isNotNull() & F.col("whole")
        all_steps = F.when(several, F.flatten(by_part)).otherwise(all_steps)
    return _together(
        parts,
        asked,
        overview=F.coalesce(F.get(said, F.lit(0)), F.lit("")),
        prerequisites=F.array_distinct(F.flatten(F.transform("p", lambda x: x["prerequisites"]))),
        steps=all_steps,
    )


def apply_dedup_groups(commands: DataFrame, parsed: DataFrame) -> DataFrame:
    """Commands without those a response group lists beside its representative."""
    listed = (
        parsed.select("history_id", F.inline("groups"))
        .select("history_id", "representative", F.explode("indices").alias("idx"))
        .where(F.col("idx") != F.col("representative"))
        .select("history_id", "idx")
    )
    return positions(commands).join(shuffled(listed), ["history_id", "idx"], "left_anti").drop("idx")


def dedup_reasons(parsed: DataFrame) -> DataFrame:
    """The reasons given, in order."""
    return (
        parsed.select("history_id", F.posexplode("groups").alias("group_no", "g"))
        .where(F.col("g.reason") != "")
        .select("history_id", "group_no", F.col("g.reason").alias("reason"))
    )


def apply_explanations(steps: DataFrame, parsed: DataFrame) -> DataFrame:
    """Steps with title, description and intent replaced where a response has text for them."""
    said = parsed.select("history_id", F.explode("steps").alias("s")).select(
        "history_id",
        "s.step_no",
        F.nullif("s.title", F.lit("")).alias("new_title"),
        F.nullif("s.description", F.lit("")).alias("new_description"),
        F.nullif("s.why", F.lit("")).alias("new_intent"),
    )
    new = {n: F.coalesce(f"new_{n}", n) for n in ("title", "description", "intent")}
    return (
        steps.join(shuffled(said), ["history_id", "step_no"], "left")
        .withColumns(new)
        .select(*steps.columns)
    )


def override_sections(sections: DataFrame, parsed: DataFrame) -> DataFrame:
    """Overview and prerequisites of a history, replaced where a response has them."""
    said = parsed.select(
        "history_id",
        F.nullif("overview", F.lit("")).alias("new_overview"),
        F.when(F.size("prerequisites") > 0, F.col("prerequisites")).alias("new_prerequisites"),
    )
    return (
        sections.join(shuffled(said), "history_id", "left")
        .withColumns(
            {
                "overview": F.coalesce("new_overview", "overview"),
                "prerequisites": F.coalesce("new_prerequisites", "prerequisites"),
            }
        )
        .select(*sections.columns)
    )


def by_history(rows: DataFrame, table: DataFrame, how: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Semi or anti join of rows with a table of histories, spread over the chunks of a history."""
    rows = with_chunk(rows, chunk_rows)
    chunks = rows.select(*KEYS).distinct().join(shuffled(table), "history_id", "left_semi")
    return rows.join(chunks, KEYS, how).drop("chunk")


def dedup_with_fallback(
    commands: DataFrame,
    responses: DataFrame,
    time_gap_s: int = TIME_GAP_S,
    chunk_rows: int = CHUNK_ROWS,
    part_rows: int = PART_ROWS,
    part_bytes: int = PART_BYTES,
    spans: DataFrame | None = None,
) -> DataFrame:
    """Response groups where a whole response arrived, the rules of :func:`dedup` elsewhere.

    ``part_rows`` and ``part_bytes`` are those of the prompts, ``spans`` the :func:`history_spans`
    of the commands, if they are known already. They tell which histories are so long that prompts
    have parts or that rows have to be worked on in chunks; where none is, the commands meet the
    routes of their histories in one shuffle for each route.
    """
    commands = commands.select("history_id", "number", "epoch_s", "has_time", "command")
    if spans is None:
        spans = staged(history_spans(commands), "route-spans")
    many_parts = F.expr(f"(high - low) div {part_rows}L > 0") | (
        F.col("bytes") + LINE_BYTES * F.col("n") > part_bytes
    )
    parted, long = spans.agg(F.count_if(many_parts), F.count_if(crosses_chunks(chunk_rows))).first()
    if parted:
        asked = prompt_parts(commands, part_rows=part_rows, part_bytes=part_bytes)
    else:
        asked = commands.sparkSession.createDataFrame([], _ASKED)
    # both routes need it; none of them reads the answers again
    parsed = staged(parse_dedup_responses(responses, asked).where(F.col("status") == "ok"), "route-answers")
    if not long:
        listed = F.transform(
            "groups", lambda g: F.filter(g["indices"], lambda i: i != g["representative"])
        )
        routes = parsed.select("history_id", F.flatten(listed).alias("listed"))
        place = F.row_number().over(W.partitionBy("history_id").orderBy("number")) - 1
        by_model = commands.join(shuffled(routes), "history_id").withColumn("idx", place.cast("bigint"))
        by_model = by_model.where(~F.array_contains("listed", F.col("idx"))).drop("listed", "idx")
        others = commands.join(shuffled(routes), "history_id", "left_anti")
        return by_model.unionByName(dedup_short(others, time_gap_s, chunk_rows))
    answered = parsed.select("history_id")
    by_model = apply_dedup_groups(
        by_history(commands, answered, "left_semi", chunk_rows), parsed
    )
    by_rule = dedup(
        by_history(commands, answered, "left_anti", chunk_rows), time_gap_s, chunk_rows
    )
    return by_model.unionByName(by_rule)
