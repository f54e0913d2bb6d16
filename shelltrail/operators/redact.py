"""Redaction: one rule after the other on any text column, with an audit table.

A rule refers to its input several times (test, replacement, comparison). Each
rule is therefore a ``transform`` over a one-element array, whose lambda variable
names the text of the rule before; a plain nesting of expressions would double
with every rule, and 62 stacked projections run no faster. The expression is
written as SQL text, which is parsed in one go; putting it together from column
objects takes thousands of calls into the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelltrail.functions.rules import RULES, Rule, java_pattern, java_replacement, rule_pattern

# Fixed value: what a text becomes that must not be shown at all.
PLACEHOLDER = "[REDACTED - contains sensitive data]"

# The analyzer resolves one nested lambda per round and allows 100 rounds.
RULES_PER_PROJECTION = 8


def _literal(text: str) -> str:
    """SQL literal of any text: raw strings side by side, which need no escapes."""
    return " ".join(f"r'{part}'" for part in text.split("'")).replace("' r'", "' r\"'\" r'")


def _may_match(x: str, rule: Rule) -> str:
    """Cheap test that is true wherever the rule matches."""
    sought = f"lower({x})" if rule.any_case else x
    tests = [f"contains({sought}, {_literal(part)})" for part in rule.needs]
    test = f"({' or '.join(tests) or 'true'})"
    if rule.only_if:
        test += f" and rlike({x}, {_literal(java_pattern(rule.only_if))})"
    return test


# Stands before the places where a rule may begin; text that holds it already takes the slow way.
START = chr(0xE000)


def _from_starts(x: str, rule: Rule) -> str:
    """The rule, tried only at the places that its ``starts`` mark.

    A match that begins elsewhere would also begin at the marked place before it. The
    second round is for marks that stood inside of a match of the first.
    """
    mark = _literal(START)
    pattern = _literal(START + rule_pattern(rule))
    replacement = _literal(java_replacement(rule.replacement))
    for _ in range(2):
        for start in rule.starts:
            x = f"regexp_replace({x}, {_literal(java_pattern(start))}, {_literal(START + '$0')})"
        x = f"replace(regexp_replace({x}, {pattern}, {replacement}), {mark}, '')"
    return x


def _rewritten(x: str, rule: Rule) -> str:
    pattern = _literal(rule_pattern(rule))
    replacement = _literal(java_replacement(rule.replacement))
    if rule.starts:
        plain = f"regexp_replace({x}, {pattern}, {replacement})"
        return f"if(contains({x}, {_literal(START)}), {plain}, {_from_starts(x, rule)})"
    if rule.by_run:
        pattern = _literal(java_pattern(rule.by_run[0]))
        replacement = _literal(java_replacement(rule.by_run[1]))
    if not rule.ends_with:
        return f"regexp_replace({x}, {pattern}, {replacement})"
    # No match reaches past the last such character. Leaving the rest out spares
    # a backtracking engine one scan to the end of the text per possible start.
    rest = f"substring_index({x}, {_literal(rule.ends_with)}, -1)"
    head = f"left({x}, length({x}) - length({rest}))"
    return f"concat(regexp_replace({head}, {pattern}, {replacement}), {rest})"


def _matches(x: str, rule: Rule) -> str:
    return f"rlike({x}, {_literal(rule_pattern(rule))})"


def _text_step(rule: Rule) -> str:
    test = _may_match("x", rule)
    if rule.drop:
        # null passes unchanged through all later rules
        return f"if({test} and {_matches('x', rule)}, null, x)"
    return f"if({test}, {_rewritten('x', rule)}, x)"


def redact(column: str, extra: Sequence[Rule] = ()) -> Column:
    """Text with every secret replaced; a fixed placeholder where a rule drops the row."""
    name = "`" + column.replace("`", "``") + "`"
    text = f"array({name})"
    for rule in RULES:
        text = f"transform({text}, x -> {_text_step(rule)})"
    text = f"get({text}, 0)"
    if extra:
        # nesting of lambdas is limited: any number of rules is one lambda over their numbers
        steps = " ".join(f"when {i} then {_text_step(rule)}" for i, rule in enumerate(extra))
        text = f"aggregate(sequence(0, {len(extra) - 1}), {text}, (x, i) -> case i {steps} end)"
    return F.expr(f"coalesce({text}, if({name} is not null, {_literal(PLACEHOLDER)}, null))")


def _noting_step(number: int, rule: Rule) -> str:
    test = f"s.dropped is null and {_may_match('s.text', rule)}"
    if rule.drop:
        gone = f"struct(s.text as text, s.fired as fired, {number} as dropped)"
        return f"if({test} and {_matches('s.text', rule)}, {gone}, s)"
    fired = f"if(t <> s.text, array_append(s.fired, {number}), s.fired)"
    new = f"struct(t as text, {fired} as fired, s.dropped as dropped)"
    return f"if({test}, get(transform(array({_rewritten('s.text', rule)}), t -> {new}), 0), s)"


def mark(
    df: DataFrame,
    extra: Sequence[Rule] = (),
    allowlist: Sequence[str] = (),
    column: str = "command",
) -> DataFrame:
    """Redact ``column`` in place and note what happened.

    Adds ``original``, ``fired`` (numbers of the rules that changed the text, in
    order) and ``dropped`` (number of the rule that removes the row, else null).
    ``allowlist`` is accepted and has no effect, as in the tool whose results
    this follows.
    """
    del allowlist
    others = [c for c in df.columns if c != column]
    start = F.struct(
        F.col(column).alias("text"),
        F.array().cast("array<int>").alias("fired"),
        F.lit(None).cast("int").alias("dropped"),
    )
    done = df.select(*others, F.col(column).alias("original"), start.alias("_r"))
    rules = list(enumerate((*RULES, *extra), start=1))
    for begin in range(0, len(rules), RULES_PER_PROJECTION):
        chain = "array(_r)"
        for number, rule in rules[begin : begin + RULES_PER_PROJECTION]:
            chain = f"transform({chain}, s -> {_noting_step(number, rule)})"
        done = done.withColumn("_r", F.expr(f"get({chain}, 0)"))
    return done.select(
        *others,
        F.col("_r.text").alias(column),
        "original",
        F.col("_r.fired").alias("fired"),
        F.col("_r.dropped").alias("dropped"),
    )


def surviving(marked: DataFrame) -> DataFrame:
    """Rows that no rule removed, without the notes."""
    return marked.where(F.col("dropped").isNull()).drop("original", "fired", "dropped")


def audit(marked: DataFrame, extra: Sequence[Rule] = (), strict: bool = False) -> DataFrame:
    """One record per row and rule that changed it; ``strict`` keeps the original text.

    Of a removed row only the record of the removing rule remains.
    """
    names = F.array(*[F.lit(rule.name) for rule in (*RULES, *extra)])
    hits = F.when(F.col("dropped").isNotNull(), F.array("dropped")).otherwise(F.col("fired"))
    original = F.col("original") if strict else F.lit(None).cast("string").alias("original")
    return marked.select(
        "history_id", "number", F.explode(hits).alias("rule_no"), original
    ).select("history_id", "number", "rule_no", F.element_at(names, F.col("rule_no")).alias("rule"), "original")


def record_counts(histories: DataFrame, records: DataFrame) -> DataFrame:
    """Audit records per history, zero included."""
    counts = records.groupBy("history_id").agg(F.count("*").alias("redactions"))
    return histories.select("history_id").join(counts, "history_id", "left").select(
        "history_id", F.coalesce("redactions", F.lit(0)).cast("bigint").alias("redactions")
    )


def records_by_rule(records: DataFrame) -> DataFrame:
    return records.groupBy("rule").agg(F.count("*").alias("records"))
