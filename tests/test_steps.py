import random

import pytest
from pyspark.sql import functions as F

from shelltrail.functions.catalogue import TOOL_FAMILIES, Workflow, intent_of
from shelltrail.functions.text import required_tool, step_tool
from shelltrail.operators import steps
from shelltrail.operators.pairs import consecutive_duplicates, neighbours
from shelltrail.schema import COMMANDS


@pytest.mark.parametrize(
    "command, tool, required",
    [
        ("", "", ""),
        ("  ls  -l", "ls", "ls"),
        ("sudo make x", "make", "make"),
        ("sudo", "sudo", "sudo"),
        ("time go build", "go", "time"),
        ("sudo time go build", "time", "time"),
        ("nohup", "nohup", "nohup"),
        (" git　log", "git", "git"),
    ],
)
def test_tools(spark, command, tool, required):
    df = spark.createDataFrame([(command,)], "command string")
    row = df.select(step_tool("command"), required_tool("command")).first()
    assert tuple(row) == (tool, required)


def test_intent_is_a_raw_prefix(spark):
    texts = ["git add x", " git add x", "sshfs m", "npm install", "npm start", "hostname", "svn up"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    extra = (Workflow("svn", ("svn",), "Subversion"), Workflow("late", ("git",), "Never"))
    got = [r[0] for r in df.select(intent_of(F.col("c"), extra)).collect()]
    assert got == ["git-commit", "", "ssh-scp", "npm-build", "npm-dev", "", "svn"]


def test_titles(commands):
    df = commands("git log", "git log", "gh x", "gh y", "svn up", "", "git add .", "pip3 i", "pip i")
    rows = steps.summarise(steps.step_commands(df)).orderBy("step_no").collect()
    assert [(r["title"], r["intent"], r["commands"]) for r in rows] == [
        ("Git operations", "", 4),  # a tie goes to the earlier tool
        ("svn operations", "", 1),
        ("Shell commands", "", 1),
        ("Commit and push changes", "git-commit", 1),
        ("pip3 operations", "", 2),
    ]
    assert (rows[0]["first_number"], rows[0]["last_number"]) == (1, 4)


def test_custom_workflow_without_title_falls_back(commands):
    df = commands("svn up", "svn up")
    flow = [Workflow("svn", ("svn",), "")]
    row = steps.summarise(steps.step_commands(df, flow), flow).first()
    assert (row["title"], row["intent"]) == ("svn operations", "svn")


def test_threshold_is_strict(commands):
    df = commands(("ls", 0), ("ls", 60), ("ls", 121), ("ls", None), ("ls", 999), ("ls", 5))
    rows = steps.step_commands(df).orderBy("number").collect()
    assert [r["step_no"] for r in rows] == [1, 1, 2, 2, 2, 2]
    rows = steps.step_commands(df, threshold_s=59).orderBy("number").collect()
    assert [r["step_no"] for r in rows] == [1, 2, 3, 3, 3, 3]


def fold(rows, threshold):
    """Steps with the intent of the group carried along."""
    family = {t: i for i, f in enumerate(TOOL_FAMILIES) for t in f}
    number, group, before, out = 0, "", None, []
    for _, n, at, timed, tool, intent in rows:
        new = before is None
        if not new:
            b_at, b_timed, b_tool = before
            related = b_tool == tool or family.get(b_tool, b_tool) == family.get(tool, tool)
            late = timed and b_timed and at - b_at > threshold
            new = not related or late or (group != "" and group != intent)
        if new:
            number, group = number + 1, intent
        elif intent and not group:
            group = intent
        before = (at, timed, tool)
        out.append((n, number))
    return out


@pytest.mark.parametrize("chunk_rows", [3, 17, 1 << 18])
def test_equals_sequential_fold(spark, chunk_rows):
    rnd = random.Random(chunk_rows)
    rows, expected = [], set()
    for h in range(60):
        own, at, n = [], 0, rnd.choice([1, 40])
        for _ in range(rnd.choice([1, 5, 60])):
            at += rnd.choice([0, 10, 60, 61, 90, -30])
            n += rnd.choice([1, 1, 2, 9])
            own.append((f"h{h}", n, at, rnd.random() > 0.1, rnd.choice(["git", "gh", "ls", ""]), rnd.choice(["", "", "a", "b"])))
        rows += own
        expected |= {(f"h{h}", *x) for x in fold(own, 60)}
    schema = COMMANDS.replace("command string", "tool string, intent string")
    df = spark.createDataFrame(rows, schema).repartition(4)
    got = steps.cut_steps(df, 60, chunk_rows).select("history_id", "number", "step_no")
    assert {tuple(r) for r in got.collect()} == expected


def test_times_that_a_long_cannot_subtract(spark):
    low, high = -(2**63), 2**63 - 1
    rows = [("h", 1, low, True, "ls"), ("h", 2, high, True, "ls"), ("h", 3, low, True, "ls"), ("h", 4, low, True, "ls")]
    df = spark.createDataFrame(rows, COMMANDS)
    starts = [r["starts"] for r in steps.step_commands(df).orderBy("number").collect()]
    assert starts == [True, True, False, False]
    late = consecutive_duplicates(neighbours(df)).orderBy("number").collect()
    assert [r["intentional"] for r in late] == [True, False, False]
