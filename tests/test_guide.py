import re

import pytest
from pyspark.sql import functions as F

from shelltrail.functions.rules import Rule
from shelltrail.operators import annotate, render, steps
from shelltrail.operators.dedup import dedup
from shelltrail.plans.guide import Guide
from shelltrail.schema import COMMANDS, RESPONSES

AT = "2024-05-06 07:08:09"

EXPECTED = """# Deploy

## Overview

This runbook covers: Git version control, Docker image building. It contains 3 steps with 4 commands total.

## Prerequisites

- Git CLI installed
- Docker installed and running

## Steps

### Step 1: Commit and push changes

```bash
git add .
git commit -m 'first version'
```

**Why:** git-commit

### Step 2: Build and publish container image

```bash
docker build -t app .
```

**Why:** docker-build

### Step 3: curl operations

```bash
curl -H "Authorization: Bearer <REDACTED>" https://api.example.org
```

## Notes

- Generated from bash history on 2024-05-06 07:08:09
- Time range: commands #2 to #8
- Commands sanitized: 2
""".replace("curl operations", "HTTP requests")


def history(commands):
    return commands(
        ("hostname --before-the-range", 0),
        ("git add .", 86390),
        ("git commit -m 'first version'", 86395),
        ("", 86399),
        ("docker build -t app .", 86400),
        ("docker build -t app .", 86401),
        ('curl -H "Authorization: Bearer abc" https://api.example.org', 90000),
        ("echo -----BEGIN PRIVATE " + "KEY-----", 90001),
        ("after the range", 90002),
    )


def test_document(commands):
    guide = Guide(history(commands), 2, 8)
    rows = guide.documents(AT, "Deploy").collect()
    assert [(r["history_id"], r["part_no"]) for r in rows] == [("h", 0)]
    assert rows[0]["markdown"] == EXPECTED
    metrics = guide.metrics().first()
    assert tuple(metrics) == ("h", 7, 5, 2, 3)


def test_parts_add_up(commands):
    guide = Guide(history(commands), 2, 8, chunk_rows=2)
    rows = guide.documents(AT, "Deploy", part_rows=2).orderBy("part_no").collect()
    assert len(rows) > 2
    assert "".join(r["markdown"] for r in rows) == EXPECTED


def test_parts_are_bounded_by_bytes(spark):
    # a megabyte each, a few short ones between
    rows = [("h", i, i, True, f"make t{i} {'x' * (10**6 if i % 7 else 3)}") for i in range(1, 41)]
    df = spark.createDataFrame(rows, COMMANDS).repartition(8)
    most = 8 * 10**6
    with Guide(df, 1, 1000, chunk_rows=64) as guide:
        parts = guide.documents(AT, part_bytes=most)
        sizes = parts.select("part_no", F.octet_length("markdown").alias("n")).orderBy("part_no").collect()
    assert [r["part_no"] for r in sizes] == list(range(len(sizes)))
    assert max(r["n"] for r in sizes) <= most and len(sizes) < 14
    prompts = annotate.dedup_prompt(df, part_bytes=most).select(F.octet_length("prompt").alias("n")).collect()
    assert max(r["n"] for r in prompts) <= most and len(prompts) < 14


def test_a_piece_longer_than_a_part(spark):
    rows = [("h", i, i, True, "x" * n) for i, n in enumerate([5, 400, 5, 5, 30, 400, 400], 1)]
    stepped = steps.step_commands(spark.createDataFrame(rows, COMMANDS))
    out = annotate.dedup_prompt(stepped, part_bytes=200).orderBy("part_no").collect()
    assert [len(r["prompt"].splitlines()) for r in out] == [1, 1, 2, 1, 1, 1]


def test_building_a_guide_starts_no_job(spark, commands):
    df = history(commands)
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    guide = Guide(df, 2, 8)
    assert len(tracker.getJobIdsForGroup(None)) == before and guide.tables == [] and guide.totals() == {}
    guide.documents(AT).collect()
    assert guide.totals() == {"extracted": 7, "kept": 5, "redactions": 2, "clean": 4, "steps": 3}
    guide.close()


def test_totals_are_the_sums_of_the_metrics(spark):
    rows = [(f"h{i % 5}", i, i * 7, True, f"mysql -psecret{i} db" if i % 3 else "ls") for i in range(200)]
    with Guide(spark.createDataFrame(rows, COMMANDS), 0, 150) as guide:
        sums = guide.metrics().agg(*[F.sum(n).alias(n) for n in ("extracted", "kept", "redactions", "steps")]).first()
        totals = guide.totals()
    assert {n: totals[n] for n in sums.asDict()} == sums.asDict()


def test_strict_audit_of_a_guide(commands):
    with Guide(history(commands), 2, 8, strict=True) as guide:
        records = {r["rule"]: r["original"] for r in guide.audit.collect()}
        assert guide.documents(AT, "Deploy").first()["markdown"] == EXPECTED
    assert records["bearer-token"].endswith("https://api.example.org") and "abc" in records["bearer-token"]
    with Guide(history(commands), 2, 8) as guide:
        assert [r["original"] for r in guide.audit.collect()] == [None, None]
        assert "original" not in guide.marked.columns


def test_timestamps(commands):
    text = Guide(history(commands), 2, 8).documents(AT, timestamps=True).first()["markdown"]
    assert text.startswith("# Runbook\n")
    assert "```bash\n# 23:59:50\ngit add .\n# 23:59:55\n" in text
    assert "# 00:00:00\ndocker build" in text


def test_nothing_left(commands):
    guide = Guide(commands("", "echo -----BEGIN PRIVATE " + "KEY-----"), 1, 2)
    text = guide.documents(AT).first()["markdown"]
    assert text == (
        "# Runbook\n\n## Overview\n\nThis runbook contains no commands.\n\n## Steps\n\n## Notes\n\n"
        f"- Generated from bash history on {AT}\n- Time range: commands #1 to #2\n- Commands sanitized: 1\n"
    )


def test_one_step_over_many_chunks(spark):
    rows = [("h", i, i, True, f"make target{i * 1000} {'x' * (i % 60)}") for i in range(1, 400)]
    df = spark.createDataFrame(rows, COMMANDS)
    stepped = steps.step_commands(df, chunk_rows=16)
    summary = steps.summarise(stepped)
    assert summary.select("step_no", "title", "commands").collect() == [(1, "make operations", 399)]
    parts = render.step_markdown(stepped, summary, part_rows=50).orderBy("part_no").collect()
    text = "".join(r["markdown"] for r in parts)
    assert len(parts) == 8
    assert text == "### Step 1: make operations\n\n```bash\n" + "".join(r[4] + "\n" for r in rows) + "```\n"


def responses(spark, *bodies, kind="dedup"):
    rows = [(f"h{i}", kind, "ok", body) for i, body in enumerate(bodies)]
    return spark.createDataFrame(rows, RESPONSES)


@pytest.mark.parametrize(
    "body, groups",
    [
        ('so: {"groups":[{"representative":1,"indices":[0,1],"reason":"r"}]} ok', [(1, [0, 1], "r")]),
        ('{"Groups":[{"INDICES":[2,null]}]}', [(0, [2, 0], "")]),
        ('{"groups":[null,{"representative":null,"indices":null,"reason":null}]}', [(0, [], ""), (0, [], "")]),
        ('{"groups":null,"more":{"groups":1}}', []),
        ('{"groups":[]}', []),
        ('{"other":1}', []),
        ('{"groups":[{"indices":[0]},{"indices":["1"]}]}', []),
        ('{"groups":[{"indices":[0.0]}]}', []),
        ('{"groups":[{"representative":"1"}]}', []),
        ('{"groups":[{"reason":5,"indices":[0]}]}', []),
        ('{"groups":[[1]]}', []),
        ('{"groups":"none"}', []),
        ('{"groups":[{"indices":[0]}]} and {"x":1}', []),
        ('{"groups":[],"groups":[{"indices":[0,1],"indices":[2]}]}', [(0, [2], "")]),
        ('{"groups":[{"indices":[0]}', []),
        ("no braces", []),
        ("} reversed {", []),
        ("", []),
        (None, []),
    ],
)
def test_group_responses(spark, body, groups):
    row = annotate.parse_dedup_responses(responses(spark, body)).first()
    assert [(g["representative"], g["indices"], g["reason"]) for g in row["groups"]] == groups


@pytest.mark.parametrize(
    "body, expected",
    [
        ('{"overview":"o","prerequisites":["a",null],"steps":[{"title":"t","Why":"w"}]}', ("o", ["a", ""], [("t", "", "w")])),
        ('{"steps":[{}]}', ("", [], [("", "", "")])),
        ('{"overview":1,"steps":[{"title":"t"}]}', ("", [], [])),
        ('{"overview":"o","prerequisites":[1]}', ("", [], [])),
        ('{"overview":"o","steps":[{"title":["t"]}]}', ("", [], [])),
        ('{"overview":"o","steps":[{"notes":7}]}', ("", [], [])),
    ],
)
def test_explain_responses(spark, body, expected):
    row = annotate.parse_explain_responses(responses(spark, body, kind="explain")).first()
    said = [(s["title"], s["description"], s["why"]) for s in row["steps"]]
    assert (row["overview"], row["prerequisites"], said) == expected


def test_parts_of_an_answer_are_put_together(spark):
    def rows(kind, *bodies, status="ok"):
        parts = [("h", kind, status, b, i) for i, b in reversed(list(enumerate(bodies)))]
        return spark.createDataFrame(parts, RESPONSES + ", part_no bigint")

    body = '{"overview":"%s","prerequisites":["a","%s"],"steps":[{"title":"%s"}]}'
    df = rows("explain", body % ("", "b", "one"), body % ("all", "c", "two"), "no json")
    said = annotate.parse_explain_responses(df).collect()
    assert len(said) == 1
    assert (said[0]["overview"], said[0]["prerequisites"]) == ("all", ["a", "b", "c"])
    assert [s["title"] for s in said[0]["steps"]] == ["one", "two"]
    steps_table = spark.createDataFrame(
        [("h", 1, "t1", "", "", 1, 1, 1), ("h", 2, "t2", "", "", 1, 2, 2), ("h", 3, "t3", "", "", 1, 3, 3)],
        "history_id string, step_no bigint, title string, description string, intent string,"
        " commands bigint, first_number bigint, last_number bigint",
    )
    out = annotate.apply_explanations(steps_table, annotate.parse_explain_responses(df)).collect()
    assert sorted((r["step_no"], r["title"]) for r in out) == [(1, "one"), (2, "two"), (3, "t3")]
    groups = annotate.parse_dedup_responses(rows("dedup", '{"groups":[{"indices":[1]}]}', '{"groups":[{"indices":[2]}]}'))
    assert [g["indices"] for g in groups.first()["groups"]] == [[1], [2]]
    failed = rows("dedup", "{}").unionByName(rows("dedup", "{}", status="failed"))
    assert [r["status"] for r in annotate.parse_dedup_responses(failed).collect()] == ["failed"]


def part_rows_of(spark, kind, bodies):
    """Responses from (history, part, status, body)."""
    rows = [(h, kind, status, body, part) for h, part, status, body in bodies]
    return spark.createDataFrame(rows, RESPONSES + ", part_no bigint")


def test_steps_of_several_parts_keep_their_places(spark, commands):
    # every third command starts a step, parts hold four numbers
    names = ("whole", "missing", "twice", "unreadable", "failed", "unknown")
    df = None
    for name in names:
        own = commands(*((f"make {c * 9}", i // 3 * 1000 + i) for i, c in enumerate("abcdefghijklm")), history=name, first=101)
        df = own if df is None else df.union(own)
    stepped = steps.step_commands(df)
    summary = steps.summarise(stepped)
    prompts = annotate.explain_prompt(stepped, summary, part_rows=4).where("history_id = 'whole'")
    headings = {r.part_no: re.findall("## Group ([0-9]+)", r.prompt) for r in prompts.collect()}
    assert headings == {0: ["1", "2"], 1: ["3"], 2: ["4"], 3: ["5"]}
    # the first part tells one step too few, the second one too many
    say = lambda *titles: '{"overview":"o","steps":[%s]}' % ",".join('{"title":"%s"}' % t for t in titles)
    full = [(0, "ok", say("one")), (1, "ok", say("three", "four?")), (2, "ok", say("four")), (3, "ok", say("five"))]
    rows = {
        "whole": full[::-1],
        "missing": full[:1] + full[2:],
        "twice": full + full[1:2],
        "unreadable": full[:1] + [(1, "ok", "no json")] + full[2:],
        "failed": full[:3] + [(3, "failed", None)],
        "unknown": full + [(4, "ok", say("six"))],
    }
    answers = part_rows_of(spark, "explain", [(h, *r) for h in names for r in rows[h]])
    asked = annotate.prompt_parts(stepped, summary, part_rows=4)
    parsed = annotate.parse_explain_responses(answers, asked)
    assert {r.history_id: (r.status, r.overview) for r in parsed.collect()} == {
        h: ("ok", "o") if h == "whole" else ("failed", "") for h in names
    }
    plain = {(r.history_id, r.step_no): r.title for r in summary.collect()}
    out = {(r.history_id, r.step_no): r.title for r in annotate.apply_explanations(summary, parsed).collect()}
    said = {1: "one", 3: "three", 4: "four", 5: "five"}
    assert out == plain | {("whole", n): t for n, t in said.items()}
    with Guide(df, 101, 113, answers, prompt_rows=4, threshold_s=300) as guide:
        assert {(r.history_id, r.step_no): r.title for r in guide.steps.collect()} == out


@pytest.mark.parametrize("chunk_rows", [2, 1 << 18])
def test_route_by_whole_answers(spark, commands, chunk_rows):
    names = ("whole", "missing", "twice", "unreadable", "failed")
    df = None
    for name in names:
        own = commands(*(f"make {c * 9}" for c in "aabcddef"), history=name, first=11)
        df = own if df is None else df.union(own)
    prompts = annotate.dedup_prompt(df, part_rows=4).where("history_id = 'whole'")
    assert sorted(r.part_no for r in prompts.collect()) == [0, 1]
    first = (0, "ok", '{"groups":[{"representative":2,"indices":[2,3]}]}')
    second = (1, "ok", '{"groups":[{"representative":6,"indices":[6,7]}]}')
    rows = {
        "whole": [second, first],
        "missing": [first],
        "twice": [first, second, second],
        "unreadable": [first, (1, "ok", "none")],
        "failed": [first, (1, "failed", None)],
    }
    answers = part_rows_of(spark, "dedup", [(h, *r) for h in names for r in rows[h]])
    left = annotate.dedup_with_fallback(df, answers, chunk_rows=chunk_rows, part_rows=4).collect()
    got = {h: sorted(r.number for r in left if r.history_id == h) for h in names}
    by_rule = sorted(r.number for r in dedup(df.where("history_id = 'whole'")).collect())
    assert got == {h: [11, 12, 13, 15, 16, 17] if h == "whole" else by_rule for h in names}
    assert len(by_rule) == 6 and by_rule != got["whole"]
    parsed = annotate.parse_dedup_responses(answers, annotate.prompt_parts(df, part_rows=4))
    assert {r.history_id for r in annotate.dedup_reasons(parsed).collect()} == set()
    applied = annotate.apply_dedup_groups(df, parsed).groupBy("history_id").count().collect()
    assert {r.history_id: r["count"] for r in applied} == {h: 6 if h == "whole" else 8 for h in names}


@pytest.mark.parametrize("first", [1, 4090, 262140])
def test_one_part_wherever_the_numbers_lie(spark, commands, first):
    df = commands(*(f"db{i} --token abc{i}" for i in range(11)), first=first)
    stepped = steps.step_commands(df)
    summary = steps.summarise(stepped)
    tables = [
        Guide(df, first, first + 10).documents(AT),
        render.step_markdown(stepped, summary),
        annotate.dedup_prompt(df),
        annotate.whole_history_prompt(df),
        annotate.explain_prompt(stepped, summary),
    ]
    rows = [t.collect() for t in tables]
    assert [len(r) for r in rows[:1] + rows[2:]] == [1, 1, 1, 1]
    assert len(rows[1]) == summary.count()
    assert all(r["part_no"] == 0 for found in rows for r in found)
    assert not any("abc" in str(r) for found in rows[2:] for r in found)


def test_groups_remove_all_but_the_representative(spark, commands):
    body = '{"groups":[{"representative":2,"indices":[0,1,2]},{"representative":4,"indices":[2,4,-1,99]}]}'
    df = commands(*"abcdef", first=11, history="h0")
    left = annotate.apply_dedup_groups(df, annotate.parse_dedup_responses(responses(spark, body)))
    assert [r["command"] for r in left.orderBy("number").collect()] == ["d", "e", "f"]


def test_prompts_hold_no_secrets(commands):
    df = commands("db --token abc", "echo -----BEGIN PRIVATE " + "KEY-----", "hostname", first=5)
    text = annotate.dedup_prompt(df).first()["prompt"]
    assert text == "0: db --token <REDACTED>\n1: [REDACTED - contains sensitive data]\n2: hostname\n"
    parts = annotate.dedup_prompt(df, part_rows=1).orderBy("part_no").collect()
    assert "".join(p["prompt"] for p in parts) == text
    whole = annotate.whole_history_prompt(df, [Rule("host", "^host", "guest")]).first()["prompt"]
    assert whole.startswith("## Group 1\n  $ db --token <REDACTED>\n") and whole.endswith("  $ guestname\n\n")


def test_route_by_status(spark, commands):
    def df(name):
        return commands("svn stauts", "svn status", "make all", "make all", history=name)

    rows = [
        ("model", "dedup", "ok", '{"groups":[{"representative":3,"indices":[2,3]}]}'),
        ("silent", "dedup", "ok", "nothing"),
        ("failed", "dedup", "failed", None),
    ]
    table = spark.createDataFrame(rows, RESPONSES)
    both = df("model").union(df("silent")).union(df("failed")).union(df("absent"))
    for chunk_rows in (2, 1 << 18):
        left = annotate.dedup_with_fallback(both, table, chunk_rows=chunk_rows)
        got = {
            r["history_id"]: r["n"]
            for r in left.groupBy("history_id").agg(F.sort_array(F.collect_list("number")).alias("n")).collect()
        }
        assert got == {"model": [1, 2, 4], "silent": [1, 2, 3, 4], "failed": [2, 3], "absent": [2, 3]}


def test_annotated_guide(spark, commands):
    body = '{"overview":"All of it.","prerequisites":["Patience"],"steps":[{"title":"Save","description":"Keep it.","why":"To be safe"}]}'
    rows = [("h", "dedup", "failed", None), ("h", "explain", "ok", body)]
    guide = Guide(history(commands), 2, 8, spark.createDataFrame(rows, RESPONSES))
    text = guide.documents(AT).first()["markdown"]
    assert "## Overview\n\nAll of it.\n\n## Prerequisites\n\n- Patience\n\n## Steps" in text
    assert "### Step 1: Save\n\nKeep it.\n\n```bash\ngit add ." in text
    assert "**Why:** To be safe\n" in text and "**Why:** docker-build\n" in text


def test_answers_are_read_once(spark, commands):
    body = '{"overview":"All of it.","steps":[{"title":"Begin","why":"To begin"}]}'
    answers = spark.createDataFrame(
        [("h", "explain", "ok", body), ("h", "dedup", "ok", '{"groups":[]}')],
        "history_id string, kind string, status string, body string",
    )
    with Guide(commands("ls", "make all", history="h"), 1, 9, answers) as guide:
        assert "parse_json" not in guide.steps._jdf.queryExecution().toString().lower()
        first = guide.steps.orderBy("step_no").first()
        assert (first["title"], first["intent"]) == ("Begin", "To begin")
        assert "All of it." in guide.documents(AT).first()["markdown"]


def test_tables_that_grow_with_the_histories_are_not_broadcast(spark):
    many = ",".join(f'{{"title":"T{i}","why":"W"}}' for i in range(50))
    rows = [(f"h{n}", "dedup", "ok", '{"groups":[]}') for n in range(5)]
    rows += [(f"h{n}", "explain", "ok", f'{{"overview":"All.","steps":[{many}]}}') for n in range(5)]
    answers = spark.createDataFrame(rows, RESPONSES)
    log = [(f"h{n}", i, None, False, c) for n in range(6) for i, c in enumerate(("git add .", "make all"), 1)]
    df = spark.createDataFrame(log, COMMANDS)

    def ran(table):
        found = table.collect()
        return found, table._jdf.queryExecution().executedPlan().toString()

    with Guide(df, 1, 9, answers) as guide:
        # the files of the staged tables are small, whatever they hold
        plans = [
            ran(annotate.dedup_with_fallback(guide.selected, answers, spans=guide.spans))[1],
            ran(annotate.apply_explanations(guide._plain_steps, guide.explained))[1],
            ran(guide.metrics())[1],
        ]
        found, plan = ran(guide.documents(AT))
        for text in [*plans, plan]:
            assert "SortMergeJoin" in text and "Broadcast" not in text
        assert len(found) == 6
        told = {r["history_id"]: r["markdown"].count("**Why:** W\n") for r in found}
        assert told == {"h0": 2, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 0}
