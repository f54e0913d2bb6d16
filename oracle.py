"""SQL for DuckDB that computes every registered query in its own way."""

from __future__ import annotations

from shelltrail.functions import catalogue
from shelltrail.functions.rules import RULES
from shelltrail.functions.text import WHITE_SPACE
from shelltrail.operators.redact import PLACEHOLDER
from shelltrail.plans import fixtures


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


WS = q(WHITE_SPACE)


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def typo(a: str, b: str) -> str:
    return (
        f"coalesce(abs(strlen({a}) - strlen({b})) <= 5 and levenshtein({a}, {b}) between 1 and"
        f" least(greatest(greatest(strlen({a}), strlen({b})) // 10, 2), 5), false)"
    )


def variable(c: str) -> str:
    return f"{trim(f'split_part(substr({c}, 8), {q("=")}, 1)')}"


def superseded(a: str, b: str) -> str:
    return (
        f"coalesce((starts_with({a}, 'cd ') and starts_with({b}, 'cd ')) or"
        f" (starts_with({a}, 'export ') and starts_with({b}, 'export ') and"
        f" {variable(a)} <> '' and {variable(a)} = {variable(b)}), false)"
    )


def fields(c: str) -> str:
    return f"string_split_regex({trim(c)}, {q(f'[{WHITE_SPACE}]+')})"


def tool(c: str, wrappers: str) -> str:
    f = fields(c)
    return f"case when {f}[1] in ({wrappers}) and len({f}) > 1 then {f}[2] else {f}[1] end"


STEP_WRAPPERS = "'sudo', 'time', 'nice', 'nohup'"


def intent(c: str, extra=()) -> str:
    whens = " ".join(
        f"when starts_with({c}, {q(p)}) then {q(w.name)}"
        for w in (*catalogue.WORKFLOWS, *extra)
        for p in w.prefixes
    )
    return f"case {whens} else '' end"


def lookup(table, key: str, other: str = "null") -> str:
    whens = " ".join(f"when {q(k)} then {q(v)}" for k, v in table)
    return f"case {key} {whens} else {other} end"


def family(t: str) -> str:
    pairs = [(m, str(i)) for i, f in enumerate(catalogue.TOOL_FAMILIES) for m in f]
    return lookup(pairs, t)


EVENTS = """
events_n as (
  select cast(user_id as varchar) as history_id, event_id, event_type,
    cast(floor(epoch(ts)) as bigint) as epoch_s, regexp_extract(props, '([0-9]+)', 1) as k,
    row_number() over (partition by user_id order by ts, event_id) as number
  from events)
"""

LOG = f"""{EVENTS},
log_t as (
  select *, (cast(floor(number / 3.0) as bigint) + event_id % 2) % 24 as t from events_n),
command_log as (
  select history_id, number,
    1704067200 + cast(floor((epoch_s - 1704067200) / 1200.0) as bigint) as epoch_s,
    true as has_time, {fixtures.COMMAND_SQL} as command
  from log_t),
histories as (select history_id, count(*) as commands from events_n group by all)
"""

LINES = f"""{LOG},
history_lines as (
  select history_id, number * 2 as pos, concat(': ', epoch_s,
    case when number % 50 = 0 then repeat('0', 12) else '' end, ':0;', command,
    case when number % 5 = 0 then chr(13) else '' end) as value from command_log
  union all
  select history_id, number * 2 + 1, {fixtures.NOISE_SQL} from command_log where number % 7 = 0),
stripped as (
  select history_id, pos, case when right(value, 1) = chr(13) then left(value, -1) else value end as v
  from history_lines),
parsed as (
  select history_id, pos,
    coalesce(try_cast(regexp_extract(v, '^: ([0-9]+):', 1) as bigint), 9223372036854775807) as epoch_s,
    true as has_time, regexp_extract(v, '^: [0-9]+:[0-9]+;(.*)$', 1) as command
  from stripped where regexp_matches(v, '^: ([0-9]+):[0-9]+;(.*)$')),
numbered as (
  select history_id, row_number() over (partition by history_id order by pos) as number,
    epoch_s, has_time, command from parsed)
"""

PAIRS = f"""{LOG},
pairs as (
  select *, lag({trim("command")}) over w as a, {trim("command")} as b,
    epoch_s - lag(epoch_s) over w as gap
  from command_log window w as (partition by history_id order by number))
"""

MANY_STEPS = (
    "array_to_string(list_transform(range(1, 121), lambda i: concat('{\"title\":\"T', i,"
    " '\",\"description\":\"\",\"why\":\"W', i % 4, '\"}')), ',')"
)

RESPONSES = f"""
response_base as (select history_id, cast(history_id as bigint) as h from histories),
responses as (
  select history_id, 'dedup' as kind, case when h % 5 = 4 then 'failed' else 'ok' end as status,
    {fixtures.DEDUP_BODY_SQL} as body from response_base
  union all
  select history_id, 'explain', case when h % 5 = 4 then 'failed' else 'ok' end,
    {fixtures.EXPLAIN_BODY_SQL.replace("MANY_STEPS", MANY_STEPS)} from response_base),
response_json as (
  select history_id, kind, status, regexp_extract(body, '(?s)\\{{.*\\}}') as j from responses),
dedup_ok as (
  select history_id, j from response_json where kind = 'dedup' and json_valid(j)
    and list_bool_and(list_transform(json_extract(j, '$.groups[*]'), lambda g:
      coalesce(json_type(g, '$.representative') in ('UBIGINT', 'BIGINT', 'NULL'), true)
      and coalesce(json_type(g, '$.reason') in ('VARCHAR', 'NULL'), true)))),
groups as (
  select history_id, i - 1 as group_no, json_extract(j, '$.groups[' || (i - 1) || ']') as g
  from dedup_ok, unnest(range(1, cast(json_array_length(j, '$.groups') as bigint) + 1)) as u(i)),
group_rows as (
  select history_id, group_no,
    coalesce(cast(json_extract(g, '$.representative') as bigint), 0) as representative,
    cast(json_extract(g, '$.indices') as bigint[]) as indices,
    coalesce(json_extract_string(g, '$.reason'), '') as reason from groups),
explain_ok as (
  select history_id, j from response_json where kind = 'explain' and json_valid(j)
    and coalesce(json_type(j, '$.overview') in ('VARCHAR', 'NULL'), true)),
explained as (
  select r.history_id, r.status, coalesce(json_extract_string(j, '$.overview'), '') as overview,
    coalesce(cast(json_extract(j, '$.prerequisites') as varchar[]), []) as prerequisites,
    coalesce(json_extract(j, '$.steps[*]'), []) as steps
  from responses r left join explain_ok o using (history_id) where r.kind = 'explain'),
said as (
  select history_id, i as step_no, nullif(json_extract_string(steps[i], '$.title'), '') as new_title,
    nullif(json_extract_string(steps[i], '$.description'), '') as new_description,
    nullif(json_extract_string(steps[i], '$.why'), '') as new_intent
  from explained, unnest(range(1, len(steps) + 1)) as u(i))
"""


def dedup(source: str, out: str, first: int = 1, gap: int = 30) -> str:
    """Recursive walk over every history at once, one number per round."""
    exact = "s.c = r.c"
    act = f"""case when r.c = '' then 'skip' when s.c is null then 'keep'
      when {exact} then case when r.epoch_s - s.epoch_s > {gap} then 'keep' else 'skip' end
      when {typo("s.c", "r.c")} or {superseded("s.c", "r.c")} then 'replace'
      when r.next_is_fix then 'skip' else 'keep' end"""
    return f"""
{out}_raw as (
  select *, {trim("command")} as c from {source}),
{out}_rows as (
  select * exclude (nc), {typo("c", "nc")} as next_is_fix from (
    select *, lead(c) over (partition by history_id order by number) as nc from {out}_raw)),
{out}_walk as (
  select history_id, cast({first - 1} as bigint) as number, 'skip' as act,
    cast(null as varchar) as c, cast(null as bigint) as epoch_s
  from (select distinct history_id from {source})
  union all
  select history_id, number, act, case when act = 'skip' then old_c else new_c end,
    case when act = 'skip' then old_e else new_e end
  from (
    select r.history_id, r.number, s.c as old_c, s.epoch_s as old_e, r.c as new_c,
      r.epoch_s as new_e, {act} as act
    from {out}_walk s join {out}_rows r on r.history_id = s.history_id and r.number = s.number + 1)),
{out}_acts as (
  select history_id, number, lead(act) over (partition by history_id order by number) as next_act
  from {out}_walk where act <> 'skip'),
{out} as (
  select r.history_id, r.number, r.epoch_s, r.has_time, r.command from {source} r
  join {out}_acts a using (history_id, number) where next_act is distinct from 'replace')
"""


def re2(rule) -> tuple[str, str]:
    replacement = rule.replacement
    for n in range(1, 10):
        replacement = replacement.replace(f"${{{n}}}", f"\\{n}")
    return q(rule.pattern), q(replacement)


def redacted(source: str, keys: str, column: str, out: str, rules=RULES) -> str:
    """Rule after rule; ``dead`` is the number of the rule that removed the row."""
    parts = [
        f"{out}_0 as (select {keys}, {column} as original, {column} as c,"
        f" cast([] as integer[]) as fired, cast(null as integer) as dead from {source})"
    ]
    for i, rule in enumerate(rules, start=1):
        pattern, replacement = re2(rule)
        if rule.drop:
            parts.append(
                f"{out}_{i} as (select {keys}, original, c, fired, coalesce(dead,"
                f" case when regexp_matches(c, {pattern}) then {i} end) as dead from {out}_{i - 1})"
            )
        else:
            parts.append(
                f"{out}_{i} as (select {keys}, original, n as c,"
                f" case when n <> c then list_append(fired, {i}) else fired end as fired, dead"
                f" from (select *, regexp_replace(c, {pattern}, {replacement}, 'g') as n"
                f" from {out}_{i - 1}))"
            )
    parts.append(f"{out} as (select * from {out}_{len(rules)})")
    return ",\n".join(parts)


def audit(marked: str, out: str, rules=RULES) -> str:
    names = "[" + ", ".join(q(r.name) for r in rules) + "]"
    return f"""
{out} as (
  select history_id, number, rule_no, {names}[rule_no] as rule, original from (
    select history_id, number, original,
      unnest(case when dead is not null then [dead] else fired end) as rule_no from {marked}))
"""


def cut(source: str, out: str, threshold: int = 60) -> str:
    """Steps of rows with tool, intent and time."""
    return f"""
{out}_p as (
  select *, {family("tool")} as fam,
    lag(tool) over w as p_tool, lag(intent) over w as p_intent, lag(has_time) over w as p_timed,
    lag(epoch_s) over w as p_epoch, row_number() over w as rn
  from {source} window w as (partition by history_id order by number)),
{out}_b as (
  select * exclude (fam, p_tool, p_intent, p_timed, p_epoch, rn), rn = 1
    or (tool <> p_tool and coalesce(fam <> {family("p_tool")}, true))
    or (has_time and p_timed and coalesce(epoch_s - p_epoch > {threshold}, false))
    or (p_intent <> '' and p_intent <> intent) as starts
  from {out}_p),
{out} as (
  select *, cast(sum(case when starts then 1 else 0 end) over (
    partition by history_id order by number rows unbounded preceding) as bigint) as step_no
  from {out}_b)
"""


def stepped(source: str, out: str, extra=(), threshold: int = 60) -> str:
    return f"""
{out}_t as (
  select history_id, number, epoch_s, has_time, command,
    {tool("command", STEP_WRAPPERS)} as tool, {intent("command", extra)} as intent from {source}),
{cut(f"{out}_t", out, threshold)}
"""


def summary(source: str, out: str, extra=()) -> str:
    titles = {}
    for w in (*catalogue.WORKFLOWS, *extra):
        titles.setdefault(w.name, w.title)
    by_tool = [(t, title) for tools, title in catalogue.TOOL_TITLES for t in tools]
    other = f"case when main_tool is null then {q(catalogue.NO_TOOL_TITLE)} else main_tool || ' operations' end"
    return f"""
{out}_tools as (
  select history_id, step_no, tool, row_number() over (
    partition by history_id, step_no order by count(*) desc, min(number)) as place
  from {source} where tool <> '' group by history_id, step_no, tool),
{out}_agg as (
  select history_id, step_no, arg_max(intent, number) as intent, count(*) as commands,
    min(number) as first_number, max(number) as last_number from {source} group by all),
{out} as (
  select a.history_id, a.step_no,
    coalesce(nullif({lookup(titles.items(), "intent")}, ''), {lookup(by_tool, "main_tool", other)}) as title,
    '' as description, intent, commands, first_number, last_number
  from (select a.*, t.tool as main_tool from {out}_agg a
    left join {out}_tools t on t.history_id = a.history_id and t.step_no = a.step_no and place = 1) a)
"""


def phrase(x: str) -> str:
    return lookup(catalogue.INTENT_PHRASES.items(), x, f"replace({x}, '-', ' ')")


def overview(hist: str, steps: str, out: str) -> str:
    return f"""
{out}_covers as (
  select history_id, string_agg({phrase("intent")}, ', ' order by first_step) as covered from (
    select history_id, intent, min(step_no) as first_step from {steps} where intent <> '' group by all)
  group by all),
{out}_counts as (
  select history_id, count(*) as n, sum(commands) as total from {steps} group by all),
{out} as (
  select h.history_id, case when n is null then 'This runbook contains no commands.' else
    concat(case when covered is not null then concat('This runbook covers: ', covered, '. ') else '' end,
      'It contains ', n, ' steps with ', total, ' commands total.') end as overview
  from {hist} h left join {out}_counts using (history_id) left join {out}_covers using (history_id))
"""


def needs(source: str, out: str) -> str:
    required = tool("command", "'sudo'")
    return f"""
{out} as (
  select history_id, prerequisite, min(number) as first_number from (
    select history_id, number, {lookup(catalogue.TOOL_PREREQUISITES.items(), required)} as prerequisite
    from {source}) where prerequisite is not null group by all),
{out}_list as (
  select history_id, array_agg(prerequisite order by first_number) as prerequisites
  from {out} group by all)
"""


CLOCK = (
    "printf('%02d:%02d:%02d', (epoch_s % 86400) // 3600, (epoch_s % 3600) // 60, epoch_s % 60)"
)


def step_text(stepped_rows: str, steps: str, out: str, timed: bool = False) -> str:
    stamp = f"case when has_time then concat('# ', {CLOCK}, chr(10)) else '' end" if timed else "''"
    return f"""
{out}_lines as (
  select history_id, step_no, string_agg(concat({stamp}, command, chr(10)), '' order by number) as body
  from {stepped_rows} group by all),
{out} as (
  select s.history_id, s.step_no, concat('### Step ', s.step_no, ': ', title, chr(10), chr(10),
    case when description <> '' then concat(description, chr(10), chr(10)) else '' end,
    '```bash', chr(10), body, '```', chr(10),
    case when intent <> '' then concat(chr(10), '**Why:** ', intent, chr(10)) else '' end) as markdown
  from {steps} s join {out}_lines using (history_id, step_no))
"""


def document(title: str, range_text: str, at: str, steps_md: str, out: str, hist: str) -> str:
    return f"""
{out}_body as (
  select history_id, string_agg(concat(markdown, chr(10)), '' order by step_no) as body
  from {steps_md} group by all),
{out} as (
  select h.history_id, cast(0 as bigint) as part_no, concat('# ', {q(title)}, chr(10), chr(10),
    '## Overview', chr(10), chr(10), overview, chr(10), chr(10),
    case when len(prerequisites) > 0 then concat('## Prerequisites', chr(10), chr(10), '- ',
      array_to_string(prerequisites, concat(chr(10), '- ')), chr(10), chr(10)) else '' end,
    '## Steps', chr(10), chr(10), coalesce(body, ''), '## Notes', chr(10), chr(10),
    '- Generated from bash history on ', {q(at)}, chr(10), '- Time range: ', {q(range_text)}, chr(10),
    case when redactions > 0 then concat('- Commands sanitized: ', redactions, chr(10)) else '' end) as markdown
  from {hist} h left join {out}_body using (history_id))
"""


def counted(hist: str, records: str, out: str) -> str:
    return f"""
{out} as (
  select h.history_id, coalesce(n, 0) as redactions from {hist} h
  left join (select history_id, count(*) as n from {records} group by all) using (history_id))
"""


def guide(first: int, last: int) -> str:
    return ",".join(
        [
            LOG,
            f"""selected as (select * from command_log where number between {first} and {last}),
hist as (select history_id, count(*) as extracted from selected group by all)""",
            dedup("selected", "deduped", first),
            redacted("deduped", "history_id, number, epoch_s, has_time", "command", "marked"),
            audit("marked", "records"),
            counted("hist", "records", "counts"),
            """clean as (select history_id, number, epoch_s, has_time, c as command
  from marked where dead is null)""",
            stepped("clean", "st"),
            summary("st", "steps"),
        ]
    )


def with_(body: str, final: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}{body}\n{final}"


APPLIED = """
positions as (
  select *, row_number() over (partition by history_id order by number) - 1 as idx from SOURCE),
listed as (
  select distinct history_id, idx from (
    select history_id, representative, unnest(indices) as idx from group_rows)
  where idx <> representative),
applied as (
  select history_id, number, epoch_s, has_time, command from positions p
  where not exists (select 1 from listed l where l.history_id = p.history_id and l.idx = p.idx))
"""

ENHANCED = """
enhanced as (
  select s.history_id, s.step_no, coalesce(new_title, title) as title,
    coalesce(new_description, description) as description, coalesce(new_intent, intent) as intent,
    commands, first_number, last_number
  from steps s left join SAID using (history_id, step_no))
"""


ALL_OK = "select history_id from responses where kind = 'dedup' and status = 'ok'"
WHOLE_DEDUP = "select history_id from whole where kind = 'dedup'"


def route(source: str, first: int, answered: str = ALL_OK) -> str:
    return f"""
{APPLIED.replace("SOURCE", source)},
{dedup(source, "ruled", first)},
routed as (
  select * from applied where history_id in ({answered})
  union all
  select * from ruled where history_id not in ({answered}))
"""


def _annotated(at: str) -> str:
    body = ",".join(
        [
            LOG,
            RESPONSES,
            """selected as (select * from command_log),
hist as (select history_id, count(*) as extracted from selected group by all)""",
            route("selected", 1),
            redacted("routed", "history_id, number, epoch_s, has_time", "command", "marked"),
            audit("marked", "records"),
            counted("hist", "records", "counts"),
            """clean as (select history_id, number, epoch_s, has_time, c as command
  from marked where dead is null)""",
            stepped("clean", "st"),
            summary("st", "steps"),
            "said_ok as (select * from said join explained using (history_id) where status = 'ok')",
            ENHANCED.replace("SAID", "said_ok"),
            overview("hist", "enhanced", "ov"),
            needs("st", "need"),
            """sections as (
  select h.history_id, coalesce(nullif(e.overview, ''), ov.overview) as overview,
    case when len(e.prerequisites) > 0 then e.prerequisites else need_list.prerequisites end
      as prerequisites, redactions
  from hist h join ov using (history_id) left join need_list using (history_id)
  join counts using (history_id)
  left join (select * from explained where status = 'ok') e on e.history_id = h.history_id)""",
            step_text("st", "enhanced", "md", timed=True),
            document("Annotated", f"commands #1 to #{LAST_NUMBER}", at, "md", "doc", "sections"),
        ]
    )
    return with_(body, "select * from doc", recursive=True)


PART_ROWS, PART_BYTES = 1 << 18, 1 << 26


def parts(pieces: str, keys: str, name: str, out: str, rows: int = PART_ROWS, size: int = PART_BYTES) -> str:
    """Pieces (keys, number, seq, text, size) in order, cut by rows and bytes."""
    half = size // 2
    return f"""
{out}_sums as (
  select *, sum(size) over (partition by {keys}) > {size} as large,
    coalesce(sum(size) over (partition by {keys} order by number, seq
      rows between unbounded preceding and 1 preceding), 0) as start from {pieces}),
{out}_state as (
  select *, (number - min(number) over (partition by {keys})) // {rows} as block,
    case when large then start // {half} else 0 end as slot, large and size > {half} as big
  from {out}_sums),
{out}_cuts as (
  select *, case when row_number() over w = 1 then 0 when block <> lag(block) over w
    or slot <> lag(slot) over w or big or lag(big) over w then 1 else 0 end as begins
  from {out}_state window w as (partition by {keys} order by number, seq)),
{out}_numbered as (
  select *, cast(sum(begins) over (partition by {keys} order by number, seq rows unbounded preceding)
    as bigint) as part_no from {out}_cuts),
{out} as (
  select {keys}, part_no, string_agg(text, '' order by number, seq) as {name}
  from {out}_numbered group by all)
"""


def prompt(text: str, rows: int = PART_ROWS, size: int = PART_BYTES) -> str:
    return f"""
lines as (
  select history_id, number, 2 as seq, strlen(original) + 24 as size,
    concat(row_number() over (partition by history_id order by number) - 1, ': ', {text}, chr(10)) as text
  from marked),
{parts("lines", "history_id", "prompt", "prompts", rows, size)}
"""


def explain_prompt(text: str, rows: int = PART_ROWS, size: int = PART_BYTES) -> str:
    return f"""
frame as (
  select history_id, first_number as number, 1 as seq, concat('## Group ', step_no,
    case when title <> '' then concat(': ', title) else '' end, chr(10)) as text from steps
  union all select history_id, last_number, 3, chr(10) from steps),
lines as (
  select history_id, number, seq, text, strlen(text) as size from frame
  union all
  select history_id, number, 2, concat('  $ ', {text}, chr(10)), strlen(original) + 24 from marked),
{parts("lines", "history_id", "prompt", "prompts", rows, size)}
"""


def step_pieces(stepped_rows: str, steps: str, out: str) -> str:
    return f"""
{out} as (
  select history_id, step_no, number, seq, text, strlen(text) as size from (
    select history_id, step_no, first_number as number, 1 as seq,
      concat('### Step ', step_no, ': ', title, chr(10), chr(10),
        case when description <> '' then concat(description, chr(10), chr(10)) else '' end,
        '```bash', chr(10)) as text from {steps}
    union all
    select history_id, step_no, last_number, 3, concat('```', chr(10),
      case when intent <> '' then concat(chr(10), '**Why:** ', intent, chr(10)) else '' end) from {steps}
    union all
    select history_id, step_no, number, 2, concat(command, chr(10)) from {stepped_rows}))
"""


def document_parts(first: int, last: int, at: str, rows: int, size: int) -> str:
    """The guide documents of :func:`guide_document`, from pieces."""
    body = [
        guide(first, last),
        overview("hist", "steps", "ov"),
        needs("st", "need"),
        step_pieces("st", "steps", "sp"),
        f"""ends as (
  select history_id, min(first_number) as lo, max(last_number) as hi from steps group by all),
heads as (
  select history_id, coalesce(lo, 0) as lo, coalesce(hi, 0) as hi, overview, prerequisites, redactions
  from hist join ov using (history_id) join counts using (history_id)
  left join need_list using (history_id) left join ends using (history_id)),
texts as (
  select history_id, lo as number, 0 as seq, concat('# Runbook', chr(10), chr(10), '## Overview', chr(10), chr(10),
    overview, chr(10), chr(10), case when len(prerequisites) > 0 then concat('## Prerequisites', chr(10), chr(10),
      '- ', array_to_string(prerequisites, concat(chr(10), '- ')), chr(10), chr(10)) else '' end,
    '## Steps', chr(10), chr(10)) as text from heads
  union all
  select history_id, hi, 4, concat('## Notes', chr(10), chr(10), '- Generated from bash history on ', {q(at)}, chr(10),
    '- Time range: commands #{first} to #{last}', chr(10),
    case when redactions > 0 then concat('- Commands sanitized: ', redactions, chr(10)) else '' end) from heads
  union all
  select history_id, number, seq, case when seq = 3 then concat(text, chr(10)) else text end from sp),
pieces as (select *, strlen(text) as size from texts)""",
        parts("pieces", "history_id", "markdown", "doc", rows, size),
    ]
    return with_(",".join(body), "select * from doc", True)


ANSWERS_IN_PARTS = f"""
asked as (
  select history_id, cast(history_id as bigint) as h, (commands + {fixtures.PART_ROWS - 1}) // {fixtures.PART_ROWS} as parts
  from histories),
part_numbers as (
  select history_id, h, parts, p as part_no from asked, unnest(range(parts)) as u(p)
    where not (h % 7 = 1 and p = parts - 1)
  union all select history_id, h, parts, 0 from asked where h % 7 = 2 and not (h % 7 = 1 and parts = 1)
  union all select history_id, h, parts, parts from asked where h % 7 = 4),
responses as (
  select history_id, parts, part_no, 'dedup' as kind, {fixtures.PART_STATUS_SQL} as status,
    {fixtures.DEDUP_PART_SQL} as body from part_numbers
  union all
  select history_id, parts, part_no, 'explain', {fixtures.PART_STATUS_SQL}, {fixtures.EXPLAIN_PART_SQL}
  from part_numbers),
answers as (select *, json_valid(body) as readable from responses),
whole as (
  select history_id, kind from answers group by history_id, kind, parts
  having list(part_no order by part_no) = range(parts) and bool_and(status = 'ok')
    and (parts = 1 or bool_and(readable))),
good as (select * from answers join whole using (history_id, kind) where readable),
group_rows as (
  select history_id, cast(json_extract(g, '$.representative') as bigint) as representative,
    cast(json_extract(g, '$.indices') as bigint[]) as indices
  from (select history_id, unnest(json_extract(body, '$.groups[*]')) as g from good where kind = 'dedup')),
said_steps as (
  select history_id, parts, part_no, i, s from (
    select *, json_extract(body, '$.steps[*]') as l from good where kind = 'explain'),
    unnest(range(1, len(l) + 1)) as u(i), unnest([l[i]]) as v(s)),
headings as (
  select history_id, (first_number - 1) // {fixtures.PART_ROWS} as part_no, min(step_no) as first_step, count(*) as n
  from steps group by all),
said as (
  select history_id, case when parts = 1 then i else first_step + i - 1 end as step_no,
    nullif(json_extract_string(s, '$.title'), '') as new_title,
    nullif(json_extract_string(s, '$.description'), '') as new_description,
    nullif(json_extract_string(s, '$.why'), '') as new_intent
  from said_steps left join headings using (history_id, part_no) where parts = 1 or i <= n),
part_texts as (
  select history_id, part_no, json_extract_string(body, '$.overview') as overview,
    cast(json_extract(body, '$.prerequisites') as varchar[]) as needs from good where kind = 'explain'),
explained as (
  select history_id, arg_min(overview, part_no) filter (overview <> '') as overview,
    flatten(list(needs order by part_no)) as needs from part_texts group by all),
new_needs as (
  select history_id, string_agg(need, '|' order by place) as needs from (
    select history_id, needs[i] as need, min(i) as place from explained, unnest(range(1, len(needs) + 1)) as u(i)
    group by all) group by all)
"""


# above every number of a history
LAST_NUMBER = 1_000_000_000


def guide_document(first: int, last: int, at: str) -> str:
    parts = [
        guide(first, last),
        overview("hist", "steps", "ov"),
        needs("st", "need"),
        """sections as (select * from hist join ov using (history_id)
  left join need_list using (history_id) join counts using (history_id))""",
        step_text("st", "steps", "md"),
        document("Runbook", f"commands #{first} to #{last}", at, "md", "doc", "sections"),
    ]
    return with_(",".join(parts), "select * from doc", True)


def queries(generated_at: str, custom_rules, custom_workflows) -> dict[str, str]:
    mark = redacted("command_log", "history_id, number, epoch_s, has_time", "command", "marked")
    mark_text = f"coalesce(case when dead is not null then {q(PLACEHOLDER)} end, c)"
    audited = f"{LOG}, {mark}, {audit('marked', 'records')}"
    steps = f"{LOG}, {stepped('command_log', 'st')}, {summary('st', 'steps')}"
    g = guide(1, LAST_NUMBER)
    own_rules = redacted(
        "command_log", "history_id, number", "command", "marked", (*RULES, *custom_rules)
    )
    deduped = with_(f"{LOG}, {dedup('command_log', 'out')}", "select * from out", True)

    def column(table: str, key: str, text: str) -> str:
        return with_(
            redacted(table, key, text, "marked"), f"select {key}, {mark_text} as {text} from marked"
        )

    return {
        "parse_history_lines": with_(LINES, "select * from parsed"),
        "number_commands": with_(LINES, "select * from numbered"),
        "number_commands_chunks": with_(LINES, "select * from numbered"),
        "positions_chunks": with_(
            LOG,
            """select *, row_number() over (partition by history_id order by number) - 1 as idx
from command_log""",
        ),
        "range_filter": with_(LINES, "select * from numbered where number between 10 and 40"),
        "empty_range_status": with_(
            LOG,
            """select h.history_id, count(c.number) as commands,
  case when count(c.number) > 0 then 'ok' else 'empty' end as status
from histories h left join command_log c on c.history_id = h.history_id and c.number between 66 and 75
group by h.history_id""",
        ),
        "drop_blank_commands": with_(LOG, f"select * from command_log where {trim('command')} <> ''"),
        "consecutive_duplicates": with_(
            PAIRS, "select history_id, number, gap > 30 as intentional from pairs where a = b"
        ),
        "typo_pairs": with_(
            PAIRS, f"select history_id, number, a, b from pairs where a is not null and {typo('a', 'b')}"
        ),
        "edit_distance_adjacent": with_(
            PAIRS,
            "select history_id, number, levenshtein(a, b) as distance from pairs where a is not null",
        ),
        "export_vars": with_(
            LOG,
            f"""select history_id, number, {variable(trim('command'))} as variable
from command_log where starts_with({trim('command')}, 'export ')""",
        ),
        "collapse_pairs": with_(
            PAIRS, f"select history_id, number, a, b from pairs where {superseded('a', 'b')}"
        ),
        "dedup_commands": deduped,
        "dedup_chunks": deduped,
        "dedup_gap_param": with_(
            f"{LOG}, {dedup('command_log', 'out', gap=5)}", "select * from out", True
        ),
        "redact_documents": column("documents", "doc_id", "text"),
        "redact_pages": column("pages", "page_id", "html"),
        "redact_commands": with_(
            f"{LOG}, {mark}", f"select history_id, number, {mark_text} as command from marked"
        ),
        "redaction_audit": with_(audited, "select history_id, number, rule_no, rule from records"),
        "redaction_strict": with_(audited, "select * from records"),
        "redaction_counts": with_(
            f"{audited}, {counted('histories', 'records', 'counts')}", "select * from counts"
        ),
        "redaction_by_rule": with_(
            audited, "select rule, count(*) as records from records group by rule"
        ),
        "full_removal": with_(
            f"{LOG}, {mark}",
            """select history_id, number, epoch_s, has_time, c as command
from marked where dead is null""",
        ),
        "custom_rules": with_(
            f"{LOG}, {own_rules}",
            "select history_id, number, c as command from marked where dead is null",
        ),
        "custom_rules_column": with_(
            f"{LOG}, {own_rules}", f"select history_id, number, {mark_text} as command from marked"
        ),
        "tools": with_(
            LOG,
            f"""select history_id, number, {tool("command", STEP_WRAPPERS)} as tool,
  {tool("command", "'sudo'")} as required_tool from command_log""",
        ),
        "intents": with_(
            LOG, f"select history_id, number, {intent('command')} as intent from command_log"
        ),
        "custom_workflows": with_(
            f"{LOG}, {stepped('command_log', 'st', custom_workflows)},"
            f" {summary('st', 'steps', custom_workflows)}",
            "select * exclude (description) from steps",
        ),
        "step_boundaries": with_(steps, "select history_id, number, step_no from st where starts"),
        "step_commands": with_(steps, "select * exclude (starts, has_time) from st"),
        "steps": with_(steps, "select * from steps"),
        "steps_chunks": with_(steps, "select * from steps"),
        "step_titles": with_(
            steps,
            """select title, count(*) as steps, cast(sum(commands) as bigint) as commands
from steps group by title""",
        ),
        "threshold_param": with_(
            f"{LOG}, {stepped('command_log', 'st', threshold=20)}, {summary('st', 'steps')}",
            "select * exclude (description) from steps",
        ),
        "overview": with_(
            f"{steps}, {overview('histories', 'steps', 'ov')}", "select * from ov"
        ),
        "prerequisites": with_(f"{LOG}, {needs('command_log', 'need')}", "select * from need"),
        "step_markdown": with_(
            f"{steps}, {step_text('st', 'steps', 'md')}",
            "select history_id, step_no, cast(0 as bigint) as part_no, markdown from md",
        ),
        "step_markdown_timed": with_(
            f"{steps}, {step_text('st', 'steps', 'md', timed=True)}",
            "select history_id, step_no, cast(0 as bigint) as part_no, markdown from md",
        ),
        "guide_documents": guide_document(1, LAST_NUMBER, generated_at),
        "guide_chunks": guide_document(1, LAST_NUMBER, generated_at),
        "guide_range": guide_document(5, 60, generated_at),
        "stage_metrics": with_(
            g,
            """select h.history_id, extracted, coalesce(k.n, 0) as kept, redactions,
  coalesce(s.n, 0) as steps
from hist h join counts using (history_id)
left join (select history_id, count(*) as n from deduped group by all) k using (history_id)
left join (select history_id, count(*) as n from steps group by all) s using (history_id)""",
            True,
        ),
        "prompt_dedup": with_(f"{LOG}, {mark}, {prompt(mark_text)}", "select * from prompts"),
        "prompt_dedup_parts": with_(
            f"{LOG}, {mark}, {prompt(mark_text, rows=16)}", "select * from prompts"
        ),
        "prompt_dedup_bytes": with_(
            f"{LOG}, {mark}, {prompt(mark_text, size=600)}", "select * from prompts"
        ),
        "prompt_explain_parts": with_(
            f"{steps}, {redacted('st', 'history_id, number, step_no', 'command', 'marked')},"
            f" {explain_prompt(mark_text, rows=32, size=500)}",
            "select * from prompts",
        ),
        "step_markdown_parts": with_(
            f"{steps}, {step_pieces('st', 'steps', 'sp')},"
            f" {parts('sp', 'history_id, step_no', 'markdown', 'md', 3, 150)}",
            "select * from md",
        ),
        "guide_parts": document_parts(1, LAST_NUMBER, generated_at, 64, 700),
        "fallback_route_parts": with_(
            f"{steps}, {ANSWERS_IN_PARTS}, {route('command_log', 1, WHOLE_DEDUP)}", "select * from routed", True
        ),
        "apply_explanations_parts": with_(
            f"{steps}, {ANSWERS_IN_PARTS}, {ENHANCED.replace('SAID', 'said')}", "select * from enhanced"
        ),
        "override_sections_parts": with_(
            f"{steps}, {ANSWERS_IN_PARTS}, {overview('histories', 'steps', 'ov')}, {needs('st', 'need')}",
            """select ov.history_id, coalesce(e.overview, ov.overview) as overview,
  coalesce(n.needs, array_to_string(need_list.prerequisites, '|')) as prerequisites
from ov left join need_list using (history_id) left join explained e on e.history_id = ov.history_id
left join new_needs n on n.history_id = ov.history_id""",
        ),
        "prompt_explain": with_(
            f"{steps}, {redacted('st', 'history_id, number, step_no', 'command', 'marked')}",
            f"""select history_id, cast(0 as bigint) as part_no, string_agg(concat('## Group ', step_no,
  case when title <> '' then concat(': ', title) else '' end, chr(10), body, chr(10)), ''
  order by step_no) as prompt
from steps join (select history_id, step_no,
  string_agg(concat('  $ ', {mark_text}, chr(10)), '' order by number) as body
  from marked group by all) using (history_id, step_no)
group by history_id""",
        ),
        "prompt_whole_history": with_(
            f"{LOG}, {mark}",
            f"""select history_id, cast(0 as bigint) as part_no, concat('## Group 1', chr(10),
  string_agg(concat('  $ ', {mark_text}, chr(10)), '' order by number), chr(10)) as prompt
from marked group by history_id""",
        ),
        "parse_responses": with_(
            f"{LOG}, {RESPONSES}",
            """select history_id, group_no, representative,
  array_to_string(indices, ',') as indices, reason from group_rows""",
        ),
        "parse_explanations": with_(
            f"{LOG}, {RESPONSES}",
            """select history_id, status, overview, array_to_string(prerequisites, '|') as prerequisites,
  len(steps) as steps, array_to_string(list_transform(steps, lambda s:
    coalesce(json_extract_string(s, '$.why'), '')), '|') as whys from explained""",
        ),
        "apply_dedup_groups": with_(
            f"{LOG}, {RESPONSES}, {APPLIED.replace('SOURCE', 'command_log')}", "select * from applied"
        ),
        "dedup_reasons": with_(
            f"{LOG}, {RESPONSES}",
            """select history_id, cast(group_no as integer) as group_no, reason
from group_rows where reason <> ''""",
        ),
        "apply_explanations": with_(
            f"{steps}, {RESPONSES}, {ENHANCED.replace('SAID', 'said')}", "select * from enhanced"
        ),
        "override_sections": with_(
            f"{steps}, {RESPONSES}, {overview('histories', 'steps', 'ov')}, {needs('st', 'need')}",
            """select ov.history_id, coalesce(nullif(e.overview, ''), ov.overview) as overview,
  array_to_string(case when len(e.prerequisites) > 0 then e.prerequisites
    else need_list.prerequisites end, '|') as prerequisites
from ov left join need_list using (history_id) join explained e on e.history_id = ov.history_id""",
        ),
        "fallback_route": with_(
            f"{LOG}, {RESPONSES}, {route('command_log', 1)}", "select * from routed", True
        ),
        "guide_annotated": _annotated(generated_at),
        "sessions_events": with_(
            f"""{EVENTS}, ev as (select history_id, number, epoch_s, true as has_time,
  event_type as tool, '' as intent from events_n), {cut('ev', 'st', 86400)}, {summary('st', 'steps')}""",
            "select * exclude (description, intent) from steps",
        ),
        "sessions_conversations": with_(
            f"""cv as (select cast(conv_id as varchar) as history_id, turn as number,
  cast(null as bigint) as epoch_s, false as has_time, role as tool, '' as intent from conversations),
{cut('cv', 'st')}, {summary('st', 'steps')}""",
            "select * exclude (description, intent) from steps",
        ),
    }
