"""Command histories derived from the ``events`` table.

No input table holds shell commands. Every event becomes a command of its user's
history, so the fixtures grow with the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelltrail.operators.numbering import number_in_order
from shelltrail.session import stage

# The command made of an event, by template number ``t`` and the
# number ``k`` in its properties. Neighbours are pairs on purpose: typing errors,
# repeated cd and export, related tools. Both SQL dialects read this text.
COMMAND_SQL = """
case t when 0 then 'git stauts' when 1 then 'git status' when 2 then 'git add .'
 when 3 then concat('git commit -m "step ',k,'"') when 4 then 'gh pr create'
 when 5 then 'ls' when 6 then '' when 7 then concat('cd /srv/',k)
 when 8 then concat('cd /srv/',k,'/app') when 9 then concat('export APP_TOKEN=tok',k)
 when 10 then concat('export APP_TOKEN=tok',k,'longer') when 11 then concat('export PATH=/opt/',k)
 when 12 then concat('docker build -t img:',k,' .') when 13 then concat('sudo docker push img:',k)
 when 14 then 'docker-compose up' when 15 then concat('kubectl apply -f ',k,'.yaml')
 when 16 then 'helm list' when 17 then 'time go build ./...'
 when 18 then concat('mysql -u root -psecret',k,' db')
 when 19 then concat('psql postgres://u:pw',k,'@host/db') when 20 then concat(chr(9),'make test ')
 when 21 then 'echo "-----BEGIN RSA PRIVATE KEY-----"'
 when 22 then concat('curl -H "Authorization: Bearer abc',k,'" https://api.example.com')
 else concat('npm install caf',chr(233),'-',k) end
"""

# Noise behind every seventh command, by command number.
NOISE_SQL = """
case number % 3 when 0 then '' when 1 then concat('continued ', chr(92)) else ': 12:;no duration' end
"""

# The body of a response, by history number and kind.
DEDUP_BODY_SQL = """
case h % 5
 when 0 then concat('Here they are: {"groups":[{"representative":2,"indices":[0,1,2],',
  '"reason":"same as ',h,'"},{"representative":5,"indices":[4,5],"reason":""}]} Done.')
 when 1 then '{"groups":[{"representative":"two","indices":[0,1]}]}'
 when 2 then 'I found no duplicates.'
 when 3 then '{"groups":[{"indices":[0,3,9999],"reason":"no representative"}],"extra":{"a":1}}'
 else null end
"""
EXPLAIN_BODY_SQL = """
case h % 5
 when 0 then concat('{"overview":"About history ',h,'.","prerequisites":["A shell","Access ',h,'"],',
  '"steps":[{"title":"First things","description":"Look around.","why":"To begin","notes":"none"},',
  '{"title":"","description":"","why":"To go on"}]}')
 when 1 then '{"overview":5,"steps":[]}'
 when 2 then 'Nothing to explain.'
 when 3 then concat('{"steps":[',MANY_STEPS,']}')
 else null end
"""

# Numbers of a prompt part in the fixture of answers in parts, and by history number h and part
# part_no of parts: which answers are missing, repeated, failed, not asked, and their bodies.
PART_ROWS = 16
PARTS_SQL = """
flatten(transform(sequence(0, parts), p -> case
  when p = parts then if(h % 7 = 4, array(p), array())
  when h % 7 = 1 and p = parts - 1 then array()
  when h % 7 = 2 and p = 0 then array(p, p)
  else array(p) end))
"""
PART_STATUS_SQL = "case when h % 7 = 6 and part_no = 1 then 'failed' else 'ok' end"
DEDUP_PART_SQL = """
case when h % 7 = 3 and part_no = 0 then 'No groups here.'
 else concat('{"groups":[{"representative":',part_no*16+1,',"indices":[',part_no*16,',',part_no*16+1,',',part_no*16+3,
  '],"reason":"part ',part_no,' of ',h,'"}]}') end
"""
EXPLAIN_PART_SQL = """
case when h % 7 = 3 and part_no = 0 then '{"steps":['
 else concat('{"overview":"',case when part_no % 2 = 1 then concat('About part ',part_no,' of ',h,'.') else '' end,
  '","prerequisites":["Access ',h,'","Part ',part_no,'"],"steps":[{"title":"First of ',part_no,
  '","description":"Look around."},{"title":"","why":"Second of ',part_no,'"},{"title":"Third of ',part_no,'"},',
  '{"why":"Fourth of ',part_no,'"}]}') end
"""

_staged: dict[tuple[str, str], tuple[str, StructType]] = {}


def epoch_seconds(ts: str) -> str:
    """SQL for whole seconds since 1970 of a timestamp without zone, in any session zone."""
    since = f"(cast({ts} as timestamp_ntz) - timestamp_ntz'1970-01-01 00:00:00')"
    return (
        f"cast(extract(day from {since}) * 86400L + extract(hour from {since}) * 3600"
        f" + extract(minute from {since}) * 60 + floor(extract(second from {since})) as bigint)"
    )


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events numbered per user in the order of time; staged once per application and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _staged:
        numbered = _number_events(spark, sf_dir)
        _staged[key] = stage(numbered, "events", keep=True), numbered.schema
    path, schema = _staged[key]
    return spark.read.schema(schema).parquet(path)


def _number_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("user_id").cast("string").alias("history_id"),
        "ts",
        "event_id",
        "event_type",
        F.regexp_extract("props", "([0-9]+)", 1).alias("k"),
        F.expr(epoch_seconds("ts")).alias("epoch_s"),
    )
    return number_in_order(events, "history_id", ["ts", "event_id"], "event-pieces").drop("ts")


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of all users; time is squeezed so that gaps fall near the thresholds."""
    events = numbered_events(spark, sf_dir)
    t = "cast((floor(number / 3D) + event_id % 2) % 24 as int)"
    epoch = "1704067200 + cast(floor((epoch_s - 1704067200) / 1200D) as bigint)"
    return events.withColumn("t", F.expr(t)).select(
        "history_id",
        "number",
        F.expr(epoch).alias("epoch_s"),
        F.lit(True).alias("has_time"),
        F.expr(COMMAND_SQL).alias("command"),
    )


def history_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw lines of the command log, with noise, carriage returns and oversized times."""
    digits = F.when(
        F.col("number") % 50 == 0, F.concat(F.col("epoch_s").cast("string"), F.lit("0" * 12))
    ).otherwise(F.col("epoch_s").cast("string"))
    line = F.concat(
        F.lit(": "),
        digits,
        F.lit(":0;"),
        "command",
        F.when(F.col("number") % 5 == 0, F.lit("\r")).otherwise(""),
    )
    own = F.struct((F.col("number") * 2).alias("pos"), line.alias("value"))
    noise = F.struct((F.col("number") * 2 + 1).alias("pos"), F.expr(NOISE_SQL).alias("value"))
    return command_log(spark, sf_dir).select(
        "history_id",
        F.inline(F.when(F.col("number") % 7 == 0, F.array(own, noise)).otherwise(F.array(own))),
    )


def histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per history, with its number of commands."""
    return numbered_events(spark, sf_dir).groupBy("history_id").agg(
        F.count("*").alias("commands")
    )


def responses_in_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to prompts in parts of ``PART_ROWS`` numbers, some of them not whole."""
    base = histories(spark, sf_dir).select(
        "history_id",
        F.col("history_id").cast("bigint").alias("h"),
        F.expr(f"(commands + {PART_ROWS - 1}) div {PART_ROWS}").alias("parts"),
    )
    rows = base.select("history_id", "h", F.explode(F.expr(PARTS_SQL)).alias("part_no"))
    kinds = F.array(
        F.struct(F.lit("dedup").alias("kind"), F.expr(DEDUP_PART_SQL).alias("body")),
        F.struct(F.lit("explain").alias("kind"), F.expr(EXPLAIN_PART_SQL).alias("body")),
    )
    status = F.expr(PART_STATUS_SQL).alias("status")
    return rows.select("history_id", "part_no", status, F.inline(kinds)).select(
        "history_id", "kind", "part_no", "status", "body"
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses of every kind a model may give, one per history and kind."""
    many = (
        "array_join(transform(sequence(1, 120), i -> concat('{\"title\":\"T',i,"
        "'\",\"description\":\"\",\"why\":\"W',i % 4,'\"}')), ',')"
    )
    base = histories(spark, sf_dir).select(
        "history_id", F.col("history_id").cast("bigint").alias("h")
    )
    status = F.when(F.col("h") % 5 == 4, "failed").otherwise("ok")
    body = F.struct
    kinds = F.array(
        body(F.lit("dedup").alias("kind"), F.expr(DEDUP_BODY_SQL).alias("body")),
        body(
            F.lit("explain").alias("kind"),
            F.expr(EXPLAIN_BODY_SQL.replace("MANY_STEPS", many)).alias("body"),
        ),
    )
    return base.select("history_id", status.alias("status"), F.inline(kinds)).select(
        "history_id", "kind", "status", "body"
    )
