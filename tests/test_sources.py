import pytest
from pyspark.sql import functions as F

from shelltrail.operators import numbering
from shelltrail.operators.pairs import neighbours
from shelltrail.schema import COMMANDS, HISTORY_LINES
from shelltrail import session
from shelltrail.plans.guide import Guide
from shelltrail.session import shared_folder
from shelltrail.sources import history


def write(folder, name, data):
    path = folder / name
    path.write_bytes(data)
    return str(path)


LINES = b": 1700000000:0;one\n: 1700000010:5;two\\\nstill two\n: 1700000020:0;three\r\n\n: 1700000030:0;four;4\r5\n"


def test_lines_to_commands(spark, tmp_path):
    path = write(tmp_path, "hist", LINES)
    rows = history.read_commands(spark, path).orderBy("number").collect()
    assert [(r["number"], r["epoch_s"], r["command"]) for r in rows] == [
        (1, 1700000000, "one"),
        (2, 1700000010, "two\\"),
        (3, 1700000020, "three"),
        (4, 1700000030, "four;4\r5"),
    ]
    assert all(r["has_time"] for r in rows)


def test_ranges(spark, tmp_path):
    path = write(tmp_path, "hist", LINES)
    rows = history.extract(spark, path, 2, 3).orderBy("number").collect()
    assert [r["number"] for r in rows] == [2, 3]
    assert history.extract(spark, path, -5, 1).count() == 1
    with pytest.raises(ValueError):
        history.extract(spark, path, 3, 2)
    with pytest.raises(history.EmptyRange):
        history.extract(spark, path, 50, 60)
    with pytest.raises(history.HistoryNotFound):
        history.extract(spark, path + "-missing", 1, 2)


def test_oversized_time(spark):
    df = spark.createDataFrame([("h", 1, ": 99999999999999999999:0;x"), ("h", 2, ": 1:0;\v")], HISTORY_LINES)
    rows = numbering.parse_lines(df).orderBy("pos").collect()
    assert [(r["epoch_s"], r["command"]) for r in rows] == [(numbering.MAX_LONG, "x"), (1, "\v")]


def test_numbers_across_many_splits(spark, tmp_path):
    expected = set()
    for f in range(3):
        lines = []
        n = 0
        for i in range(4000):
            if i % 5 == f:
                lines.append(b"noise " + b"x" * (i % 90))
                continue
            n += 1
            expected.add((f"hist{f}", n, f"cmd {f} {i}"))
            lines.append(b": %d:0;cmd %d %d" % (1000 + i, f, i) + (b"\r" if i % 2 else b""))
        write(tmp_path, f"hist{f}", b"\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001")
    try:
        name = F.regexp_extract("_metadata.file_path", "([^/]+)$", 1)
        df = history.read_commands(spark, str(tmp_path), name)
        got = [tuple(r) for r in df.select("history_id", "number", "command").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == len(expected) and set(got) == expected


@pytest.mark.parametrize("block_rows", [7, 1 << 18])
def test_numbers_of_a_table(spark, block_rows):
    rows = [(h, p * 3, f": {p}:0;{h}{p}" if p % 4 else "noise") for h in "ab" for p in range(100)]
    parsed = numbering.parse_lines(spark.createDataFrame(rows, HISTORY_LINES).repartition(6))
    got = numbering.number_commands(parsed, block_rows).collect()
    kept = [p for p in range(100) if p % 4]
    assert {(r["history_id"], r["number"], r["command"]) for r in got} == {
        (h, i + 1, f"{h}{p}") for h in "ab" for i, p in enumerate(kept)
    }
    placed = numbering.positions(spark.createDataFrame(got, COMMANDS.split(", command")[0] + ", command string"), block_rows)
    assert all(r["idx"] == r["number"] - 1 for r in placed.collect())


def test_number_in_any_order_with_one_hot_key(spark):
    rows = [("hot" if i % 3 else f"k{i % 30}", i // 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t bigint, id bigint").repartition(5)
    got = numbering.number_in_order(df, "k", ["t", "id"], "test").collect()
    seen: dict[str, int] = {}
    expected = set()
    for k, t, i in sorted(rows, key=lambda r: (r[1], r[2])):
        seen[k] = seen.get(k, 0) + 1
        expected.add((k, i, seen[k]))
    assert {(r["k"], r["id"], r["number"]) for r in got} == expected


def test_neighbours_across_seams(spark):
    rows = [("h", i * 4, i, True, f"c{i}") for i in range(1, 60)]
    df = spark.createDataFrame(rows, COMMANDS)
    for chunk_rows in (3, 10, 1 << 18):
        got = {(r["a"], r["b"]) for r in neighbours(df, chunk_rows).collect()}
        assert got == {(f"c{i}", f"c{i + 1}") for i in range(1, 59)}


def test_shared_folder_is_the_one_of_the_cluster(spark):
    class Session:
        conf = {"spark.checkpoint.dir": "/shared/checkpoints"}

    assert shared_folder(Session()) == "/shared/checkpoints"
    assert shared_folder(spark) == shared_folder(spark)


def test_folder_rules(spark):
    class Context:
        master, applicationId = "spark://host:7077", "app"

        def getCheckpointDir(self):
            return self.folder

    class Session:
        conf, sparkContext = {}, Context()

    Context.folder = "/given/to/the/context"
    assert shared_folder(Session()) == "/given/to/the/context"
    Context.folder = None
    with pytest.raises(session.NoSharedFolder):
        shared_folder(Session())


def test_staged_tables_have_an_owner(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    rows = [("h", i, i, True, f"git add {i}") for i in range(1, 20)]
    with Guide(spark.createDataFrame(rows, COMMANDS), 1, 19, chunk_rows=4) as guide:
        assert guide.metrics().first()["extracted"] == 19
        assert len(list(tmp_path.iterdir())) > 2
    assert list(tmp_path.iterdir()) == []
    with session.staging(spark):
        kept = session.stage(spark.range(3), "kept", keep=True)
        session.staged(spark.range(3), "gone")
    assert [str(p) for p in tmp_path.iterdir()] == [kept]


def test_files_of_one_history_are_numbered_together(spark, tmp_path):
    for name in ("b", "a"):
        write(tmp_path, name, b"".join(b": %d:0;%s%d\n" % (i, name.encode(), i) for i in range(3)))
    df = history.read_commands(spark, str(tmp_path), F.lit("all"))
    got = [r["command"] for r in df.orderBy("number").collect()]
    assert got == ["a0", "a1", "a2", "b0", "b1", "b2"]
    assert [r["number"] for r in df.orderBy("number").collect()] == [1, 2, 3, 4, 5, 6]


def test_unreadable_history(spark, tmp_path):
    path = write(tmp_path, "broken.gz", b"no gzip at all")
    with pytest.raises(history.UnreadableHistory):
        history.read_commands(spark, path)


def test_written_guides_keep_their_order(spark, tmp_path):
    parts = [("a b", i, f"line {i}\nmore {i}\n") for i in range(20)] + [("c", 0, "x\n")]
    df = spark.createDataFrame(parts, "history_id string, part_no bigint, markdown string").repartition(7)
    history.write_markdown(df, str(tmp_path / "md"))
    folders = sorted(p for p in (tmp_path / "md").iterdir() if p.is_dir())
    texts = ["".join(f.read_text() for f in sorted(d.glob("part-*"))) for d in folders]
    assert sorted(texts) == sorted(["".join(p[2] for p in parts[:20]), "x\n"])
    history.write_parquet(df, str(tmp_path / "pq"))
    assert spark.read.parquet(str(tmp_path / "pq")).count() == 21


def test_one_file_for_each_guide(spark, tmp_path):
    texts = {f"h/{i}": [f"# part {p} of {i} é\n" * (p + 1) for p in range(1 + i % 4)] for i in range(12)}
    texts[None] = ["no id"]
    rows = [(h, p, t) for h, parts in texts.items() for p, t in enumerate(parts)]
    df = spark.createDataFrame(rows[::-1], "history_id string, part_no bigint, markdown string").repartition(5)
    folder = tmp_path / "guides"
    folder.mkdir()
    # what an attempt without success has left is in the folder, but not named
    (folder / "h%2F0-lost.md").write_text("half of")
    found = history.write_guides(df, str(folder)).collect()
    assert len(found) == len(texts) and len(list(folder.glob("*.md"))) == len(texts) + 1
    for r in found:
        body = open(r["path"], "rb").read().decode()
        assert body == "".join(texts[r["history_id"]])
        assert (r["parts"], r["bytes"]) == (len(texts[r["history_id"]]), len(body.encode()))
    assert not any("lost" in r["path"] for r in found)
    none = history.write_guides(df.where("part_no < 0"), f"file://{tmp_path}/none")
    assert none.collect() == []


def test_an_attempt_that_fails_leaves_no_manifest(spark, tmp_path):
    bad = F.udf(lambda i: 1 // (i - 3), "bigint")
    df = spark.range(5).select(
        F.lit("h").alias("history_id"), F.col("id").alias("part_no"), F.lit("x").alias("markdown"), bad("id").alias("z")
    )
    df = df.where("z > -9")
    with pytest.raises(Exception, match="ZeroDivision"):
        history.write_guides(df, str(tmp_path / "g"))
    assert not (tmp_path / "g" / "_manifest" / "_SUCCESS").exists()
