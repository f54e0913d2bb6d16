import math
import random
from collections import Counter

import duckdb
import pytest

from shelltrail.llm import lm_scoring

SCHEMA = "doc_id bigint, text string, block string, ids int, words int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


def brute(rows, order, alpha=lm_scoring.ALPHA):
    docs = [[w for w in (t or "").translate(LOWER).encode().split()] for _, t in rows]

    def count(ws):
        return Counter(tuple(ws[i : i + n]) for n in range(1, order + 1) for i in range(len(ws) - n + 1))

    own = [count(ws) for ws in docs]
    total = sum(own, Counter())
    words = sum(map(len, docs))
    out = []
    for (i, _), ws, mine in zip(rows, docs, own, strict=True):
        c = lambda g, mine=mine: total[g] - mine[g]
        logs = 0.0
        for k in range(len(ws)):
            factor = 1.0
            for n in range(min(order, k + 1), 0, -1):
                g = tuple(ws[k - n + 1 : k + 1])
                if n == 1:
                    logs += math.log(factor * max(c(g), lm_scoring.UNSEEN) / max(words - len(ws), 1))
                elif c(g) > 0:
                    logs += math.log(factor * c(g) / c(g[:-1]))
                    break
                factor *= alpha
        out.append((str(i), len(ws), round(logs, 6)))
    return sorted(out)


def result(df, **more):
    return sorted((str(r.doc_id), r.n_words, round(r.log_score, 6)) for r in lm_scoring.score(df, **more).collect())


def corpus(n=120):
    rng = random.Random(6)
    vocabulary = ["the"] * 30 + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(n)]
    return rows + [(500, rows[3][1]), (500, rows[3][1].upper()), (None, rows[4][1]), (501, None), (502, ""), (503, "é É\x0b\tx  the\n")]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_against_the_definition(spark, order):
    rows = corpus()
    # small blocks and partitions
    got = result(frame(spark, rows).repartition(3), order=order, block_chars=900, partition_chars=100)
    want = brute(rows, order)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) < 1e-5 for g, w in zip(got, want, strict=True))


def test_one_document_and_none(spark):
    rows = [(1, "a b a b")]
    assert result(frame(spark, rows)) == brute(rows, 3)
    assert result(frame(spark, [])) == []
    assert result(frame(spark, [(1, None), (2, "")])) == [("1", 0, 0.0), ("2", 0, 0.0)]


def test_very_long_text(spark):
    rows = [(1, "x y z " * 60000), (2, "x y z"), (3, "q")]
    got, want = result(frame(spark, rows)), brute(rows, 3)
    assert all(g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-4 for g, w in zip(got, want, strict=True))


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    got = lm_scoring.query(spark, sf)
    assert got.columns == ["doc_id", "n_words", "log_score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(lm_scoring.ORACLE).fetchall())
