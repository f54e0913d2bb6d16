import random
import zlib
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from shelltrail.llm import periodic

SCHEMA = "doc_id bigint, text string, runs string, n_words int"


def brute(w):
    """Runs by the definition: stretches of equal words p apart, smallest p of each stretch."""
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i - s + p >= max(6, 4 * p):
                out.setdefault((s, i - s + p), p)
            i += 1
    return sorted((s, length, p) for (s, length), p in out.items())


def kept(w, runs):
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def looped(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def some_words(rng, n):
    kinds = rng.choice([1, 2, 3, 50])
    w = [f"w{rng.randrange(kinds)}" for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randrange(3, 11)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_cover():
    differences = {(a - b) % periodic.MODULUS for a in periodic.COVER for b in periodic.COVER}
    assert len(differences) == periodic.MODULUS and periodic.STEPS.min() == 0


def test_extensions_against_comparison():
    rng = random.Random(3)
    docs = [some_words(rng, rng.randrange(2, 150)) for _ in range(12)] * 2  # copies too
    flat = [int(x[1:]) + 1 if x else 0 for d in docs for x in [*d, ""]]
    words = np.array(flat, np.int64)
    extension = periodic.Extensions(words)
    first = 0
    for d in docs:
        n = len(d)
        i, j = np.triu_indices(n, 1)
        got = extension(first + i, first + j)
        for a, b, x in zip(i.tolist(), j.tolist(), got.tolist(), strict=True):
            k = 0
            while b + k < n and d[a + k] == d[b + k]:
                k += 1
            assert x == k
        first += n + 1


@pytest.mark.parametrize("piece", [7, periodic.PIECE])
def test_runs_against_the_definition(monkeypatch, piece):
    monkeypatch.setattr(periodic, "PIECE", piece)
    rng = random.Random(1)
    for _ in range(60):
        docs = [some_words(rng, rng.randrange(250)) for _ in range(rng.randrange(1, 8))]
        counts, runs, collapsed = periodic.scan([" ".join(d).encode() for d in docs])
        for d, n, r, c in zip(docs, counts, runs, collapsed, strict=True):
            found = [(x["start"], x["length"], x["period"]) for x in r]
            assert n == len(d) and found == brute(d) and c.decode() == kept(d, found)


def test_cases(spark):
    texts = [None, "", " \t\n", "a a a a a", "a a a a a a", "x\x0ba\x0cb a b a b\ta b\na  b", "é é é é é é\xa0é"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "b " * 7, "x", 1), (4, texts[4], "y", 2)]
    out = periodic.periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    by_id = {r.doc_id: r for r in out}
    for i in (0, 1, 2):
        assert (by_id[i].n_words, by_id[i].runs, by_id[i].collapsed) == (0, [], "")
    assert by_id[3].runs == [] and by_id[3].collapsed == "a a a a a"
    assert [tuple(r) for r in by_id[4].runs] == [(0, 6, 1)] and by_id[4].collapsed == "a"
    assert [tuple(r) for r in by_id[5].runs] == [(1, 10, 2)] and by_id[5].collapsed == "x a b"
    assert by_id[6].runs == []  # a no-break space parts no words
    assert by_id[None].collapsed == "b"
    empty = spark.createDataFrame([], SCHEMA)
    assert periodic.periodic_runs(empty).columns == ["doc_id", "n_words", "runs", "collapsed"]
    assert periodic.periodic_runs(empty).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(5000)}" for _ in range(200000)]
    words += words[-777:] * 5 + ["z"] * 100000
    row = periodic.periodic_runs(spark.createDataFrame([(1, " ".join(words), "x", 1)], SCHEMA)).first()
    assert [tuple(r) for r in row.runs] == [(199223, 777 * 6, 777), (203885, 100000, 1)]
    assert row.collapsed == " ".join([*words[:200000], "z"])


def test_query_against_the_definition_and_sql(spark, tmp_path):
    rng = random.Random(9)
    docs = [(i, rng.choice([" ", "\n "]).join(some_words(rng, rng.randrange(90)))) for i in range(120)]
    docs += [(200, None), (201, ""), (None, "a " * 9), (7, docs[7][1]), (-5, "x y " * 8)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = periodic.query(spark, str(tmp_path))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = []
    for doc_id, text in docs:
        w = looped(doc_id, (text or "").split())
        runs = brute(w)
        s, length, p = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None,) * 3)
        lines = "".join(f"{s},{length},{p}\n" for s, length, p in runs)
        digests = [sha256(x.encode()).hexdigest() for x in (lines, kept(w, runs))]
        want.append((doc_id, len(runs), s, length, p, length and 1000 * length // p, *digests))
    assert got == sorted(want, key=str)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    sql = con.sql(periodic.ORACLE)
    assert sql.columns == out.columns
    assert sorted(sql.fetchall(), key=str) == got
