import random
import re

import duckdb
import numpy as np
import pytest

from shelltrail.llm import neardup
from shelltrail.llm.common import table
from shelltrail.llm.components import components

SCHEMA = "doc_id bigint, text string, n bigint, rep bigint, key string, kept int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, words):
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        grams = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
        sets[i] = grams
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = root(i), root(j)
                parent[max(p, q)] = min(p, q)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x", 3) for i, t in rows], SCHEMA)


def result(df, words):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, words=words).collect()}


def edited(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
    return " ".join(w)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    make = lambda size: " ".join(rng.choice(vocabulary) for _ in range(size))
    passage = make(60)
    texts = []
    while len(texts) < n:
        base = make(rng.randrange(1, 200))
        if rng.random() < 0.3:
            base = passage + " " + base
        texts.append(base)
        for _ in range(rng.choice([0, 0, 1, 3, 8])):
            texts.append(edited(rng.choice([base, texts[-1]]), rng, rng.randrange(0, 1 + len(base.split()) // 30)))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "words"), [(1, 4), (2, 5)])
def test_against_all_pairs(spark, seed, words):
    rows = corpus(seed)
    rows += [(i + 5000, t) for i, t in enumerate([None, "", " \t\n", "One", "ONE", "one two", "one\x0btwo", "É é", "é é"])]
    assert result(frame(spark, rows).repartition(6), words) == brute(rows, words)


def test_chains_and_one_large_group(spark):
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(200)}" for _ in range(150))
    rows = [(0, base)]
    for i in range(1, 60):
        rows.append((i, edited(rows[-1][1], rng, 3)))
    rows += [(100 + i, edited(base, rng, 2)) for i in range(700)]
    rows += [(1000 + i, base.upper()) for i in range(300)]
    assert result(frame(spark, rows).repartition(6), 4) == brute(rows, 4)


@pytest.mark.parametrize("shingles", [300, 1 << 20])
def test_blocks_of_a_large_bucket(spark, monkeypatch, shingles):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", shingles)
    rng = random.Random(8)
    base = " ".join(f"w{rng.randrange(200)}" for _ in range(150))
    # most pairs lie below the threshold, some chains go through
    rows = corpus(5, 100) + [(1000 + i, edited(base, rng, 6)) for i in range(150)]
    assert result(frame(spark, rows), 4) == brute(rows, 4)


def test_null_and_repeated_ids(spark):
    text = "one two three four five six"
    rows = [(None, text), (None, "quite another text of six words"), (7, text), (7, text), (9, text + "!"), (3, None)]
    out = neardup.near_duplicates(frame(spark, rows)).collect()
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out)
    assert got == [
        ("3", "3", True), ("7", "7", True), ("7", "7", True), ("9", "9", True), ("None", "7", False), ("None", "None", True)
    ]
    assert neardup.near_duplicates(frame(spark, [])).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    error = []
    for _ in range(60):
        a = rng.integers(0, 2**63, 400, np.uint64)
        b = np.concatenate([a[:340], rng.integers(0, 2**63, 60, np.uint64)])
        share = (neardup.signature(np.sort(a)) == neardup.signature(np.sort(b))).mean()
        error.append(share - 340 / 460)
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.05


def test_components_of_long_paths(spark):
    rng = random.Random(2)
    names = list(range(400))
    rng.shuffle(names)
    links = [(names[i], names[i + 1]) for i in range(150)] + [(names[200], names[i]) for i in range(201, 300)]
    links += [(5, 5)] + links[:3]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    want = {n: min(names[:151]) for n in names[:151]} | {n: min(names[200:300]) for n in names[200:300]}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_query_against_all_pairs_of_a_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()]
    out = neardup.query(spark, sf).collect()
    want = brute(rows, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert sorted(map(tuple, out)) == sorted(con.sql(neardup.ORACLE).fetchall())
