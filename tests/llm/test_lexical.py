import math
import random
import re

import duckdb
import pytest

from shelltrail.llm import lexical
from shelltrail.llm.common import texts

DOCS = "doc_id bigint, text string, item_id string, rank int, score double, n int, term string"
ITEMS = "item_id string, text string, doc_id int, rank int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """(item_id, rank, doc_id, score) by the definition."""
    words = [terms(t) for _, t in docs]
    n_all, length = sum(bool(w) for w in words), sum(map(len, words))
    out = []
    for item_id, text in items:
        scores = [0] * len(docs)
        for term in set(terms(text)):
            tf = [w.count(term) for w in words]
            df = sum(map(bool, tf))
            weight = math.floor(1000 * math.log((2 * n_all + 2) / (2 * df + 1)))
            for d, f in enumerate(tf):
                if f:
                    m = 100 - 50 + 50 * len(words[d]) * n_all // length
                    scores[d] += weight * (1000000000 * f // (1000 * f + 20 * m))
        found = sorted((-s, i is None, i or 0) for s, (i, _) in zip(scores, docs, strict=True) if s > 0)
        out += [(item_id, r, None if null else i, -s) for r, (s, null, i) in enumerate(found[:k], 1)]
    return sorted(out, key=str)


def corpus(rng, n):
    """Texts over few frequent and many rare words, with copies, near copies and long ones."""
    frequent = [f"f{i}" for i in range(8)]
    rare = [f"r{i}" for i in range(150)] + ["É1", "Ünï", "日本"]
    docs = []
    for i in range(n):
        size = rng.choice([1, 5, 20, 60, 300])
        w = [rng.choice(frequent) if rng.random() < 0.6 else rng.choice(rare) for _ in range(size)]
        docs.append((i, rng.choice([" ", ", ", "\x00"]).join(w)))
    docs += [(n + i, docs[3][1]) for i in range(90)] + [(n + 100 + i, docs[7][1] + f" f{i % 4}") for i in range(40)]
    return docs


def wide(docs):
    return [(i, t, "x", 0, 0.5, 1, "y") for i, t in docs]


@pytest.mark.parametrize(
    "k, settings",
    [
        (5, {}),
        (50, {"DEAL": 3, "BLOCK_DOCS": 4}),
        (7, {"PART_CHARS": 60, "PROBE": 1, "SLICE": 11}),
        (1, {"PIVOTS": 1, "BLOCK_DOCS": 1}),
    ],
)
def test_against_the_definition(spark, monkeypatch, k, settings):
    for name, value in settings.items():
        monkeypatch.setattr(lexical, name, value)
    rng = random.Random(k)
    docs = corpus(rng, 150)
    docs += [(None, docs[5][1]), (None, docs[5][1]), (5, docs[9][1]), (500, None), (501, ""), (502, "?!")]
    docs += [(503, "F1 " * 3000 + "r1")]
    items = [(f"i{i}", " ".join(rng.choice(docs[:150])[1].split()[:12])) for i in range(6)]
    items += [("common", "f0 f1 f2"), ("none", "zzz"), ("empty", ""), (None, "r1 r2"), ("null", None)]
    items += [("i0", items[0][1]), ("i0", "R1 r1-r2 É1 日本")]
    out = lexical.rank(
        spark.createDataFrame(wide(docs), DOCS).repartition(5),
        spark.createDataFrame([(i, t, 1, 2) for i, t in items], ITEMS),
        k,
    )
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(docs, items, k)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert lexical.rank(docs, items).collect() == []
    some = spark.createDataFrame([("a", "f0 r1", 1, 1)], ITEMS)
    assert lexical.rank(docs, some).collect() == []
    nothing = spark.createDataFrame(wide([(1, None), (2, "...")]), DOCS)
    assert lexical.rank(nothing, some).collect() == []


def test_a_very_long_text(spark):
    docs = [(1, "a b " * 400000 + "q"), (2, "q"), (3, "b")] + [(i, "c d") for i in range(10, 20)]
    items = [("x", "q b")]
    out = lexical.rank(
        spark.createDataFrame(wide(docs), DOCS), spark.createDataFrame([(*i, 1, 1) for i in items], ITEMS)
    )
    assert sorted((tuple(r) for r in out.collect()), key=str) == brute(docs, items, 50)


def test_summaries_skip_blocks(spark):
    rng = random.Random(2)
    docs = corpus(rng, 2500)
    items = [(f"i{i}", docs[i][1]) for i in range(0, 200, 10)]
    rows = texts(spark.createDataFrame(docs, "doc_id bigint, text string"))
    part = next(lexical.item_parts(spark.createDataFrame(items, "i string, t string"), "i", "t"))
    known = lexical.vectors(rows, part.vocabulary).cache()
    search = lexical.counted(known, part)
    lexical.probe(known, search, 10)
    # frequent lists go by their largest parts, blocks of the others by their summaries
    lists = sum(len(x) for x in search.terms)
    assert sum(len(x) for x in search.order) < 0.9 * lists
    pivots = lexical.pivots_of(known, search)
    index = lexical.blocks(lexical.postings(known, search, pivots)).toArrow()
    best = lexical.Best(len(items), 10)
    seen, skipped = map(sum, zip(*(lexical.look(b, search, best) for b in index.to_batches()), strict=True))
    assert skipped > 0.3 * seen
    for b in index.to_pylist():
        top = dict(zip(b["top_terms"], b["top_parts"], strict=True))
        own = {}
        for t, p in zip(b["terms"], b["parts"], strict=True):
            own[t] = max(own.get(t, 0), p)
        assert top == own and len(b["doc_ids"]) == len(b["counts"]) <= lexical.BLOCK_DOCS
    known.unpersist()


def test_query_against_sql(spark):
    sf_dir = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    want = con.sql(lexical.ORACLE)
    out = lexical.query(spark, sf_dir)
    assert out.columns == want.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted(want.fetchall())
