import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from shelltrail.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, label int, rank int, score string, v int, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4) for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            fine[(i, tuple(math.floor(64 * float(np.float32(x))) for x in v))] = 1
    dims = [len(v) for _, v in fine]
    dim = max(sorted(set(dims)), key=dims.count)
    data = [(i, v) for i, v in fine if len(v) == dim]
    out = []
    for i, v in data:
        if i in queries:
            hits = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in data if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(hits[:k])]
    return sorted(out)


def check(spark, rows, queries, k=5, pivots=6):
    df = frame(spark, rows).repartition(5)
    out = topk.top_k(df, df.where(F.col("vec_id").isin(list(queries))), k=k, pivots=pivots)
    assert sorted(map(tuple, out.collect())) == brute(rows, queries, k)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(5, 8)) * 3
    rows = [(i, (centres[i % 5] + rng.normal(size=8) * 0.3).tolist()) for i in range(400)]
    check(spark, rows, range(0, 400, 7))


def test_ties_copies_and_unusable_vectors(spark):
    rng = np.random.default_rng(3)
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(90)]
    rows += [(100 + i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(60)]
    rows += [(100, rows[90][1])] * 3 + [(None, same), (201, None), (202, [1.0, None, 2.0])]
    rows += [(203, [1.0, float("nan"), 2.0]), (204, [float("inf"), 1.0, 2.0]), (205, [1.0, 2.0]), (206, [])]
    check(spark, rows, [*range(0, 90, 4), *range(100, 210)])


def test_an_id_with_several_vectors(spark):
    rng = np.random.default_rng(12)
    rows = [(5, rng.normal(size=4).tolist()) for _ in range(6)] + [(i, rng.normal(size=4).tolist()) for i in range(100, 159)]
    rows += [(7, rows[0][1]), (7, rng.normal(size=4).tolist()), (8, rows[0][1])]
    # every vector of an id is a query; none of its rows is a candidate
    check(spark, rows, [5, 7, 8, 120], k=20)


def test_bounds_leave_out_cells_of_clusters(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 16)) * 4
    x = np.floor(64 * (centres[np.arange(6000) % 30] + rng.normal(size=(6000, 16)) * 0.05)).astype(np.int64)
    pivots = x[:60].astype(float)
    cell, far = topk.nearest(x, pivots)
    counts = np.bincount(cell, minlength=60).astype(float)
    radius = np.array([far[cell == c].max(initial=0) for c in range(60)])
    norms = np.array([np.linalg.norm(x[cell == c], axis=1).max(initial=0) for c in range(60)])
    least = np.full((60, 21), np.inf)
    for c in range(60):
        d = np.sort(far[cell == c])[:21]
        least[c, : len(d)] = d
    bounds = topk.Bounds(pivots, counts, radius, norms, least, 20)
    q = x[7::30][:50]
    upper, sure = bounds.upper(q), bounds.sure(q)
    score = q @ x.T
    assert (np.sort(score, 1)[:, -21] >= sure).all()
    for c in np.flatnonzero(counts):
        assert (score[:, cell == c].max(1) <= upper[:, c]).all()
    needed = (upper >= sure[:, None]).any(0) & (counts > 0)
    assert counts[needed].sum() < 0.2 * len(x)


def test_vectors_of_two_lengths(spark):
    rng = np.random.default_rng(8)
    three = [(i, rng.normal(size=3).tolist()) for i in range(120)]
    five = [(500 + i, rng.normal(size=5).tolist()) for i in range(40)]
    df = frame(spark, three + five + [(900, [1.0, 2.0])])
    found = topk.top_k(df, df.where("vec_id % 4 = 0")).collect()
    got = {(r.query_id, r.rank, r.vec_id, r.score) for r in found}
    alone = [topk.top_k(d, d.where("vec_id % 4 = 0")).collect() for d in (frame(spark, three), frame(spark, five))]
    assert got == {(r.query_id, r.rank, r.vec_id, r.score) for rows in alone for r in rows}
    assert {r.query_id for r in found} == {*range(0, 120, 4), *range(500, 540, 4)}


def test_fewer_than_k_and_none(spark):
    check(spark, [(1, [1.0, 2.0]), (2, [0.1, 0.2]), (3, [-1.0, 0.0])], [1, 2])
    df = frame(spark, [])
    assert topk.top_k(df, df).collect() == []
    df = frame(spark, [(1, [1.0])])
    assert topk.top_k(df, df.where("false")).collect() == []
    assert topk.top_k(df, df).collect() == []


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from read_parquet('{sf}/embeddings.parquet')")
    got = topk.query(spark, sf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == sorted(con.sql(topk.ORACLE).fetchall())
