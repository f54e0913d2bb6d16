import zlib

import numpy as np
import pytest

from shelltrail.llm import sharding

SCHEMA = "doc_id bigint, text string, shard string, row int"


@pytest.mark.parametrize("total", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation_is_a_bijection_with_an_inverse(total):
    rows = np.arange(total)
    there = sharding.permute(rows, total)
    assert sorted(there.tolist()) == rows.tolist()
    assert sharding.permute(there, total, inverse=True).tolist() == rows.tolist()


def test_large_domain():
    rows = np.array([0, 1, 2**40, 2**44 - 3])
    there = sharding.permute(rows, 2**44 - 2)
    assert (there < 2**44 - 2).all() and (there >= 0).all()
    assert (sharding.permute(there, 2**44 - 2, inverse=True) == rows).all()


def test_shards_against_the_definition(spark):
    rows = [(i, f"text {i % 5}" if i % 7 else None, "x", 1) for i in range(50)]
    rows += [(None, "a", "x", 1)] * 4 + [(3, "é", "x", 1)] * 30
    out = sharding.shard_rows(spark.createDataFrame(rows, SCHEMA).repartition(5), shards=7).collect()
    digests = sorted(
        (i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        for i, t, _, _ in rows
    )
    got = sorted((r.row, r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in out)
    assert got == [(n, *d) for n, d in enumerate(digests)]
    for r in out:
        place = int(sharding.permute(np.array([r.row]), len(rows))[0])
        assert (r.shard, r.slot) == (place % 7, place // 7)
        assert sharding.row_at(r.shard, r.slot, len(rows), 7) == r.row
    for shard in range(7):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (12, 11, 13)
    again = sharding.shard_rows(spark.createDataFrame(rows, SCHEMA).repartition(2), shards=7)
    assert sorted(map(str, again.collect())) == sorted(map(str, out))


def test_empty_table_and_bad_shards(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_rows(empty).collect() == []
    with pytest.raises(ValueError):
        sharding.shard_rows(empty, shards=0)
