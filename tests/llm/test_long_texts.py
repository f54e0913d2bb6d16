"""One text of more than a megabyte through the operators whose own tests have none."""

import zlib

import numpy as np
import pytest

from shelltrail.llm import license_scan, lm_scoring, neardup, quality, sharding, toxicity
from shelltrail.llm.common import table

SF = "/root/testdata/sf0.01"
LONG = "\n".join(f"Line {i} has some words of its own, number {i * 7919 % 10007}." for i in range(25000))
SCHEMA = "doc_id bigint, text string, score string, n int"


@pytest.fixture(scope="module")
def docs(spark):
    assert len(LONG) > 10**6
    rows = [(1, LONG), (2, "short one"), (3, LONG + " and an end"), (4, None)]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def test_sharding(docs):
    out = {r.doc_id: r for r in sharding.shard_rows(docs).collect()}
    assert out[1].size == len(LONG) + 1 and out[1].text_crc32 == zlib.crc32(LONG.encode())


def test_lm_scoring(docs):
    out = {r.doc_id: r for r in lm_scoring.score(docs).collect()}
    assert out[1].n_words == len(LONG.split()) and np.isfinite(out[1].log_score) and out[1].log_score < 0


def test_neardup(docs):
    out = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert out == {1: 1, 2: 2, 3: 1, 4: 4}


def test_classifiers(spark, docs):
    known, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    good = {r.doc_id: r for r in quality.score(docs, quality.learn(known, labels)).collect()}
    assert 0 <= good[1].score <= 1 and all(0 <= k < 25000 for k in good[1].bad_lines)
    toxic = {r.doc_id: r for r in toxicity.tag(docs, toxicity.learn(known, labels)).collect()}
    assert 0 <= toxic[1].score < toxicity.THRESHOLD


def test_license_scan(spark):
    text = LONG + " mit license " + LONG
    row = license_scan.scan(spark.createDataFrame([(1, text, "x", 1)], SCHEMA)).first()
    assert row.base_labels == "mit" and row.first_word == row.last_word and row.n_base == 1
