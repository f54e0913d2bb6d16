import hashlib

import numpy as np
import pytest
import tiktoken
from test_neardup import brute

import corpus_pipeline
from shelltrail.llm import bpe, decontaminate, quality, toxicity
from shelltrail.llm.common import learned_fold, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage, written and read again."""
    docs, out = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages_keep_the_columns_and_only_drop_rows(stages):
    for name, (before, after) in list(stages.items())[:-1]:
        assert after.columns == before.columns, name
        assert after.exceptAll(before).isEmpty(), name
        assert after.count() > 0.5 * before.count(), name


@pytest.mark.parametrize(("name", "label", "rejected"), [("toxicity", "toxic", 1), ("quality", "quality", 0)])
def test_classifier_stages_on_held_out_labels(spark, stages, name, label, rejected):
    before, after = stages[name]
    module = {"toxic": toxicity, "quality": quality}[label]
    held = before.where(~learned_fold("doc_id", module.FOLDS, module.HELD_OUT))
    labels = {r.doc_id: r[label] for r in held.join(table(spark, SF, "labels"), "doc_id").collect()}
    kept = ids(after)
    bad = [i for i, v in labels.items() if v == rejected]
    good = [i for i, v in labels.items() if v != rejected]
    assert sum(i in kept for i in good) >= 0.95 * len(good)
    assert sum(i not in kept for i in bad) >= 0.5 * len(bad) > 0


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    groups = brute([(r.doc_id, r.text) for r in before.collect()], 5)
    assert ids(after) == {i for i, (_, component) in groups.items() if i == component}


def test_no_benchmark_passage_stays_and_clean_documents_do(spark, stages):
    before, after = stages["decontamination"]
    tests = [b" " + b" ".join(decontaminate.words_of(r.text)) + b" " for r in table(spark, SF, "benchmark").collect()]
    leaked = {
        r.doc_id for r in before.collect() if any(t in b" " + b" ".join(decontaminate.words_of(r.text)) + b" " for t in tests)
    }
    assert leaked and not leaked & ids(after)
    assert len(ids(before) - leaked - ids(after)) <= 2


def test_token_ids_are_those_of_the_library(stages):
    before, after = stages["byte_bpe"]
    library = tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.RANKS), special_tokens={})
    rows = {r.doc_id: r for r in after.collect()}
    for r in before.collect():
        want = np.array(library.encode_ordinary(r.text), "<u4").tobytes()
        got = rows.pop(r.doc_id)
        assert bytes(got.ids) == want and got.n_tokens == len(want) // 4
        assert got.ids_sha256 == hashlib.sha256(want).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert not rows


def test_run_is_the_stages_one_after_another(spark, stages):
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == {r.doc_id: r.ids_sha256 for r in stages["byte_bpe"][1].collect()}


def test_names_that_differ_in_case_only(spark):
    schema = "doc_id bigint, text string, Toxicity string, QUALITY string, Toxicity_ int, Leaks int"
    docs = spark.createDataFrame([(1, "A plain line of some words.", "a", "b", 1, 2), (2, None, "c", "d", 3, 4)], schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")], name
    row = next(r for r in docs.collect() if r.doc_id == 1)
    assert (row["Toxicity"], row["QUALITY"], row["Toxicity_"], row["Leaks"]) == ("a", "b", 1, 2)


def test_hard_rows_and_more_columns(spark):
    schema = "doc_id bigint, text string, score double, toxicity string, quality string, leaks int, rep int, n int"
    rows = [(1, None), (2, ""), (None, "a plain line of some words"), (None, "a plain line of some words"), (3, "x " * 50000)]
    rows += [(4, "Some plain text, of a line.")] * 2 + [(5, "some plain text, of a line.")]
    docs = spark.createDataFrame([(i, t, 0.5, "a", "b", 1, 2, 3) for i, t in rows], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    left = sorted(str(r.doc_id) for r in docs.collect())
    assert set(left) <= {"1", "2", "3", "4", "None"} and left.count("4") <= 1
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.collect() == []
