import itertools

import numpy as np
import pytest

from shelltrail.llm import crf, learning, quality, toxicity
from shelltrail.llm.common import table

SCHEMA = "doc_id bigint, text string, score string, quality string, toxic int"
SF = "/root/testdata/sf0.01"


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(3)
    lens = rng.integers(1, 8, 6)
    n = int(lens.sum())
    first = np.zeros(n, bool)
    first[np.cumsum(lens) - lens] = True
    score, trans, start = rng.normal(size=n) * 3, rng.normal(size=(2, 2)) * 2, rng.normal(size=2)
    want, pairs, at = [], np.zeros((2, 2)), 0
    for size in lens.tolist():
        total, one, two = 0.0, np.zeros(size), np.zeros((2, 2))
        for s in itertools.product((0, 1), repeat=size):
            w = start[s[0]] + sum(score[at + i] * s[i] for i in range(size))
            w = np.exp(w + sum(trans[a, b] for a, b in zip(s, s[1:], strict=False)))
            total, one = total + w, one + w * np.array(s)
            for a, b in zip(s, s[1:], strict=False):
                two[a, b] += w
        want, pairs, at = [*want, *(one / total)], pairs + two / total, at + size
    got = crf.Chains(score, first, trans, start)
    assert np.allclose(got.p, want) and np.allclose(got.pairs(), pairs)


def test_long_chains_over_many_blocks():
    rng = np.random.default_rng(4)
    n = 5000
    score, first = rng.normal(size=n) * 4, np.zeros(n, bool)
    first[[0, 700, 701]] = True
    trans, start = np.array([[1.0, -1], [-2, 1]]), np.array([0.3, -0.3])
    got = crf.Chains(score, first, trans, start).p
    # plain recursions in logarithms
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(n):
        base = start if first[t] else np.logaddexp(*(fwd[t - 1][:, None] + trans))
        fwd[t] = base + [0, score[t]]
    for t in range(n - 2, -1, -1):
        if not first[t + 1]:
            bwd[t] = np.logaddexp(*(trans + bwd[t + 1] + [0, score[t + 1]]).T)
    both = fwd + bwd
    assert np.allclose(got, 1 / (1 + np.exp(both[:, 0] - both[:, 1])))


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_held_out_accuracy(spark, module, label):
    out = module.query(spark, SF).join(table(spark, SF, "labels"), "doc_id").toPandas()
    held = out[out.held_out]
    assert len(held) > 60
    assert (held.predicted == held[label]).mean() > 0.9
    assert ((held.score >= 0) & (held.score <= 1)).all()


def hard_rows(spark):
    rows = [(1, None, "x", "y", 0), (2, "", "x", "y", 0), (None, "a b", "x", "y", 0), (4, "word " * 30000, "x", "y", 0)]
    rows += [(5, "Some plain words. More of them.\nA line.\n\n", "x", "y", 0)] * 3
    rows += [(6, "you moron and idiot, go away", "x", "y", 0)]
    return spark.createDataFrame(rows, SCHEMA)


def examples():
    good = [f"The {a} went to the {b}. It was a fine day.\nThey came home late, and slept." for a in "abcdefgh" for b in "uvwxyz"]
    bad = [f"{a}{b}## {b}{a}$$ {a}&& {b}%%\nBUY!! BUY!! BUY!! {a}!!" for a in "abcdefgh" for b in "uvwxyz"]
    return good + bad, np.array([1] * len(good) + [0] * len(bad))


def test_quality_of_hard_rows(spark):
    model = quality.fit(*examples())
    out = quality.score(hard_rows(spark), model).collect()
    assert len(out) == 8 and all(0 <= r.score <= 1 for r in out)
    scores = {(r.doc_id): r.score for r in out}
    assert scores[1] == scores[2] and scores[5] > 0.5
    junk = spark.createDataFrame([(1, "q## w$$ e&&\nBUY!! NOW!! BUY!!", "", "", 0)], SCHEMA)
    found = quality.score(junk, model).collect()[0]
    assert found.score < 0.5 and found.bad_lines == [0, 1]


def test_toxic_spans_of_hard_rows(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]
    items, y = [], []
    for i in range(300):
        text = list(rng.choice(words, 30))
        if i % 3 == 0:
            text[int(rng.integers(30))] = ["moron", "idiot"][i % 2]
        items.append(" ".join(text))
        y.append(int(i % 3 == 0))
    model = toxicity.fit(items, np.array(y))
    out = {r.doc_id: r for r in toxicity.tag(hard_rows(spark), model).collect()}
    assert out[1].score == out[2].score == 0 and out[5].score < 0.3 and out[4].score < 0.3
    text = "you moron and idiot, go away"
    assert out[6].score > 0.5
    assert [text[s.start : s.end] for s in out[6].spans] == ["moron", "idiot"]


def test_sample_of_repeated_ids(spark):
    # one id has most of the rows, all of them short; some ids have two texts or two labels
    rows = [(i, f"text {i}") for i in range(300)] + [(7, f"copy {i}") for i in range(3000)] + [(8, "a text")]
    labels = [(i, i % 2) for i in range(300)] + [(7, 1)] * 50 + [(9, 0), (None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    known = spark.createDataFrame(labels, "doc_id bigint, y int")
    every = {(f"text {i}", i % 2) for i in range(300)} - {("text 7", 1), ("text 8", 0)}
    every |= {("copy 0", 1), ("a text", 0), ("text 9", 0)}
    folds, none = 5, -1
    texts, y = learning.labelled_sample(docs, known, "y", folds, none, (1000, 1000))
    assert len(texts) == 301 and set(zip(texts, y.tolist(), strict=True)) == every
    texts, y = learning.labelled_sample(docs, known, "y", folds, none, (20, 10))
    assert len(set(texts)) == len(texts) == 30 and y.tolist().count(1) == 10
    # the same sample as without the repeated rows
    single = docs.groupBy("doc_id").agg({"text": "min"}).toDF("doc_id", "text")
    assert learning.labelled_sample(single, known, "y", folds, none, (20, 10))[0] == texts


def test_without_labels_and_without_rows(spark):
    docs = hard_rows(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    nulls = spark.createDataFrame([(None, 1, None), (5, None, None)], "doc_id bigint, quality int, toxic int")
    for some in (labels, nulls):
        assert {r.score for r in quality.score(docs, quality.learn(docs, some)).collect()} == {0.5}
        assert {r.score for r in toxicity.tag(docs, toxicity.learn(docs, some)).collect()} == {0.0}
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score(empty, quality.fit(*examples())).collect() == []
    assert toxicity.tag(empty, toxicity.learn(empty, labels)).collect() == []
