import random

import numpy as np
import pytest

from shelltrail.llm import decontaminate as dc
from shelltrail.llm.common import table

SCHEMA = "doc_id bigint, text string, item_id bigint, score string"
ITEMS = "item_id bigint, text string, doc_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)


def items(spark, rows):
    return spark.createDataFrame([(i, t, 5) for i, t in rows], ITEMS)


def smith_waterman(item, text):
    """Best score by the plain recursion."""
    before, best = [0] * (len(text) + 1), 0
    for a in item:
        row = [0]
        for j, b in enumerate(text, 1):
            s = dc.MATCH if a == b else dc.MISMATCH
            row.append(max(0, before[j - 1] + s, before[j] + dc.GAP, row[-1] + dc.GAP))
        before, best = row, max(best, *row)
    return best


def test_alignment_against_the_recursion():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, text = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 30))
        score, end = dc.align(item, text)
        assert score == smith_waterman(item.tolist(), text.tolist())
        if score:
            _, back = dc.align(item[::-1], text[: end + 1][::-1])
            assert smith_waterman(item.tolist(), text[end - back : end + 1].tolist()) == score


def edited(words, rng, rate):
    out = []
    for w in words:
        r = rng.random()
        if r < rate / 3:
            continue
        out.append(f"q{rng.randrange(99)}" if r < 2 * rate / 3 else w)
        if 2 * rate / 3 < r < rate:
            out.append("extra")
    return out


@pytest.mark.parametrize("part_chars", [dc.PART_CHARS, 700])
def test_against_all_alignments(spark, part_chars):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)] + ["the"] * 80
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    tests = {i: make(rng.randrange(12, 50)) for i in range(20)}
    docs = {}
    for d in range(250):
        words = make(rng.randrange(1, 300))
        for _ in range(rng.choice([0, 0, 1, 2])):
            at = rng.randrange(len(words) + 1)
            words[at:at] = edited(tests[rng.randrange(20)], rng, rng.choice([0, 0, 0.1, 0.25]))
        docs[d] = words
    rows = [(d, " ".join(w).upper() if d % 9 == 0 else ", ".join(w)) for d, w in docs.items()]
    want = {}
    for d, words in docs.items():
        for i, item in tests.items():
            share = smith_waterman(item, words) / (dc.MATCH * len(item))
            if share >= dc.THRESHOLD:
                want[d, i] = round(share, 9)
    bench = items(spark, [(i, " ".join(w)) for i, w in tests.items()])
    out = dc.find_leaks(frame(spark, rows).repartition(4), bench, part_chars=part_chars).collect()
    got = {(r.doc_id, r.item_id): round(r.score, 9) for r in out}
    assert len(got) == len(out) and all(score <= want[pair] for pair, score in got.items())
    # lightly edited copies without loss, heavily edited ones nearly so
    assert all(got.get(pair) == score for pair, score in want.items() if score >= 0.7)
    assert len(got) >= 0.97 * len(want) > 150
    for r in out:
        part = docs[r.doc_id][r.first_word : r.last_word + 1]
        assert smith_waterman(tests[r.item_id], part) == round(r.score * dc.MATCH * len(tests[r.item_id]))


@pytest.mark.parametrize("foreign", [15, 30, 38])
def test_a_copy_with_one_long_insertion(spark, foreign):
    item = [f"w{i}" for i in range(40)]
    copy = ["x" if i in (5, 34) else w for i, w in enumerate(item)]
    text = [f"a{i}" for i in range(60)] + copy[:20] + [f"f{i}" for i in range(foreign)] + copy[20:] + ["b"] * 60
    want = smith_waterman(item, text) / (dc.MATCH * len(item))
    bench, docs = items(spark, [(1, " ".join(item))]), frame(spark, [(1, " ".join(text)), (2, "b " * 60)])
    out = dc.find_leaks(docs, bench).collect()
    left = sorted(r.doc_id for r in dc.without_leaks(docs, bench).collect())
    if want >= dc.THRESHOLD:
        assert [(r.doc_id, r.score, r.first_word, r.last_word) for r in out] == [(1, want, 60, 99 + foreign)]
        assert left == [2]
    else:
        assert out == [] and left == [1, 2]


def test_passages_of_a_long_item(spark):
    item = [f"w{i}" for i in range(300)]
    rows = [(1, ["a"] * 40 + item[100:200] + ["b"] * 40), (2, item[:140]), (3, item[50:100]), (4, item[50:99])]
    # a passage that stands in so many documents that its n-grams are the commonest of the item
    rows += [(10 + i, [f"c{i}"] + item[230:290]) for i in range(50)]
    want = {}
    for d, words in rows:
        score = smith_waterman(item, words)
        if score >= dc.MATCH * dc.PASSAGE_WORDS:
            want[d] = score / (dc.MATCH * len(item))
    docs, bench = frame(spark, [(d, " ".join(w)) for d, w in rows]), items(spark, [(1, " ".join(item))])
    assert {r.doc_id: r.score for r in dc.find_leaks(docs, bench).collect()} == want
    assert set(want) == {d for d, _ in rows} - {4}
    assert [r.doc_id for r in dc.without_leaks(docs, bench).collect()] == [4]


def test_ids_of_any_type_and_short_items(spark):
    item = " ".join(f"w{i}" for i in range(12))
    bench = [("mmlu-12", item), ("q 7", "Who wrote the old book?"), ("3", "one two three"), ("2", "only two")]
    bench = spark.createDataFrame([*bench, (None, "none " * 4 + item[::-1])], "item_id string, text string")
    rows = [(1, f"a {item} b"), (2, "so who wrote the old book then"), (3, "who wrote the very old book")]
    rows += [(4, "two three one two three"), (5, "one two, only two"), (6, "none " * 4 + item[::-1])]
    docs = frame(spark, rows)
    out = dc.find_leaks(docs, bench)
    assert dict(out.dtypes)["item_id"] == "string"
    got = {(r.doc_id, r.item_id, r.score) for r in out.collect()}
    assert got == {(1, "mmlu-12", 1.0), (2, "q 7", 1.0), (4, "3", 1.0), (5, "2", 1.0)}
    assert sorted(r.doc_id for r in dc.without_leaks(docs, bench).collect()) == [3]


@pytest.mark.parametrize("part_chars", [10, dc.PART_CHARS])
def test_items_of_one_and_two_words(spark, part_chars):
    bench = items(spark, [(1, "Solo"), (2, "alpha beta"), (3, "beta alpha beta"), (4, "?"), (5, "w " * 9)])
    texts = ["x alpha beta solo SOLO", "beta alpha", "alpha-beta alpha beta", "so lo", "beta alpha beta"]
    docs = frame(spark, list(enumerate(texts)))
    out = dc.find_leaks(docs, bench, part_chars=part_chars).collect()
    got = {(r.doc_id, r.item_id, r.score, r.first_word, r.last_word) for r in out}
    assert got == {(0, 1, 1.0, 3, 3), (0, 2, 1.0, 1, 2), (2, 2, 1.0, 0, 1), (2, 3, 1.0, 1, 3), (4, 2, 1.0, 1, 2), (4, 3, 1.0, 0, 2)}
    left = dc.without_leaks(docs, bench, part_chars=part_chars).collect()
    assert sorted(r.doc_id for r in left) == [1, 3]


def test_passage_length_is_an_argument(spark):
    item = [f"w{i}" for i in range(300)]
    docs = frame(spark, [(1, " ".join(item[50:80])), (2, " ".join(item[50:70]))])
    bench = items(spark, [(1, " ".join(item))])
    assert [r.doc_id for r in dc.find_leaks(docs, bench, passage=30).collect()] == [1]
    assert dc.find_leaks(docs, bench).collect() == []


def test_a_megabyte_in_one_text(spark):
    item = " ".join(f"w{i}" for i in range(30))
    rows = [(1, "foreign words " * 60000 + item + " tail" * 60000), (2, "foreign words " * 60000)]
    out = dc.find_leaks(frame(spark, rows), items(spark, [(1, item)])).collect()
    assert [(r.doc_id, r.score, r.first_word) for r in out] == [(1, 1.0, 120000)]


def test_an_item_in_most_documents_is_found(spark):
    passage = " ".join(f"common{i}" for i in range(20))
    rows = [(i, f"own{i} {passage} tail{i}") for i in range(300)] + [(1000 + i, f"other{i} text") for i in range(50)]
    out = dc.find_leaks(frame(spark, rows), items(spark, [(1, passage)])).collect()
    assert sorted(r.doc_id for r in out) == list(range(300)) and {r.score for r in out} == {1.0}
    assert {(r.first_word, r.last_word) for r in out} == {(1, 20)}


def test_hard_rows(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, item), (1, None), (2, ""), (3, item), (3, item), (4, "the " * 40000 + item), (5, "é È ß " * 20)]
    bench = [(7, item), (7, item), (8, None), (None, item), (9, "too short"), (10, ""), (11, "the " * 20)]
    out = dc.find_leaks(frame(spark, rows), items(spark, bench)).collect()
    got = sorted((str(r.doc_id), r.item_id, r.score) for r in out)
    assert got == [("3", 7, 1.0), ("3", 7, 1.0), ("4", 7, 1.0), ("4", 11, 1.0), ("None", 7, 1.0)]
    assert dc.find_leaks(frame(spark, []), items(spark, bench)).collect() == []
    assert dc.find_leaks(frame(spark, rows), items(spark, [])).collect() == []


def test_query_finds_the_passages_of_a_table(spark):
    sf = "/root/testdata/sf0.01"
    tests = [(r.item_id, dc.words_of(r.text)) for r in table(spark, sf, "benchmark").collect()]
    want = set()
    for r in table(spark, sf, "documents").collect():
        body = b" " + b" ".join(dc.words_of(r.text)) + b" "
        want |= {(r.doc_id, i) for i, w in tests if b" " + b" ".join(w) + b" " in body}
    out = {(r.doc_id, r.item_id) for r in dc.query(spark, sf).collect()}
    assert want <= out and len(want) > 3 and len(out - want) <= 2
