import math
import os
import zlib
from collections import Counter

import pytest
import regex

from shelltrail.llm import language
from shelltrail.llm.common import table

SCHEMA = "doc_id bigint, text string, lang string, source string, score double, h int"
EN = "the cat and the dog sat on the old mat with a hat"
DE = "der Hund und die Katze saßen auf der alten Matte mit dem Hut"
FR = "le chat et le chien étaient assis sur le vieux tapis"


def words(text):
    return regex.findall(r"\p{L}[\p{L}\p{M}]*", (text or "").lower())


def brute(learned, text):
    """Language and mean scores by the definition, with plain dictionaries."""
    counts = {}
    for lang, t in sorted(set(learned)):
        own = counts.setdefault(lang, [Counter() for _ in range(language.LONGEST + 1)])
        for w in words(t):
            own[0][w] += 1
            for size in range(1, language.LONGEST + 1):
                padded = f" {w} "
                for i in range(len(padded) - size + 1):
                    if padded[i : i + size] != " ":
                        own[size][padded[i : i + size]] += 1
    if not words(text) or not counts:
        return "und", 0.0

    def cost(lang, size, item):
        n, total = counts[lang][size][item], counts[lang][size].total()
        return -math.log10(n / total) if n else language.PENALTY

    means, n = dict.fromkeys(counts, 0.0), 0
    for w in words(text):
        items, size = [w], 0
        if not any(c[0][w] for c in counts.values()):
            for size in range(language.LONGEST, 0, -1):
                padded = f" {w} "
                items = [padded[i : i + size] for i in range(len(padded) - size + 1)]
                items = [x for x in items if any(c[size][x] for c in counts.values())]
                if items:
                    break
        if items:
            n += 1
            for lang in means:
                means[lang] += sum(cost(lang, size, x) for x in items) / len(items)
    means = {lang: m / max(1, n) for lang, m in means.items()}
    best = min(sorted(means), key=lambda lang: round(means[lang], 9))
    return best, 1 / sum(10 ** (means[best] - m) for m in means.values())


def learned(rows):
    return [
        (r[2], r[1])
        for r in rows
        if r[0] is not None and None not in r[1:3] and zlib.crc32(str(r[0]).encode()) % 4 != 2
    ]


ROWS = [(i, [EN, DE, FR][i % 3] + " " + "abcdefgh"[i % 8] * 3, ["en", "de", "fr"][i % 3], "s", 1.5, 1) for i in range(40)]
TEXTS = [
    None,
    "",
    " 12 -- ½ ² ٣ _",
    "the",
    "Katzen",
    "KATZE!!",
    "zzzzq",
    "日本語",
    "日本語 der",
    "é",
    "hound dogs chats vieille alte",
    EN + " " + "x" * 200 + " " + DE,
    "der " * 3 + "the " * 3,
    "ǅ İstanbul ﬁ",
    "x́y é",
]


def test_against_the_definition(spark):
    rows = ROWS + [(50, None, "en", "s", 0.0, 1), (None, DE, "en", "s", 0.0, 1), (52, DE, None, "s", 0.0, 1), ROWS[0]]
    model = language.learn(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == ["de", "en", "fr"]
    asked = [(i, t, "xx", "s", 0.0, 1) for i, t in enumerate(TEXTS)] + [(3, "the", "xx", "s", 0.0, 1), (None, DE, "xx", "s", 0.0, 1)]
    out = language.identify(spark.createDataFrame(asked, SCHEMA), model).collect()
    assert len(out) == len(asked) and out[0].asDict().keys() == {"doc_id", "lang_pred", "score"}
    for r in out:
        text = DE if r.doc_id is None else TEXTS[r.doc_id]
        lang, score = brute(learned(rows), text)
        assert (r.lang_pred, pytest.approx(r.score)) == (lang, score), text
    assert out[0].lang_pred == out[2].lang_pred == "und" and out[7].score == pytest.approx(1 / 3)


def test_nothing_learned_and_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = language.learn(empty)
    out = language.identify(spark.createDataFrame(ROWS[:2], SCHEMA), model).collect()
    assert [(r.lang_pred, r.score) for r in out] == [("und", 0.0)] * 2
    assert language.identify(empty, model).count() == 0


def test_slices_and_memory_do_not_change_results(spark, monkeypatch):
    model = language.learn(spark.createDataFrame(ROWS, SCHEMA))
    items = [" ".join(TEXTS[3:]) * 5, "a" * 300 + " " + FR, "é" * 3000]
    whole = [language.Lookup(model).predict(t) for t in items]
    monkeypatch.setattr(language, "SLICE", 7)
    monkeypatch.setattr(language, "KNOWN_NUMBERS", 16)
    monkeypatch.setattr(language, "MOST_GRAMS", 3)
    lookup = language.Lookup(model)
    for t, (lang, score) in zip(items, whole, strict=True):
        assert lookup.predict(t) == (lang, pytest.approx(score))


def test_a_very_long_text(spark):
    model = language.learn(spark.createDataFrame(ROWS, SCHEMA))
    text = (FR + "\n") * 30000 + "q" * 200000
    row = language.identify(spark.createDataFrame([(1, text, "", "s", 0.0, 1)], SCHEMA), model).first()
    assert row.lang_pred == "fr" and 0.5 < row.score <= 1


def test_sample_is_bounded_and_shared(spark):
    rows = [(i, f"word{i} {EN}", "en", "s", 0.0, 1) for i in range(300)] + ROWS * 5
    got = language.sample(spark.createDataFrame(rows, SCHEMA).select("lang", "text"), 30).collect()
    count = Counter(r.lang for r in got)
    assert count["en"] == 10 and count["de"] <= 10 and len({r.text for r in got}) == len(got)
    assert not language.sample(spark.createDataFrame(rows, SCHEMA).select("lang", "text"), 30, 5).collect()


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    if not os.path.exists(sf_dir):
        pytest.skip("no tables")
    told = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").select("doc_id", "lang").collect()}
    out = [r for r in language.query(spark, sf_dir).collect()]
    assert len(out) == len(told)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out)
    assert sum(r.lang_pred == told[r.doc_id] for r in held) / len(held) > 0.97
