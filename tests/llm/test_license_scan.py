import re

from shelltrail.llm import license_scan

SCHEMA = "doc_id bigint, text string, labels string, n_words int"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    words = WORD.findall((text or "").translate(LOWER))
    found = []
    for phrase, label in license_scan.BASE_PHRASES:
        want = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    return len(words), found


TEXTS = [
    None,
    "",
    "...",
    "MIT License",
    "the mit-license and MIT  LICENSE\n\nmit license",
    "commit license; mit licenses; émit license",
    "Licensed under the Apache License, Version 2.0. GNU General Public License",
    "Licensed under the Apche Licence, Versio 2.0.",
    "x " * 30000 + "Relased under the MIT Licence " + "y " * 30000,
    "Released under the MIT",
    "İ K MIT License ünder",
    "apache\x00license general public license general public license",
    "All rights reservd. All rights reserved",
    "Licensed under CC BY-NC 4.0.",
]


def test_base_rule_against_the_definition(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(3, "MIT License", "x", 1)]
    out = license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for r in out:
        n, found = base(TEXTS[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(found)), TEXTS[r.doc_id][:60]
        starts = [i for i, _ in found]
        assert r.first_word == min(starts, default=None) and r.last_word == max(starts, default=None)
        assert r.base_labels == ",".join(sorted({label for _, label in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_edited_notices_are_found_with_their_spans(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)]
    out = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out[7].labels == "apache" and out[7].base_labels == "" and 0.9 < out[7].score < 1
    span = out[8].spans[0]
    assert (span.label, span.edits, span.first, span.last) == ("mit", 2, 30000, 30004)
    assert [s.edits for s in out[12].spans] == [1, 0]
    assert out[13].labels == "cc-by-nc"
    assert out[9].labels == "" and out[0].labels == ""


def edits_in(notice, text):
    """Fewest edits of the notice against any part of a text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(notice, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_seeds_lose_no_notice(spark):
    import random

    rng = random.Random(5)
    rows, want = [], []
    for i in range(300):
        notice, label, edits = rng.choice(license_scan.NOTICES)
        text = list(notice)
        for _ in range(rng.randrange(edits + 3)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choice(["", "q", "x", " "])
        text = "some words " + "".join(text) + " and more"
        rows.append((i, text, "x", 1))
        form = " " + " ".join(WORD.findall(text)) + " "
        want.append({lab for n, lab, e in license_scan.NOTICES if edits_in(n, form) <= e})
    out = license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    for r in out:
        fuzzy = {s.label for s in r.spans}
        assert fuzzy == want[r.doc_id], rows[r.doc_id]


def test_empty_table(spark):
    assert license_scan.scan(spark.createDataFrame([], SCHEMA)).collect() == []
