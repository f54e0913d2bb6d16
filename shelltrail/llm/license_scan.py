"""Fuzzy search for short licence notices.

A notice with at most k edits, cut into k + 1 pieces, keeps one piece unchanged
(pigeonhole). Every piece is searched exactly in the whole text; only around a hit the
``regex`` library's bounded-error matching verifies the notice, with the edits it counts
and the span it finds. Next to it the base rule finds the places where the words of a
phrase stand one after another.

Both work on the word form of a text: A-Z lowered, words joined by one space.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrail.llm.common import table, texts, utf8

# Phrases whose words must stand consecutively, and their labels.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Short notices that are searched with errors: text in word form, label, edits allowed.
NOTICES = (
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person", "mit", 4),
    ("licensed under the apache license version 2 0", "apache", 4),
    ("licensed under the gnu general public license", "gpl", 4),
    ("gnu lesser general public license", "lgpl", 3),
    ("gnu affero general public license", "agpl", 3),
    ("licensed under cc by nc 4 0", "cc-by-nc", 1),
    ("licensed under cc by sa 4 0", "cc-by-sa", 1),
    ("licensed under cc by 4 0", "cc-by", 1),
    ("mozilla public license version 2 0", "mpl", 4),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("licensed under the bsd license", "bsd", 2),
    ("all rights reserved", "proprietary", 2),
    ("this is free and unencumbered software released into the public domain", "unlicense", 4),
)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_word = np.zeros(256, bool)
_word[48:58] = _word[65:91] = _word[97:123] = _word[128:] = True
# Word bytes lowered, every other byte a space.
WORD_FORM = np.where(_word, _lower, 32).astype(np.uint8)


def pieces(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """The notice in edits + 1 pieces of nearly equal length, each with its place."""
    body = notice.encode()
    cuts = [len(body) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, body[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def places(buffer: bytes, needle: bytes) -> list[int]:
    """All places of a byte string, overlapping ones too."""
    found, at = [], buffer.find(needle)
    while at >= 0:
        found.append(at)
        at = buffer.find(needle, at + 1)
    return found


class WordForm:
    """Word form of the texts of a batch: `` w w w `` for each, ended by a newline."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        # each text gets a space before and a space and a newline behind it
        grown = np.full(len(body) + 3 * n, 32, np.uint8)
        sizes = np.diff(offsets)
        grown[np.arange(len(body)) + np.repeat(3 * np.arange(n) + 1, sizes)] = WORD_FORM[body]
        ends = offsets[1:] + 3 * np.arange(n) + 2
        grown[ends] = 10
        gap = grown == 32
        keep = np.ones(len(grown), bool)
        keep[1:] = ~(gap[1:] & gap[:-1])
        form = grown[keep]
        self.bytes = form.tobytes()
        self.ends = np.flatnonzero(form == 10)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]).astype(np.int64)
        # a word begins behind a space that another word byte follows
        self.words = np.flatnonzero((form[:-1] == 32) & (form[1:] > 32)) + 1
        self.before = np.searchsorted(self.words, self.starts)
        self.n_words = np.searchsorted(self.words, self.ends) - self.before

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at)

    def word_of(self, at: int, text: int) -> int:
        """Number of the word of a text that holds a byte, or of the one before a space."""
        return max(0, int(np.searchsorted(self.words, at, "right") - 1 - self.before[text]))


def base_places(form: WordForm) -> list[tuple[int, int, str]]:
    """(text, first word, label) of every place of a base phrase."""
    found = []
    for phrase, label in BASE_PHRASES:
        at = np.array(places(form.bytes, f" {phrase} ".encode()), np.int64)
        for text, p in zip(form.text_of(at).tolist(), at.tolist(), strict=True):
            found.append((text, form.word_of(p + 1, text), label))
    return found


def verifier(notice: str, edits: int) -> regex.Pattern:
    return regex.compile(b"(?b)(?:%s){e<=%d}" % (notice.encode(), edits))


def fuzzy_places(form: WordForm, notices=NOTICES) -> list[tuple[int, int, int, str, int, int]]:
    """(text, first word, last word, label, edits, notice length) of every verified notice.

    Of the matches of one notice that overlap, only the one with the fewest edits counts.
    """
    found = []
    for notice, label, edits in notices:
        size, check = len(notice), verifier(notice, edits)
        hits = [(at, at - p) for p, piece in pieces(notice, edits) for at in places(form.bytes, piece)]
        if not hits:
            continue
        at, start = np.array(hits, np.int64).T
        text = form.text_of(at)
        order = np.lexsort((start, text))
        text, start = text[order], start[order]
        # possible starts that lie close together in a text are searched in one window
        cut = np.flatnonzero((np.diff(text) > 0) | (np.diff(start) > 2 * edits)) + 1
        spans: dict[int, set[tuple[int, int, int]]] = {}
        for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(text)], strict=True):
            t = int(text[i])
            a = max(int(start[i]) - edits, int(form.starts[t]))
            b = min(int(start[j - 1]) + size + 2 * edits, int(form.ends[t]))
            for m in check.finditer(form.bytes, a, b):
                spans.setdefault(t, set()).add((sum(m.fuzzy_counts), m.start(), m.end()))
        for t, matches in spans.items():
            taken: list[tuple[int, int]] = []
            for errors, a, b in sorted(matches):
                i = bisect_right(taken, (a, b))
                if (i and taken[i - 1][1] > a) or (i < len(taken) and taken[i][0] < b):
                    continue
                taken.insert(i, (a, b))
                found.append((t, form.word_of(a, t), form.word_of(b - 1, t), label, errors, size))
    return found


SCHEMA = (
    "doc_id {id}, n_words bigint, n_base bigint, first_word bigint, last_word bigint,"
    " base_labels string, labels string, score double,"
    " spans array<struct<first: bigint, last: bigint, label: string, edits: int>>"
)


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES
) -> DataFrame:
    """Licence labels of every whole text.

    ``n_base``, ``first_word`` and ``last_word`` tell of base places only (null if there is
    none); ``labels`` joins their labels and those of verified notices; ``spans`` has one
    entry for each verified notice, by words from 0. ``score`` is 1 where a base phrase
    stands, else 1 less the share of edits of the best notice, else 0. Null and empty texts
    have no words, empty label strings and score 0. Rows are kept one by one, repeated ones
    too; other columns are not carried. A very long text is read whole, in the memory of its task.
    """
    rows = texts(df, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            form = WordForm(*utf8(batch.column("text")))
            base: list[list[tuple[int, str]]] = [[] for _ in range(n)]
            fuzzy: list[list[tuple]] = [[] for _ in range(n)]
            for text, word, label in base_places(form):
                base[text].append((word, label))
            for text, *span in fuzzy_places(form, notices):
                fuzzy[text].append(tuple(span))
            firsts = [min(b)[0] if b else None for b in base]
            lasts = [max(b)[0] if b else None for b in base]
            own = [{label for _, label in b} for b in base]
            more = [{s[2] for s in f} for f in fuzzy]
            scores = [
                1.0 if b else max((1 - s[3] / s[4] for s in f), default=0.0)
                for b, f in zip(base, fuzzy, strict=True)
            ]
            spans = [
                [dict(zip(("first", "last", "label", "edits"), s, strict=False)) for s in sorted(f)]
                for f in fuzzy
            ]
            span = pa.struct(
                [("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("edits", pa.int32())]
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(form.n_words, pa.int64()),
                    pa.array([len(b) for b in base], pa.int64()),
                    pa.array(firsts, pa.int64()),
                    pa.array(lasts, pa.int64()),
                    pa.array([",".join(sorted(x)) for x in own], pa.string()),
                    pa.array([",".join(sorted(x | y)) for x, y in zip(own, more, strict=True)], pa.string()),
                    pa.array(scores, pa.float64()),
                    pa.array(spans, pa.list_(span)),
                ],
                names=[
                    "doc_id", "n_words", "n_base", "first_word", "last_word",
                    "base_labels", "labels", "score", "spans",
                ],
            )

    return rows.mapInArrow(run, SCHEMA.format(id=kind))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans").cast("bigint")).drop("spans")
