"""Toxic spans and toxicity scores by a linear-chain conditional random field.

Labels are given for documents, the field needs them for tokens. A word is called toxic if
it stands in so many contexts of documents labelled 1 and in so few of documents labelled 0
that chance does not explain it; its tokens in documents labelled 1 are the labelled toxic
tokens. The field learns weights of words and of neighbouring states from whole token
sequences. Scoring runs forward-backward over every token of every
text: the document's score is its largest token marginal, and runs of tokens with a
marginal of one half or more are its offending spans.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from shelltrail.llm import crf
from shelltrail.llm.common import learned_fold, table, texts, with_column
from shelltrail.llm.learning import labelled_sample, without_copies

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
# Share of contexts in documents labelled 0 that a toxic word may have.
MOST_CLEAN = 0.02
# Toxic words that chance may be expected to give.
CHANCE_WORDS = 0.5
# Bytes of words whose scores a worker remembers, about; it starts afresh when it knows more.
KNOWN_BYTES = 3 << 23
# Characters of the texts whose chains are worked on at a time.
PART_CHARS = 1 << 20

words_of = re.compile(r"[^\W\d_]+").findall
find_words = re.compile(r"[^\W\d_]+").finditer


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    # without labels of both classes nothing is learned and every score is this
    constant: float | None = 0.0

    def score(self, word: str) -> float:
        return self.bias + self.weights.get(word.lower(), 0.0)


def toxic_words(n: int, ids: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """True for the words (numbers below ``n``) that stand almost only in bad texts.

    Counted are not places but different contexts, a word with its two neighbours: copies
    and passages that many texts share count once, so the plain words of a passage that
    holds a toxic word are not taken for toxic.
    """
    v = n + 1
    around = np.concatenate([[n], ids, [n]])
    context = (around[:-2] * v + ids) * v + around[2:]
    in_bad, in_clean = np.unique(context[bad]), np.unique(context[~bad])
    only_bad = np.setdiff1d(in_bad, in_clean, assume_unique=True)
    clean = np.bincount(in_clean // v % v, minlength=n)
    pure = np.bincount(only_bad // v % v, minlength=n)
    total = clean + pure
    rate = len(in_bad) / (len(in_bad) + len(in_clean))
    sizes, words_of_size = np.unique(total, return_counts=True)
    # from frequent to rare: how many words of so many contexts are pure by chance
    expected = np.cumsum((words_of_size * rate**sizes)[::-1])[::-1]
    least = max(3.0, sizes[expected <= CHANCE_WORDS].astype(float).min(initial=np.inf))
    return (pure >= least) & (clean <= MOST_CLEAN * total)


def fit(items: list[str], y: np.ndarray) -> Model:
    """A field fitted to texts with labels 0 and 1."""
    if len(set(y.tolist())) < 2:
        return Model(constant=float(y.mean()) if len(y) else 0.0)
    # first the documents labelled 1, so that a clean near copy does not hide a toxic one
    order = np.argsort(-y, kind="stable")
    keep = order[without_copies([items[i] for i in order], words_of)]
    types: dict[str, int] = {}
    lines, kept = [], []
    for i in keep.tolist():
        found = [types.setdefault(w.lower(), len(types)) for w in words_of(items[i])]
        if found:
            lines.append(np.array(found, np.int64))
            kept.append(int(y[i]))
    if len(set(kept)) < 2:
        return Model(constant=float(y.mean()))
    ids = np.concatenate(lines)
    sizes = np.array([len(a) for a in lines])
    first = np.zeros(len(ids), bool)
    first[np.cumsum(sizes) - sizes] = True
    bad = np.repeat(np.array(kept), sizes) == 1
    n = len(types)
    state = (toxic_words(n, ids, bad)[ids] & bad).astype(np.int64)

    # the last weight is the bias
    def score_of(w: np.ndarray, part: slice) -> np.ndarray:
        return w[ids[part]] + w[n]

    def gradient_of(residual: np.ndarray, part: slice) -> np.ndarray:
        return np.append(np.bincount(ids[part], residual, n), residual.sum())

    guess = np.append(np.zeros(n), -2.0)
    w, trans, start = crf.fit(score_of, gradient_of, guess, state, first, steps=40, penalty=1e-4)
    weights = {word: float(w[i]) for word, i in types.items() if abs(w[i]) > 1e-3}
    return Model(weights, float(w[n]), trans, start, None)


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the learned fold of labelled documents."""
    return fit(*labelled_sample(texts(docs), labels, "toxic", FOLDS, HELD_OUT))


class Tagger:
    """Marginals of the words of many texts."""

    def __init__(self, model: Model):
        self.model, self.known, self.size = model, {}, 0

    def tag(self, items: list[str]) -> list[np.ndarray]:
        """Marginals of the words of each text, some texts at a time."""
        out, part, chars = [], [], 0
        for text in items:
            part.append(text)
            chars += len(text)
            if chars > PART_CHARS:
                out += self._tag(part)
                part, chars = [], 0
        return out + self._tag(part) if part else out

    def _tag(self, items: list[str]) -> list[np.ndarray]:
        words = [words_of(t) for t in items]
        known = self.known
        if self.size > KNOWN_BYTES:
            known.clear()
            self.size = 0
        for found in words:
            for w in set(found).difference(known):
                known[w] = self.model.score(w)
                self.size += 150 + 2 * len(w)
        sizes = np.array([len(w) for w in words], np.int64)
        score = np.fromiter((known[w] for found in words for w in found), np.float64, sizes.sum())
        first = np.zeros(len(score), bool)
        ends = np.cumsum(sizes)
        first[(ends - sizes)[sizes > 0]] = True
        p = crf.Chains(score, first, self.model.trans, self.model.start).p
        return np.split(p, ends[:-1])


def spans_of(text: str, p: np.ndarray) -> list[dict]:
    """Runs of offending words as characters from ``start`` to before ``end``."""
    spans, last = [], -2
    hot = set(np.flatnonzero(p >= 0.5).tolist())
    for k, m in enumerate(find_words(text)) if hot else ():
        if k in hot:
            if last == k - 1:
                spans[-1]["end"] = m.end()
                spans[-1]["p"] = max(spans[-1]["p"], float(p[k]))
            else:
                spans.append({"start": m.start(), "end": m.end(), "p": float(p[k])})
            last = k
    return spans


def scores_of(model: Model, tagger: Tagger, items: list[str]) -> tuple[list[float], list[np.ndarray]]:
    """Score of each text, and the marginals of its words."""
    if model.constant is not None:
        return [model.constant] * len(items), [np.empty(0)] * len(items)
    marginals = tagger.tag(items)
    return [float(p.max()) if len(p) else 0.0 for p in marginals], marginals


def with_score(df: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with the score of the text; see ``tag``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        model = sent.value
        tagger = Tagger(model)
        return lambda text: pa.array(scores_of(model, tagger, text.to_pylist())[0], pa.float64())

    return with_column(df, name, DoubleType(), text_col, make)


def tag(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ``score`` and ``spans`` (start, end, p by characters) of every whole text.

    A text without words (empty or null too) has no tokens and scores 0, or the constant of
    a model that learned nothing. Rows are kept one by one; other columns are not carried.
    """
    rows = texts(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        tagger = Tagger(model)
        for batch in batches:
            items = batch.column("text").to_pylist()
            scores, marginals = scores_of(model, tagger, items)
            spans = [spans_of(t, p) for t, p in zip(items, marginals, strict=True)]
            span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array(spans, pa.list_(span))],
                names=["doc_id", "score", "spans"],
            )

    schema = f"doc_id {kind}, score double, spans array<struct<start: int, end: int, p: double>>"
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return tag(docs, model).select(
        "doc_id",
        (~learned_fold("doc_id", FOLDS, HELD_OUT)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("spans").cast("bigint").alias("n_spans"),
    )
