"""Document quality by a linear-chain conditional random field over lines.

Every line is described by what its characters and words look like, together with the same
description of the lines before and behind it. The field has the states good and bad;
forward-backward gives each line the probability of being bad. A document's badness is the
mean of these, weighted by line length, and a one-dimensional logistic regression turns it
into the probability of label 1.

Labels are given for documents. The field is fitted twice: first every line has the label
of its document, then lines of bad documents that the first field holds for good count as
good.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from shelltrail.llm import crf
from shelltrail.llm.common import learned_fold, table, texts, utf8, with_column
from shelltrail.llm.learning import fit_sigmoid, labelled_sample

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5

# Classes of bytes.
UPPER, LOWER, DIGIT, MARK, SYMBOL, BLANK = range(6)
_kind = np.full(256, SYMBOL, np.uint8)
_kind[65:91] = UPPER
_kind[97:123] = _kind[128:] = LOWER
_kind[48:58] = DIGIT
_kind[[33, 39, 44, 45, 46, 58, 59, 63]] = MARK
_kind[[9, 10, 11, 12, 13, 32]] = BLANK
OWN = 14


def line_features(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of a batch, their weights, and the number of lines of each text.

    An empty text is one empty line. The weight of a line is its bytes plus one.
    """
    texts = [body[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    lines_of = [t.split(b"\n") for t in texts]
    counts = np.array([len(x) for x in lines_of], np.int64)
    lines = [x for found in lines_of for x in found]
    n = len(lines)
    size = np.array([len(x) for x in lines], np.int64)
    flat = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8) if n else np.empty(0, np.uint8)
    start = np.cumsum(size + 1) - (size + 1)
    kind = _kind[flat]

    def per_line(hit: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(hit)])
        return (total[start + size] - total[start]).astype(float)

    upper, lower, digit, mark, symbol, blank = (per_line(kind == k) for k in range(6))
    odd = (kind == MARK) | (kind == SYMBOL)
    before = np.concatenate([[BLANK], kind[:-1]])
    behind = np.concatenate([kind[1:], [BLANK]])
    run_end = odd & ((before == MARK) | (before == SYMBOL)) & (behind == BLANK)
    alone = odd & (before == BLANK) & (behind == BLANK)
    words = [x.split() for x in lines]
    n_words = np.array([len(w) for w in words], float)
    distinct = np.array([len(set(w)) for w in words], float)
    again = np.array([sum(map(bytes.__eq__, w, w[1:])) for w in words], float)
    width, ws = np.maximum(size, 1), np.maximum(n_words, 1)
    letters = np.maximum(upper + lower, 1)
    features = np.stack(
        [
            (size == 0).astype(float),
            np.log1p(size) / 5,
            upper / letters,
            digit / width,
            5 * mark / width,
            5 * symbol / width,
            blank / width,
            per_line(run_end) / ws,
            per_line(alone) / ws,
            1 - distinct / ws,
            again / ws,
            np.minimum(size / ws, 30) / 10,
            (n_words < 3).astype(float),
            (upper + lower) / width,
        ],
        axis=1,
    )
    return features, size + 1.0, counts


def with_neighbours(own: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with those of the lines around it in its text, and where texts begin."""
    n = len(own)
    first = np.zeros(n, bool)
    ends = np.cumsum(counts)
    first[ends - counts] = True
    last = np.zeros(n, bool)
    last[ends - 1] = True
    before = np.where(first[:, None], 0, np.roll(own, 1, axis=0))
    behind = np.where(last[:, None], 0, np.roll(own, -1, axis=0))
    edge = np.stack([first, last, np.ones(n)], axis=1).astype(float)
    return np.concatenate([own, before, behind, edge], axis=1), first


@dataclass
class Model:
    weights: np.ndarray | None = None
    trans: np.ndarray | None = None
    start: np.ndarray | None = None
    slope: float = 0.0
    offset: float = 0.0
    # without labels of both classes nothing is learned and every score is this
    constant: float | None = 0.5

    def lines(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probability of being bad and weight of every line, and lines of each text."""
        own, weight, counts = line_features(body, offsets)
        if not len(own):
            return np.empty(0), weight, counts
        x, first = with_neighbours(own, counts)
        return crf.Chains(x @ self.weights, first, self.trans, self.start).p, weight, counts

    def badness(self, p: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
        at = np.cumsum(counts) - counts
        return np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at) if len(counts) else p

    def score(self, badness: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * badness + self.offset, -30, 30)))


def fit(items: list[str], y: np.ndarray) -> Model:
    """A field fitted to texts with quality 0 or 1."""
    if len(set(y.tolist())) < 2:
        return Model(constant=float(y.mean()) if len(y) else 0.5)
    body, offsets = utf8(pa.array(items, pa.string()))
    own, weight, counts = line_features(body, offsets)
    x, first = with_neighbours(own, counts)
    bad = np.repeat(1 - y, counts)
    state = bad.copy()
    model = Model(constant=None)
    weights = np.zeros(x.shape[1])
    for _ in range(2):
        weights, model.trans, model.start = crf.fit(
            lambda w, part: x[part] @ w,
            lambda r, part: r @ x[part],
            weights, state, first, steps=120, rate=0.1, penalty=1e-3,
        )
        model.weights = weights
        p = crf.Chains(x @ weights, first, model.trans, model.start).p
        state = (bad & (p >= 0.5)).astype(np.int64)
    model.slope, model.offset = fit_sigmoid(model.badness(p, weight, counts), y)
    return model


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the learned fold of labelled documents."""
    return fit(*labelled_sample(texts(docs), labels, "quality", FOLDS, HELD_OUT))


def scores_of(model: Model, text: pa.Array) -> tuple[np.ndarray, list]:
    """Score of each text, and the numbers of its bad lines."""
    n = len(text)
    if model.constant is not None or n == 0:
        return np.full(n, model.constant or 0.0), [[] for _ in range(n)]
    p, weight, counts = model.lines(*utf8(text))
    bad = [np.flatnonzero(x >= 0.5) for x in np.split(p, np.cumsum(counts)[:-1])]
    return model.score(model.badness(p, weight, counts)), bad


def with_score(df: DataFrame, model: Model, name: str, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``df`` with the score of the text; see ``score``."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda text: pa.array(scores_of(sent.value, text)[0], pa.float64())

    return with_column(df, name, DoubleType(), text_col, make)


def score(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ``score`` and ``bad_lines`` (numbers from 0 of lines held for bad) of every text.

    A null or empty text is one empty line and is scored like any other. Rows are kept one
    by one; other columns are not carried. A model that learned nothing gives its constant. A very
    long text is read whole: its task holds the features of all its lines.
    """
    rows = texts(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            scores, bad = scores_of(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(scores, pa.float64()),
                    pa.array(bad, pa.list_(pa.int32())),
                ],
                names=["doc_id", "score", "bad_lines"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, score double, bad_lines array<int>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = learn(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (~learned_fold("doc_id", FOLDS, HELD_OUT)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("bad_lines").cast("bigint").alias("n_bad_lines"),
    )
