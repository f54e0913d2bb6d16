"""Bounded samples of labelled documents, for the operators that learn from labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelltrail.llm.common import learned_fold

# Documents with label 0 and with label 1 that a model is fitted on, at most, and the
# longest of them in characters.
SAMPLE = (1600, 1200)
SAMPLE_CHARS = 20000


def labelled_sample(
    rows: DataFrame, labels: DataFrame, label: str, folds: int, held_out: int,
    sizes: tuple[int, int] = SAMPLE, most_chars: int = SAMPLE_CHARS,
) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most ``sizes`` documents of the classes 0 and 1.

    Only documents of the learned fold and of at most ``most_chars`` characters; of these
    the ones with the smallest hashes of their id. A document with two labels counts with
    both, an id in several rows or labels of one class counts once, with the smallest of its
    texts. ``rows`` has doc_id and text.
    """
    wanted = labels.select("doc_id", F.col(label).alias("label")).where(F.col("label").isin(0, 1))
    wanted = wanted.where(learned_fold("doc_id", folds, held_out)).distinct()
    short = rows.where(F.length("text") <= most_chars)
    known = short.select("doc_id").distinct().join(wanted, "doc_id")
    ids = [
        row
        for value in (0, 1)
        for row in known.where(F.col("label") == value)
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sizes[value])
        .collect()
    ]
    if not ids:
        return [], np.empty(0, np.int64)
    kind = dict(rows.dtypes)["doc_id"]
    chosen = rows.sparkSession.createDataFrame(ids, f"doc_id {kind}, label int")
    # one row for each of the chosen ids and labels, whose number is bounded
    own = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    got = sorted((r.text, r.label) for r in own.agg(F.min("text").alias("text")).collect())
    return [t for t, _ in got], np.array([y for _, y in got], np.int64)


def without_copies(texts: list[str], words_of) -> list[int]:
    """Numbers of the texts that are no near copies of texts before them.

    A text is left out if over half of its five-word shingles stood in kept texts; of long
    texts an eighth of the shingles, chosen by their hash, is looked at.
    """
    seen: set[int] = set()
    kept = []
    for i, text in enumerate(texts):
        words = words_of(text)
        size = min(5, max(1, len(words)))
        grams = {hash(g) for g in zip(*(words[k:] for k in range(size)), strict=False)}
        if len(grams) > 200:
            grams = {g for g in grams if g % 8 == 0}
        if grams and len(grams & seen) > len(grams) / 2:
            continue
        seen |= grams
        kept.append(i)
    return kept


def fit_sigmoid(x: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and offset of a one-dimensional logistic regression, by damped Newton steps.

    A small penalty keeps them finite where the classes are apart; classes weigh the same.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    slope = offset = 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        r, v = weight * (y - p), weight * p * (1 - p)
        grad = np.array([(r * x).sum() - 1e-4 * slope, r.sum() - 1e-6 * offset])
        hess = np.array([[(v * x * x).sum() + 1e-4, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        move = np.linalg.solve(hess + 1e-4 * np.eye(2), grad)
        move *= min(1.0, 2.0 / max(1e-12, float(np.abs(move).max())))
        slope, offset = slope + move[0], offset + move[1]
    return float(slope), float(offset)
