"""Language of texts: words first, and ever shorter character n-grams for words never seen.

A word that the learned texts hold in any language is scored in each language by the negative
decimal logarithm of its share of that language's words. Any other word is put between blanks and
scored by its n-grams of six characters, the mean over those that some language holds; if no
language holds one of them, by five characters, and so on down to one. A language that lacks what
is scored gets ``PENALTY``, more than any share can give. A text gets the language with the smallest
mean over its words; words without any known n-gram do not count.

Counts come from a bounded sample of the learned texts (``SAMPLE`` texts, shared evenly by the
languages), so the model that travels to the tasks is bounded too, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrail.llm.common import learned_fold, table, texts

FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
# Different texts that are learned from, in all, and the longest of them in characters. Each
# language has an equal share of them; of more languages than that the most frequent are learned.
SAMPLE = 2000
SAMPLE_CHARS = 8000
LONGEST = 6
PENALTY = 7.0
# Long texts are read in slices of so many characters, cut between words.
SLICE = 1 << 20
# A worker remembers the scores of stretches of letters: so many numbers and characters, about.
KNOWN_NUMBERS = 1 << 22
KNOWN_CHARS = 1 << 23
# N-grams of a long word that are looked up at a time.
MOST_GRAMS = 1 << 16

_word = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_between = regex.compile(r"[^\p{L}\p{M}]")
# ASCII that is no letter, as blanks
_letters = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))


def stretches_of(text: str) -> Iterator[list[str]]:
    """What ASCII characters that are no letters part, in lower case, in slices of the text.

    Most stretches are one word; those beyond ASCII may hold none or several.
    """
    at = 0
    while at < len(text):
        cut = None if at + SLICE >= len(text) else _between.search(text, at + SLICE)
        end = cut.start() if cut else len(text)
        yield text[at:end].lower().encode().translate(_letters).decode().split()
        at = end


def words_in(stretch: str) -> list[str]:
    """Words: letters with their marks."""
    return [stretch] if stretch.isascii() else _word.findall(stretch)


@dataclass
class Model:
    """Scores by language of words and n-grams: of item k the entries from at[k] to at[k + 1]."""

    languages: list[str]
    words: list[str]
    grams: list[str]
    at: np.ndarray
    language: np.ndarray
    score: np.ndarray
    lookup: Lookup | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"lookup": None}

    def scorer(self) -> Lookup:
        """One for each worker that has the model."""
        if self.lookup is None:
            self.lookup = Lookup(self)
        return self.lookup


class Lookup:
    """Scores of words, remembered within bounds."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.languages)
        self.words = {w: k for k, w in enumerate(model.words)}
        self.grams = {g: k for k, g in enumerate(model.grams, len(model.words))}
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.chars = 0
        # of each stretch the sums over its words that count, their number, and that of all its words
        self.table = np.zeros((1024, self.width + 2))

    def _sums(self, items: list[int], owner: list[int], share: list[float], owners: int) -> np.ndarray:
        """Of each owner the sum over its items, in their shares, in all languages."""
        m = self.model
        items, owner, share = np.array(items, np.int64), np.array(owner, np.int64), np.array(share)
        n = m.at[items + 1] - m.at[items]
        at = np.repeat(m.at[items] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        key = np.repeat(owner, n) * self.width + m.language[at]
        low = np.bincount(key, np.repeat(share, n) * (m.score[at] - PENALTY), owners * self.width)
        return low.reshape(owners, self.width) + PENALTY * np.bincount(owner, share, owners)[:, None]

    def _grams_of(self, text: str, size: int, first: int, last: int) -> list[int]:
        parts = (text[i : i + size] for i in range(first, last))
        return [k for k in map(self.grams.get, parts) if k is not None]

    def _of_long_word(self, word: str) -> np.ndarray | None:
        """Scores of a word that is no known one, its n-grams looked up in pieces; None if none is known."""
        text = f" {word} "
        for size in range(LONGEST, 0, -1):
            total, n, places = np.zeros(self.width), 0, len(text) - size + 1
            for lo in range(0, places, MOST_GRAMS):
                items = self._grams_of(text, size, lo, min(places, lo + MOST_GRAMS))
                total += self._sums(items, [0] * len(items), [1.0] * len(items), 1)[0]
                n += len(items)
            if n:
                return total / n
        return None

    def _learn(self, stretches: list[str]) -> None:
        """Remember new stretches; their words are scored together."""
        first = len(self.known)
        while first + len(stretches) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        rows = self.table[first : first + len(stretches)]
        items, owner, share = [], [], []
        for j, stretch in enumerate(stretches):
            self.known[stretch] = first + j
            self.chars += len(stretch)
            for word in words_in(stretch):
                rows[j, -1] += 1
                k = self.words.get(word)
                if k is not None:
                    found = [k]
                elif len(word) > MOST_GRAMS:
                    found, scores = [], self._of_long_word(word)
                    if scores is not None:
                        rows[j, :-2] += scores
                        rows[j, -2] += 1
                else:
                    text = f" {word} "
                    for size in range(LONGEST, 0, -1):
                        found = self._grams_of(text, size, 0, len(text) - size + 1)
                        if found:
                            break
                if found:
                    rows[j, -2] += 1
                    items += found
                    owner += [j] * len(found)
                    share += [1 / len(found)] * len(found)
        rows[:, :-2] += self._sums(items, owner, share, len(stretches))

    def rows_of(self, stretches: list[str]) -> np.ndarray:
        """Row of the table for each stretch."""
        new = set(stretches).difference(self.known)
        if new:
            self._learn(list(new))
        return np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))

    def of_text(self, text: str) -> np.ndarray:
        """Sums over the words that count, their number, and that of all words."""
        total = np.zeros(self.width + 2)
        step = max(1, KNOWN_NUMBERS // (4 * len(total)))
        for stretches in stretches_of(text):
            for lo in range(0, len(stretches), step):
                if len(self.known) * len(total) > KNOWN_NUMBERS or self.chars > KNOWN_CHARS:
                    self._forget()
                rows = self.rows_of(stretches[lo : lo + step])
                total += self.table[rows].sum(axis=0)
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and confidence: how its share of 10 ** -mean stands among all languages."""
        *total, n, words = self.of_text(text or "")
        if not words or not self.width:
            return UNKNOWN, 0.0
        mean = np.array(total) / max(1, n)
        best = int(np.argmin(mean))
        return self.model.languages[best], float(1 / np.sum(10 ** (mean[best] - mean)))


def sample(rows: DataFrame, size: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> DataFrame:
    """(lang, text): at most ``size`` different texts, those with the smallest hashes of each language."""
    spark = rows.sparkSession
    own = rows.where(F.length("text") <= most_chars).select("lang", "text", F.xxhash64("text").alias("h"))
    keys = own.select("lang", "h").distinct()
    counts = keys.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(size).collect()
    share = max(1, size // max(1, len(counts)))
    # hashes below this bound are some three times as many as are wanted
    tops = [
        (r["lang"], min(2**63 - 1, -(2**63) + 2**64 * (3 * share + 30) // r["count"])) for r in counts
    ]
    top = F.broadcast(spark.createDataFrame(tops, "lang string, top bigint"))
    few = keys.join(top, "lang").where(F.col("h") <= F.col("top")).select("lang", "h")
    chosen = few.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h")))
    chosen = chosen.where(F.col("n") <= share).select("lang", "h")
    # at most ``size`` keys; equal texts come together again
    return own.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))


def count_items(learned: DataFrame) -> DataFrame:
    """(lang, size, item, n): words have size 0, n-grams their length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, items = [], []
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for stretches in stretches_of(text):
                    words = list(chain.from_iterable(map(words_in, stretches)))
                    langs += [lang] * len(words)
                    items += words
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(items, pa.string())], ["lang", "item"])

    words = learned.select("lang", "text").mapInArrow(run, "lang string, item string")
    words = words.groupBy("lang", "item").agg(F.count("*").alias("n"))
    padded = words.select("lang", F.concat(F.lit(" "), "item", F.lit(" ")).alias("w"), "n")
    longest = F.least(F.lit(LONGEST), F.length("w"))
    sized = padded.select("lang", "w", "n", F.explode(F.sequence(F.lit(1), longest)).alias("size"))
    places = F.sequence(F.lit(1), F.length("w") - F.col("size") + 1)
    grams = sized.select(
        "lang", "size", "n", F.explode(F.transform(places, lambda i: F.substr("w", i, F.col("size")))).alias("item")
    )
    grams = grams.where(F.col("item") != " ").groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    return words.select("lang", F.lit(0).alias("size"), "item", "n").union(grams.select("lang", "size", "item", "n"))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the texts of the learned fold whose language is told."""
    rows = docs.where(learned_fold(id_col, FOLDS, HELD_OUT)).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # what the sample holds: bounded by SAMPLE x SAMPLE_CHARS
    got = count_items(sample(rows)).orderBy("size", "item", "lang").toArrow().to_pydict()
    languages = sorted(set(got["lang"]))
    number = {lang: k for k, lang in enumerate(languages)}
    size, n = np.array(got["size"], np.int64), np.array(got["n"], float)
    language = np.array([number[x] for x in got["lang"]], np.int32)
    totals = np.zeros((LONGEST + 1, max(1, len(languages))))
    np.add.at(totals, (size, language), n)
    items = list(zip(got["size"], got["item"], strict=True))
    first = [k for k in range(len(items)) if k == 0 or items[k] != items[k - 1]]
    return Model(
        languages,
        [items[k][1] for k in first if items[k][0] == 0],
        [items[k][1] for k in first if items[k][0] > 0],
        np.array([*first, len(items)], np.int64),
        language,
        -np.log10(n / totals[size, language]),
    )


def identify(
    df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, ``lang_pred`` and ``score`` (0 to 1) of every text, read as a whole.

    A null text, an empty one and one without letters are ``und`` with score 0, and so is every text
    if nothing was learned. A text with letters of which nothing is known gets the first language
    in the alphabet, with an equal share as its score; so do ties. Rows are kept one by one, also
    equal ones and those with null ids; other columns are not carried. Long texts are read in
    slices.
    """
    rows = texts(df, id_col, text_col)
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = sent.value.scorer()
        for batch in batches:
            found = [lookup.predict(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([f[0] for f in found], pa.string()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                names=["doc_id", "lang_pred", "score"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a null id has no remainder: not learned from
    held_out = ~F.coalesce(learned_fold("doc_id", FOLDS, HELD_OUT), F.lit(False))
    return identify(docs, learn(docs)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
