"""Leaks of benchmark items into documents, also edited and paraphrased ones.

Word n-grams of the test items are looked up in all documents and their document
frequencies are counted. The rarest n-grams of each item are its seeds. Where a seed stands
in a document, the words around it are aligned with the whole item by Smith-Waterman on
words; the best score tells a leak: as a share of a perfect copy's, or for passages of long
items by itself. Seeds that gaps of one leak can set apart share a window, so that a copy cut
by foreign words is aligned as one.

Seeds are the rarest part of an item's own n-grams, not those below a fixed frequency: an
item that leaked into a third of all documents has no rare n-grams, and is still found.
A copy so edited that none of its seeds is left whole is not found.

The test items travel to the documents, in parts of bounded size; each part is a pass over
the documents, which never move.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import LongType

from shelltrail.llm.common import staged, table, texts, with_column
from shelltrail.llm.license_scan import WORD_FORM
from shelltrail.llm.words import mix

SEED_WORDS = 3
# Share of an item's n-grams that are its seeds, and their least number.
SEED_SHARE, LEAST_SEEDS = 0.75, 4
# Edited copies of items with fewer words cannot be told from chance: only whole copies are
# leaks of them. Items of fewer than SEED_WORDS words are their own seeds.
LEAST_WORDS = 8
# Share of a perfect copy's score from which on a passage is a leak.
THRESHOLD = 0.5
# A passage that scores like so many words copied without a change is a leak of an item of
# any length.
PASSAGE_WORDS = 50
MATCH, MISMATCH, GAP = 2, -1, -1
# Characters of test items that are sent to the tasks at once.
PART_CHARS = 1 << 24
_split = WORD_FORM.tobytes()


def words_of(text: str) -> list[bytes]:
    """Lower-case words: runs of ASCII letters and digits and of all non-ASCII characters."""
    return text.lower().encode().translate(_split).split()


class Items:
    """Test items as word numbers (from 1), and their n-grams.

    Gram g has the key ``keys[g]`` and stands in the items ``item[a:b]`` at the word
    places ``place[a:b]`` with a, b = ``bounds[g : g + 2]``.
    """

    def __init__(
        self, rows: list[tuple[int, str]], size: int = SEED_WORDS, least: int = SEED_WORDS, most: float = math.inf
    ):
        self.size = size
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        self.ids, self.words = [], []
        for item_id, text in sorted(set(rows)):
            words = words_of(text)
            if max(least, size) <= len(words) <= most:
                self.ids.append(item_id)
                self.words.append(np.array([number(w, len(self.vocabulary) + 1) for w in words], np.int64))
        keys = [self.grams(w) for w in self.words]
        if keys:
            flat = np.concatenate(keys)
            item = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            place = np.concatenate([np.arange(len(k)) for k in keys])
        else:
            flat, item, place = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, first = np.unique(flat[order], return_index=True)
        self.bounds = np.append(first, len(flat))

    def grams(self, words: np.ndarray) -> np.ndarray:
        """Keys of the n-grams from every place on."""
        n = max(0, len(words) - self.size + 1)
        key = np.zeros(n, np.uint64)
        for k in range(self.size):
            key = mix(key + words[k : k + n].astype(np.uint64))
        return key

    def numbers(self, items: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of texts one after another (0: in no item), and words of each text."""
        words = [words_of(t) for t in items]
        counts = np.array([len(w) for w in words], np.int64)
        flat = np.fromiter(
            map(self.vocabulary.get, chain.from_iterable(words), repeat(0)), np.int64, counts.sum()
        )
        return flat, counts

    def hits(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, place and gram of every n-gram of an item in texts."""
        known = flat > 0
        starts = known.copy()
        for k in range(1, self.size):
            starts[:-k] &= known[k:]
            starts[-k:] = False
        at = np.flatnonzero(starts)
        text = np.searchsorted(np.cumsum(counts), at, "right")
        ends = np.cumsum(counts)[text] if len(at) else at
        at, text = at[at + self.size <= ends], text[at + self.size <= ends]
        key = np.zeros(len(at), np.uint64)
        for k in range(self.size):
            key = mix(key + flat[at + k].astype(np.uint64))
        gram = np.searchsorted(self.keys, key)
        if len(self.keys):
            same = self.keys[np.minimum(gram, len(self.keys) - 1)] == key
            at, text, gram = at[same], text[same], gram[same]
        else:
            at, text, gram = at[:0], text[:0], gram[:0]
        return text, at - (np.cumsum(counts) - counts)[text], gram

    def seeds(
        self,
        frequency: np.ndarray,
        share: float = SEED_SHARE,
        least: int = LEAST_SEEDS,
        passage: int = PASSAGE_WORDS,
    ) -> np.ndarray:
        """True for the occurrences (item, place) whose gram is among the rarest of the item."""
        gram = np.repeat(np.arange(len(self.keys)), np.diff(self.bounds))
        chosen = np.zeros(len(gram), bool)
        order = np.lexsort((self.place, frequency[gram], self.item))
        sizes = np.bincount(self.item, minlength=len(self.ids))
        rank = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # of a long item no more n-grams are left out than a passage can do without
        keep = np.maximum(np.ceil(sizes * share), sizes - 2 * (1 - share) * passage)
        keep = np.maximum(least, keep).astype(np.int64)
        chosen[order[rank < np.repeat(keep, sizes)]] = True
        return chosen


def align(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of an item in a window, and the place of its last word.

    One row for each word of the item; gaps along the row are a running maximum.
    """
    steps = np.arange(len(window)) * -GAP
    row = np.zeros(len(window), np.int64)
    best, end = 0, -1
    for word in item:
        diagonal = np.concatenate([[0], row[:-1]]) + np.where(window == word, MATCH, MISMATCH)
        new = np.maximum(np.maximum(diagonal, row + GAP), 0)
        row = np.maximum(new, np.maximum.accumulate(new + steps) - steps)
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def least_score(words: int, threshold: float, passage: int = PASSAGE_WORDS) -> int:
    """Whole score from which on a passage is a leak of an item of so many words."""
    if words < LEAST_WORDS:
        return MATCH * words
    # the small number is for products that rounding puts above a whole number
    return min(math.ceil(MATCH * threshold * words - 1e-6), MATCH * passage)


def slack_of(words: int, threshold: float, passage: int = PASSAGE_WORDS) -> int:
    """Most words by which the gaps of a leak of an item of so many words can shift it."""
    return max(0, MATCH * words - least_score(words, threshold, passage)) // -GAP


def shared(item: np.ndarray, window: np.ndarray) -> int:
    """Words that an item and a window have in common, with repetition: no alignment matches more."""
    words, times = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(words, window), len(words) - 1)
    there = np.bincount(at[words[at] == window], minlength=len(words))
    return int(np.minimum(times, there).sum())


def leaks_in(
    items: Items,
    seed: np.ndarray,
    flat: np.ndarray,
    counts: np.ndarray,
    threshold: float,
    passage: int = PASSAGE_WORDS,
):
    """(text, item, score, first word, last word) of the best place of each item in each text."""
    text, place, gram = items.hits(flat, counts)
    # every hit, once for each item that has the gram as a seed
    sizes = np.diff(items.bounds)[gram]
    which = np.repeat(items.bounds[:-1][gram], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text, place = np.repeat(text, sizes)[seed[which]], np.repeat(place, sizes)[seed[which]]
    which = which[seed[which]]
    item, begin = items.item[which], place - items.place[which]
    order = np.lexsort((begin, item, text))
    text, item, begin = text[order], item[order], begin[order]
    offsets = np.cumsum(counts) - counts
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    # a hit of an item that is one n-gram is a copy of it: the first in each text counts
    lengths = np.array([len(w) for w in items.words], np.int64)
    whole = lengths[item] == items.size
    first = np.ones(len(text), bool)
    first[1:] = (np.diff(text) != 0) | (np.diff(item) != 0)
    for i in np.flatnonzero(whole & first).tolist():
        found[int(text[i]), int(item[i])] = (1.0, int(begin[i]), int(begin[i]) + items.size - 1)
    text, item, begin = text[~whole], item[~whole], begin[~whole]
    slack = np.array([slack_of(len(w), threshold, passage) for w in items.words], np.int64)
    apart = np.diff(begin) > slack[item[1:]]
    cut = np.flatnonzero((np.diff(text) != 0) | (np.diff(item) != 0) | apart) + 1
    for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(text)], strict=True):
        if i == j:
            continue
        t, k = int(text[i]), int(item[i])
        words = items.words[k]
        a = max(0, int(begin[i] - slack[k]))
        b = min(int(counts[t]), int(begin[j - 1] + len(words) + slack[k]))
        window = flat[offsets[t] + a : offsets[t] + b]
        least = least_score(len(words), threshold, passage)
        if MATCH * shared(words, window) < least:
            continue
        score, end = align(words, window)
        share = score / (MATCH * len(words))
        if score >= least and share > found.get((t, k), (0.0, 0, 0))[0]:
            # aligned backwards from its end, the best alignment ends at its first word
            _, back = align(words[::-1], window[: end + 1][::-1])
            found[t, k] = (share, a + end - back, a + end)
    return [(t, k, *rest) for (t, k), rest in sorted(found.items())]


def parts_of(items: DataFrame, id_col: str | None, text_col: str, part_chars: int) -> Iterator[Items]:
    """The test items in parts of about ``part_chars`` characters; without ids if ``id_col`` is None."""
    own = F.lit(None) if id_col is None else F.col(id_col)
    rows = items.select(own.alias("item_id"), F.col(text_col).alias("text")).where("text is not null")
    if id_col is not None:
        rows = rows.where("item_id is not null")
    rows = rows.distinct()
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-chars // part_chars)
    for part in range(parts):
        one = rows.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part) if parts > 1 else rows
        # numbered, as ids of any type need not be sortable
        found = one.collect()
        numbered = [(n, r.text) for n, r in enumerate(found)]
        for size in range(SEED_WORDS, 0, -1):
            out = Items(numbered, size, size, math.inf if size == SEED_WORDS else size)
            out.ids = [found[n].item_id for n in out.ids]
            if out.ids:
                yield out


def frequencies(rows: DataFrame, items: Items) -> np.ndarray:
    """Number of documents that hold each n-gram of the items."""
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = sent.value
        total = np.zeros(len(items.keys), np.int64)
        for batch in batches:
            text, _, gram = items.hits(*items.numbers(batch.column("text").to_pylist()))
            pairs = np.unique(text * np.int64(len(items.keys) + 1) + gram)
            total += np.bincount(pairs % (len(items.keys) + 1), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["gram", "n"]
        )

    counted = rows.select("text").mapInArrow(run, "gram bigint, n bigint")
    # one row for each n-gram of the part, whose size is bounded
    found = counted.groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    sent.unpersist()
    out = np.zeros(len(items.keys), np.int64)
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out


def find_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    part_chars: int = PART_CHARS,
    passage: int = PASSAGE_WORDS,
) -> DataFrame:
    """doc_id, item_id, score, first_word, last_word of every leak.

    One row for each document row and test item whose best alignment reaches ``threshold``
    of a perfect copy's score, or the score of ``passage`` words in a row. ``score`` is the
    share of a perfect copy's in both cases. Words count from 0 within the document. Null and
    empty texts hold no leaks; a null document id is kept as it is; repeated document rows
    give repeated leaks, repeated test items count once, and one id with several texts gives
    a row for each. The item id keeps its type. Of items with fewer than LEAST_WORDS words only
    whole copies count; items without id, text or words are not searched. Empty tables give an
    empty result; other columns do not matter. A very long text is read whole, in the memory of its
    task. Parts of a large benchmark are searched one after another.
    """
    rows = texts(df, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    item_type = benchmark.select(item_id_col).schema[0].dataType
    item_kind = to_arrow_type(item_type)
    schema = f"doc_id {kind}, item_id {item_type.simpleString()}, score double, first_word bigint, last_word bigint"
    found = []
    for sent, last in searches(rows, benchmark, item_id_col, item_text_col, part_chars, passage):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items, seed = sent.value
            for batch in batches:
                out = leaks_in(items, seed, *items.numbers(batch.column("text").to_pylist()), threshold, passage)
                if out:
                    text, item, score, first, last = zip(*out, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column("doc_id").take(pa.array(text)),
                            pa.array([items.ids[k] for k in item], item_kind),
                            pa.array(score, pa.float64()),
                            pa.array(first, pa.int64()),
                            pa.array(last, pa.int64()),
                        ],
                        names=["doc_id", "item_id", "score", "first_word", "last_word"],
                    )

        part = rows.mapInArrow(run, schema)
        found.append(part if last else staged(part, "leaks"))
        if not last:
            sent.unpersist()
    if not found:
        return df.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, found)


def searches(
    rows: DataFrame, benchmark: DataFrame, id_col: str | None, text_col: str, part_chars: int, passage: int
) -> Iterator[tuple[Broadcast, bool]]:
    """The items of each part with their seeds, sent to the tasks, and whether it is the last part."""
    parts = parts_of(benchmark, id_col, text_col, part_chars)
    items = next(parts, None)
    while items is not None:
        seed = items.seeds(frequencies(rows, items), passage=passage)
        sent = rows.sparkSession.sparkContext.broadcast((items, seed))
        items = next(parts, None)
        yield sent, items is None


def without_leaks(
    df: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    part_chars: int = PART_CHARS,
    passage: int = PASSAGE_WORDS,
) -> DataFrame:
    """The rows of ``df`` that hold no leak, with all their columns; see ``find_leaks``.

    Items without id are searched too.
    """
    rows = df.select(F.coalesce(text_col, F.lit("")).alias("text"))
    mark = "leaks" + "_" * max(map(len, df.columns))
    for sent, last in searches(rows, benchmark, None, item_text_col, part_chars, passage):

        def make(sent=sent):
            items, seed = sent.value

            def leaks(text: pa.Array) -> pa.Array:
                out = leaks_in(items, seed, *items.numbers(text.to_pylist()), threshold, passage)
                return pa.array(np.bincount([t for t, *_ in out], minlength=len(text)), pa.int64())

            return leaks

        df = with_column(df, mark, LongType(), text_col, make).where(F.col(mark) == 0).drop(mark)
        if not last:
            df = staged(df, "clean")
            sent.unpersist()
    return df


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
