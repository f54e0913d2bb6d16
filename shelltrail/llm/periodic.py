"""Periodic runs of words, found by longest common extensions over a difference cover.

A run is a stretch of words with smallest period q, at least ``max(6, 4 q)`` words long, that
no neighbouring word extends. A batch of texts is one array of word numbers in which a
0 ends every text:

* the difference cover of 31 residues holds six of them, so that any two positions reach
  sampled ones together within 30 words. Only suffixes at sampled positions are sorted, by their
  first 31 words and then by doubling; neighbours in that order have an exact common
  length, and a sparse table tells its minimum over any range. The common extension of two positions
  is a comparison of a few words up to the sampled ones, then one such minimum.
* a run of period p covers the first of the grid positions 0, 2p, 4p, ... that lies in
  it together with p more, and agrees from there on for ``max(6, 4p) - 3p + 1`` words. The grids of
  all p up to a quarter of the text have n log n positions; those that agree are
  lengthened to both sides by common extensions (to the left by bisection).

Suffixes are sorted for the texts only in which some grid position agrees as far as its first words
are compared. All steps work on whole arrays; a text is in one task with about 150 bytes of memory
for each of its words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrail.llm.common import table

LEAST_WORDS = 6
LEAST_EXPONENT = 4
# A perfect difference set: every residue is the difference of two of its members.
MODULUS = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
# Texts that are worked on together have at most so many characters, or are one text; grids are
# looked at in pieces of about so many positions.
BLOCK_CHARS = 1 << 21
PIECE = 1 << 19
# Words of a grid position that are compared before suffixes are sorted.
FIRST_WORDS = 8


def _steps_to_cover() -> np.ndarray:
    """Words from residues (a, b) to the next place where both are in the cover."""
    inside = np.zeros(MODULUS, bool)
    inside[COVER] = True
    at = np.arange(MODULUS)
    out = np.full((MODULUS, MODULUS), -1)
    for step in range(MODULUS - 1, -1, -1):
        a = inside[(at + step) % MODULUS]
        out[np.outer(a, a)] = step
    return out


STEPS = _steps_to_cover()


class Extensions:
    """Longest common extensions of positions of one text, in an array of texts ended by 0."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.words = np.concatenate([words, np.zeros(2 * MODULUS, np.int64)])
        at = np.arange(n)
        self.at = at[np.isin(at % MODULUS, COVER)]
        self.number = np.full(n + 2 * MODULUS, -1, np.int64)
        self.number[self.at] = np.arange(len(self.at))
        # ranks of samples by their first 31, 62, 124, ... words, samples of a text together
        self.ranks = [self._first_ranks(np.cumsum(words == 0) - (words == 0))]
        while len(self.at) and self.ranks[-1].max() + 1 < len(self.at):
            rank, after = self.ranks[-1], self._after(len(self.ranks) - 1)
            later = np.where(after < 0, -1, rank[after])
            self.ranks.append(self._refined(rank, later))
        self.rank = self.ranks[-1]
        self._minima()

    def _after(self, level: int) -> np.ndarray:
        """The sample 31 * 2**level words behind each sample, or -1."""
        to = self.at + (MODULUS << level)
        return np.where(to < len(self.number), self.number[np.minimum(to, len(self.number) - 1)], -1)

    @staticmethod
    def _refined(rank: np.ndarray, key: np.ndarray) -> np.ndarray:
        order = np.lexsort((key, rank))
        r, k = rank[order], key[order]
        out = np.empty(len(rank), np.int64)
        out[order] = np.concatenate([[0], np.cumsum((r[1:] != r[:-1]) | (k[1:] != k[:-1]))])[: len(r)]
        return out

    def _first_ranks(self, text_no: np.ndarray) -> np.ndarray:
        rank = text_no[self.at]
        if not len(rank):
            return rank
        self.text_no = rank
        # as many words as fit into 63 bits are one key
        width = max(1, int(self.words.max()).bit_length())
        each = max(1, 63 // width)
        for first in range(0, MODULUS, each):
            key = np.zeros(len(rank), np.int64)
            for k in range(first, min(MODULUS, first + each)):
                key = (key << width) | self.words[self.at + k]
            rank = self._refined(rank, key)
        return rank

    def _minima(self) -> None:
        """Common lengths of neighbours in the order of the samples, and their minima."""
        order = np.argsort(self.rank)
        a, b = order[:-1], order[1:]
        same = self.text_no[a] == self.text_no[b] if len(self.at) else np.empty(0, bool)
        length = np.zeros(len(a), np.int64)
        x, y = self.at[a], self.at[b]
        live = np.flatnonzero(same)
        for level in range(len(self.ranks) - 1, -1, -1):
            # equal ranks by so many words: both go on behind them
            rank, step = self.ranks[level], MODULUS << level
            i, j = self.number[x[live]], self.number[y[live]]
            fine = (i >= 0) & (j >= 0)
            equal = live[fine][rank[i[fine]] == rank[j[fine]]]
            length[equal] += step
            x[equal] += step
            y[equal] += step
        length[live] += self._direct(x[live], y[live], np.full(len(live), MODULUS))
        self.table = [length]
        while 2 << (len(self.table) - 1) <= len(length):
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(last[:-half], last[half:]))

    def _direct(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from i and j on, up to ``most``."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        k = 0
        while len(live):
            live = live[self.words[i[live] + k] == self.words[j[live] + k]]
            k += 1
            out[live] = k
            live = live[most[live] > k]
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from i and j on; i < j lie in one text."""
        step = STEPS[i % MODULUS, j % MODULUS]
        out = self._direct(i, j, step)
        there = np.flatnonzero(out == step)
        a = self.rank[self.number[i[there] + step[there]]]
        b = self.rank[self.number[j[there] + step[there]]]
        low, high = np.minimum(a, b), np.maximum(a, b)
        # exponent of the largest power of two in the range
        level = np.frexp((high - low).astype(float))[1] - 1
        for k in np.unique(level).tolist():
            these = np.flatnonzero(level == k)
            minima = self.table[k]
            lo, hi = low[these], high[these]
            out[there[these]] += np.minimum(minima[lo], minima[hi - (1 << k)])
        return out


def _grids(counts: np.ndarray, firsts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Text, period and position of all grid positions, in pieces."""
    tops = np.where(counts >= LEAST_WORDS, counts // LEAST_EXPONENT, 0)
    text = np.repeat(np.arange(len(counts)), tops)
    period = np.arange(len(text)) - np.repeat(np.cumsum(tops) - tops, tops) + 1
    many = -(-(counts[text] - period) // (2 * period))
    piece = np.cumsum(many) // PIECE
    cuts = np.flatnonzero(np.diff(piece)) + 1
    for lo, hi in zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(text)]]), strict=True):
        m = many[lo:hi]
        t, p = np.repeat(text[lo:hi], m), np.repeat(period[lo:hi], m)
        k = np.arange(len(t)) - np.repeat(np.cumsum(m) - m, m)
        yield t, p, firsts[t] + 2 * p * k


def _needed(p: np.ndarray) -> np.ndarray:
    return np.maximum(LEAST_WORDS, LEAST_EXPONENT * p) - 3 * p + 1


def _agree(words: np.ndarray, i: np.ndarray, p: np.ndarray, k: int) -> np.ndarray:
    """Whether word k behind i and i + p is the same; beyond the needed words it need not be."""
    done = _needed(p) <= k
    return done | (words[np.where(done, 0, i + p + k)] == words[i + k])


def find_runs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs (text, start, length, period) of texts, by text, start and period.

    ``words`` holds the positive word numbers of all texts, each followed by a 0; ``counts`` the
    number of words of each text. Starts count from the first word of the text.
    """
    firsts = np.cumsum(counts + 1) - counts - 1
    padded = np.concatenate([words, np.zeros(FIRST_WORDS, np.int64)])
    found = []
    for t, p, i in _grids(counts, firsts):
        live = np.arange(len(i))
        for k in range(FIRST_WORDS):
            live = live[_agree(padded, i[live], p[live], k)]
        found.append(np.stack([t[live], p[live], i[live]]))
    t, p, i = np.concatenate(found, axis=1) if found else np.empty((3, 0), np.int64)
    if not len(t):
        return (np.empty(0, np.int64),) * 4

    # suffixes of the texts that are left
    used = np.unique(t)
    at = np.concatenate([np.arange(firsts[u], firsts[u] + counts[u] + 1) for u in used.tolist()])
    extension = Extensions(words[at])
    place = np.full(len(counts), 0)
    place[used] = np.cumsum(counts[used] + 1) - counts[used] - 1
    i = i - firsts[t]

    ahead = np.empty(len(t), np.int64)
    for lo in range(0, len(t), PIECE):
        part = slice(lo, lo + PIECE)
        x = place[t[part]] + i[part]
        ahead[part] = extension(x, x + p[part])
    fine = ahead >= _needed(p)
    # what agrees up to the next grid position is the same run there
    fine[1:] &= ~((t[1:] == t[:-1]) & (p[1:] == p[:-1]) & (i[1:] - i[:-1] == 2 * p[1:]) & (ahead[:-1] >= 2 * p[1:]))
    t, p, i, ahead = t[fine], p[fine], i[fine], ahead[fine]
    # words to the left that agree too: bisection, as agreement over k words holds for fewer
    low, high = np.zeros(len(t), np.int64), np.minimum(2 * p, i)
    while (low < high).any():
        middle = (low + high + 1) // 2
        x = place[t] + i - middle
        agrees = extension(x, x + p) >= middle
        low, high = np.where(agrees, middle, low), np.where(agrees, high, middle - 1)
    start, length = i - low, low + p + ahead
    # a run that reaches the grid position before is found from there
    fine = (low < 2 * p) & (length >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * p))
    t, start, length, p = t[fine], start[fine], length[fine], p[fine]
    # multiples of the smallest period have the same stretch
    order = np.lexsort((p, length, start, t))
    t, start, length, p = (x[order] for x in (t, start, length, p))
    new = np.ones(len(t), bool)
    new[1:] = (t[1:] != t[:-1]) | (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    t, start, length, p = (x[new] for x in (t, start, length, p))
    order = np.lexsort((p, start, t))
    return tuple(x[order] for x in (t, start, length, p))


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most ``BLOCK_CHARS``, or of one row."""
    first, total = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > first and total + size > BLOCK_CHARS:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def scan(items: list[bytes]) -> tuple[np.ndarray, list[list[dict]], list[bytes]]:
    """Number of words, runs and collapsed text of each text."""
    split = [t.split() for t in items]
    counts = np.array([len(w) for w in split], np.int64)
    numbers: dict[bytes, int] = defaultdict(count(1).__next__)
    ends = (b"\x00 end",)  # holds a blank, so it is no word
    numbers[ends[0]] = 0
    flat = chain.from_iterable(chain(w, ends) for w in split)
    words = np.fromiter(map(numbers.__getitem__, flat), np.int64, int(counts.sum()) + len(items))
    del numbers
    t, start, length, period = find_runs(words, counts)
    runs: list[list[dict]] = [[] for _ in items]
    for row in zip(t.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        runs[row[0]].append({"start": row[1], "length": row[2], "period": row[3]})
    collapsed = []
    for own, found in zip(split, runs, strict=True):
        if found:
            keep = np.ones(len(own), bool)
            for r in found:
                keep[r["start"] + r["period"] : r["start"] + r["length"]] = False
            own = [own[k] for k in np.flatnonzero(keep).tolist()]
        collapsed.append(b" ".join(own))
    return counts, runs, collapsed


RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, ``runs`` (start, length, period) and ``collapsed`` of every text.

    Words are what blanks and the control characters 9 to 13 part. Runs are ordered by start, then
    period; the collapsed text joins by one space the words that no run holds after its first
    period. A null or empty text has no words, no runs and an empty collapsed text. Rows are kept
    one by one, also equal ones and those with null ids; other columns are not carried. A very
    long text is one block of its task.
    """
    kind = dict(df.dtypes)[id_col]
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    run_type = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column("text"), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            for lo, hi in _blocks(sizes):
                own = texts.slice(lo, hi - lo).cast(pa.large_binary()).to_pylist()
                counts, runs, collapsed = scan(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(lo, hi - lo),
                        pa.array(counts, pa.int64()),
                        pa.array(runs, run_type),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )

    return rows.mapInArrow(run, f"doc_id {kind}, n_words bigint, runs {RUNS}, collapsed string")


def looped(df: DataFrame) -> DataFrame:
    """The texts of the query: one in ten gets a periodic end, by the crc32 of its id.

    With h the crc32 of the id, g = h div 10 and n words, h % 10 = 0 makes every word from
    a = g % n on the original word a + (i - a) % p, where p = 1 + (n - a) div (3 + g % 8).
    A null id has no h and leaves the text.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.expr("h div 10")
    words = F.regexp_extract_all("text", F.lit("([^\\x20\\x09-\\x0D]+)"))

    def with_loop(w):
        n = F.size(w).cast("bigint")
        a = F.col("g") % n
        p = 1 + F.call_function("div", n - a, 3 + F.col("g") % 8)
        part = F.struct(n.alias("n"), a.alias("a"), p.alias("p"), w.alias("w"))
        return F.transform(F.array(part), lambda s: F.array_join(
            F.transform(
                F.sequence(F.lit(0).cast("bigint"), s["n"] - 1),
                lambda i: F.get(s["w"], F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"]).cast("int")),
            ), " "))[0]

    # words are bound once, by a list of one
    text = F.transform(
        F.array(words), lambda w: F.when(F.size(w) > 0, with_loop(w)).otherwise(F.col("text"))
    )[0]
    rows = df.select("doc_id", "text").withColumn("h", h).withColumn("g", g)
    return rows.select("doc_id", F.when(F.col("h") % 10 == 0, text).otherwise(F.col("text")).alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")),
        F.lit("\n"),
    ))
    # greatest length, then smallest start and period
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p")))
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.expr("1000 * best.length div (-best.p)").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# crc32 of the id bit by bit; runs as stretches of equal words p apart
ORACLE = r"""
with d as (
  select doc_id, row_number() over () as r,
    list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: w <> '') as w,
    list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda x, b: list_reduce([xor(x, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda y, z: case when y % 2 = 1 then xor(y // 2, 3988292384) else y // 2 end)) as c
  from documents),
h as (select *, xor(c, 4294967295) as h, len(w)::bigint as n from d),
a as (select *, case when h % 10 = 0 and n > 0 then (h // 10) % n end as a from h),
p as (select *, 1 + (n - a) // (3 + (h // 10) % 8) as p from a),
words as (
  select r, i, n, w[1 + case when a is not null and i >= a then a + (i - a) % p else i end] as word
  from (select *, unnest(range(n)) as i from p)),
same as (
  select x.r, x.i, y.i - x.i as q from words x join words y
  on x.r = y.r and x.word = y.word and y.i > x.i and 4 * (y.i - x.i) <= x.n),
stretches as (
  select r, q, min(i) as s, count(*) + q as len
  from (select *, i - row_number() over (partition by r, q order by i) as k from same) group by r, q, k),
runs as (
  select r, s, len, min(q) as q from stretches where len >= greatest(6, 4 * q) group by r, s, len),
dropped as (select distinct r, unnest(range(s + q, s + len)) as i from runs),
kept as (
  select r, string_agg(word, ' ' order by i) as text from words anti join dropped using (r, i) group by r),
summary as (
  select r, count(*) as n_runs, max({'length': len, 's': -s, 'p': -q}) as best,
    string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as lines
  from runs group by r)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, (-best.s)::bigint as start, best.length::bigint as length,
  (-best.p)::bigint as period, (1000 * best.length // (-best.p))::bigint as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(text, '')) as collapsed_sha256
from d left join summary using (r) left join kept using (r)
"""
