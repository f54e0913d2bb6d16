"""Near duplicates by min-max hashing.

Each of a number of hash functions is evaluated once for every shingle of a document, and
both the smallest and the largest value are kept: two signature values for one evaluation.
Bands of equal values bring candidates together; candidates are confirmed on full shingle
sets; documents linked in chains form one component.

Copies with equal shingle sets are one representative from the start. In a bucket not all
pairs are looked at: members are first compared with one pivot, the smallest id. Only where
the members of a bucket are still in different components, pairs across components are
compared, in blocks of bounded size, and only the links that join components leave the
task. Pairs inside a component cannot change the result and are left out, so a group of
thousands of copies costs one comparison for each member.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrail.llm.common import staged, table, texts
from shelltrail.llm.components import components
from shelltrail.llm.words import WordHashes, grams, mix

WORDS = 5
PERCENT = 80
# Hash functions; each gives a smallest and a largest value.
FUNCTIONS = 80
# Values in a band: 160 values make 32 bands, and a pair of similarity 0.8 is missed with
# probability (1 - 0.8**5)**32 = 3e-6.
BAND = 5
# Shingles of the members of a bucket that are compared with each other at a time.
BLOCK_SHINGLES = 1 << 20
# From this number of members on, a pair is compared in the first of its shared bands only. This
# spares repeated comparisons and changes no result.
SMALL_BUCKET = 8
# Groups of exact copies of more than this share of all rows are few enough to be sent to all tasks.
HOT_SHARE, LEAST_HOT = 1e-4, 500
SEED = 11

_rng = np.random.default_rng(SEED)
_factors = _rng.integers(0, 2**63, FUNCTIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_shifts = _rng.integers(0, 2**63, FUNCTIONS, np.uint64)


def shingle_sets(items: list[str], hashes: WordHashes, words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a short text is one shingle."""
    flat, counts = hashes(items)
    whole, inside = grams(flat, counts, words)
    sets, at = [], 0
    for n in counts.tolist():
        if n >= words:
            sets.append(np.unique(whole[at : at + n - words + 1]))
        elif n:
            one = np.uint64(n)
            with np.errstate(over="ignore"):
                for w in flat[at : at + n]:
                    one = mix(np.array([one + w], np.uint64))[0]
            sets.append(np.array([one], np.uint64))
        else:
            sets.append(np.empty(0, np.uint64))
        at += n
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest values of all functions, then the largest ones, as 32-bit numbers."""
    low = np.full(FUNCTIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(FUNCTIONS, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = (shingles[None, at : at + 1024] ^ _shifts[:, None]) * _factors[:, None]
        low = np.minimum(low, part.min(1))
        high = np.maximum(high, part.max(1))
    return (np.concatenate([low, high]) >> np.uint64(32)).astype(np.uint32)


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    n, size = len(signatures), signatures.shape[1] // BAND
    values = signatures.astype(np.uint64).reshape(n, size, BAND)
    key = np.broadcast_to(np.arange(1, size + 1, dtype=np.uint64), (n, size)).copy()
    for k in range(BAND):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k])
    return key.view(np.int64)


def digests(rows: DataFrame, words: int) -> DataFrame:
    """doc_id, n (shingles), two digests of the set, and the signature (null for empty sets)."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = shingle_sets(batch.column("text").to_pylist(), hashes, words)
            digest = np.array([[xxhash.xxh64_intdigest(s.tobytes(), k) for k in (1, 2)] for s in sets], np.uint64)
            digest = digest.reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(digest[:, 0], pa.int64()),
                    pa.array(digest[:, 1], pa.int64()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "n", "d1", "d2", "signature"],
            )

    return rows.mapInArrow(
        run, f"doc_id {kind}, n bigint, d1 bigint, d2 bigint, signature binary"
    )


def band_rows(reps: DataFrame) -> DataFrame:
    """(key, band, rep, n) for every band of every representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = b"".join(batch.column("signature").to_pylist())
            key = bands(np.frombuffer(raw, np.uint32).reshape(batch.num_rows, -1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(key.ravel()),
                    pa.array(np.tile(np.arange(key.shape[1], dtype=np.int32), len(key))),
                    pa.array(np.repeat(batch.column("rep").to_numpy(), key.shape[1])),
                    pa.array(np.repeat(batch.column("n").to_numpy(), key.shape[1])),
                ],
                names=["key", "band", "rep", "n"],
            )

    schema = "key bigint, band int, rep bigint, n bigint"
    return reps.select("rep", "n", "signature").mapInArrow(run, schema)


def close_sizes(a: str, b: str, percent: int):
    """Sets of these sizes can be similar: the smaller has enough shingles."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def confirmed(pairs: DataFrame, wanted: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar. ``wanted`` has rep and text.

    A text is attached by join; the second join leaves the rows of one b together, so its
    set is made once.
    """
    left = pairs.join(wanted.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(wanted.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            other = dict.fromkeys(batch.column("text_b").to_pylist())
            for text, s in zip(other, shingle_sets(list(other), hashes, words), strict=True):
                other[text] = s
            sets = shingle_sets(batch.column("text_a").to_pylist(), hashes, words)
            keep = []
            for s, text in zip(sets, batch.column("text_b").to_pylist(), strict=True):
                t = other[text]
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(100 * common >= percent * (len(s) + len(t) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a bigint, b bigint")


class Forest:
    """Which components have become one, and the links that made them so."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, c: int) -> int:
        while c in self.parent:
            c = self.parent[c]
        return c

    def unite(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
        return a != b


def links_across(reps, comps, left, sets, percent: int, band: int) -> list[tuple[int, int]]:
    """Links that connect components of a bucket, as few as do.

    Members of the most frequent component are not compared with each other. In larger
    buckets a pair is looked at only in the first band that it shares. What is looked at is
    compared by its full sets.
    """
    n = len(reps)
    sizes = np.array([len(s) for s in sets])
    flat, ends = np.concatenate(sets), np.cumsum(sizes)
    many = n > SMALL_BUCKET
    if many:
        keys = bands(np.stack([signature(s) for s in sets]))
    names, counts = np.unique(comps, return_counts=True)
    minor = np.flatnonzero(comps != names[counts.argmax()])
    forest, found = Forest(), []
    rank = np.full(n, -1)
    rank[minor] = np.arange(len(minor))
    root = comps.copy()
    for i in minor.tolist():
        at = np.flatnonzero(
            (root != root[i])
            & (rank < rank[i])
            & ((left != left[i]) | (left == 2))
            & (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        )
        if many and len(at):
            at = at[(keys[at] == keys[i]).argmax(1) == band]
        if not len(at):
            continue
        # shingles of all candidates, looked up in the set of i
        length = sizes[at]
        stop = np.cumsum(length)
        own = np.repeat(ends[at] - stop, length) + np.arange(stop[-1])
        place = np.minimum(np.searchsorted(sets[i], flat[own]), sizes[i] - 1)
        common = np.add.reduceat((sets[i][place] == flat[own]).astype(np.int64), stop - length)
        for j in at[100 * common >= percent * (length + sizes[i] - common)].tolist():
            if forest.unite(int(comps[i]), int(comps[j])):
                found.append((int(max(reps[i], reps[j])), int(min(reps[i], reps[j]))))
        if found:
            root = np.array([forest.root(c) for c in names.tolist()])[np.searchsorted(names, comps)]
    return found


def across(members: DataFrame, wanted: DataFrame, words: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between members of a bucket in different components.

    ``members`` has key, band, rep, n, comp. A bucket is cut into blocks of a bounded number
    of shingles; every two blocks meet once, with the texts of their members.
    """
    sizes = members.groupBy("key").agg(F.sum("n").alias("size"))
    cut = members.join(sizes, "key").withColumn(
        "blocks", F.expr(f"cast(ceil(size / {BLOCK_SHINGLES}) as int)")
    )
    cut = cut.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    side = F.when(F.col("block") == F.col("other"), 2).otherwise((F.col("block") < F.col("other")).cast("int"))
    meet = (
        cut.join(wanted, "rep")
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", "band", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
            side.alias("side"), "rep", "comp", "text",
        )
    )
    tasks = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    meet = meet.repartition(tasks, "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()

        def flush() -> Iterator[pa.RecordBatch]:
            comps = np.array([r["comp"] for r in held], np.int64)
            if len(held) < 2 or (comps == comps[0]).all():
                return
            sets = shingle_sets([r["text"] for r in held], hashes, words)
            reps = np.array([r["rep"] for r in held], np.int64)
            side = np.array([r["side"] for r in held])
            found = links_across(reps, comps, side, sets, percent, held[0]["band"])
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        current, held = None, []
        for batch in batches:
            for r in batch.to_pylist():
                place = (r["key"], r["i"], r["j"])
                if place != current:
                    yield from flush()
                    current, held = place, []
                held.append(r)
        yield from flush()

    return meet.mapInArrow(run, "a bigint, b bigint").distinct()


def with_first(rows: DataFrame, firsts: DataFrame, copies: list[str]) -> DataFrame:
    """(doc_id, n, rep) of all rows: the representative of the exact copies of each.

    Representatives of large groups of copies travel to the rows, whose number there is bounded; only
    the others meet their rows in a shuffle.
    """
    total = firsts.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") > max(LEAST_HOT, int(total * HOT_SHARE))
    large = F.broadcast(firsts.where(hot).select(*copies, F.col("rep").alias("hot_rep"), F.lit(True).alias("hot")))
    # at most 1 / HOT_SHARE rows
    told = rows.join(large, copies, "left")
    by_shuffle = told.where(F.col("hot").isNull()).drop("hot", "hot_rep")
    by_shuffle = by_shuffle.join(firsts.where(~hot).select(*copies, "rep"), copies, "left")
    near = told.where(F.col("hot")).select("doc_id", "n", F.col("hot_rep").alias("rep"))
    return near.unionByName(by_shuffle.select("doc_id", "n", "rep"))


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    A-Z are lowered, words are what stands between ASCII blanks, and a document's set has
    its distinct shingles of ``words`` words; a shorter text is one shingle as a whole. Two
    documents are linked if 100 * intersection >= percent * union; texts without words (null
    too) are linked with nothing. The component is the smallest id that links lead to.
    Ids must be integers. Rows with the same id share its links; a row with a null id can
    copy another row but is not linked to similar ones, and stays if it copies none with an
    id. Repeated rows are copies with the same id: each is returned, and kept. An empty table
    gives an empty result; other columns are not carried. A very long text is read whole, in the
    memory of its task.
    """
    rows = texts(df, id_col, text_col).select(F.col("doc_id").cast("bigint"), "text")
    marked = staged(digests(rows, words), "digests")
    copies = ["n", "d1", "d2"]
    firsts = marked.where("n > 0").groupBy(*copies).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    firsts = staged(firsts, "copies")
    member = staged(with_first(marked.drop("signature"), firsts, copies), "members")
    reps = (
        marked.where("doc_id is not null")
        .join(firsts.select(*copies, F.col("rep").alias("doc_id")), [*copies, "doc_id"])
        .select(F.col("doc_id").alias("rep"), "n", "signature")
        .dropDuplicates(["rep", "n", "signature"])
    )
    reps = staged(reps, "representatives")
    every = band_rows(reps)
    buckets = every.groupBy("key").agg(
        F.min(F.struct("rep", "n")).alias("pivot"), F.count("*").alias("size")
    )
    buckets = buckets.where("size > 1").select(
        "key", F.col("pivot.rep").alias("pivot"), F.col("pivot.n").alias("pivot_n")
    )
    shared = staged(every.join(buckets, "key"), "buckets")
    some = shared.select("rep").distinct()
    wanted = staged(
        rows.select(F.col("doc_id").alias("rep"), "text").join(some, "rep", "left_semi").distinct(), "texts"
    )
    # every member and the pivot that it shares most buckets with
    to_pivot = shared.where(F.col("rep") != F.col("pivot")).where(close_sizes("n", "pivot_n", percent))
    tries = to_pivot.groupBy("rep", "pivot").agg(F.count("*").alias("times"))
    first = tries.groupBy("rep").agg(F.max(F.struct("times", -F.col("pivot"))).alias("best"))
    first = staged(
        first.select(F.col("rep").alias("a"), (-F.col("best.col2")).alias("b")), "pivot-pairs"
    )
    links = staged(confirmed(first, wanted, words, percent), "links")
    parts = components(links)
    # buckets that still hold several components
    named = shared.select("key", "band", "rep", "n").join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    named = staged(named.select("key", "band", "rep", "n", F.coalesce("component", "rep").alias("comp")), "named")
    split = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    split = split.where("lo < hi").select("key")
    more = staged(across(named.join(split, "key"), wanted, words, percent), "links")
    if not more.isEmpty():
        parts = components(links.unionByName(more))
    return (
        member.join(parts.withColumnRenamed("id", "rep"), "rep", "left")
        .withColumn("component_id", F.coalesce("component", "rep", "doc_id"))
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            "component_id",
            F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        )
    )


def without_near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT
) -> DataFrame:
    """The rows of ``df`` of which one stands for each group of near duplicates, all columns.

    The row with the smallest id of each component stays; of rows that agree in id and text
    one stays. Rows with a null id cannot be told apart and all stay.
    """
    found = near_duplicates(df, id_col, text_col, words, percent).where("kept and doc_id is not null")
    keep = found.select(F.col("doc_id").alias(id_col)).distinct()
    one = df.join(keep, id_col, "left_semi").dropDuplicates([id_col, text_col])
    return one.unionByName(df.where(F.col(id_col).isNull()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4)


ORACLE = """
with recursive w as (
    select doc_id, regexp_extract_all(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x20\\x09-\\x0D]+') as ws
    from documents
),
s as (
    select distinct doc_id, unnest(case
        when len(ws) >= 4 then list_transform(range(1, len(ws) - 2), lambda i: ws[i:i + 3])
        when len(ws) > 0 then [ws] else [] end) as shingle
    from w
),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
    select a.doc_id as x, b.doc_id as y, count(*) as common
    from s as a join s as b on a.shingle = b.shingle and a.doc_id < b.doc_id group by all
),
e as (
    select x, y from p join n as a on a.doc_id = x join n as b on b.doc_id = y
    where 100 * common >= 80 * (a.n + b.n - common)
),
both_ways as (select x, y from e union all select y, x from e),
reach as (
    select doc_id, doc_id as c from documents
    union
    select y, c from reach join both_ways on x = doc_id where c < y
)
select d.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(c) as component_id,
    min(c) = d.doc_id as kept
from documents as d join reach using (doc_id) left join n using (doc_id)
group by d.doc_id
"""
