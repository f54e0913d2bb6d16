"""Language-model scores by stupid backoff.

The score of a word after its context is the share count(context + word) / count(context)
if that n-gram was seen, else ALPHA times the score after the shorter context, down to
count(word) / words. Counts come from the whole corpus less the document that is scored,
so that a document does not vouch for itself.

The n-gram count tables are partitioned by ranges of the n-gram's hash. Blocks of documents
are exploded into their distinct n-grams, which travel with their counts within the block
to the partition of their hash; there the counts are summed and joined back to every block
that asked, and each block sums up its documents. One row carries all n-grams that go from
a block to a partition, sorted, so that hashes pack well and counts come back in the same
order. A frequent n-gram travels once for each block, whatever its number of places.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrail.llm.bpe import pack, unpack
from shelltrail.llm.common import table, texts
from shelltrail.llm.words import WordHashes, grams

ORDER = 3
ALPHA = 0.4
# Fixed value: a word.
WORD = r"[^\x20\x09-\x0D]+"
# A word that no other document has counts as this share of a place.
UNSEEN = 0.5
# Text of a block and of a partition of the count tables, in characters.
BLOCK_CHARS = 1 << 23
PARTITION_CHARS = 1 << 24
# N-grams are told apart by this many bits of their hash: two of a corpus of 10**12
# different ones are taken for one with probability 10**12 / 2**56.
HASH_BITS = 56


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as the planes of their differences."""
    steps = np.diff(values, prepend=np.uint64(0))
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 3)


def unpack_sorted(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class Block:
    """The documents of a block as numbers of its distinct words."""

    def __init__(self, payload: bytes):
        vocabulary, counts, words = unpack_block(payload)
        self.counts = counts
        self.flat = vocabulary[words]

    def order(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the n-gram that begins at every place, and whether it lies in one document."""
        key, inside = grams(self.flat, self.counts, n)
        return key >> np.uint64(64 - HASH_BITS), inside


def pack_block(flat: np.ndarray, counts: np.ndarray) -> bytes:
    vocabulary, words = np.unique(flat, return_inverse=True)
    # frequent words get low numbers, which pack well
    order = np.argsort(-np.bincount(words, minlength=len(vocabulary)), kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    parts = [pack_sorted(vocabulary), pack(number), pack(counts, number[words])]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unpack_block(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, at = [], 0
    while at < len(payload):
        size = int.from_bytes(payload[at : at + 8], "little")
        parts.append(payload[at + 8 : at + 8 + size])
        at += 8 + size
    by_hash, number = unpack_sorted(parts[0]), unpack(parts[1])[0]
    vocabulary = np.empty_like(by_hash)
    vocabulary[number] = by_hash
    counts, words = unpack(parts[2])
    return vocabulary, counts.astype(np.int64), words


def make_blocks(rows: DataFrame, block_chars: int) -> DataFrame:
    """block, ids (doc_id of each document), payload."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = WordHashes(), TaskContext.get().partitionId() << 32
        ids, flats, counts, chars = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            flat, count = np.concatenate(flats), np.concatenate(counts)
            doc_ids = pa.concat_arrays(ids)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, len(doc_ids)], pa.int32()), doc_ids),
                    pa.array([pack_block(flat, count)], pa.binary()),
                ],
                names=["block", "ids", "payload"],
            )

        for batch in batches:
            items, at = batch.column("text").to_pylist(), 0
            while at < len(items):
                # as many documents as fill the block
                end = at
                while end < len(items) and (chars < block_chars or end == at):
                    chars += len(items[end])
                    end += 1
                flat, count = hashes(items[at:end])
                ids.append(batch.column("doc_id").slice(at, end - at))
                flats.append(flat)
                counts.append(count)
                at = end
                if chars >= block_chars:
                    yield from flush()
                    block += 1
                    ids, flats, counts, chars = [], [], [], 0
        if ids:
            yield from flush()

    return rows.mapInArrow(run, f"block bigint, ids array<{kind}>, payload binary")


def asked(blocks: DataFrame, order: int, partitions: int) -> DataFrame:
    """Distinct n-grams of each block by partition: part, block, n, hashes, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
                block = Block(payload)
                for n in range(1, order + 1):
                    key, inside = block.order(n)
                    found, counts = np.unique(key[inside], return_counts=True)
                    cuts = np.searchsorted(found, edges(partitions))
                    spans = [(p, int(a), int(b)) for p, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(found)], strict=True)) if a < b]
                    for at in range(0, len(spans), 64):
                        some = spans[at : at + 64]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([p for p, _, _ in some], pa.int32()),
                                pa.array([number] * len(some), pa.int64()),
                                pa.array([n] * len(some), pa.int32()),
                                pa.array([pack_sorted(found[a:b]) for _, a, b in some], pa.binary()),
                                pa.array([pack(counts[a:b]) for _, a, b in some], pa.binary()),
                            ],
                            names=["part", "block", "n", "hashes", "counts"],
                        )

    schema = "part int, block bigint, n int, hashes binary, counts binary"
    return blocks.mapInArrow(run, schema)


def edges(partitions: int) -> np.ndarray:
    """First hash of each partition."""
    return (np.arange(partitions, dtype=np.uint64) * np.uint64(2**HASH_BITS // partitions)).astype(np.uint64)


def corpus_counts(rows: pa.Table) -> pa.Table:
    """For one partition and order: the corpus counts of the n-grams that each block asked for."""
    hashes = [unpack_sorted(h) for h in rows.column("hashes").to_pylist()]
    counts = np.concatenate([unpack(c)[0] for c in rows.column("counts").to_pylist()])
    sizes = [len(h) for h in hashes]
    found, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, counts, len(found)).astype(np.int64)[place]
    ends = np.cumsum(sizes)
    return pa.table(
        {
            "block": rows.column("block"),
            "part": rows.column("part"),
            "n": rows.column("n"),
            "totals": pa.array([pack(t) for t in np.split(total, ends[:-1])], pa.binary()),
        }
    )


def document_scores(
    block: Block, totals: dict[int, np.ndarray], order: int, words: int, alpha: float
) -> np.ndarray:
    """Sum of the logarithms of the scores of each document's words."""
    flat, counts = block.flat, block.counts
    doc = np.repeat(np.arange(len(counts)), counts)
    others = (words - counts)[doc].astype(float)
    ends = np.cumsum(counts)
    place = np.arange(len(flat)) - np.repeat(ends - counts, counts)
    seen = {0: others}
    for n in range(1, order + 1):
        key, inside = block.order(n)
        found, number = np.unique(key[inside], return_inverse=True)
        # occurrences in the document itself
        own, back, many = np.unique(doc[inside] * np.int64(len(found) + 1) + number, return_inverse=True, return_counts=True)
        if len(found) != len(totals[n]):
            raise RuntimeError("counts do not belong to this block")
        value = np.zeros(len(flat))
        value[inside] = totals[n][number] - many[back]
        seen[n] = value
    # score of each word by the longest context that was seen with it
    score = np.full(len(flat), np.nan)
    for n in range(order, 0, -1):
        # the n-gram that ends at a word begins n - 1 places before
        at = np.flatnonzero(np.isnan(score) & (place >= n - 1))
        begin = at - (n - 1)
        top, base = seen[n][begin], seen[n - 1][begin] if n > 1 else others[at]
        if n == 1:
            top = np.maximum(top, UNSEEN)
            base = np.maximum(base, 1.0)
        hit = top > 0
        lost = np.minimum(order - 1, place[at]) - (n - 1)
        score[at[hit]] = np.log(top[hit] / base[hit]) + lost[hit] * np.log(alpha)
    sums = np.concatenate([[0.0], np.cumsum(score)])
    out = np.array([score[a:b].sum() for a, b in zip(ends - counts, ends, strict=True)])
    return out if len(sums) > 1 else np.zeros(len(counts))


def score(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    alpha: float = ALPHA,
    block_chars: int = BLOCK_CHARS,
    partition_chars: int = PARTITION_CHARS,
) -> DataFrame:
    """doc_id, n_words, log_score (sum of natural logarithms over the words) of every row.

    Words are what stands between ASCII blanks, A-Z lowered. A context that is shorter at the
    beginning of a document is no backoff. A word that no other document has counts UNSEEN
    places; a corpus of one document counts at least one word. A null or empty text has no
    words and the sum 0. Null and repeated ids and repeated rows are scored one by one, and
    copies of a document in other rows do count for it. An empty table gives an empty result;
    other columns are not carried. N-grams are compared by HASH_BITS bits of their hashes: of n different
    ones about n * n / 2 ** (HASH_BITS + 1) pairs count as one. A very long text is a block by itself.
    """
    rows = texts(df, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    words = rows.agg(F.sum(F.regexp_count("text", F.lit(WORD)))).first()[0] or 0
    # words are at least two characters with their blank
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(tasks, -(-2 * words // partition_chars))
    # both uses of the blocks read the same shuffle
    blocks = make_blocks(rows, block_chars).repartition(tasks, "block")
    counted = (
        asked(blocks, order, partitions)
        .groupBy("part", "n")
        .applyInArrow(corpus_counts, "block bigint, part int, n int, totals binary")
    )

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError("counts of a block that is not there")
        block = Block(left.column("payload")[0].as_py())
        totals = {}
        for n in range(1, order + 1):
            parts = sorted((r["part"], r["totals"]) for r in right.to_pylist() if r["n"] == n)
            totals[n] = np.concatenate([np.empty(0, np.int64), *(unpack(t)[0].astype(np.int64) for _, t in parts)])
        ids = left.column("ids").combine_chunks().flatten()
        return pa.table(
            {
                "doc_id": ids,
                "n_words": pa.array(block.counts, pa.int64()),
                "log_score": pa.array(document_scores(block, totals, order, words, alpha), pa.float64()),
            }
        )

    return blocks.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(
        finish, f"doc_id {kind}, n_words bigint, log_score double"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", F.round("log_score", 4).alias("log_score")
    )


ORACLE = f"""
with w as (
    select doc_id, unnest(range(1, len(ws) + 1)) as place, unnest(ws) as w
    from (
        select doc_id, regexp_extract_all(
            translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x20\\x09-\\x0D]+') as ws
        from documents
    )
),
g as (
    select doc_id, place, w as w3,
        lag(w) over d as w2, lag(w, 2) over d as w1
    from w window d as (partition by doc_id order by place)
),
c1 as (select w3 as a, count(*) as n from g group by all),
o1 as (select doc_id, w3 as a, count(*) as n from g group by all),
c2 as (select w2 as a, w3 as b, count(*) as n from g where place > 1 group by all),
o2 as (select doc_id, w2 as a, w3 as b, count(*) as n from g where place > 1 group by all),
c3 as (select w1 as a, w2 as b, w3 as c, count(*) as n from g where place > 2 group by all),
o3 as (select doc_id, w1 as a, w2 as b, w3 as c, count(*) as n from g where place > 2 group by all),
size as (select doc_id, count(*) as own, (select count(*) from g) as total from g group by doc_id),
s as (
    select g.doc_id, g.place, total - own as words,
        c1.n - o1.n as n1, c2.n - o2.n as n2, c3.n - o3.n as n3,
        b1.n - p1.n as m1, b2.n - p2.n as m2
    from g join size using (doc_id)
    join c1 on c1.a = w3 join o1 on o1.doc_id = g.doc_id and o1.a = w3
    left join c2 on c2.a = w2 and c2.b = w3
    left join o2 on o2.doc_id = g.doc_id and o2.a = w2 and o2.b = w3
    left join c3 on c3.a = w1 and c3.b = w2 and c3.c = w3
    left join o3 on o3.doc_id = g.doc_id and o3.a = w1 and o3.b = w2 and o3.c = w3
    left join c1 as b1 on b1.a = w2
    left join o1 as p1 on p1.doc_id = g.doc_id and p1.a = w2
    left join c2 as b2 on b2.a = w1 and b2.b = w2
    left join o2 as p2 on p2.doc_id = g.doc_id and p2.a = w1 and p2.b = w2
),
l as (
    select doc_id, case
        when place > 2 and n3 > 0 then ln(n3 / m2)
        when place > 1 and n2 > 0 then ln(n2 / m1) + case when place > 2 then ln({ALPHA}) else 0 end
        else ln(greatest(n1, {UNSEEN}) / greatest(words, 1)) + least(place - 1, 2) * ln({ALPHA})
    end as score
    from s
)
select d.doc_id, count(score)::bigint as n_words, coalesce(round(sum(score), 4), 0.0)::double as log_score
from documents as d left join l on l.doc_id = d.doc_id
group by d.doc_id
"""
