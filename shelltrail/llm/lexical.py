"""Ranked lexical search over posting lists that are cut into blocks of similar documents.

Every document is a vector of term parts: ``c = (10**9 tf) div (1000 tf + 20 m)``, where m follows
its length. A term's weight is w, and the score of a document for an item is the sum of w * c over
the item's terms. Searching the k best documents of every item takes four passes:

1. the documents' vectors over the terms of the items, once written as a table; counts of documents,
   terms and documents by term come from it.
2. a probe: the documents of each item's rarest lists (shortest first, until they hold ``PROBE`` documents)
   are scored whole. The k-th best score is a threshold that the answer is sure to reach. The largest c of
   every term is counted too. An item's lists of small largest parts that together stay below the
   threshold are of no use to it: documents of these lists only cannot be in the answer.
3. the other lists are clustered: each posting goes to the nearest of ``PIVOTS`` pivot documents, and
   the postings of a (list, cluster) in the order of their nearness are cut into blocks of
   ``BLOCK_DOCS``. A block holds its documents' vectors over the terms that items ask together with
   its own, and a summary: the coordinatewise maximum of the vectors. Blocks are written as a table.
4. for each item of a list a block is skipped if the score of the summary stays below the item's
   threshold, which is exact as no document of the block can exceed it. The documents of other blocks are
   scored; one that several lists of an item hold counts in the first of them only.

Hot lists, clusters and groups of copies are dealt over many tasks by a salt that follows the list's length.
Items are searched in parts of ``PART_CHARS`` characters, one part after another: what travels to
all tasks is bounded by a part, and each task passes on k documents of an item at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from shelltrail.llm.common import staged, table, texts

K = 50
PROBE = 500
PIVOTS = 64
BLOCK_DOCS = 32
# Characters of the items that are searched together (or one item), and of a text read at once.
PART_CHARS = 1 << 16
SLICE = 1 << 22
# Postings of a (list, cluster, salt) that are dealt to one task, about.
DEAL = 1 << 14

# A-Z lowered, ASCII that is no letter or digit a blank
_terms = bytes(range(256)).lower()
_terms = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in _terms)


def words_of(text: str) -> Iterator[list[bytes]]:
    """Terms of a text (letters and digits of ASCII, A-Z lowered, and all else beyond), in slices."""
    body = text.encode().translate(_terms)
    at = 0
    while at < len(body):
        end = body.find(b" ", at + SLICE)
        end = len(body) if end < 0 else end
        yield body[at:end].split()
        at = end


@dataclass
class Items:
    """Items that are searched together: their ids, and the distinct terms of each as numbers."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: dict[bytes, int]


@dataclass
class Search:
    """What the passes behind the counts need to know."""

    terms: list[np.ndarray]  # of each item
    total: int  # N
    length: int  # L
    weight: np.ndarray  # w of each term
    frequency: np.ndarray  # df of each term
    # item numbers by term in whose lists the item looks, and the place of the list with the item
    lists: list[list[tuple[int, int]]] | None = None
    order: list[np.ndarray] | None = None  # an item's lists, first that counts first
    threshold: np.ndarray | None = None

    def parts(self, n: np.ndarray, counts: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """c of the terms of documents with n terms in all, of which ``counts`` are known."""
        m = 100 - 50 + (50 * n * self.total) // max(1, self.length)
        return (1000000000 * tf) // (1000 * tf + 20 * np.repeat(m, counts))


def item_parts(items: DataFrame, id_col: str, text_col: str) -> Iterator[Items]:
    """Items in parts; the driver holds one part at a time. Items without terms have no answer."""
    ids, terms, chars = [], [], 0

    def part() -> Items:
        vocabulary = {t: k for k, t in enumerate(sorted(set().union(*terms)))}
        numbers = [np.array(sorted(vocabulary[t] for t in own), np.int64) for own in terms]
        return Items(ids, numbers, vocabulary)

    for row in items.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        own = {w for words in words_of(row["t"] or "") for w in words}
        if not own:
            continue
        if terms and chars + len(row["t"]) > PART_CHARS:
            yield part()
            ids, terms, chars = [], [], 0
        ids.append(row["i"])
        terms.append(own)
        chars += len(row["t"])
    if terms:
        yield part()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms in all), ``terms`` (known ones, ascending) and their ``tf`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = sent.value.get
        size = max(1, len(sent.value))
        for batch in batches:
            n, keys = [], []
            for row, text in enumerate(batch.column("text")):
                count = 0
                for words in words_of(text.as_py()):
                    count += len(words)
                    known = np.fromiter((k for w in words if (k := number(w)) is not None), np.int64)
                    keys.append(known + row * size)
                n.append(count)
            keys, tf = np.unique(np.concatenate(keys) if keys else np.empty(0, np.int64), return_counts=True)
            offsets = pa.array(np.searchsorted(keys, np.arange(len(n) + 1) * size), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(keys % size, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64())),
                ],
                names=["doc_id", "n", "terms", "tf"],
            )

    return docs.mapInArrow(run, f"doc_id {kind}, n bigint, terms array<int>, tf array<bigint>")


def lists_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Number of values of each list, and all values."""
    counts = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    return counts, column.flatten().to_numpy(zero_copy_only=False)


def counted(known: DataFrame, items: Items) -> Search:
    """Counts over all documents, and the weights of the terms."""
    sums = known.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, length = int(sums[0]), int(sums[1])
    by_term = known.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.ln(F.lit(2 * total + 2) / (2 * F.col("df") + 1)))
    frequency = np.zeros(len(items.vocabulary), np.int64)
    weights = np.zeros(len(items.vocabulary), np.int64)
    # one row for each term of the part
    for r in by_term.select("term", "df", weight.cast("bigint").alias("w")).collect():
        frequency[r["term"]], weights[r["term"]] = r["df"], r["w"]
    return Search(items.terms, total, length, weights, frequency)


class Best:
    """The k best (score, document) of each item that a task has seen, smaller ids first."""

    def __init__(self, items: int, k: int):
        self.k, self.items = k, items
        self.found: list[list] = [[] for _ in range(items)]

    def add(self, item: int, scores: list[int], docs: list) -> None:
        own = self.found[item]
        own += zip(scores, docs, strict=True)
        if len(own) > 4 * self.k:
            self._cut(item)

    def _cut(self, item: int) -> None:
        # a null id comes behind all others
        order = sorted(self.found[item], key=lambda f: (-f[0], f[1] is None, 0 if f[1] is None else f[1]))
        self.found[item] = order[: self.k]

    def batch(self, id_type: pa.DataType) -> pa.RecordBatch:
        for item in range(self.items):
            self._cut(item)
        rows = [(i, score, doc) for i, own in enumerate(self.found) for score, doc in own]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], pa.int32()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array([r[2] for r in rows], id_type),
            ],
            names=["item_no", "score", "doc_id"],
        )


def best_rows(found: DataFrame, k: int) -> DataFrame:
    """The k best rows of each item with their ``rank``; each task has passed on its own k best."""
    order = W.partitionBy("item_no").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def probe(known: DataFrame, search: Search, k: int) -> None:
    """Set the threshold of every item and the lists it looks into."""
    spark = known.sparkSession
    size, items = len(search.weight), len(search.terms)
    probes: list[list[int]] = [[] for _ in range(size)]
    for i, own in enumerate(search.terms):
        own = own[np.argsort(search.frequency[own], kind="stable")]
        before = np.cumsum(search.frequency[own]) - search.frequency[own]
        for t in own[before < max(k, PROBE)].tolist():
            probes[t].append(i)
    sent = spark.sparkContext.broadcast((search, probes))
    kind = dict(known.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, probes = sent.value
        best = Best(items, k)
        largest = np.zeros(size, np.int64)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            counts, terms = lists_of(batch.column("terms"))
            n = batch.column("n").to_numpy()
            c = search.parts(n, counts, lists_of(batch.column("tf"))[1])
            np.maximum.at(largest, terms, c)
            ids = batch.column("doc_id").to_pylist()
            lo = np.cumsum(counts) - counts
            dense = np.zeros(size, np.int64)
            for d in range(len(ids)):
                part = slice(lo[d], lo[d] + counts[d])
                asked = {i for t in terms[part].tolist() for i in probes[t]}
                if asked:
                    dense[terms[part]] = c[part] * search.weight[terms[part]]
                    for i in asked:
                        score = int(dense[search.terms[i]].sum())
                        if score > 0:
                            best.add(i, [score], [ids[d]])
                    dense[terms[part]] = 0
        if id_type is None:
            return
        some = np.flatnonzero(largest)
        yield best.batch(id_type)
        # rows without an item number tell the largest part of a term
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(-1 - some, pa.int32()),
                pa.array(largest[some], pa.int64()),
                pa.nulls(len(some), id_type),
            ],
            names=["item_no", "score", "doc_id"],
        )

    found = staged(
        known.mapInArrow(run, f"item_no int, score bigint, doc_id {kind}"), "lexical-probe"
    )
    largest = np.zeros(size, np.int64)
    tops = found.where("item_no < 0").groupBy("item_no").agg(F.max("score").alias("c"))
    for r in tops.collect():  # one row for each term of the part
        largest[-1 - r["item_no"]] = r["c"]
    # a score of 0 is no answer
    threshold = np.ones(items, np.int64)
    last = best_rows(found.where("item_no >= 0"), k).where(F.col("rank") == k)
    for r in last.select("item_no", "score").collect():  # one row for each item of the part
        threshold[r["item_no"]] = r["score"]

    search.threshold = threshold
    search.lists, search.order = [[] for _ in range(size)], []
    most = largest * search.weight
    for i, own in enumerate(search.terms):
        own = own[np.argsort(most[own], kind="stable")]
        useful = own[np.cumsum(most[own]) >= threshold[i]]
        useful = useful[np.argsort(search.frequency[useful], kind="stable")]
        search.order.append(useful)
        for place, t in enumerate(useful.tolist()):
            search.lists[t].append((i, place))


def pivots_of(known: DataFrame, search: Search) -> np.ndarray:
    """Unit vectors of pivot documents (term x pivot): different documents with the smallest hashes."""
    some = known.where(F.size("terms") > 0).select("terms", "tf", "n", F.xxhash64("terms", "tf").alias("h"))
    chosen = some.select("h").distinct().orderBy("h").limit(PIVOTS)
    rows = some.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min_by(F.struct("terms", "tf", "n"), "n").alias("v"))
    out = np.zeros((len(search.weight), PIVOTS), np.float32)
    for k, r in enumerate(rows.orderBy("h").collect()):
        terms, tf = np.array(r["v"]["terms"]), np.array(r["v"]["tf"], np.int64)
        c = search.parts(np.array([r["v"]["n"]]), np.array([len(terms)]), tf) * search.weight[terms]
        out[terms, k] = c / max(1.0, float(np.sqrt((c.astype(float) ** 2).sum())))
    return out


def postings(known: DataFrame, search: Search, pivots: np.ndarray) -> DataFrame:
    """A row for each document and list that some item looks into.

    term, cluster, salt, near, doc_id, and the document's ``terms`` and ``parts`` among the terms that those items
    ask. A document stays out of a list if every item of the list finds it in an earlier one.
    """
    # for each list all terms of its items
    asked = {}
    for t, own in enumerate(search.lists):
        if own:
            terms = [search.terms[i] for i, _ in own]
            asked[t] = terms[0] if len(terms) == 1 else np.unique(np.concatenate(terms))
    sent = known.sparkSession.sparkContext.broadcast((search, asked, pivots))
    kind = dict(known.dtypes)["doc_id"]
    schema = f"term int, cluster int, salt int, near float, doc_id {kind}, terms array<int>, parts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, asked, pivots = sent.value
        salts = 1 + search.frequency // DEAL
        turn = 0
        dense = np.zeros(len(search.weight), np.int64)
        for batch in batches:
            counts, terms = lists_of(batch.column("terms"))
            c = search.parts(batch.column("n").to_numpy(), counts, lists_of(batch.column("tf"))[1])
            lo = np.cumsum(counts) - counts
            rows, lists, clusters, nears, out_terms, out_parts = [], [], [], [], [], []
            for d in np.flatnonzero(counts).tolist():
                part = slice(lo[d], lo[d] + counts[d])
                # a part of 0 (one word in an enormous text) is like no word
                own, value = terms[part][c[part] > 0], c[part][c[part] > 0]
                first: dict[int, tuple[int, int]] = {}
                for t in own.tolist():
                    for i, place in search.lists[t]:
                        if i not in first or place < first[i][0]:
                            first[i] = (place, t)
                if not first:
                    continue
                score = (value * search.weight[own]).astype(np.float32)
                near = score @ pivots[own]
                cluster = int(np.argmax(near))
                nearness = float(near[cluster] / max(1.0, np.sqrt(score @ score)))
                dense[own] = value
                for t in {t for _, t in first.values()}:
                    held = dense[asked[t]]
                    inside = np.flatnonzero(held)
                    rows.append(d)
                    lists.append(t)
                    clusters.append(cluster)
                    nears.append(nearness)
                    out_terms.append(asked[t][inside])
                    out_parts.append(held[inside])
                dense[own] = 0
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out_terms])]), pa.int32())
            flat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_terms, out_parts)]
            spread = (turn + np.arange(len(rows))) % salts[lists] if rows else np.empty(0, np.int64)
            turn += len(rows)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lists, pa.int32()),
                    pa.array(clusters, pa.int32()),
                    pa.array(spread, pa.int32()),
                    pa.array(nears, pa.float32()),
                    batch.column("doc_id").take(pa.array(rows, pa.int64())),
                    *(pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in flat),
                ],
                names=["term", "cluster", "salt", "near", "doc_id", "terms", "parts"],
            )

    return known.mapInArrow(run, schema)


def blocks(rows: DataFrame) -> DataFrame:
    """Blocks of postings: term, cluster, ``doc_ids``, the documents' vectors one after another
    (``counts``, ``terms``, ``parts``), and the summary (``top_terms``, ``top_parts``)."""
    kind = dict(rows.dtypes)["doc_id"]
    near = rows.repartition("term", "cluster", "salt").sortWithinPartitions("term", "cluster", "salt", "near")
    numbers = ("counts", "terms", "parts", "top_terms", "top_parts")
    schema = f"term int, cluster int, doc_ids array<{kind}>, " + ", ".join(f"{x} array<int>" for x in numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = [batch.column(x).to_numpy() for x in ("term", "cluster", "salt")]
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            at = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
            first = np.flatnonzero(at % BLOCK_DOCS == 0)
            block = np.cumsum(at % BLOCK_DOCS == 0) - 1
            counts, terms = lists_of(batch.column("terms"))
            parts = lists_of(batch.column("parts"))[1]
            # the largest part of every (block, term)
            owner = np.repeat(block, counts)
            order = np.lexsort((terms, owner))
            o, t, p = owner[order], terms[order], parts[order]
            heads = np.flatnonzero(np.concatenate([[True], (o[1:] != o[:-1]) | (t[1:] != t[:-1])]))
            tops = np.maximum.reduceat(p, heads)
            edges = np.append(first, n)
            ends = np.concatenate([[0], np.cumsum(counts)])

            def lists(offsets, values):
                values = values if isinstance(values, pa.Array) else pa.array(values, pa.int32())
                return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)

            top_edges = np.searchsorted(o[heads], np.arange(len(first) + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[0][first], pa.int32()),
                    pa.array(keys[1][first], pa.int32()),
                    lists(edges, batch.column("doc_id")),
                    lists(edges, counts),
                    lists(ends[edges], terms),
                    lists(ends[edges], parts),
                    lists(top_edges, t[heads]),
                    lists(top_edges, tops),
                ],
                names=["term", "cluster", "doc_ids", *numbers],
            )

    return near.mapInArrow(run, schema)


def search_blocks(index: DataFrame, search: Search, k: int, id_kind: str) -> DataFrame:
    """(item_no, score, doc_id) of the blocks that the summaries do not rule out."""
    sent = index.sparkSession.sparkContext.broadcast(search)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = sent.value
        best = Best(len(search.terms), k)
        id_type = None
        for batch in batches:
            id_type = batch.schema.field("doc_ids").type.value_type
            look(batch, search, best)
        if id_type is not None:
            yield best.batch(id_type)

    return index.mapInArrow(run, f"item_no int, score bigint, doc_id {id_kind}")


def look(batch: pa.RecordBatch, search: Search, best: Best) -> tuple[int, int]:
    """Score what the summaries leave; how many (block, item) there were, and how many were skipped."""
    n_top, top_terms = lists_of(batch.column("top_terms"))
    top_parts = lists_of(batch.column("top_parts"))[1].astype(np.int64)
    n_docs, counts = lists_of(batch.column("counts"))
    n_entries, terms = lists_of(batch.column("terms"))
    parts = lists_of(batch.column("parts"))[1].astype(np.int64)
    tops, docs, entries = (np.cumsum(x) - x for x in (n_top, n_docs, n_entries))
    seen = skipped = 0
    # column of each term in a block; column 0 is that of terms the block lacks
    column = np.zeros(len(search.weight), np.int64)
    for b, t in enumerate(batch.column("term").to_pylist()):
        part = slice(tops[b], tops[b] + n_top[b])
        held, asking = top_terms[part], search.lists[t]
        column[held] = np.arange(1, len(held) + 1)
        summary = np.concatenate([[0], top_parts[part] * search.weight[held]])
        asked = [(i, place, column[search.terms[i]]) for i, place in asking]
        left = [x for x in asked if summary[x[2]].sum() >= search.threshold[x[0]]]
        seen, skipped = seen + len(asked), skipped + len(asked) - len(left)
        if left:
            own = slice(entries[b], entries[b] + n_entries[b])
            row = np.repeat(np.arange(n_docs[b]), counts[docs[b] : docs[b] + n_docs[b]])
            matrix = np.zeros((n_docs[b], len(held) + 1), np.int64)
            matrix[row, column[terms[own]]] = parts[own] * search.weight[terms[own]]
            ids = batch.column("doc_ids")[b].as_py()
            for i, place, columns in left:
                scores = matrix[:, columns].sum(axis=1)
                # found in an earlier list of the item
                earlier = matrix[:, column[search.order[i][:place]]].any(axis=1)
                fine = np.flatnonzero((scores >= search.threshold[i]) & ~earlier)
                if len(fine):
                    best.add(i, scores[fine].tolist(), [ids[d] for d in fine.tolist()])
        column[held] = 0
    return seen, skipped


def rank(
    docs: DataFrame,
    items: DataFrame,
    k: int = K,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each item's k best documents with a score above 0.

    Terms are maximal stretches of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lowered. Null and empty texts have no terms: such documents do not count, such items have no
    answer. Equal scores are ranked by the id, null ids last. Every row is a document of its own,
    also with an id or a text that stands in other rows, and every row of ``items`` an item of its
    own. Empty tables give an empty result; other columns do not travel. Long texts are read in slices.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    item_type = items.schema[item_col].dataType
    results = []
    for part in item_parts(items, item_col, item_text_col):
        known = staged(vectors(rows, part.vocabulary), "lexical-vectors")
        search = counted(known, part)
        probe(known, search, k)
        index = staged(blocks(postings(known, search, pivots_of(known, search))), "lexical-blocks")
        best = best_rows(search_blocks(index, search, k, kind), k)
        own = spark.createDataFrame(
            list(enumerate(part.ids)),
            StructType([StructField("item_no", LongType()), StructField("item_id", item_type)]),
        )
        # as many rows as the part has items
        named = best.join(F.broadcast(own), "item_no")
        results.append(staged(named.select("item_id", F.col("rank").cast("int"), "doc_id", "score"), "lexical-best"))
    if not results:
        schema = StructType([StructField("item_id", item_type)])
        nothing = spark.createDataFrame([], schema).select(
            "item_id", F.lit(None).cast("int").alias("rank"),
            F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("bigint").alias("score"),
        )
        return nothing
    return reduce(DataFrame.unionByName, results)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
with docs as (
  select row_number() over () as r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as words from documents),
items as (
  select row_number() over () as i, item_id, unnest(list_distinct(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) as term from benchmark),
totals as (select count(*)::bigint as nn, sum(len(words))::bigint as ll from docs where len(words) > 0),
tf as (
  select r, term, count(*)::bigint as tf from (select r, unnest(words) as term from docs)
  where term in (select term from items) group by r, term),
weights as (
  select term, floor(1000 * ln((2 * max(nn) + 2) / (2 * count(*) + 1)))::bigint as w from tf, totals group by term),
scores as (
  select i, item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * len(words) * nn) // ll))))::bigint as score
  from items join tf using (term) join weights using (term) join docs using (r), totals
  group by i, item_id, r having score > 0),
ranked as (
  select item_id, row_number() over (partition by i order by score desc, doc_id nulls last) as rank, doc_id, score
  from scores join docs using (r))
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 50
"""
