"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens. Blocks of neighbouring documents are dictionary-coded: each
distinct pre-token of a block gets a number, and each document becomes the numbers in the
order of its positions. The distinct words are shuffled by a hash of the word; all
occurrences of a word in the corpus then meet in one partition, where it is encoded once
and its ids are joined back to every block that has it and take the places of the numbers.
So a word moves once for each block that has it and not once for each place, and no word
is hotter than the number of blocks. Rows are packed: one row holds the words of a block
that fall into the same hash bucket, or the positions of all its documents.

Decoding joins ids with the token-byte table, whose size is that of the vocabulary and is
checked; it is sent to every task.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelltrail.llm.common import table, texts

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
# Text of a block, in characters.
BLOCK_CHARS = 1 << 23
# Bytes of word parts that a worker remembers, about; it starts afresh when it knows more.
KNOWN_BYTES = 5 << 23
# Largest vocabulary whose byte table is sent to the tasks.
MOST_TOKENS = 1 << 21


@lru_cache(2)
def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(2)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


class Splitter:
    """Pre-tokens of texts.

    A single space between two other characters always begins a new pre-token (or a run of
    blanks that a new one follows), so a text can be cut before such spaces and the parts
    split by themselves and remembered. Texts with other runs of blanks are split whole.
    """

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        # the shortcut holds for the fixed pattern only
        self.by_parts = pattern == PATTERN
        self.known: dict[str, tuple[str, ...] | None] = {}
        self.size = 0

    def part(self, part: str) -> tuple[str, ...] | None:
        got = self.known.get(part, 0)
        if got == 0:
            if self.size > KNOWN_BYTES:
                self.known.clear()
                self.size = 0
            rest = part[1:] if part[:1] == " " else part
            got = None if not rest or rest[0].isspace() else tuple(self.find(part))
            self.known[part] = got
            self.size += 200 + 4 * len(part) + 60 * len(got or ())
        return got

    def parts(self, text: str) -> list[str] | None:
        """The parts, the later ones with their space; None if the text must be split whole."""
        return text.replace(" ", "\0 ").split("\0") if self.by_parts and "\0" not in text else None


class Block:
    """Dictionary code of the pre-tokens of neighbouring documents."""

    def __init__(self, split: Splitter):
        self.split, self.numbers, self.codes = split, {}, {}
        self.docs: list[tuple[object, bytes]] = []
        self.chars = 0

    def _code(self, words) -> bytes:
        numbers = self.numbers
        return np.array([numbers.setdefault(w, len(numbers)) for w in words], "<u4").tobytes()

    def add(self, doc_id, text: str) -> None:
        parts = self.split.parts(text)
        code = None
        if parts is not None:
            codes = self.codes
            for part in set(parts).difference(codes):
                words = self.split.part(part)
                codes[part] = None if words is None else self._code(words)
            got = [codes[p] for p in parts]
            if None not in got:
                code = b"".join(got)
        self.docs.append((doc_id, self._code(self.split.find(text)) if code is None else code))
        self.chars += len(text)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2**32, compressed; bytes of equal weight lie together."""
    parts = []
    for a in arrays:
        planes = np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        parts += [len(a).to_bytes(8, "little"), planes.tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def unpack(packed: bytes) -> list[np.ndarray]:
    body, arrays, at = zstandard.ZstdDecompressor().decompress(packed), [], 0
    while at < len(body):
        n = int.from_bytes(body[at : at + 8], "little")
        planes = np.frombuffer(body, np.uint8, 4 * n, at + 8).reshape(4, n)
        arrays.append(np.ascontiguousarray(planes.T).view("<u4").ravel())
        at += 8 + 4 * n
    return arrays


def pack_codes(codes: np.ndarray) -> bytes:
    """Word numbers, those of the 256 most frequent words apart: each kind packs by itself."""
    high, low = codes >> np.uint32(8), (codes & np.uint32(255)).astype(np.uint8)
    rare = high > 0
    parts = [np.packbits(rare), low[~rare], low[rare]]
    parts += [((high[rare] >> np.uint32(8 * k)) & np.uint32(255)).astype(np.uint8) for k in range(3)]
    body = b"".join(zstandard.compress(x.tobytes(), 3) for x in parts)
    return len(codes).to_bytes(8, "little") + body


def unpack_codes(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    with zstandard.ZstdDecompressor().stream_reader(packed[8:], read_across_frames=True) as frames:
        body = np.frombuffer(frames.read(), np.uint8)
    rare = np.unpackbits(body[: -(-n // 8)], count=n).astype(bool)
    at, few = -(-n // 8), int(rare.sum())
    codes = np.zeros(n, np.uint32)
    codes[~rare] = body[at : at + n - few]
    planes = body[at + n - few :].reshape(4, few).astype(np.uint32)
    codes[rare] = planes[0] | planes[1] << np.uint32(8) | planes[2] << np.uint32(16) | planes[3] << np.uint32(24)
    return codes


def word_rows(words: list[str], codes: list[np.ndarray], buckets: int):
    """(bucket, packed words) rows of a block, and its codes with frequent words numbered low."""
    n = len(words)
    every = np.concatenate(codes) if codes else np.empty(0, np.uint32)
    by_count = np.argsort(-np.bincount(every, minlength=n), kind="stable")
    number = np.empty(n, np.uint32)
    number[by_count] = np.arange(n, dtype=np.uint32)
    raw = [words[i].encode() for i in by_count.tolist()]
    bucket = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, n)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    rows = []
    for some in np.split(order, cuts) if n else ():
        body = [raw[i] for i in some.tolist()]
        sizes = np.fromiter(map(len, body), np.int64, len(body))
        rows.append((int(bucket[some[0]]), pack(np.diff(some, prepend=0), sizes), zstandard.compress(b"".join(body))))
    return rows, [number[c] for c in codes]


BLOCK_SCHEMA = (
    "block bigint, ids array<{id}>, sizes binary, codes binary, bucket array<int>,"
    " numbers array<binary>, words array<binary>"
)


def pre_tokens(rows: DataFrame, pattern: str, block_chars: int, buckets: int) -> DataFrame:
    """A row for each block: its documents' ids, sizes and codes, and its words by bucket."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, first, made = Splitter(pattern), TaskContext.get().partitionId() << 32, 0

        def flush(block: Block, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            codes = [np.frombuffer(c, "<u4") for _, c in block.docs]
            words, codes = word_rows(list(block.numbers), codes, buckets)
            sizes = np.array([len(c) for c in codes])
            bucket, number, word = zip(*words, strict=True) if words else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + made], pa.int64()),
                    pa.array([[d for d, _ in block.docs]], pa.list_(id_type)),
                    pa.array([pack(sizes)], pa.binary()),
                    pa.array([pack_codes(np.concatenate(codes))], pa.binary()),
                    pa.array([bucket], pa.list_(pa.int32())),
                    pa.array([number], pa.list_(pa.binary())),
                    pa.array([word], pa.list_(pa.binary())),
                ],
                names=["block", "ids", "sizes", "codes", "bucket", "numbers", "words"],
            )

        block, id_type = Block(split), None
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for doc_id, text in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                block.add(doc_id, text)
                if block.chars >= block_chars:
                    yield from flush(block, id_type)
                    block, made = Block(split), made + 1
        if block.docs:
            yield from flush(block, id_type)

    return rows.mapInArrow(run, BLOCK_SCHEMA.format(id=kind))


def word_ids(blocks: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Word numbers of each block with ids (block, found): a word's occurrences meet in one task."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, *words in zip(*(batch.column(n).to_pylist() for n in ("block", "bucket", "numbers", "words")), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * len(words[0]), pa.int64()),
                        pa.array(words[0], pa.int32()),
                        pa.array(words[1], pa.binary()),
                        pa.array(words[2], pa.binary()),
                    ],
                    names=["block", "bucket", "numbers", "words"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, size = encoding(ranks, pattern)._encode_single_piece, {}, 0
        for batch in batches:
            out = []
            for numbers, words in zip(
                batch.column("numbers").to_pylist(), batch.column("words").to_pylist(), strict=True
            ):
                steps, sizes = unpack(numbers)
                text, ends = zstandard.decompress(words), np.cumsum(sizes).tolist()
                if size > KNOWN_BYTES:
                    known.clear()
                    size = 0
                found = []
                for a, b in zip([0, *ends], ends, strict=False):
                    word = text[a:b]
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode(word), "<u4").tobytes()
                        size += 150 + len(word) + len(ids)
                    found.append(ids)
                counts = np.fromiter((len(i) // 4 for i in found), np.int64, len(found))
                out.append(pack(steps, counts, np.frombuffer(b"".join(found), "<u4")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), pa.array(out, pa.binary())], names=["block", "found"]
            )

    asked = blocks.mapInArrow(explode, "block bigint, bucket int, numbers binary, words binary")
    return asked.repartition("bucket").mapInArrow(run, "block bigint, found binary")


class Tokens:
    """The token-byte table: bytes of ids."""

    def __init__(self, ids: np.ndarray, tokens: list[bytes]):
        self.ids = ids
        self.body = np.frombuffer(b"".join(tokens), np.uint8)
        self.sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def decode(self, packed: bytes) -> bytes:
        want = np.frombuffer(packed, "<u4")
        place = np.searchsorted(self.ids, want)
        if len(want) and (place.max() >= len(self.ids) or (self.ids[place] != want).any()):
            raise ValueError("an id is not in the vocabulary")
        size = self.sizes[place]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.starts[place] - (ends - size), size) + np.arange(total)
        return self.body[at].tobytes()


def token_table(spark: SparkSession, ranks: str) -> Broadcast:
    """The token-byte table for all tasks; its size is that of the vocabulary."""
    tokens = read_ranks(ranks)
    if len(tokens) > MOST_TOKENS:
        raise ValueError("the vocabulary is too large to send to every task")
    by_id = sorted((i, t) for t, i in tokens.items())
    return spark.sparkContext.broadcast((np.array([i for i, _ in by_id], np.int64), [t for _, t in by_id]))


def assemble(docs: pa.Table, words: pa.Table, tokens: Tokens | None = None) -> pa.Table:
    """Documents of a block with the ids in the places of the word numbers, decoded again if asked."""
    found = [unpack(x) for x in words.column("found").to_pylist()]
    if len(found) != docs.column("word_rows")[0].as_py():
        raise RuntimeError("a block lost word rows or has them twice")
    none = np.empty(0, np.int64)
    number = np.concatenate([none, *(np.cumsum(f[0].astype(np.int64)) for f in found)])
    length = np.concatenate([none, *(f[1].astype(np.int64) for f in found)])
    flat = np.concatenate([np.empty(0, "<u4"), *(f[2] for f in found)]).astype("<u4")
    order = np.argsort(number)
    if not np.array_equal(number[order], np.arange(len(number))):
        raise RuntimeError("a block lost words or has them twice")
    start = (np.cumsum(length) - length)[order]
    length = length[order]
    codes = unpack_codes(docs.column("codes")[0].as_py())
    places = unpack(docs.column("sizes")[0].as_py())[0].astype(np.int64)
    out = []
    for numbers in np.split(codes, np.cumsum(places)[:-1]):
        sizes = length[numbers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(start[numbers] - (ends - sizes), sizes) + np.arange(total)
        out.append(flat[at].tobytes())
    doc_ids = docs.column("ids").combine_chunks().flatten()
    columns = {"doc_id": doc_ids, "ids": pa.array(out, pa.binary())}
    if tokens is not None:
        columns["decoded"] = pa.array([tokens.decode(x) for x in out], pa.binary())
    return pa.table(columns)


def encode(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    ranks: str = RANKS,
    pattern: str = PATTERN,
    block_chars: int = BLOCK_CHARS,
    decoded: bool = False,
) -> DataFrame:
    """``doc_id`` and ``ids`` of every row; ids are little-endian unsigned 32-bit integers.

    With ``decoded``, a column of that name has the bytes that the ids give back, as
    :func:`decode` would add it, but made in the task that puts the ids together.
    A null or empty text has no ids (empty bytes). Null and repeated ids and repeated rows
    give a row each. Other columns are not carried: join by id. An empty table gives an
    empty result. A text longer than ``block_chars`` is a block by itself.
    """
    rows = texts(df, id_col, text_col)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # both uses of the blocks read the same shuffle; the words have some buckets for each task
    blocks = pre_tokens(rows, pattern, block_chars, 2 * tasks).repartition(tasks, "block")
    found = word_ids(blocks, ranks, pattern)
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, ids binary" + (", decoded binary" if decoded else "")
    sent = token_table(df.sparkSession, ranks) if decoded else None

    def together(docs: pa.Table, words: pa.Table) -> pa.Table:
        return assemble(docs, words, Tokens(*sent.value) if sent else None)

    # the words stay out of the second use, but not out of the shuffle that both uses share
    word_rows = F.greatest(F.size("bucket"), F.size("numbers"), F.size("words")).alias("word_rows")
    docs = blocks.select("block", "ids", "sizes", "codes", word_rows)
    return docs.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(together, schema)


def decode(df: DataFrame, ids_col: str = "ids", ranks: str = RANKS, name: str = "decoded") -> DataFrame:
    """Adds the bytes of the ids as column ``name``; null for null ids, empty for none.

    Joins every id with the token-byte table. An id that is not in the vocabulary is an error.
    """
    sent = token_table(df.sparkSession, ranks)

    @F.pandas_udf("binary")
    def join(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = Tokens(*sent.value)
        for column in batches:
            yield pd.Series([None if x is None else tokens.decode(x) for x in column], dtype=object)

    return df.withColumn(name, join(ids_col))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), decoded=True).select(
        "doc_id",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
