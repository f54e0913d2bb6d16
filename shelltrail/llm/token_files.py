"""Token ids in seekable zstandard files.

A file holds the ids of documents in ascending order as little-endian unsigned 32-bit
integers. It is a sequence of independent zstandard frames, cut between documents where
possible, then a skippable frame with the document index, then the seek table of the
public zstandard seekable format: for each frame its compressed and decompressed size and
the lower half of the XXH64 checksum of its content. A reader opens the trailing tables
and decompresses only the frames of the documents it wants.

Documents are range-partitioned by id, so that files in partition order are in id order;
each partition streams its files into a shared folder. The names of complete files travel
back as a manifest table: files of lost or repeated attempts are never named in it.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelltrail.llm.common import give_back, staged, table, texts
from shelltrail.session import own_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
FRAME_BYTES = 1 << 18
FILE_BYTES = 1 << 28
# Bytes of word parts, their pieces and ids that a worker remembers, about.
KNOWN_BYTES = 1 << 27
# Characters of a long text that are coded at once, about.
STRETCH_CHARS = 1 << 18

# Fixed values of the zstandard seekable format.
SEEK_FRAME = 0x184D2A5E
INDEX_FRAME = 0x184D2A50
SEEK_FOOTER = 0x8F92EAB1
WITH_CHECKSUMS = 0x80


# Characters that normalising only puts in lower case and that never join with a neighbour of another
# kind: letters, digits, and marks without the apostrophe, behind which contractions are cut off.
LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
MARKS = r"!-&(-/:-@\[-`{-~"
PLAIN = re.compile(f"[{LETTERS}0-9{MARKS}]+")
PIECES = re.compile(f"[{LETTERS}]+|[0-9]|[{MARKS}]+")
ASCII_MARKS = "".join(c for c in map(chr, range(128)) if re.match(f"[{MARKS}]", c))

# The normaliser and the splitting for which this holds.
STEPS = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "split": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}


def has_known_steps(tokenizer) -> bool:
    """Whether a tokenizer normalises and splits as :data:`STEPS` say."""
    made = json.loads(tokenizer.to_str())
    normalizers = (made.get("normalizer") or {}).get("normalizers", [])
    splits = (made.get("pre_tokenizer") or {}).get("pretokenizers", [])
    return (
        [n["type"] for n in normalizers] == STEPS["normalizer"]
        and [n["type"] for n in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": STEPS["split"]}
        and not (splits[1]["add_prefix_space"] or splits[1]["use_regex"])
        and made["model"]["type"] == "BPE"
    )


class Known(dict):
    """Ids of words; those that are missing are asked for, and ``size`` counts bytes.

    A word that is put together of others is remembered only if these were known before: otherwise it is
    a rare one, and what is remembered of it are the others.
    """

    def __init__(self, code, older: dict[str, bytes]):
        super().__init__({"": b""})
        self.code, self.older, self.size = code, older, 0

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            before = self.size
            ids = self.code(word)
            if self.size != before:
                return ids
        self[word] = ids
        self.size += 200 + 4 * len(word) + len(ids)
        return ids


PACKERS = [struct.Struct(f"<{n}I").pack for n in range(32)]


def pack_ids(ids: list[int]) -> bytes:
    return PACKERS[len(ids)](*ids) if len(ids) < len(PACKERS) else np.array(ids, "<u4").tobytes()


def stretches(text: str) -> Iterator[str]:
    """A long text, cut at spaces; these are dropped."""
    start = 0
    while len(text) - start > STRETCH_CHARS and (end := text.find(" ", start + STRETCH_CHARS)) >= 0:
        yield text[start:end]
        start = end + 1
    yield text[start:] if start else text


class Encoder:
    """Ids of texts, as bytes, through the ``tokenizers`` library.

    The normaliser and the splitting of the tokenizer never look across a space or a line
    break and drop both, so the ids of a text are those of its space-separated parts one
    after another. The splitting cuts a part of plain letters, digits and marks into the runs of
    letters, the digits and the runs of marks, in lower case: each such piece goes to the library's model.
    Any other part, and each that may hold a special token, goes through the library as a whole. Pieces and
    frequent parts are coded once and then remembered; of what a worker remembers the half that was not used
    of late is forgotten when it is too much, also within a batch or a long text. Names of special
    tokens in a text have the ids of these tokens, as is the library's default; with ``plain`` they
    are ordinary text, so that no text can forge one.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.cuts = has_known_steps(self.tokenizer)
        if self.cuts:
            # a character's bytes in the letters of the model
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            every = (chr(i) for i in range(0x180))
            self.letters = {ord(c): split(c)[0][0] for c in every if PLAIN.match(c)}
            self.model = self.tokenizer.model
        self.known = Known(self._code, {})

    def encode(self, items: list[str]) -> list[bytes]:
        return [b"".join(map(self._stretch, stretches(text))) for text in items]

    def _stretch(self, text: str) -> bytes:
        if self.known.size > KNOWN_BYTES // 2:
            self.known.older = {}
            self.known = Known(self._code, self.known)
        return b"".join(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))

    def _code(self, word: str) -> bytes:
        if self.cuts and word.isascii() and word.isalpha():
            if not word.islower():
                return self.known[word.lower()]
            ids = [t.id for t in self.model.tokenize(word)]  # by far the most frequent kind of piece
        elif self.cuts and word.isascii() and (start := word.rstrip(ASCII_MARKS)).isalpha():
            return self.known[start.lower()] + self.known[word[len(start) :]]
        elif self.cuts and PLAIN.fullmatch(word) and "<|" not in word:
            pieces = PIECES.findall(word.lower())
            if len(pieces) > 1 or pieces[0] != word:
                return b"".join([self.known[p] for p in pieces])
            ids = [t.id for t in self.model.tokenize(word.translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return pack_ids(ids)


@lru_cache(2)
def encoder(path: str, plain: bool = False) -> Encoder:
    return Encoder(path, plain)


class Writer:
    """Writes one file; ``add`` documents in order, then ``close``."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        self.stream, self.frame_bytes = stream, frame_bytes
        self.packer = zstandard.ZstdCompressor(level=3, write_content_size=True)
        self.pending: list[bytes] = []
        self.size = self.written = 0
        self.frames: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        if self.size and self.size + len(ids) > self.frame_bytes:
            self._flush()
        for at in range(0, len(ids), self.frame_bytes):
            part = ids[at : at + self.frame_bytes]
            self.pending.append(part)
            self.size += len(part)
            if self.size >= self.frame_bytes:
                self._flush()

    def _flush(self) -> None:
        if self.size:
            body = b"".join(self.pending)
            packed = self.packer.compress(body)
            self._put(packed, len(body), xxhash.xxh64_intdigest(body) & 0xFFFFFFFF)
            self.pending, self.size = [], 0

    def _put(self, packed: bytes, size: int, check: int) -> None:
        self.stream.write(packed)
        self.written += len(packed)
        self.frames.append((len(packed), size, check))

    def close(self) -> None:
        self._flush()
        known = np.array([i is not None for i in self.ids], np.uint8)
        ids = np.array([i or 0 for i in self.ids], "<i8")
        index = self.packer.compress(
            known.tobytes() + ids.tobytes() + np.array(self.counts, "<i8").tobytes()
        )
        self._put(struct.pack("<II", INDEX_FRAME, len(index)) + index, 0, 0)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), WITH_CHECKSUMS, SEEK_FOOTER)
        self.stream.write(struct.pack("<II", SEEK_FRAME, len(entries) + len(footer)))
        self.stream.write(entries + footer)
        self.stream.close()


class Reader:
    """Documents of one file, by their place in it; only the frames they lie in are read."""

    def __init__(self, source):
        self.source = source
        end = source.size()
        frames, flags, magic = struct.unpack("<IBI", self._read(end - 9, 9))
        if magic != SEEK_FOOTER or not flags & WITH_CHECKSUMS:
            raise ValueError("no seek table with checksums")
        head = self._read(end - 17 - 12 * frames, 8 + 12 * frames)
        if struct.unpack("<II", head[:8]) != (SEEK_FRAME, 12 * frames + 9):
            raise ValueError("the seek table is damaged")
        entries = np.frombuffer(head, "<u4", offset=8).reshape(-1, 3).astype(np.int64)
        self.packed_at = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.at = np.concatenate([[0], np.cumsum(entries[:, 1])])
        self.checks = entries[:, 2]
        self.unpacker = zstandard.ZstdDecompressor()
        self.decompressed = 0
        body = self._read(int(self.packed_at[-2]) + 8, int(entries[-1, 0]) - 8)
        index = self.unpacker.decompress(body)
        n = len(index) // 17
        known = np.frombuffer(index, np.uint8, n)
        ids = np.frombuffer(index, "<i8", n, n)
        self.ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.counts = np.frombuffer(index, "<i8", n, 9 * n)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.frame: tuple[int, bytes] = (-1, b"")

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def _content(self, number: int) -> bytes:
        if self.frame[0] != number:
            a, b = int(self.packed_at[number]), int(self.packed_at[number + 1])
            body = self.unpacker.decompress(self._read(a, b - a))
            if xxhash.xxh64_intdigest(body) & 0xFFFFFFFF != self.checks[number]:
                raise ValueError(f"checksum of frame {number} is wrong")
            self.frame, self.decompressed = (number, body), self.decompressed + 1
        return self.frame[1]

    def read(self, place: int) -> bytes:
        a, b = int(self.starts[place]) * 4, int(self.starts[place + 1]) * 4
        parts = []
        number = int(np.searchsorted(self.at, a, "right")) - 1
        while a < b:
            body, base = self._content(number), int(self.at[number])
            part = body[a - base : b - base]
            parts.append(part)
            a += len(part)
            number += 1
        return b"".join(parts)


def write_tokens(
    df: DataFrame,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str = TOKENIZER,
    end_id: int = END_ID,
    frame_bytes: int = FRAME_BYTES,
    file_bytes: int = FILE_BYTES,
    plain_specials: bool = False,
) -> DataFrame:
    """Write the ids of all documents to files below ``folder``; return their manifest.

    Manifest: piece, file, path, docs, tokens, first_token (ids in all files before it). Document ids
    must be integers, as the index of a file has them in 64 bits. Names of special tokens in a text
    get the ids of these tokens, or those of plain text with ``plain_specials``. Very long texts are
    coded whole and fill several frames.
    A null text is an empty one and still gets its end id; null ids come first; rows with
    the same id are all kept, in the order of a hash of their text. An empty table gives no
    file and an empty manifest. ``folder`` must be reachable from every executor by a scheme
    that pyarrow can open (local and shared paths, hdfs, s3, gs, abfs).
    """
    rows = texts(df, id_col, text_col).select(F.col("doc_id").cast("bigint"), "text")
    rows = (
        rows.withColumn("same", F.xxhash64("text"))
        .withColumn("tie", F.monotonically_increasing_id())
        .repartitionByRange("doc_id", "same", "tie")
        .sortWithinPartitions("doc_id", "same")
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(tokenizer, plain_specials).encode, TaskContext.get()
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        end = struct.pack("<I", end_id)
        done, out, path = [], None, ""

        def finish():
            out.close()
            done.append((task.partitionId(), len(done), path, len(out.counts), sum(out.counts)))

        for batch in batches:
            found = encode(batch.column("text").to_pylist())
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                if out is None:
                    name = f"{task.partitionId():06d}-{len(done):04d}-{uuid.uuid4().hex}.tokens"
                    path = f"{folder}/{name}"
                    out = Writer(system.open_output_stream(f"{root}/{name}"), frame_bytes)
                out.add(doc_id, ids + end)
                if out.written >= file_bytes:
                    finish()
                    out = None
        if out is not None:
            finish()
        give_back()
        columns = list(zip(*done, strict=True)) or [[]] * 5
        kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)],
            names=["piece", "file", "path", "docs", "tokens"],
        )

    # a table's writer starts a process for each of its local files, at its executor's full size for a moment:
    # few tasks write the manifest, and none that codes. All rows of a piece come from one attempt at it.
    files = rows.mapInArrow(run, "piece int, file int, path string, docs bigint, tokens bigint")
    manifest = staged(files.repartition("piece"), "token-manifest")
    earlier = W.orderBy("piece", "file").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("first_token", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)))


def read_tokens(manifest: DataFrame, wanted: set[int] | None = None) -> DataFrame:
    """Documents of the files of a manifest: doc_id, start, ids (as bytes).

    ``start`` counts the ids of all documents before. With ``wanted`` ids, only the frames
    that hold them are decompressed.
    """
    # a fixed number of tasks: the rows are small, the files behind them are not
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("path", "first_token").repartition(tasks, "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if encoder.cache_info().currsize:  # a worker that has coded before
            encoder.cache_clear()
            give_back()
        for batch in batches:
            for path, first in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                system, name = pafs.FileSystem.from_uri(path)
                with system.open_input_file(name) as source:
                    reader = Reader(source)
                    places = [
                        i for i, d in enumerate(reader.ids) if wanted is None or d in wanted
                    ]
                    for a in range(0, len(places), 256):
                        some = places[a : a + 256]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([reader.ids[i] for i in some], pa.int64()),
                                pa.array([first + int(reader.starts[i]) for i in some], pa.int64()),
                                pa.array([reader.read(i) for i in some], pa.binary()),
                            ],
                            names=["doc_id", "start", "ids"],
                        )

    return files.mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = own_path(spark, "token-files")
    manifest = write_tokens(table(spark, sf_dir, "documents"), folder)
    return read_tokens(manifest).select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def crc_of(ids: bytes) -> int:
    """The checksum that the query gives, for readers outside of Spark."""
    return zlib.crc32(ids)
