import io
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from texts import HARD, fuzzed
from tokenizers import Tokenizer

from shelltrail.llm import token_files

SCHEMA = "doc_id bigint, text string, path string, start int"


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(token_files.TOKENIZER)
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


def test_files_hold_what_the_library_gives(spark, library, tmp_path):
    rows = list(enumerate(HARD + fuzzed(1000)))
    df = frame(spark, rows[::-1]).repartition(4)
    manifest = token_files.write_tokens(df, f"file://{tmp_path}/a", frame_bytes=512, file_bytes=3000)
    out = token_files.read_tokens(manifest).orderBy("doc_id").collect()
    start = 0
    for (i, t), r in zip(rows, out, strict=True):
        ids = [*library(t), 1]
        assert (r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) == (i, start, ids), t
        start += len(ids)
    assert manifest.count() > 4
    some = token_files.read_tokens(manifest, {3, 20}).collect()
    assert sorted((r.doc_id, r.start) for r in some) == [(i, out[i].start) for i in (3, 20)]


def test_special_tokens_in_texts(spark, tmp_path):
    untouched = Tokenizer.from_file(token_files.TOKENIZER)
    names = ["a<|endoftext|>b", "<|startoftext|> one", "<|ENDOFTEXT|>", "x <|endoftext|>\n<|endoftext|><|start"]
    texts = names + fuzzed(300)

    def written(name, **options):
        manifest = token_files.write_tokens(frame(spark, list(enumerate(texts))), str(tmp_path / name), **options)
        out = token_files.read_tokens(manifest).orderBy("doc_id").collect()
        return [np.frombuffer(r.ids, "<u4").tolist()[:-1] for r in out]

    want = [untouched.encode(t, add_special_tokens=False).ids for t in texts]
    got = written("s")
    assert got == want
    assert 49407 in got[0] and 49406 in got[1]
    # as plain text, on demand
    plain = written("p", plain_specials=True)
    assert plain[len(names) :] == want[len(names) :]
    assert not {49406, 49407} & {i for ids in plain for i in ids}
    back = [untouched.decode(ids).replace("</w>", "").replace(" ", "") for ids in plain[:2]]
    assert back == [t.replace(" ", "") for t in names[:2]]


def test_memory_of_parts_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_BYTES", 20000)
    encoder = token_files.Encoder(token_files.TOKENIZER)
    plain = Tokenizer.from_file(token_files.TOKENIZER)
    most = 0
    for k in range(60):
        line = "".join(chr(0x4E00 + (k * 37 + i) % 5000) for i in range(100))
        assert np.frombuffer(encoder.encode([line])[0], "<u4").tolist() == plain.encode(line, add_special_tokens=False).ids
        most = max(most, len(encoder.known))
    assert most < 40


def test_frequent_parts_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_BYTES", 40000)
    encoder = token_files.Encoder(token_files.TOKENIZER)
    coded, code = [], encoder._code
    encoder._code = encoder.known.code = lambda word: coded.append(word) or code(word)
    for k in range(60):
        encoder.encode(["often used " + " ".join(f"w{k}x{i}" for i in range(10))])
    assert coded.count("often") == coded.count("used") == 1
    assert len(encoder.known) + len(encoder.known.older) < 400


def test_memory_is_bounded_within_a_batch_and_a_text(monkeypatch):
    monkeypatch.setattr(token_files, "KNOWN_BYTES", 40000)
    monkeypatch.setattr(token_files, "STRETCH_CHARS", 500, raising=False)
    plain = Tokenizer.from_file(token_files.TOKENIZER)
    letters = [chr(97 + i) for i in range(26)]
    words = [a + b + c for a in letters for b in letters for c in letters[:4]]
    texts = ["\n ".join(words[i : i + 50]) for i in range(0, len(words), 50)]
    for items in (texts, [" ".join(texts) + " "], ["\n" * 600 + words[0] + "  " * 600]):
        encoder = token_files.Encoder(token_files.TOKENIZER)
        for text, ids in zip(items, encoder.encode(items), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(encoder.known) + len(encoder.known.older) < 500 < len(words)


def test_rare_parts_of_several_pieces_are_not_remembered():
    encoder = token_files.Encoder(token_files.TOKENIZER)
    encoder.encode(["Seldom, "])
    assert {"seldom", ","} <= encoder.known.keys() and "Seldom," not in encoder.known
    encoder.encode(["Seldom, "])
    assert "Seldom," in encoder.known
    library = Tokenizer.from_file(token_files.TOKENIZER)
    for text in ("Abc<|", "ABC<|endoftext|>", "abc|>", "It's.", "Abc.'s", "abc.'", "x<|startoftext|>.", "\x7fa.", "a\t."):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want, repr(text)


@pytest.mark.parametrize("plain", [False, True])
def test_pieces_have_the_ids_of_whole_parts(plain):
    encoder = token_files.Encoder(token_files.TOKENIZER, plain)
    library = Tokenizer.from_file(token_files.TOKENIZER)
    library.encode_special_tokens = plain
    marks = [chr(0x338), chr(0x301), chr(0x307), chr(0x3000), chr(0x6F22), chr(0x212A), "<|endoftext|>"]
    for c in [*map(chr, range(1, 0x250)), *marks]:
        for text in (c, f"a{c},", f"({c}B", c + c, f"I{c}ll", f"{c}9{c}!"):
            want = library.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == want, repr(text)
    assert encoder.cuts and "a" in encoder.known


def test_null_and_repeated_ids(spark, library, tmp_path):
    rows = [(None, "n"), (5, "a b"), (5, "a b"), (5, "c"), (2, None), (None, "m")]
    manifest = token_files.write_tokens(frame(spark, rows), str(tmp_path / "b"))
    out = token_files.read_tokens(manifest).orderBy("start").collect()
    assert [r.doc_id for r in out] == [None, None, 2, 5, 5, 5]
    sizes = [len(r.ids) // 4 for r in out]
    assert [r.start for r in out] == [sum(sizes[:k]) for k in range(6)]
    assert sorted(bytes(r.ids) for r in out) == sorted(
        np.array([*library(t), 1], "<u4").tobytes() for _, t in rows
    )


def test_empty_table(spark, tmp_path):
    manifest = token_files.write_tokens(frame(spark, []), str(tmp_path / "c"))
    assert token_files.read_tokens(manifest).collect() == []


def test_coding_tasks_write_no_table(spark, tmp_path, monkeypatch):
    plans = []

    def staged(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    monkeypatch.setattr(token_files, "staged", staged)
    token_files.write_tokens(frame(spark, [(1, "a"), (2, "b")]), str(tmp_path / "d"))
    # the manifest comes out of a shuffle behind the tasks that code
    assert plans and plans[0].index("Exchange hashpartitioning(piece") < plans[0].index("MapInArrow")


class Sink(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()
        super().close()


def one_file(docs, frame_bytes):
    sink = Sink()
    writer = token_files.Writer(sink, frame_bytes)
    for i, ids in docs:
        writer.add(i, ids)
    writer.close()
    return sink.kept


def test_frames_are_independent_and_checked():
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 50000, n).astype("<u4").tobytes()) for i, n in enumerate([3, 0, 500, 2, 40, 1])]
    body = one_file(docs, 256)
    # any zstandard reader sees the whole content and skips the tables
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body), read_across_frames=True).read()
    assert plain == b"".join(d for _, d in docs)
    frames, flags, magic = struct.unpack("<IBI", body[-9:])
    assert magic == 0x8F92EAB1 and flags == 0x80 and frames > 3
    reader = token_files.Reader(pa.BufferReader(body))
    assert reader.read(4) == docs[4][1] and reader.decompressed == 1
    assert [reader.read(i) for i in range(6)] == [d for _, d in docs]
    broken = bytearray(body)
    entry = len(body) - 9 - 12 * frames + 8
    broken[entry] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        token_files.Reader(pa.BufferReader(bytes(broken))).read(0)
    assert token_files.crc_of(docs[0][1]) == zlib.crc32(docs[0][1])
