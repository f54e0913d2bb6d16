import numpy as np
import pytest
import tiktoken
from texts import HARD, fuzzed

from shelltrail.llm import bpe

SCHEMA = "doc_id bigint, text string, ids string, code int, block int, number int, word int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def library():
    ranks = bpe.read_ranks(bpe.RANKS)
    return tiktoken.Encoding("t", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_the_library_and_comes_back(spark, library):
    rows = list(enumerate(HARD + fuzzed(2000)))
    df = frame(spark, [*rows, (None, "null id"), (3, "again"), (3, "again")]).repartition(5)
    out = bpe.decode(bpe.encode(df, block_chars=3000)).collect()
    want = [(i, t or "") for i, t in rows] + [(None, "null id"), (3, "again"), (3, "again")]
    want = sorted(
        (str(i), np.array(library.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in want
    )
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in out) == want


def test_decoded_where_ids_are_put_together(spark):
    rows = list(enumerate(HARD + fuzzed(300)))
    df = frame(spark, [*rows, (None, "null id"), (3, "again")]).repartition(5)
    out = bpe.encode(df, block_chars=2000, decoded=True)
    again = bpe.decode(out.select("doc_id", "ids")).select("doc_id", "ids", "decoded")
    as_rows = lambda x: sorted((str(r.doc_id), bytes(r.ids), bytes(r.decoded)) for r in x.collect())
    assert as_rows(out) == as_rows(again)
    # one shuffle of the blocks serves both uses of them
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("ReusedExchange") + plan.count("ReusedExchange") >= 1


def test_a_very_long_text(spark, library):
    text = "".join(f"word{i % 977}, été {i}\n" for i in range(70000))
    row = bpe.encode(frame(spark, [(1, text)]), decoded=True).first()
    assert bytes(row.decoded).decode() == text
    assert np.frombuffer(row.ids, "<u4").tolist() == library.encode_ordinary(text)


def test_other_pattern(spark):
    pattern = r"\S+|\s+"
    ranks = bpe.read_ranks(bpe.RANKS)
    library = tiktoken.Encoding("t", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = list(enumerate(["one two  three", " x\ny "]))
    out = {r.doc_id: r.ids for r in bpe.encode(frame(spark, rows), pattern=pattern).collect()}
    for i, text in rows:
        assert np.frombuffer(out[i], "<u4").tolist() == library.encode_ordinary(text)


def test_decode_of_nulls_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None), (2, b""), (3, np.array([5, 6], "<u4").tobytes())], "i int, ids binary")
    out = {r.i: r.decoded for r in bpe.decode(df).collect()}
    table = {i: t for t, i in bpe.read_ranks(bpe.RANKS).items()}
    assert out[1] is None and bytes(out[2]) == b"" and bytes(out[3]) == table[5] + table[6]
    bad = spark.createDataFrame([(1, np.array([50256], "<u4").tobytes())], "i int, ids binary")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(bad).collect()


def test_empty_table(spark):
    assert bpe.decode(bpe.encode(frame(spark, []))).collect() == []
