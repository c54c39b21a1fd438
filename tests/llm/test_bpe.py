import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veritab.llm import bpe, common, packing
from veritab.llm.queries import vocabulary
from veritab.llm.tokens import codec

SIGNS = [*"  \n\t's'tdmrevelld aAé9٣.,!<|> 　漢字🙂'\r\x0b\x85\x00", "<|endoftext|>", "'ll", "'re", " the", "    ", "aaaa", "''''", "<|endo"]


def library():
    return Tokenizer.from_file(vocabulary())


def texts(n, size, seed):
    r = random.Random(seed)
    return ["".join(r.choice(SIGNS) for _ in range(r.randint(0, size))) for _ in range(n)]


def test_codec_gives_the_librarys_ids():
    c, t, given = codec(vocabulary()), library(), texts(3000, 60, 1)
    assert [c.encode(x).tolist() for x in given] == [e.ids for e in t.encode_batch(given, add_special_tokens=False)]
    r = random.Random(2)
    for _ in range(100):
        ids = [r.randrange(50257) for _ in range(20)]
        assert c.decode(np.array(ids, np.uint32)) == t.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("leaf", [1, 5, 40])
def test_tree_of_joins_equals_the_whole_text(leaf):
    c, t = codec(vocabulary()), library()
    runs = ["a" * 900, " " * 700, "é" * 500, "'" * 300 + "s" * 300, " \n" * 200 + "x", "ab" * 400 + " " * 99 + "1" * 200, "<|endoftext|>" * 9, "!" * 500 + "<|endoftext|>" + "?" * 90]
    for text in [*texts(120, 90, leaf), *runs]:
        at = bpe._cuts(text, leaf, list(c.special))
        joined = bpe.join_all(c, [c.encode(text[a:b]) for a, b in zip(at, at[1:])])
        assert joined.tolist() == t.encode(text, add_special_tokens=False).ids, (leaf, text)


def test_encode_and_decode_rows(spark):
    given = [(1, "short one"), (1, "x" * 300 + " and a longer text " * 9), (None, None), (2, ""), (2, "<|endoftext|>" * 30), (3, "word " * 100)]
    df = spark.createDataFrame([(i, x, "clash", 5) for i, x in given], "doc_id long, text string, ids string, row int")
    rows = bpe.decode(bpe.encode(df, vocabulary(), leaf=64), vocabulary()).collect()
    t = library()
    want = sorted((str(i), t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in given)
    assert sorted((str(r["id"]), np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in rows) == want
    assert bpe.encode(df.limit(0), vocabulary()).count() == 0


def test_rows_from_a_shuffle_keep_their_ids(spark):
    given = [(k % 40, f"text {k} " * (3 + k % 50)) for k in range(400)] + [(7, "twin " * 90)] * 3
    df = spark.createDataFrame(given, "doc_id long, text string").repartition(3, "text").repartition(5)
    rows = bpe.encode(df, vocabulary(), leaf=64, decoded="again").collect()
    t = library()
    want = sorted((i, t.encode(x, add_special_tokens=False).ids, x) for i, x in given)
    assert sorted((r["id"], np.frombuffer(r["ids"], "<u4").tolist(), r["again"]) for r in rows) == want


def test_slices_are_bounded_by_bytes():
    texts = ["a" * 10, None, "b" * 300, "", "c" * 60, "d" * 60]
    whole = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    slices = [b["text"].to_pylist() for b in common.bounded(iter([whole, whole.slice(0, 0)]), "text", 100)]
    assert [x for s in slices for x in s] == texts and slices == [["a" * 10, None], ["b" * 300], ["", "c" * 60], ["d" * 60]]


def test_packing_cuts_into_powers_of_two(spark):
    assert packing.pieces(1) == [1] and packing.pieces(3000) == [1024, 1024, 512, 256, 128, 32, 16, 8] and packing.pieces(2048) == [1024, 1024]
    given = [(1, "a b c " * 900), (1, "again"), (None, None), (4, "")]
    df = spark.createDataFrame([(i, x, "clash") for i, x in given], "doc_id long, text string, bucket string")
    rows = packing.pack(df, vocabulary(), length=64).collect()
    t = library()
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 and r["length"] == 2 ** r["bucket"] for r in rows)
    want = sorted((str(i), [*t.encode(x or "", add_special_tokens=False).ids, 0]) for i, x in given)
    docs, now = [], []
    for r in sorted(rows, key=lambda r: r["sequence_id"]):
        assert r["start"] == len(now)
        now += np.frombuffer(r["ids"], "<u4").tolist()
        if len(now) == r["doc_tokens"]:
            docs.append((str(r["id"]), now))
            now = []
    assert not now and sorted(docs) == want
    assert packing.pack(df.limit(0), vocabulary()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, vocabulary(), length=1000)


def test_equal_lengths_lie_together(spark, tmp_path):
    df = spark.createDataFrame([(k, "word " * k) for k in range(70)], "doc_id long, text string").repartition(5)
    packed = packing.pack(df, vocabulary(), length=64)
    packing.write_buckets(packed, f"{tmp_path}/buckets")
    key = lambda r: (r["id"], r["start"], r["length"], bytes(r["ids"]))
    want = sorted(key(r) for r in packed.collect())
    got = [sorted(key(r) for r in packing.read_bucket(spark, f"{tmp_path}/buckets", b).collect()) for b in range(7)]
    assert sorted(x for b in got for x in b) == want and all(x[2] == 2 ** b for b, rows in enumerate(got) for x in rows)
