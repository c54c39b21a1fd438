import numpy as np
import pyarrow.parquet as pq
from tokenizers import Tokenizer

from veritab.llm import trainorder
from veritab.llm.queries import vocabulary


def test_permutation_is_one_to_one_and_keyed():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(trainorder.permute(np.arange(n), n).tolist()) == list(range(n))
    a, b = trainorder.permute(np.arange(1000), 1000, 1), trainorder.permute(np.arange(1000), 1000, 2)
    assert (a != b).any() and (a != np.arange(1000)).any()


def test_every_sequence_has_one_slot_and_reads_back(spark, tmp_path):
    given = [(1, "a b c " * 60), (1, "again"), (None, None), (4, ""), *[(k, f"text {k} " * (k % 9)) for k in range(5, 60)]]
    df = spark.createDataFrame([(*x, 9) for x in given], "doc_id long, text string, slot int").repartition(5)
    trainorder.write_shards(trainorder.records(df, vocabulary(), length=16, per_shard=8), f"{tmp_path}/shards")
    rows = spark.read.parquet(f"{tmp_path}/shards").collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert all(len(r["record"]) == 32 and r["shard"] == r["slot"] // 8 and r["offset"] == r["slot"] % 8 * 32 for r in rows)
    t = Tokenizer.from_file(vocabulary())
    want = sorted((str(i), s, ids[s:s + 16]) for i, x in given for ids in [[*t.encode(x or "", add_special_tokens=False).ids, 0]] for s in range(0, len(ids), 16))
    assert sorted((str(r["id"]), r["start"], np.frombuffer(r["record"], "<u2")[:r["n_tokens"]].tolist()) for r in rows) == want
    assert trainorder.records(df.limit(0), vocabulary()).count() == 0


def test_a_shard_is_one_file_and_reading_goes_on_from_any_place(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k} " * (k % 40)) for k in range(300)], "doc_id long, text string").repartition(7)
    made = trainorder.records(df, vocabulary(), length=16, per_shard=8)
    trainorder.write_shards(made, f"{tmp_path}/shards")
    want = {r["slot"]: bytes(r["record"]) for r in made.collect()}
    n = len(want)
    assert n > 500
    files = sorted((tmp_path / "shards").glob("*/*.parquet"), key=lambda f: int(f.parent.name[6:]))
    assert [f.parent.name for f in files] == [f"shard={k}" for k in range((n + 7) // 8)]
    for k, f in enumerate(files):  # bytes of the record column as they lie in the file
        column = b"".join(pq.read_table(f, columns=["record"], partitioning=None)["record"].to_pylist())
        assert column == b"".join(want[s] for s in range(8 * k, min(n, 8 * k + 8)))
    for shard, offset in ((0, 0), (3, 5 * 32), (len(files) - 1, 0), (len(files), 0)):
        rows = trainorder.read_shards(spark, f"{tmp_path}/shards", shard, offset).collect()
        assert {(r["shard"], r["offset"]): bytes(r["record"]) for r in rows} == {(s // 8, s % 8 * 32): want[s] for s in range(8 * shard + offset // 32, n)}
        assert len(rows) == max(0, n - 8 * shard - offset // 32)
    trainorder.write_shards(made.limit(0), f"{tmp_path}/none")
    assert trainorder.read_shards(spark, f"{tmp_path}/none").count() == 0
