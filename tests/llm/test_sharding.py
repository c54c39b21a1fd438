import zlib

from veritab.llm import sharding


def brute(rows, shards):
    rows = sorted(((i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows))
    total, before, out, slots = sum(r[2] for r in rows), 0, [], {}
    for has, i, size, crc in rows:
        shard = shards * (2 * before + size) // (2 * total)
        out.append((i if has else None, size, crc, shard, slots.setdefault(shard, 0)))
        slots[shard] += 1
        before += size
    return sorted(out, key=str)


def test_balanced_contiguous_and_exact(spark):
    rows = [(i % 37 if i % 5 else 7, "é" * (i * i % 91)) for i in range(400)] + [(None, None), (None, ""), (-3, "x" * 3000)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, shard int, part int")
    got = sharding.shard_by_bytes(df, 16)
    assert sorted((tuple(r) for r in got.select("id", "size", "text_crc32", "shard", "slot").collect()), key=str) == brute(rows, 16)
    even = sharding.shard_by_bytes(df.filter("size(split(text, '')) < 500"), 4).groupBy("shard").sum("size").collect()
    assert max(r[1] for r in even) - min(r[1] for r in even) < 2 * 183
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0
