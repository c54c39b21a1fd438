import random
import re

import pytest
from pyspark.sql import functions as F

from check_oracles import database
from veritab.llm import exactdup
from veritab.llm.queries import ORACLES, QUERIES


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return sorted((n, str(i), str(min((x for x in ids if x is not None), default=None)), len(ids)) for n, ids in groups.items() for i in ids)


@pytest.mark.parametrize("parts", [1, 9])
def test_equals_brute_force_with_a_hot_group(spark, parts):
    r = random.Random(parts)
    some = ["hot text " * 5, "hot \t text " * 5, "", None, " ", "a", "a ", "A", "same start " * 4 + "1", "same start " * 4 + "2", " ", "x" * 5000]
    rows = [(i, "hot  text " * 5 if i % 3 == 0 else r.choice(some)) for i in range(600)] + [(None, "only null"), (None, "a"), (5, "twice"), (5, "twice")]
    df = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, kept string").repartition(5)
    got = exactdup.mark(df, parts=parts).collect()
    assert sorted((g["__norm"], str(g["doc_id"]), str(g["__keep_id"]), g["__group_size"]) for g in got) == brute(rows)
    kept = [(g["__norm"], str(g["doc_id"]), str(g["__keep_id"])) for g in got if g["__kept"]]
    assert sorted(kept) == sorted({(n, k, k) for n, _, k, _ in brute(rows)})
    assert exactdup.keep_first(df).columns == df.columns


def test_of_equal_ids_the_first_raw_text_stays_and_every_range_is_a_task(spark):
    rows = [(1, f"same{' ' * (k % 5 + 1)}text") for k in range(40)] + [(k, f"word{k * 7919 % 1000:04}") for k in range(2, 3000)] + [(5000, "long " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for parts in (1, 3, 8):
        kept = exactdup.mark(df.repartition(parts), parts=37).filter("__kept AND doc_id = 1").collect()
        assert [(r["text"], r["__group_size"]) for r in kept] == [(min(t for _, t in rows[:40]), 40)]
    spread = exactdup.mark(df, parts=37).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) > 25  # ranges are placed as they are numbered, not hashed together


def test_empty_table(spark):
    assert exactdup.mark(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_matches_duckdb(spark):
    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op6_exact_dedup"](spark, sf)
    want = database(sf).execute(f"SELECT {', '.join(rows.columns)} FROM ({ORACLES['op6_exact_dedup']})").fetchall()
    assert sorted(tuple(r) for r in rows.collect()) == sorted(want)
