"""Steps of the answers: what is written once, what is not shuffled, and the same rows as before."""

from pyspark.sql import functions as F

from veritab.catalog import QUERIES
from veritab.catalog.answering import Flow
from veritab.catalog.registry import Source
from veritab.operators import grid as H
from veritab.operators import guards as G
from veritab.session import tune

SHEET = "wb string, sheet string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def claims(spark):
    rows = [("w", "s", i, "a" if i % 2 else "", "b", "c" if i % 3 == 0 else " ") for i in range(40)]
    return spark.createDataFrame(rows, f"{SHEET}, row bigint, x string, y string, z string").select(
        *G.ROW, F.create_map(F.lit("x"), "x", F.lit("y"), "y", F.lit("z"), "z").alias("vals"))


def test_values_of_claims_are_worked_out_once(spark):
    """they were made again for each of the joins that read them."""
    values = claims(spark)
    for size in (4, 40):  # files of few rows, and one that is looked at value by value
        links = values.select(*G.ROW, F.concat(F.lit("f"), F.floor(F.col("row") / size)).alias("name"), F.lit(0).alias("place"))
        for few in (8, 64):
            found = G.borrowed_rows(links, values, few=few)
            assert "map_entries" not in plan(found)
            held = {r.row: {k: v.strip() for k, v in r.vals.items() if v.strip()} for r in values.collect()}
            more = lambda a, b: a // size == b // size and len(held[b]) > len(held[a]) and held[a].items() <= held[b].items()
            want = {a: min(b for b in held if more(a, b)) for a in held if any(more(a, b) for b in held)}
            assert {r.row: r.larger_row for r in found.collect()} == want and want


def test_links_are_rescued_without_joins(spark):
    """own links were worked out three times, for two joins and a union."""
    own = spark.createDataFrame([("w", "s", 1, "a", 0), ("w", "s", 1, "b", 2), ("w", "s", 2, "a", 0)], f"{SHEET}, row bigint, name string, place int")
    judged = spark.createDataFrame(
        [("w", "s", 1, 4, "b"), ("w", "s", 1, 5, "c"), ("w", "s", 1, 3, "c"), ("w", "s", 2, 1, ""), ("w", "s", 3, 2, "a")], f"{SHEET}, row bigint, item_no int, provenance string")
    links, rescued = G.rescue_links(own, judged)
    assert "Join" not in plan(links) and "Join" not in plan(rescued)
    assert sorted(tuple(r)[2:] for r in links.collect()) == [(1, "a", 0), (1, "b", 2), (1, "c", 6), (2, "a", 0), (3, "a", 2)]
    assert sorted(tuple(r)[2:] for r in rescued.select(*G.ROW, "name", "item_no").collect()) == [(1, "c", 3), (3, "a", 2)]


def test_answers_are_written_without_columns_that_no_step_reads(spark, tmp_path):
    """F16: the first answers went through every step with all their texts, rules were joined by shuffling all judgements."""
    for name, rows in (("orders", [(k, k % 3, "2024-01-0%d" % (1 + k % 9)) for k in range(1, 60)]), ("customer", [(k, "n", "m") for k in range(3)])):
        names = {"orders": "o_orderkey bigint, o_custkey bigint, o_orderdate string", "customer": "c_custkey bigint, c_name string, c_mktsegment string"}[name]
        spark.createDataFrame(rows, names).write.parquet(str(tmp_path / f"{name}.parquet"))
    flow = Flow(Source(tune(spark), str(tmp_path)))
    assert set(flow.first.columns) == {*G.ROW, "ord", "batch", "tags", "confidence"}
    assert "memo" in Flow(Source(spark, str(tmp_path)), "memo").first.columns
    assert "rightHint=(strategy=broadcast)" in plan(flow.unfolded)
    assert QUERIES["g10_downgrade_records"](spark, str(tmp_path)).count() == flow.lowered.count() > 0


def test_inherited_values_do_not_put_own_texts_together(spark):
    """texts of all cells were gathered, sorted and joined to find the rows that have none."""
    cells = spark.createDataFrame(
        [("w", "s", 1, 1, "H", "", ""), ("w", "s", 1, 2, "K", "", ""), ("w", "s", 2, 1, " top ", "", ""), ("w", "s", 3, 1, "own", "", ""), ("w", "s", 3, 1, "twice", "", ""),
         ("w", "s", 4, 1, "  ", "", ""), ("w", "s", 5, 2, "x", "", "")], f"{SHEET}, row int, col int, value string, fill_rgb string, pattern string")
    merges = spark.createDataFrame([("w", "s", 2, 9, 1, 1)], f"{SHEET}, r1 int, r2 int, c1 int, c2 int")
    colmap = spark.createDataFrame([("w", "s", "h", [1]), ("w", "s", "k", [2])], f"{SHEET}, rep string, cols array<int>")
    values = H.read_values(cells, merges, colmap)
    assert sorted((r.row, r.rep, r.text, r.inherited) for r in values.collect()) == [
        (2, "h", "top", False), (3, "h", "own, twice", False), (5, "h", "top", True), (5, "k", "x", False)]
    twice = H.read_values(cells, merges.unionByName(merges), colmap)
    assert sorted((r.row, r.rep) for r in twice.collect()) == [(2, "h")] * 2 + [(3, "h")] * 2 + [(5, "h")] * 2 + [(5, "k")]
    assert "array_join" in plan(values) and "array_join" not in plan(values.filter("inherited"))
