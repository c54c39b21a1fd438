"""Work that must follow the data: files of sinks, sides that are broadcast, tasks of small files."""

import os

from pyspark.sql import functions as F

from veritab import fixtures
from veritab.catalog import QUERIES
from veritab.operators import report as R
from veritab.operators import rules as RB
from veritab.session import tune
from veritab.sources import files as S


def folders(path):
    return [d for d in os.listdir(path) if "=" in d]


def many_sheets(spark):
    return spark.range(3000).select((F.col("id") % 50).cast("string").alias("wb"), F.concat(F.lit("S"), (F.col("id") % 300).cast("string")).alias("sheet"), F.col("id").alias("row"))


def test_files_of_a_sink_do_not_follow_the_number_of_sheets(spark, tmp_path):
    out, rows = str(tmp_path / "out"), many_sheets(spark).withColumn("v", F.lit(1))
    S.write_per_sheet(rows, out)
    for _ in range(2):
        S.write_per_sheet(rows.filter("sheet = 'S7' AND row > 1000").withColumn("v", F.lit(2)), out)
    assert len(folders(out)) <= S.FOLDERS
    got = S.read_per_sheet(spark, out)
    assert got.columns == rows.columns
    kept = {(r.row, r.v) for r in got.collect()}
    assert kept == {(i, 1) for i in range(3000) if i % 300 != 7} | {(i, 2) for i in range(1001, 3000) if i % 300 == 7}


def test_sheets_without_a_name_are_replaced_too(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([(None, "a", 1), ("", "a", 2), ("w", None, 3)], "wb string, sheet string, v int")
    S.write_per_sheet(df, out)
    S.write_per_sheet(df.filter("wb IS NULL").withColumn("v", F.lit(9)), out)
    assert {tuple(r) for r in S.read_per_sheet(spark, out).collect()} == {(None, "a", 9), ("", "a", 2), ("w", None, 3)}


def test_files_of_a_report_do_not_follow_the_number_of_sheets(spark, tmp_path):
    out = str(tmp_path / "out")
    cells = many_sheets(spark).selectExpr("*", "1 AS item_no", "2 AS col", "'h' AS header", "'PASS' AS verdict", "'' AS remark")
    report = R.judgement_report(cells)
    R.write_report(report, out)
    again = R.judgement_report(cells.filter("sheet = 'S7'").withColumn("verdict", F.lit("FAIL")))
    R.write_report(again, out)
    assert len(folders(out)) <= S.FOLDERS
    got = R.read_report(spark, out, report.schema).select("sheet", "row", F.col("cells")[0]["verdict"].alias("v")).collect()
    assert len(got) == 3000 and {r.sheet for r in got if r.v == "FAIL"} == {"S7"} and sum(r.v == "FAIL" for r in got) == 10


def test_no_side_is_broadcast_by_the_size_of_its_file(spark):
    """Before a stage has run, sizes are guesses from a file whose rows become many."""
    plan = QUERIES["o12_remark_merge"](tune(spark), "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_rows_of_a_small_file_are_dealt_over_tasks(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("p_partkey")).coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    part = spark.read.parquet(str(tmp_path / "part.parquet"))
    dealt = fixtures._dealt(part, "part", {}, rows=100)
    assert part.rdd.getNumPartitions() == 1 and dealt.rdd.getNumPartitions() == 10 and dealt.count() == 1000
    assert fixtures._dealt(part, "part", {}, rows=1000).rdd.getNumPartitions() == 1


def test_a_shared_table_is_written_once(spark, tmp_path):
    for name in ("orders", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    known = {}
    fixtures.share(spark, str(tmp_path), "claim_base", known)
    folder = known["claim_base"]
    fixtures.share(spark, str(tmp_path), "claim_base", known)
    assert known["claim_base"] == folder
    plain, shared = (fixtures.load(spark, str(tmp_path), "claims", k) for k in ({}, known))
    assert shared.inputFiles()[0].find("/shared/claim_base-") > 0
    assert sorted(map(str, plain.collect())) == sorted(map(str, shared.collect()))


def test_rules_do_not_carry_columns_that_nobody_reads(spark):
    """The first record of a number is kept as one value, so what is in it goes through every sort."""
    texts = [F.concat(F.lit(n), "id").alias(n) for n in RB.COLUMNS if n != "key_cell"]
    rows = spark.range(30).select(F.lit("w").alias("wb"), F.lit("s").alias("sheet"), F.col("id").alias("row"), (F.col("id") % 20).cast("string").alias("key_cell"), *texts)
    kept = RB.parse_rules(rows)
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert "say_pass" not in plan and "remark_text" not in plan and "axis" not in plan
    assert sorted((r.item_no, r.item, r.rule_text) for r in kept.collect()) == [(i, f"item{i}", f"rule_text{i}") for i in range(20)]
