"""Files on disk: folders, manifests, answers, sinks."""

import json

from pyspark.sql import functions as F

from veritab.functions.text import base_name
from veritab.operators import ingest as I
from veritab.sources import answers as A, files as S

def test_folder_listing(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("sub/one.docx", "two.bin", "~$one.docx", ".three.docx"):
        (tmp_path / name).write_bytes(b"x")
    found = S.read_folder(spark, str(tmp_path))
    listed = I.list_files(found.select("path")).select(base_name(F.col("path")).alias("n"), "supported").collect()
    assert {(r.n, r.supported) for r in listed} == {("one.docx", True), ("two.bin", False)}


def test_manifest(spark):
    m = {"sheets": [
        {"sheet": S.ROSTER_SHEET, "rows": [{"키충돌": False, "제출": [{"파일": ["z.pdf"]}]}]},
        {"sheet": "a", "rows": [
            {"키충돌": True, "제출": [{"파일": ["c.pdf"]}]},
            {"키충돌": False, "제출": [{"파일": ["d\\E.pdf", "D/e.PDF", "묶음/", ""]}, {"파일": ["f.pdf"]}]},
        ]}, {"sheet": "b", "rows": []},
    ]}
    files, counters = S.scan_manifest(spark.createDataFrame([("w", json.dumps(m, ensure_ascii=False))], "wb string, body string"))
    assert {r.key for r in files.collect()} == {"d/e.pdf", "f.pdf"}
    r = counters.collect()[0]
    assert (r.sheets, r.rows_of_skipped_sheets, r.rows, r.rows_in_collision, r.folders) == (1, 1, 1, 1, 2)


def test_answers_take_the_row_from_the_key(spark):
    keyed = {"줄": {"r3": {"행": 9, "맺은파일": ["file_01"], "값": {"총시간": "40", "참여명단": {"상태": "찾음", "이름": ["가"]}}, "v1": {"판정": "O", "근거": "표제"}}}}
    listed = {"줄": [{"행": 5, "맺은파일": [], "확신": "높음"}]}
    raw = spark.createDataFrame([(i, json.dumps(x, ensure_ascii=False)) for i, x in enumerate((keyed, listed))], "ord int, body string")
    got = {r.row: r for r in A.scan_answers(raw).collect()}
    assert set(got) == {3, 5} and got[3].tags == ["file_01"] and got[3].roster.names == ["가"] and got[3].confidence == "못맺음" and got[5].confidence == "높음"
    said = A.unfold_judgements(A.scan_answers(raw)).collect()
    assert [(r.item_no, r.said, r.rationale) for r in said] == [(1, "O", "표제")]


def test_what_cannot_be_read_is_recorded(spark):
    bodies = ['{"줄": {"r3": {"확신": "높음"}, "r03": {"확신": "낮음"}, "x": {}}}', '{"줄": {"r1": ', "", None, '{"다른": 1}', '{"줄": [{"행": 4}, {"행": "넷"}, {}]}',
              '{"줄": {"r8": {"판정": {"v2": {"판정": "O"}, "v02": {"판정": "X"}}, "v1": {"판정": "X"}, "v01": {"판정": "O"}}}}']
    raw = spark.createDataFrame(list(enumerate(bodies)), "ord int, body string")
    answers = A.scan_answers(raw)
    assert sorted((r.ord, r.row) for r in answers.collect()) == [(0, 3), (5, 4), (6, 8)]
    gone = sorted((r.ord, r.key, r.reason) for r in A.rejected_answers(raw).collect())
    assert gone == [(0, "r03", "no row number"), (0, "x", "no row number"), (1, "", "no readable rows"), (2, "", "no readable rows"), (3, "", "no readable rows"),
                    (4, "", "no readable rows"), (5, "", "no row number"), (5, "넷", "no row number")]
    said = A.unfold_judgements(answers).filter("ord = 6").collect()
    assert sorted((r.item_no, r.said) for r in said) == [(1, "X"), (2, "O")]


def test_sinks_keep_other_sheets(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("w", "a", 1), ("w", "b", 2)], "wb string, sheet string, v int")
    S.write_per_sheet(df, out)
    S.write_per_sheet(df.filter("sheet = 'a'").withColumn("v", F.lit(9)), out)
    assert {(r.sheet, r.v) for r in spark.read.parquet(out).collect()} == {("a", 9), ("b", 2)}
    read = spark.createDataFrame([("p", "h", "docx", 3, "ok"), ("q", "h", "", 0, "error")], "path string, sha256 string, method string, n_chars int, status string")
    S.append_index(read, str(tmp_path / "index"))
    S.append_index(read, str(tmp_path / "index"))
    assert spark.read.json(str(tmp_path / "index")).count() == 1  # the second run finds it there
