"""One small workbook from cells to writes."""

import json

from veritab.operators.rules import HEADINGS
from veritab.plans import full_check

CHECKED = "FFFCE4D6"


def test_full_check(spark):
    rule_rows = [HEADINGS] + [
        ["1", "계획서 제출여부", "모형", "", "", "", "문서종류", "기업명", "있음"], ["2", "날인 여부", "사람"],
        ["3", "일시 일치", "계산", "날짜", "", "", "시작일 · 종료일", "일시", "같음"], ["4", "시간 일치", "계산", "수", "", "", "총시간", "시간", "같음"],
    ]
    rule_cells = [("b", "⑤인턴십", 2 + i, 1 + j, v) for i, r in enumerate(rule_rows) for j, v in enumerate(r) if v]
    head = {1: "순번", 2: "참여기관", 3: "일시", 4: "총시간(00H)"}
    checks = {5: "계획서 제출여부", 6: "날인 여부", 7: "일시 일치", 8: "시간 일치", 9: "비고"}
    cells = [("w", "인턴십", 3, col, v, "", "") for col, v in head.items()] + [("w", "인턴십", 3, col, v, CHECKED, "solid") for col, v in checks.items()]
    data = {4: ("가나㈜", "24-06-03 ~ 24-06-16", "40"), 5: ("다라㈜", "24-07-08 ~ 24-07-19", "40"), 6: ("가나㈜", "", "40"), 7: ("마바㈜", "2024-07", "8H×5일")}
    for row, vals in data.items():
        cells += [("w", "인턴십", row, 2 + i, v, "", "") for i, v in enumerate(vals) if v]
    cells += [("w", "인턴십", 8, 1, "5", "", ""), ("w", "인턴십", 5, 9, "손글씨\n[시간 일치] 옛말", "", "")]

    def answer(tag, start, end, hours, verdict="O", why="표제"):
        return {"맺은파일": [tag] if tag else [], "맺은근거": "같음", "확신": "높음", "값": {"시작일": start, "종료일": end, "총시간": hours}, "v1": {"판정": verdict, "출처": tag or "없음", "근거": why, "비고": ""}}

    body = {"줄": {
        "r4": answer("file_01", "24년 06월 03일", "24년 06월 16일", "40H"), "r5": answer("file_02", "24년 07월 15일", "24년 07월 26일", "32", "X"),
        "r6": answer("file_01", "", "", "40"), "r99": answer("file_01", "", "", ""), "r7": answer("", "", "", ""),
    }}
    df = spark.createDataFrame
    out = full_check.run(
        df(cells, "wb string, sheet string, row int, col int, value string, fill_rgb string, pattern string"),
        df([], "wb string, sheet string, r1 int, r2 int, c1 int, c2 int"), df([("w", 0, "인턴십")], "wb string, ord int, title string"),
        df(rule_cells, "wb string, sheet string, row int, col int, value string"),
        df([("b", 0, "기업명", "참여기관 · 기관명"), ("b", 1, "시간", "시간(00H)")], "wb string, ord int, rep string, alias_text string"),
        df([("w", "인턴십", i, f"{i}.pdf") for i in (1, 2, 3)], "wb string, sheet string, ord int, name string"),
        df([("w", "인턴십", 1, 0, json.dumps(body, ensure_ascii=False)), ("w", "인턴십", 2, 1, '{"줄": {"r04": {}}}'), ("w", "인턴십", 3, 1, "cut off {")], "wb string, sheet string, ord int, batch int, body string"),
    )
    got = {(r.row, r.item_no): r.verdict for r in out.judged.collect()}
    P, X, U, B = "PASS", "FAIL", "UNDETERMINED", "BLANK"
    assert got == {
        (4, 1): P, (4, 2): U, (4, 3): P, (4, 4): P, (5, 1): X, (5, 2): U, (5, 3): X, (5, 4): X,
        (6, 1): U, (6, 2): U, (6, 3): B, (6, 4): P, (7, 1): U, (7, 2): U, (7, 3): U, (7, 4): U,
    }
    signals = {(r.code, r.detail) for r in out.signals.collect()}
    assert ("unknown row", "99") in signals and ("borrowed evidence", "6") in signals and ("unused file", "3.pdf") in signals
    assert ("row in unknown columns only", "8") in signals
    assert {("answer not readable", "no row number · r04"), ("answer not readable", "no readable rows · "), ("file used by several rows", "1.pdf 4"), ("file used by several rows", "1.pdf 6")} <= signals
    writes = {(r.row, r.col): r.value for r in out.writes.collect()}
    assert writes[4, 7] == P and writes[5, 7] == X and writes[6, 7] is None
    assert writes[5, 9].startswith("손글씨\n") and "옛말" not in writes[5, 9] and "[시간 일치]" in writes[5, 9]
