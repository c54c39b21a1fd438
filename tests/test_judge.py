"""Verdict tables for each kind of computed check."""

import pytest
from pyspark.sql import functions as F

from veritab.functions.rulebook import calc_method
from veritab.functions.text import split_list
from veritab.catalog import judging as Q
from veritab.catalog import reporting as O
from veritab.catalog.registry import Source
from veritab.operators import judge as J
from veritab.session import tune

P, X, U, B = J.PASS, J.FAIL, J.UNDETERMINED, J.BLANK
CLAIM = ("map<string,string>", "struct<status:string,names:array<string>>")


def run(spark, calc, cases, fields="", cols="값", item="날짜 일치"):
    """cases: (vals, ext, roster, links, prior)."""
    rules = spark.createDataFrame([("s", 9, item, "계산", calc, fields, cols)], "sheet string, item_no int, item string, judge string, calc string, f string, c string")
    rules = rules.select("sheet", "item_no", "item", "judge", calc_method(F.col("calc")).alias("calc"), split_list(F.col("f")).alias("extract_fields"), split_list(F.col("c")).alias("claim_cols"))
    rows = [("s", i, v, e, r, l, p) for i, (v, e, r, l, p) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"sheet string, row int, vals {CLAIM[0]}, ext {CLAIM[0]}, roster {CLAIM[1]}, links array<string>, prior map<int,string>")
    return [r.verdict for r in J.judge(df, rules, ["sheet"]).orderBy("row").collect()]


def test_duration(spark):
    """Whole months: the day of the month decides, a year's end does not; one date is no period."""
    table = {"2031.02.10 ~ 2031.05.10": P, "2031.02.10 ~ 2031.05.09": X, "2030-12-15 ~ 2031-03-20": P, "2031/01/31-2031/02/28": X, "2031년 2월": U, "  ": B, "2031.02.10": U}
    got = run(spark, "기간 ≥ 3개월", [({"값": t}, {}, None, [], {}) for t in table])
    assert dict(zip(table, got)) == table


def test_threshold(spark):
    """At the limit, just below, sums of tagged pieces, and what cannot be read."""
    table = {"15": P, "14.5": X, "15.0 H": P, "9h 그리고 6h": P, "7시간 + 7시간": X, "3 x 5": U, "열다섯": U, "": U}
    got = run(spark, "값 ≥ 15", [({}, {"합계": t}, None, ["f1"], {}) for t in table], fields="합계")
    assert dict(zip(table, got)) == table


def test_dates(spark):
    table = [
        ("2031-04-07 ~ 2031-04-11", "2031.4.7", "2031.4.11", P), ("2031-04-07 ~ 2031-04-11", "2031.4.8", "2031.4.11", X),
        ("31/04/07~11", "2031년 4월 7일", "2031년 4월 11일", P), ("2031-04-07", "4월쯤", "", U), ("", "2031-04-07", "2031-04-11", B),
        ("2031년 4월", "2031-04-30", "", P), ("2031년 4월", "2031-05-01", "", X), ("2031-04-07 ~ 2031-05-11", "2031-04", "", P), ("2031-04-07 ~ 2031-04-11", "2031-04-07", "", U),
    ]
    got = run(spark, "날짜", [({"값": c}, {"부터": a, "까지": b}, None, ["f1"], {}) for c, a, b, _ in table], fields="부터 · 까지")
    assert got == [v for *_, v in table]


def test_count_of_names(spark):
    table = [("2", "한가온/류다솜", P), ("2", "한가온\n류다솜\n77", P), ("1", "한가온; 류다솜", X), ("0", "", B), ("", "한가온", B), ("두 명", "한가온, 류다솜", U)]
    got = run(spark, "이름개수 · 이름칸=적힌 이름", [({"값": n, "적힌 이름": s}, {}, None, [], {}) for n, s, _ in table])
    assert got == [v for *_, v in table]


def test_numbers_and_roster(spark):
    roster = lambda status, *names: (status, list(names))
    cases = [
        ("3", {}, roster("찾음", "가", "나", "다"), P), ("4", {}, roster("찾음", "가", "나"), X), ("4", {}, roster("명단없음"), U),
        ("4", {"참여인원수": "참여학생 4명"}, None, P), ("4", {}, roster("찾음"), U),
    ]
    rows = [({"값": n}, e, r, ["f"], {}) for n, e, r, _ in cases]
    assert run(spark, "수", rows, fields="참여인원수 · 참여명단", item="참여학생 수 일치") == [v for *_, v in cases]
    # people never stand in for hours where the rule does not list the roster
    assert run(spark, "수", [({"값": "40"}, {}, roster("찾음", "가"), ["f"], {})], fields="총시간", item="시간 일치") == [U]


def test_lists_and_objects_are_no_scalars(spark):
    """An empty list counts nobody, and a list or object never hides the value behind it."""
    one = lambda n, ext, fields: run(spark, "수", [({"값": n}, ext, None, ["f1"], {})], fields=fields, item="참여 인원")[0]
    assert one("1", {"참여명단": "[]"}, "참여명단") == U
    assert [one(n, {"참여명단": '["한가온", " ", "류다솜"]'}, "참여명단") for n in "23"] == [P, X]
    assert one("6", {"문서": '["a", "b"]', "인원": "6"}, "문서 · 인원") == P
    assert run(spark, "값 ≥ 15", [({}, {"문서": '{"이름": "9"}', "합계": "15"}, None, ["f1"], {})], fields="문서 · 합계") == [P]


def test_one_row_answered_twice_keeps_the_first_verdict(spark):
    said = spark.createDataFrame([("s", 1, 2, "PASS"), ("s", 1, 2, "FAIL"), ("s", 1, 3, "FAIL")], "sheet string, row int, item_no int, verdict string")
    assert J.prior_verdicts(said, ["sheet"]).collect()[0].prior in ({2: "PASS", 3: "FAIL"}, {2: "FAIL", 3: "FAIL"})


def test_isbn_and_term(spark):
    assert run(spark, "ISBN 같음", [({"값": "978-0-306-40615-7"}, {"ISBN": "9780306406157"}, None, ["f"], {}), ({"값": "978-0-306-40615-7"}, {"ISBN": "978-0-13-110362-8"}, None, ["f"], {})]) == [P, X]
    cases = [("2025-1", "2025학년도 1학기", P), ("25-1", "2025-1", P), ("2025-1", "2025학년도 2학기", X), ("2025-1", "봄학기", U)]
    assert run(spark, "학기", [({"값": a}, {"학기": b}, None, ["f"], {}) for a, b, _ in cases]) == [v for *_, v in cases]


@pytest.mark.parametrize("prior,verdict", [("UNDETERMINED", B), ("FAIL", B), ("PASS", P), (None, P)])
def test_predecessor(spark, prior, verdict):
    row = ({"값": "2024-05-03"}, {"일시": "2024년 5월 3일"}, None, ["f"], {2: prior} if prior else {})
    assert run(spark, "날짜 · 앞선#2", [row], fields="일시") == [verdict]


def test_no_link_no_evidence_verdict(spark):
    assert run(spark, "값 ≥ 40", [({}, {"총시간": "40"}, None, [], {})], fields="총시간") == [U]
    assert run(spark, "ISBN 유효", [({"값": "0-306-40615-2"}, {}, None, [], {})]) == [P]
    assert run(spark, "", [({"값": "1"}, {}, None, ["f"], {})]) == [U]


def test_verdicts_alone_are_the_same_verdicts(spark):
    from veritab.catalog import judging as Q
    from veritab.catalog.registry import Source

    t = Source(spark, "/root/testdata/sf0.001")
    key = lambda df: sorted(map(str, df.select("wb", "sheet", "row", "item_no", "verdict").collect()))
    whole = J.judge(Q.cases(t), Q.rules(t), Q.SHEET, carry=("wb",))
    short = J.judge(Q.cases(t), Q.rules(t), Q.SHEET, carry=("wb",), parts=("verdict",))
    assert key(whole) == key(short) and short.filter("rationale IS NOT NULL OR remark IS NOT NULL").count() == 0


def test_a_grid_judges_what_it_shows(spark):
    """The same verdicts as of all items, words only where a note is shown."""
    t = Source(tune(spark), "/root/testdata/sf0.001")
    shown = {(r.row, r.item_no): (r.verdict, r.rationale) for r in O.judged(t, items=O.GRID_ITEMS, worded=O.NOTED).collect()}
    whole = {(r.row, r.item_no): (r.verdict, r.rationale) for r in O.judged(t).collect()}
    assert {i for _, i in shown} == set(O.GRID_ITEMS) and len(shown) == sum(i in O.GRID_ITEMS for _, i in whole)
    assert all(whole[k][0] == v and (w is None if k[1] in (4, 5, 9) else w == whole[k][1]) for k, (v, w) in shown.items())
    noted = O.judged(t, items=O.GRID_ITEMS, worded=(5,)).filter("item_no IN (5, 9)").collect()
    assert {r.item_no for r in noted if r.rationale} == {5} and all(r.rationale == whole[r.row, 5][1] for r in noted if r.item_no == 5)


def test_remarks_that_no_query_shows_are_not_made(spark):
    t = Source(tune(spark), "/root/testdata/sf0.001")
    said = Q.verdicts(t, 4, 5, 9)
    assert said.filter("remark IS NOT NULL").isEmpty()
    whole = J.judge(Q.cases(t), Q.rules(t).filter("item_no IN (4, 5, 9)"), Q.SHEET).drop("remark")
    assert sorted(map(str, said.drop("remark").collect())) == sorted(map(str, whole.collect()))


def test_code_that_the_jvm_never_compiles_is_not_run(spark):
    """A method of more than 8000 bytes of code runs interpreted for ever."""
    assert int(tune(spark).conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
