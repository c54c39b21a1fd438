"""Reading values out of text: input, expected."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from veritab.functions import text as X, values as V


def read(spark, fn, inputs):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(inputs)], "i int, s string")
    return [r.out for r in df.select("i", fn(F.col("s")).alias("out")).orderBy("i").collect()]


DATES = [  # each notation, two and four digits, ends of ranges, and what is no day
    ("2031/4/7", ["20310407"]),
    ("31.4.7 – 31.12.1", ["20310407", "20311201"]),
    ("2031년4월7일부터", ["20310407"]),
    ("31-04-07~9", ["20310407", "20310409"]),
    ("2031-04-07 (월) ~ 2031-04-08 (화), 9시간", ["20310407", "20310408"]),
    ("2031-04-07", ["20310407", "20310407"]),
    ("2031.02.31", ["20310231"]),
    ("2031년 4월", []),
    ("제7호", []),
    (unicodedata.normalize("NFD", "2031년 4월 7일"), ["20310407"]),
    ("２０３１.４.７", ["20310407"]),
    ("", []),
    (None, []),
]


def test_dates(spark):
    assert read(spark, V.dates_in, [s for s, _ in DATES]) == [d for _, d in DATES]


def test_months(spark):
    cases = [("2031-04", ["203104"]), ("2031/4 ~ 2031/6", ["203104", "203106"]), ("2031년 4월 7일", ["203104"]), ("2031-04-07", []), ("", [])]
    assert read(spark, V.months_in, [s for s, _ in cases]) == [m for _, m in cases]


def test_hours_and_numbers(spark):
    cases = [("15", 15.0), ("15.5H", 15.5), ("7시간, 8 h", 15.0), ("2×7H", None), ("", None), (None, None), ("1,500 h", 500.0), ("1,500", 1500.0), ("7 아니면 8", None)]  # a tagged piece starts after the comma
    assert read(spark, V.hours, [s for s, _ in cases]) == [h for _, h in cases]
    assert read(spark, V.single_number, ["모두 6명", "6 / 7", "여섯", "2,345.25"]) == [6.0, None, None, 2345.25]
    assert read(spark, lambda c: V.single_number(c, "시간"), ["31-04-07 ~ 31-04-11 (12시간)"]) == [12.0]


def test_name_count(spark):
    long = "가" * 31
    cases = [("한가온", 1), ("한가온 · 류다솜 / 문새벽", 3), ("Ines Maro VELT、 백하람;", 2), ("한가온, 12, 가, ,", 1), (f"{long}, {long[1:]}", 1), ("  ", 0), (None, 0)]
    assert read(spark, V.name_count, [s for s, _ in cases]) == [n for _, n in cases]


def test_roster_found_but_empty_is_unknown(spark):
    df = spark.sql("SELECT '찾음' AS s, array() AS n UNION ALL SELECT '찾음', array('가', ' ', '나') UNION ALL SELECT '명단없음', array('가')")
    got = [r.out for r in df.select(V.roster_count(F.col("s"), F.col("n").cast("array<string>")).alias("out")).collect()]
    assert got == [None, 2, None]


def test_isbn(spark):
    cases = [("978-0-306-40615-7", True), ("978-0-306-40615-8", False), ("0-306-40615-2", True), ("979-11-1234", None), ("X123456789", False), ("", None)]
    assert read(spark, V.isbn_valid, [s for s, _ in cases]) == [ok for _, ok in cases]


def test_term(spark):
    cases = [("2025-1", "2025-1"), ("2025학년도 1학기", "2025-1"), ("25-1", "2025-1"), ("봄학기", None), ("2025-12", None)]
    assert read(spark, V.term, [s for s, _ in cases]) == [t for _, t in cases]


def test_text_helpers(spark):
    assert read(spark, X.short_item, ["40시간 이상 여부", "참여인원 일치 (해당 시)", "계획서 제출여부", "확인", " 여부"]) == [
        "40시간 이상", "참여인원", "계획서", "확인", "여부"]
    assert read(spark, X.squeeze, ["a  \r\n\n\n\nb\t\nc　\n"]) == ["a\n\nb\nc"]
    assert read(spark, X.name_key, ["참여학생 (명)", unicodedata.normalize("NFD", "기 간"), "A·B"]) == ["참여학생(명)", "기간", "ab"]
    keys = read(spark, X.natural_key, ["section10", "section2", "a1b22", "007"])
    assert keys[1] < keys[0]
    garbled = ["검수기준.xlsx".encode().decode("latin-1"), "plain.txt", None]
    assert read(spark, X.repair_name, garbled) == ["검수기준.xlsx", "", None]


@pytest.mark.parametrize("form", ["NFC", "NFD"])
def test_nfc_matches_python(spark, form):
    words = [unicodedata.normalize(form, w) for w in ("한글 문서", "café ÅΩ", "plain", "ガ行")]
    assert read(spark, X.nfc, words) == [unicodedata.normalize("NFC", w) for w in words]
