"""Derived input tables as SQL text that Spark and DuckDB both understand.

The given tables hold no claims, answers, worksheets or rules. Each entry of ``TABLES``
derives one such table from them, row by row, so its size follows the data. Names in
braces are the tables it reads.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from veritab.session import shared_folder

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

TABLES: dict[str, str] = {}


def case(expr: str, *options: str, other: str | None = None) -> str:
    """``CASE expr WHEN 0 THEN … WHEN 1 THEN …``."""
    whens = " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options))
    return f"CASE {expr} {whens}" + (f" ELSE {other}" if other else "") + " END"


def text(expr: str) -> str:
    return f"cast({expr} as string)"


def div(a: str, b: int) -> str:
    return f"cast(floor(({a}) / {b}.0) as bigint)"


def _name(i: str) -> str:
    return case(f"({i}) % 5", "'한가온'", "'류다솜'", "'문새벽'", "'Ines Maro VELT'", "'백하람'")


def _isbn13_check(base: str) -> str:
    terms = " + ".join(
        f"cast(substr({base}, {i}, 1) as int) * {1 if i % 2 else 3}" for i in range(1, 13)
    )
    return f"((10 - ({terms}) % 10) % 10)"


def _isbn10_check(base: str) -> str:
    terms = " + ".join(f"cast(substr({base}, {i}, 1) as int) * {11 - i}" for i in range(1, 10))
    return f"((11 - ({terms}) % 11) % 11)"


def _ymd(d: str, y: str = "", sep1: str = "-", sep2: str = "-", end: str = "") -> str:
    year = f"substr({d}, 3, 2)" if y == "yy" else f"substr({d}, 1, 4)"
    tail = f", '{end}'" if end else ""
    return f"concat({year}, '{sep1}', substr({d}, 6, 2), '{sep2}', substr({d}, 9, 2){tail})"


# --- claims and evidence, one row per order ---------------------------------------------

TABLES["claim_base"] = f"""
SELECT o_orderkey AS k,
       concat('W', {text(div('o_orderkey', 800))}) AS wb,
       concat('S', {text('o_orderkey % 8')}) AS sheet,
       {div('o_orderkey % 800', 8)} AS rank,
       c_name AS company, c_mktsegment AS segment,
       {text('cast(o_orderdate as date)')} AS d1,
       {text('cast(o_orderdate as date) + cast(o_orderkey % 150 as int)')} AS d2,
       {text('cast(o_orderdate as date) + 3')} AS d1late,
       1 + {div('o_orderkey', 3)} % 4 AS n_names,
       lpad({text('(o_orderkey * 7919) % 1000000000')}, 9, '0') AS base9
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey
"""

_sep = case(f"{div('k', 4)} % 4", "', '", "' · '", "';'", "chr(10)")
_pieces = ", ".join([
    _name("k"), "CASE WHEN n_names > 1 THEN company END",
    f"CASE WHEN n_names > 2 THEN {_name('k + 2')} END",
    "CASE WHEN n_names > 3 THEN concat('Park ', segment) END",
])
_b12 = "concat('978', base9)"
_good13 = f"concat({_b12}, {text(_isbn13_check(_b12))})"
_c10 = _isbn10_check("base9")
_good10 = f"concat(base9, CASE WHEN {_c10} = 10 THEN 'X' ELSE {text(_c10)} END)"

TABLES["claims"] = f"""
SELECT k, wb, sheet, k AS row, rank, company,
       {case('k % 6',
             f"concat({_ymd('d1', sep1='.', sep2='.')}, '-', {_ymd('d2', sep1='.', sep2='.')})",
             f"concat({_ymd('d1', 'yy')}, ' ~ ', {_ymd('d2', 'yy')})",
             _ymd('d1', sep1='년 ', sep2='월 ', end='일'),
             f"concat({_ymd('d1', 'yy')}, '~', substr(d2, 9, 2))",
             "substr(d1, 1, 7)", "''")} AS period,
       {case('k % 7', "'40'", "'32시간'", "'(20H)+(20H)'", "'8H×5일'", "'1,200 H'", "'3 또는 5'", "''")} AS hours,
       CASE WHEN k % 17 = 0 THEN '' WHEN k % 13 = 0 THEN '셋'
            WHEN k % 5 = 4 THEN {text('n_names + 1')} ELSE {text('n_names')} END AS headcount,
       concat(concat_ws({_sep}, {_pieces}), CASE WHEN k % 9 = 0 THEN concat({_sep}, '123', {_sep}, 'A') ELSE '' END) AS names,
       CASE WHEN k % 19 = 0 THEN ''
            WHEN k % 11 = 0 THEN base9
            WHEN k % 23 = 0 THEN CASE WHEN k % 3 = 0 THEN concat(base9, '-', 'X') ELSE {_good10} END
            WHEN k % 3 = 0 THEN concat({_b12}, {text(f'({_isbn13_check(_b12)} + 1) % 10')})
            WHEN k % 2 = 0 THEN concat('978-', substr(base9, 1, 3), '-', substr(base9, 4, 6), '-', {text(_isbn13_check(_b12))})
            ELSE {_good13} END AS isbn,
       {case('k % 4', "concat(substr(d1, 1, 4), '-1')", "concat(substr(d1, 1, 4), '학년도 2학기')",
             "concat(substr(d1, 3, 2), '-2')", "'봄학기'")} AS term
FROM {{claim_base}}
"""

TABLES["evidence"] = f"""
SELECT k, k % 10 AS fault,
       CASE WHEN k % 10 = 3 THEN '' WHEN k % 10 = 2 THEN substr(d1, 1, 7)
            WHEN k % 10 = 0 THEN {_ymd('d1late', sep1='.', sep2='.')}
            WHEN k % 2 = 0 THEN {_ymd('d1', sep1='.', sep2='.')}
            ELSE {_ymd('d1', 'yy', sep1='년 ', sep2='월 ', end='일')} END AS ev_start,
       CASE WHEN k % 10 IN (1, 2, 3) OR k % 6 = 2 THEN '' ELSE {_ymd('d2')} END AS ev_end,
       {case('k % 11', "''", "'40'", "'(20H)+(20H)'", "'8H×5일'", "'총 32시간'",
             other=case('k % 7', "'40'", "'32시간'", "'(20H)+(20H)'", "'8H×5일'", "'1,200 H'", "'3 또는 5'", "''"))} AS total_hours,
       {case('k % 6', "''", f"concat('참여학생 ', {text('n_names')}, '명')", "''", text('n_names'), "'여럿'",
             f"concat({text('n_names')}, '명 또는 9명')")} AS ev_headcount,
       {case('k % 10', "'찾음'", "'찾음'", "'찾음'", "'찾음'", "'찾음'", "'찾음'", "'명단없음'", "'글자깨짐'", other="'찾음'")} AS roster_status,
       CASE WHEN k % 10 = 5 THEN '' ELSE concat_ws('|', {_pieces}) END AS roster_names,
       CASE WHEN k % 10 = 3 THEN '' WHEN k % 10 = 0 THEN '9780306406157' ELSE {_good13} END AS ev_isbn,
       {case('k % 5', "concat(substr(d1, 1, 4), '학년도 1학기')", "concat(substr(d1, 1, 4), '-2')",
             "concat(substr(d1, 1, 4), '-2')", "'미정'", "''")} AS ev_term,
       CASE WHEN k % 10 = 4 THEN '' ELSE concat('doc_', {text('k % 500')}, '.pdf') END AS links,
       {case('k % 10', "'PASS'", "'PASS'", "'PASS'", "'PASS'", "'PASS'", "'PASS'", "'PASS'", "'FAIL'", "'UNDETERMINED'", "''")} AS prior2
FROM {{claim_base}}
"""

# Model verdicts: item 1 always, item 2 as planted, item 5 one that code replaces.
TABLES["model_said"] = f"""
SELECT wb, sheet, k AS row, item_no, CASE item_no WHEN 1 THEN '계획서 제출여부' WHEN 2 THEN '일시 확인' ELSE '일시 일치' END AS item,
       CASE WHEN item_no <> 2 THEN 'PASS' WHEN k % 10 = 7 THEN 'FAIL' WHEN k % 10 = 8 THEN 'UNDETERMINED' ELSE 'PASS' END AS verdict
FROM (SELECT *, CASE each_item WHEN 3 THEN 5 ELSE each_item END AS item_no FROM (SELECT *, EACH(1, 3) AS each_item FROM {{claim_base}}) x) y
WHERE item_no <> 2 OR k % 10 <> 9
"""

_ITEMS = [
    # item_no, item, judge, method, extract fields, claim columns
    (1, "계획서 제출여부", "모형", "", "", ""),
    (2, "일시 확인", "모형", "", "", ""),
    (3, "날인 여부", "사람", "", "", ""),
    (4, "3개월 이상 여부", "계산", "기간 ≥ 3개월", "", "기간"),
    (5, "일시 일치", "계산", "날짜", "시작일 · 종료일", "기간"),
    (6, "시간 일치", "계산", "수", "총시간", "시간"),
    (7, "참여학생 수 일치", "계산", "수", "참여인원수 · 참여명단", "참여인원"),
    (8, "참여인원 일치 (해당 시)", "계산", "이름개수 · 이름칸=참여학생명", "", "참여인원"),
    (9, "40시간 이상 여부", "계산", "값 ≥ 40", "총시간", ""),
    (10, "ISBN 유효 여부", "계산", "ISBN 유효", "", "ISBN"),
    (11, "ISBN 일치", "계산", "ISBN 같음", "ISBN", "ISBN"),
    (12, "학기 일치", "계산", "학기", "학기", "학기"),
    (13, "개최일 확인", "계산", "날짜 · 앞선#2", "시작일 · 종료일", "개최일 · 기간"),
    (14, "기타 확인", "계산", "", "", ""),
]
TABLES["judge_rules"] = (
    "SELECT * FROM (VALUES "
    + ", ".join(
        "('S%d', %d, '%s', '%s', '%s', '%s', '%s')" % (s, *item) for s in range(8) for item in _ITEMS
    )
    + ") AS t(sheet, item_no, item, judge, calc_text, extract_text, claim_text)"
)
ITEMS = _ITEMS


# --- rule books, one rule row per part: 100 parts are a workbook of four sheets ----------

RULE_SHEETS = ["③프로젝트", "④세미나", "⑤인턴십", "⑥교재"]
RULE_ROWS = [
    # key cell, item, judge, method, extract fields, claim columns, rule text
    ("1", "3개월 이상 여부", "계산", "기간 ≥ 3개월", "", "기간", "길이"),
    ("2", "일시 일치 (연월일)", "계산", "날짜", "시작일 · 종료일", "일시", "같은 날"),
    ("3", "날인 여부", "사람", "—", "", "", ""),
    ("4", "참여학생 수 일치", "계산", "수", "참여인원수 · 참여명단", "참여인원 · 인원", "같은 수"),
    ("5", "40시간 이상 여부", "계산", "값 ≥ 40 시간", "총시간 · 시작일", "시간", "마흔"),
    ("6", "참여인원 일치", "계산", "이름개수 · 이름칸=참여학생명", "없음", "참여인원 | 참여학생명", "센다"),
    ("7", "ISBN 유효", "계산", "ISBN 유효", "—", "ISBN", "검증"),
    ("8", "ISBN 일치", "계산", "ISBN 같음", "ISBN", "ISBN · isbn", "같음"),
    ("9", "학기 확인", "계산", "학기", "학기", "학기", "같음"),
    ("10", "개최일 확인", "계산", "날짜 · 앞선#2", "일시_연월일", "개최일 · 일시", "같은 날"),
    ("11", "계획서 제출여부", "모형", "", "문서종류", "기업명 · 과제명", "있음"),
    ("12", "", "모형", "", "", "", "빈 이름"),
    ("11", "결과보고서 제출여부", "모형", "", "", "기업명", "번호 겹침"),
    ("13", "계획서  제출여부", "모형", "", "", "과제명", "이름 겹침"),
    ("14", "요약서 포함 여부", "기계", "", "", "", "모르는 주체"),
    ("15", "사진 제시 여부", "계산", "눈으로", "", "", "셈법 없음"),
    ("16", "서명 확인", "모형", "", "", "", ""),
    ("17", "명단 확인", "모형", "", "참여자명단 · 참여인원", "참여학생명", "닮은 이름"),
    ("18", "참여기관 확인", "모형", "", "기관 · 총시간", "참여기관", "겹치는 낱말"),
    ("", "", "", "", "", "", ""),
    ("19", "교재명 확인", "모형", "", "교재명", "교재명", "같음"),
    ("범례", "O 맞음", "", "", "", "", ""),
    ("20", "표 밖", "모형", "", "", "", "끝난 뒤"),
    ("21", "표 밖 둘", "모형", "", "", "", "끝난 뒤"),
    ("", "덧붙임", "", "", "", "", ""),
]
ALIAS_ROWS = [
    ("기업명", "참여기관 · 참여기관(기업) · 기관명 | 업체명"), ("참여인원", "인원 · 참여학생(명) · 참여 인원"),
    ("참여학생명", "참여학생 · 성명"), ("일시", "기간 · 기 간 · 일 시"), ("시간", "시간(00H) · 총시간"),
    ("ISBN", "ISBN번호 · isbn"), ("학기", "개설학기"), ("과제명", "프로젝트명 · 과제명"),
    ("기업 명", "회사명"), ("저자", "—"),
]


def _pick(i: str, rows: list[tuple], column: int) -> str:
    return case(i, *[f"'{r[column]}'" for r in rows])


TABLES["rule_rows"] = f"""
SELECT k, wb, wbno, sheet, i, i + 4 + wbno % 3 AS row,
       {_pick('i', RULE_ROWS, 0)} AS key_cell, {_pick('i', RULE_ROWS, 1)} AS item,
       {_pick('i', RULE_ROWS, 2)} AS judge, {_pick('i', RULE_ROWS, 3)} AS calc_text,
       CASE WHEN wbno % 3 = 1 AND i = 3 THEN '참여인원 수' ELSE {_pick('i', RULE_ROWS, 4)} END AS extract_text,
       {_pick('i', RULE_ROWS, 5)} AS claim_text, {_pick('i', RULE_ROWS, 6)} AS rule_text
FROM (SELECT p_partkey AS k, {div('p_partkey', 100)} AS wbno, concat('W', {text(div('p_partkey', 100))}) AS wb,
             p_partkey % 25 AS i, {case(div('p_partkey % 100', 25), *[f"'{s}'" for s in RULE_SHEETS])} AS sheet
      FROM {{part}}) t
"""

HEADINGS = ["#", "검수 항목", "판정주체", "셈법", "대조 축", "증빙 문서", "추출 필드", "엑셀 대조 열",
            "판정 규칙", "O", "X", "확인 불가", "공란", "비고 문구"]

_DATA = {1: "key_cell", 2: "item", 3: "judge", 4: "calc_text", 7: "extract_text", 8: "claim_text", 9: "rule_text"}
# slots 1-14 are the columns of a rule row; 15-28 the headings and 29-32 the other cells,
# once per sheet or workbook; one heading is misspelt in every fourth workbook
_slots = " ".join(
    [f"WHEN {i} THEN {n}" for i, n in _DATA.items()]
    + [f"WHEN {14 + i} THEN " + ("CASE WHEN wbno % 4 = 1 THEN '방법' ELSE '판정 규칙' END" if i == 9 else f"'{h}'")
       for i, h in enumerate(HEADINGS, 1)]
    + ["WHEN 29 THEN concat('검수 별첨 ', cast(wbno as string))", "WHEN 30 THEN '적어 둔 것'", "WHEN 31 THEN '#'",
       "WHEN 32 THEN CASE WHEN wbno % 5 = 4 THEN '공통 값 없음' ELSE '공통으로 뽑을 값: 문서번호 · 총시간 · 작성일' END"]
)
TABLES["rule_cells"] = f"""
SELECT wb, CASE WHEN slot IN (30, 31) THEN '메모' WHEN slot = 32 THEN '개요' ELSE sheet END AS sheet,
       CASE WHEN slot <= 14 THEN row WHEN slot <= 28 THEN 3 + wbno % 3 WHEN slot = 31 THEN 14 WHEN slot = 32 THEN 2 ELSE 1 END AS row,
       CASE WHEN slot <= 14 THEN slot WHEN slot <= 28 THEN slot - 14 ELSE 1 END AS col, value
FROM (SELECT *, CASE slot {_slots} ELSE '' END AS value FROM (SELECT *, EACH(1, 32) AS slot FROM {{rule_rows}}) x) y
WHERE value <> '' AND (slot <= 14 OR (i = 0 AND (slot <= 29 OR sheet = '④세미나')))
"""

TABLES["alias_cells"] = """
SELECT wb, '열 낱말' AS sheet, CASE WHEN slot < 3 THEN ord + 3 + 9 * late ELSE 2 + 9 * late END AS row, CASE slot WHEN 3 THEN 1 ELSE slot END AS col,
       CASE slot WHEN 1 THEN rep WHEN 2 THEN alias_text ELSE '대표  이름' END AS value
FROM (SELECT *, CASE WHEN wb IN ('W3', 'W17') THEN 1 ELSE 0 END AS late, EACH(1, 3) AS slot FROM {alias_rows}) t
WHERE slot < 3 OR ord = 0
UNION ALL SELECT wb, '열 낱말', 1, 1, '학교들이 쓰는 이름' FROM {alias_rows} WHERE ord = 0
"""

TABLES["alias_rows"] = f"""
SELECT wb, ord, {_pick('ord', ALIAS_ROWS, 0)} AS rep, {_pick('ord', ALIAS_ROWS, 1)} AS alias_text
FROM (SELECT concat('W', {text(div('p_partkey', 10))}) AS wb, p_partkey % 10 AS ord FROM {{part}}) t
"""


# --- answers of the linking model, one per order, with planted faults ---------------------

def _tag(n: str) -> str:
    return f"concat('file_', lpad({text(n)}, 2, '0'))"


TABLES["sheet_rows"] = f"""
SELECT k, wb, sheet, k AS row, rank, {div('rank', 8)} AS batch, {div('rank', 3)} AS grp,
       concat('C', {text(div('rank', 3))}) AS company, '40' AS hours,
       {case('rank % 3', f"concat('P', {text('rank')})", "''", f"concat('Q', {text('rank')})")} AS period,
       CASE WHEN rank % 3 = 1 THEN CASE WHEN k % 5 = 0 THEN '8' ELSE '' END ELSE '7' END AS heads
FROM {{claim_base}}
"""

# Attempts at each batch, by its number: answered at once; a row missing, then answered; blank to the end; a row
# missing to the end; blank once so far; blank, then answered, and one more that nobody needs.
TABLES["attempts"] = """
SELECT wb, sheet, batch, attempt, CASE WHEN p = 5 AND attempt = 3 THEN row + 1000000000 ELSE row END AS row,
       CASE WHEN p = 2 OR (p IN (4, 5) AND attempt = 1) THEN '' ELSE 'file_01' END AS tags,
       CASE WHEN p = 2 AND attempt = 2 THEN '  ' ELSE '' END AS link_reason,
       CASE WHEN p = 3 OR (p = 1 AND attempt = 1) THEN 'length' ELSE 'stop' END AS finish
FROM (SELECT *, batch % 6 AS p, EACH(1, 3) AS attempt FROM {sheet_rows}) t
WHERE attempt <= CASE p WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 3 END
  AND NOT ((p = 3 OR (p = 1 AND attempt = 1)) AND rank % 8 = 0)
"""

TABLES["sheet_files"] = """
SELECT wb, sheet, grp AS ord, concat('doc_', cast(k as string), '.pdf') AS name FROM {sheet_rows} WHERE rank % 3 = 0
"""

_base = _tag("grp + 1")
TABLES["answers"] = f"""
SELECT k, wb, sheet, 2 * k + again AS ord, CASE WHEN k % 31 = 0 THEN k + 1000000000 ELSE k END AS row, batch, rank,
       CASE WHEN shrug THEN '' WHEN k % 11 = 0 THEN '' WHEN k % 23 = 0 THEN concat({_base}, '|file_9999')
            WHEN k % 19 = 0 THEN concat({_base}, '|', {_base}) WHEN k % 43 = 0 THEN concat({_base}, '|', {_tag('grp + 2')})
            WHEN k % 47 = 0 THEN concat('doc_', {text('k - 8 * (rank % 3)')}, '.pdf') ELSE {_base} END AS tags,
       CASE WHEN shrug THEN '' WHEN k % 22 = 0 THEN '이름이 없어 특정 불가' WHEN k % 11 = 0 THEN '' ELSE '기간 같음' END AS link_reason,
       {case('(k + again) % 5', "'높음'", "'보통'", "'낮음'", "'못맺음'", "'모름'")} AS confidence,
       CASE WHEN k % 33 = 0 THEN '따로 확인' ELSE '' END AS memo,
       {case('k % 4', "'40'", "'32시간'", "''", "'8H×5일'")} AS total_hours,
       {case('k % 6', "'찾음'", "'찾음'", "'명단없음'", "'글자깨짐'", "'찾음'", "''")} AS roster_status,
       CASE WHEN k % 3 = 0 THEN '' ELSE '한가온|류다솜' END AS roster_names,
       CASE WHEN k % 5 < 2 THEN '' ELSE concat('참여학생 ', {text('k % 9')}, '명 (재직자를 포함한 전체 인원)') END AS heads_text,
       again
FROM (SELECT *, ({div('k', 64)} + k % 8) % 9 = 4 AS shrug, EACH(0, CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END) AS again
      FROM {{sheet_rows}} WHERE k % 37 <> 0) t
"""

TABLES["answer_judgements"] = f"""
SELECT k, wb, sheet, ord, row, batch, item_no, {case('(k + item_no) % 5', "'O'", "'X'", "'확인 불가'", "'공란'", "''")} AS said,
       CASE WHEN k % 7 = 0 THEN '없음' WHEN k % 17 = 0 THEN {_tag(div('rank', 3) + ' + 2')}
            WHEN item_no = 2 AND k % 3 = 0 THEN '' ELSE {_tag(div('rank', 3) + ' + 1')} END AS provenance,
       CASE WHEN (k + item_no) % 13 = 0 THEN '' WHEN k % 53 = 0 THEN repeat('근거 ', 80)
            WHEN k % 59 = 0 THEN '「붙임」 표제' ELSE '표제 p.1' END AS rationale,
       CASE WHEN k % 8 = 0 THEN '' WHEN k % 53 = 1 THEN repeat('비고 ', 80)
            WHEN k % 10 = 1 THEN concat('[', CASE WHEN item_no = 1 THEN '계획서 제출여부' ELSE '일시' END, '] [일 시] 다시 볼 것')
            WHEN k % 10 = 2 THEN '[다른 항목] 볼 것' ELSE '볼 것' END AS remark
FROM (SELECT *, EACH(1, 2) AS item_no FROM {{answers}}) t
"""

TABLES["unlinked_files"] = f"""
SELECT wb, sheet, batch, k AS ord, CASE WHEN k % 2 = 0 THEN {_tag('grp + 1')} ELSE concat('doc_', {text('k - 8 * (rank % 3)')}, '.pdf') END AS ref,
       concat('까닭 ', {text('k % 7')}) AS reason
FROM {{sheet_rows}} WHERE k % 5 < 2
"""

_pairs = lambda name, cols: ", ".join(f"'\"{c}\": \"', {v}, '\"'" for c, v in cols)
_judge = lambda n: (
    f"'\"v{n}\": {{{{\"판정\": \"', said{n}, '\", \"출처\": \"', prov{n}, '\", \"근거\": \"', why{n}, '\", \"비고\": \"', note{n}, '\"}}}}'"
)
_body = (
    "concat('\"맺은파일\": [', CASE WHEN tags = '' THEN '' ELSE concat('\"', replace(tags, '|', '\", \"'), '\"') END, "
    "'], \"맺은근거\": \"', link_reason, '\", \"확신\": \"', confidence, '\", \"메모\": \"', memo, "
    "'\", \"값\": {{\"총시간\": \"', total_hours, '\", \"참여명단\": {{\"상태\": \"', roster_status, '\", \"이름\": [', "
    "CASE WHEN roster_names = '' THEN '' ELSE concat('\"', replace(roster_names, '|', '\", \"'), '\"') END, ']}}}}, ', "
    + _judge(1) + ", ', ', " + _judge(2) + ")"
)
_side = lambda n: (
    f"j{n}.said AS said{n}, j{n}.provenance AS prov{n}, j{n}.rationale AS why{n}, j{n}.remark AS note{n}"
)
TABLES["answer_json"] = f"""
SELECT wb, sheet, ord, batch,
       CASE WHEN k % 10 = 0 THEN concat('{{{{"줄": [{{{{"행": ', cast(row as string), ', ', {_body}, '}}}}]}}}}')
            ELSE concat('{{{{"줄": {{{{"r', cast(row as string), '": {{{{"행": 7, ', {_body}, '}}}}}}}}}}}}') END AS body
FROM (SELECT a.*, {_side(1)}, {_side(2)} FROM {{answers}} a
      JOIN {{answer_judgements}} j1 ON j1.ord = a.ord AND j1.item_no = 1
      JOIN {{answer_judgements}} j2 ON j2.ord = a.ord AND j2.item_no = 2) t
"""


# --- worksheets, one data row per part, 40 parts a sheet and four sheets a workbook --------

CHECK_RGB = "FFFCE4D6"
_HEADERS = {1: "순번", 2: "참여기관(기업)", 3: "과제 구분", 4: "기 간", 5: "참여학생명", 9: "총 소요시수", 10: "계획서 제출여부",
            11: "일시 일치", 12: "비고", 13: "학교 의견", 15: "참여기관(기업)", 16: "자체 확인", 18: "DOI"}
_CHECKED = (10, 11, 12, 13, 14, 17)
_known = lambda v: f"CASE WHEN i % 13 = 12 THEN '' ELSE {v} END"
_VALUES = {
    1: "''", 2: _known("p_name"), 3: f"CASE WHEN i % 3 = 0 THEN {_known('p_brand')} ELSE '' END", 4: _known("p_type"),
    5: _known("'한가온 '"), 6: _known("CASE WHEN i % 4 > 0 THEN '류다솜' ELSE '' END"),
    7: _known("CASE WHEN i % 4 > 1 THEN 'Ines Maro VELT' ELSE '' END"), 8: _known("CASE WHEN i % 4 = 3 THEN '백하람' ELSE '' END"),
    9: text("p_size"), 10: "CASE WHEN i % 6 = 0 THEN 'O' ELSE '' END", 11: "''",
    12: "CASE i % 5 WHEN 0 THEN concat('[일시 일치] 다름', chr(10), '손으로 쓴 글 / [다른 것] 둠') WHEN 1 THEN '[계획서 제출여부] 없음' ELSE '' END",
    13: "CASE WHEN i % 7 = 0 THEN '의견' ELSE '' END", 15: _known("'뒤'"), 18: "''",
}
_title = case("s % 4", "'③프로젝트'", "'⑦ 세미나'", f"CASE WHEN {div('s', 4)} % 2 = 0 THEN '⑤인턴십 현황' ELSE '인턴십' END", "'별첨3 개설교과'")

TABLES["sheet_parts"] = f"""
SELECT *, {_title} AS sheet, concat('W', {text('wbno')}) AS wb,
       5 + i + CASE WHEN i >= 10 THEN 5 ELSE 0 END + CASE WHEN i >= 20 THEN 19 ELSE 0 END
       + CASE WHEN i >= 30 THEN 20 - s % 2 ELSE 0 END + CASE WHEN i >= 35 THEN 25 ELSE 0 END AS row
FROM (SELECT *, p_partkey % 40 AS i, {div('p_partkey', 40)} AS s, {div('p_partkey', 160)} AS wbno FROM {{part}}) t
"""
_slot_value = " ".join(
    [f"WHEN {k} THEN {v}" for k, v in _VALUES.items()] + [f"WHEN {20 + k} THEN '{v}'" for k, v in _HEADERS.items()]
    + ["WHEN 39 THEN '작성 안내'", "WHEN 40 THEN '빈칸은 두십시오'"]
)
TABLES["cells"] = f"""
SELECT wb, sheet, CASE WHEN slot <= 20 THEN row WHEN slot < 39 THEN 4 ELSE slot - 38 END AS row,
       CASE WHEN slot <= 20 THEN slot WHEN slot < 39 THEN slot - 20 ELSE 1 END AS col, value,
       CASE WHEN slot - 20 IN {_CHECKED} THEN '{CHECK_RGB}' ELSE '' END AS fill_rgb,
       CASE WHEN slot - 20 IN {_CHECKED} THEN 'solid' ELSE '' END AS pattern
FROM (SELECT *, CASE slot {_slot_value} ELSE '' END AS value FROM (SELECT *, EACH(1, 40) AS slot FROM {{sheet_parts}}) x) y
WHERE (slot <= 20 OR i = 0) AND (value <> '' OR slot - 20 IN {_CHECKED})
UNION ALL SELECT wb, '머리글 없음' AS sheet, 31 + i AS row, 2 AS col, p_name AS value, '' AS fill_rgb, '' AS pattern FROM {{sheet_parts}} WHERE i < 5 AND s % 4 = 0
"""
TABLES["merges"] = """
SELECT wb, sheet, min(row) AS r1, max(row) AS r2, 3 AS c1, 3 AS c2 FROM {sheet_parts} WHERE i < 39
GROUP BY wb, sheet, cast(floor(i / 3.0) as bigint)
UNION ALL SELECT wb, sheet, 4, 4, 5, 7 FROM {sheet_parts} WHERE i = 0
"""
GRID_ITEMS = [
    ("계획서 제출여부", "기업명|참여기관|참여기관(기업)"), ("일시 일치", "일시|기간"), ("참여인원 일치", "참여학생명"), ("구분 확인", "구분"),
    ("모호 항목", "참여"), ("없는 항목", "게재일자|발행일"), ("다시 기업", "기업명|참여기관|참여기관(기업)"), ("의견", ""), ("비고", ""),
]
TABLES["grid_items"] = f"""
SELECT wb, sheet, item_no, {case('item_no - 1', *[f"'{a}'" for a, _ in GRID_ITEMS])} AS item,
       {case('item_no - 1', *[f"'{b}'" for _, b in GRID_ITEMS])} AS claim_text
FROM (SELECT wb, sheet, EACH(1, {len(GRID_ITEMS)}) AS item_no FROM {{sheet_parts}} WHERE i = 0) t
"""
SHEET_TARGETS = ["③프로젝트", "④세미나", "⑤인턴십", "⑤현장실습", "별첨3 개설교과", "프로젝트 세미나"]
TABLES["sheet_titles"] = """
SELECT wb, s % 4 AS ord, sheet AS title FROM {sheet_parts} WHERE i = 0
UNION ALL SELECT wb, 3 + n, concat('현장실습 ', cast(n as string)) FROM (SELECT wb, EACH(1, 2) AS n FROM {sheet_parts} WHERE i = 0 AND s % 4 = 0) t
UNION ALL SELECT wb, 6, CASE wbno % 4 WHEN 0 THEN '별첨1. 명 단' WHEN 1 THEN '⑨별첨1' ELSE '별첨1 (참여 학생)' END FROM {sheet_parts} WHERE i = 0 AND s % 4 = 0 AND wbno % 4 < 3
UNION ALL SELECT wb, 7, '별첨1 명단 사본' FROM {sheet_parts} WHERE i = 0 AND s % 4 = 0 AND wbno % 8 = 4
"""
TABLES["sheet_targets"] = f"""
SELECT wb, {case('n - 1', *[f"'{x}'" for x in SHEET_TARGETS])} AS name
FROM (SELECT wb, EACH(1, {len(SHEET_TARGETS)}) AS n FROM {{sheet_parts}} WHERE i = 0 AND s % 4 = 0) t
"""
TABLES["roster_cells"] = f"""
SELECT wb, '별첨1 명단' AS sheet, CASE WHEN slot <= 3 THEN 2 + i ELSE 1 END AS row, CASE WHEN slot <= 3 THEN slot ELSE slot - 3 END AS col, value,
       '' AS fill_rgb, '' AS pattern
FROM (SELECT *, CASE slot WHEN 1 THEN {text('i')} WHEN 2 THEN CASE WHEN k % 11 = 0 THEN '7777' WHEN k % 13 = 0 THEN '김'
                WHEN k % 17 = 0 THEN c_name ELSE concat('학생', {text('k % 90')}) END
              WHEN 3 THEN CASE WHEN k % 3 = 0 THEN '' ELSE c_mktsegment END
              WHEN 4 THEN '순번' WHEN 5 THEN '참여 학생명' WHEN 6 THEN CASE WHEN wbno % 3 = 2 THEN '비고' ELSE '재직 구분' END END AS value
      FROM (SELECT *, EACH(1, 6) AS slot FROM (SELECT *, c_custkey AS k, c_custkey % 150 AS i, {div('c_custkey', 150)} AS wbno,
            concat('W', {text(div('c_custkey', 150))}) AS wb FROM {{customer}}) c) x) y
WHERE (slot <= 3 OR i = 0) AND value <> ''
"""


# --- evidence documents, files and pages ---------------------------------------------------

_nfd = "\u1112\u1161\u11ab\u1100\u1173\u11af"  # decomposed Hangul
_ext = case("doc_id % 8", "'.docx'", "'.hwpx'", "'.hwp'", "'.pdf'", "'.png'", "'.TXT'", "'.PDF'", "''")
# Every given document and turn stays whole; faults are planted in additional rows, whose ids
# follow those of the given ones.
FAULT = 1_000_000_000
_fault_text = case(
    "doc_id % 97", f"concat('{_nfd} {_nfd}', text)", "concat('ㄱㄴㄷ 한글 ㅏㅑ ', text)",
    "concat('줄 하나  ', chr(13), chr(10), chr(10), chr(10), chr(10), '줄 둘', chr(9), chr(10), text)", "''", "'   '",
    "concat(text, ' key sk-ABCDEFGHIJKLMNOPQRSTUVWX end')", "concat('AIza', repeat('x', 35), ' ', text)", "concat(text, ' -----BEGIN RSA PRIVATE KEY-----')",
    "concat('\"private_key\" : \"', repeat('a', 45), text)", "concat(text, ' -----BEGIN PRIVATE KEY----- sk-ABCDEFGHIJKLMNOPQRSTUVWX')", "text",
)
TABLES["all_docs"] = f"""
SELECT doc_id, source, lang, text FROM {{documents}}
UNION ALL
SELECT doc_id + {FAULT} AS doc_id, source, lang, {_fault_text} AS text FROM {{documents}} WHERE doc_id % 97 < 10
"""
TABLES["docs"] = f"""
SELECT doc_id, source, lang, doc_id AS ord,
       concat(CASE WHEN doc_id % 37 = 0 THEN '~$' WHEN doc_id % 41 = 0 THEN '.' ELSE '' END, '보고서 ', {text('doc_id % 120')},
              CASE doc_id % 9 WHEN 0 THEN ': 최종*본' WHEN 1 THEN concat(' ', repeat('긴 이름 ', 15)) WHEN 2 THEN concat('-', {text('doc_id % 7')}, '차') ELSE '' END, {_ext}) AS name,
       text
FROM {{all_docs}}
"""
TABLES["doc_pages"] = f"""
SELECT conv_id AS doc_id, turn + 1 AS page, text FROM {{conversations}}
UNION ALL
SELECT conv_id + {FAULT} AS doc_id, turn + 1 AS page,
       CASE WHEN conv_id % 7 = 0 THEN '스캔 쪽' WHEN conv_id % 11 = 0 THEN concat('{_nfd}{_nfd}{_nfd}{_nfd}', text)
            WHEN conv_id % 13 = 0 THEN concat('ㄱㄴㄷㄹ 가나 ', text) ELSE '  ' END AS text
FROM {{conversations}} WHERE conv_id % 7 = 0 OR conv_id % 11 = 0 OR conv_id % 13 = 0 OR conv_id % 5 = 0
"""
TABLES["files"] = f"""
SELECT doc_id AS ord, name, concat('/root ', source, CASE WHEN doc_id % 5 = 0 THEN '/하위/' ELSE '/' END, name) AS path, length(text) AS n_chars,
       CASE WHEN doc_id % 101 = 0 THEN false ELSE true END AS present, doc_id % 3 <> 0 AS layer_usable, doc_id % 4 = 0 AS layer_repaired,
       doc_id % 6 = 0 AS cached, doc_id % 5 <> 0 AS allow_ocr, 1 + doc_id % 4 AS pages, trim(text) = '' AS no_text
FROM {{docs}}
"""
TABLES["read_cache"] = """
SELECT doc_id AS ord, text, name, 'docx' AS method, length(text) AS chars, 1 AS pages FROM {docs} WHERE doc_id % 3 = 0
"""


# --- verdicts to be written into the worksheets ---------------------------------------------

TABLES["grid_verdicts"] = f"""
SELECT wb, sheet AS title, n AS item_no, i,
       CASE WHEN i = 38 THEN '연구실' WHEN s % 4 = 1 THEN '④세미나' ELSE sheet END AS sheet_name,
       CASE WHEN i = 37 THEN NULL ELSE row END AS row,
       {case('n - 1', "'계획서 제출여부'", "'일시 일치'", "'학교 의견'", "'총 소요시수'", "'인원'")} AS header,
       {case('n - 1', '10', '11', '13', '9')} AS col,
       CASE WHEN n = 5 THEN NULL ELSE {case('(i + n) % 4', "'PASS'", "'FAIL'", "'UNDETERMINED'", "'BLANK'")} END AS verdict,
       CASE WHEN n = 5 AND i % 3 > 0 THEN '' WHEN (i + n) % 4 IN (1, 2) OR n = 5 THEN concat('볼 것 ', {text('i % 4')}) ELSE '' END AS remark
FROM (SELECT *, EACH(1, 5) AS n FROM {{sheet_parts}}) t
"""


# --- rendering ---------------------------------------------------------------------------

def _needs(name: str) -> list[str]:
    return re.findall(r"(?<!\{)\{([a-z_]+)\}(?!\})", TABLES[name])


def order_of(names: list[str]) -> list[str]:
    """Derived tables that ``names`` need, each after what it reads."""
    out: list[str] = []

    def visit(n: str) -> None:
        if n in TABLES and n not in out:
            for m in _needs(n):
                visit(m)
            out.append(n)

    for n in names:
        visit(n)
    return out


def oracle(sql: str) -> str:
    """DuckDB text: every derived table that ``sql`` names in braces becomes a CTE."""
    needed = order_of(re.findall(r"\{([a-z_]+)\}", sql))
    plain = lambda s: re.sub(r"EACH\((.+?), (.+?)\)", r"unnest(generate_series(\1, \2))", re.sub(r"\{([a-z_]+)\}", r"\1", s))
    ctes = [f"{n} AS ({plain(TABLES[n]).replace('{{', '{').replace('}}', '}')})" for n in needed]
    body = plain(sql).strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


@lru_cache(maxsize=None)
def _sql(name: str) -> str:
    return re.sub(r"EACH\((.+?), (.+?)\)", r"explode(sequence(\1, \2))", TABLES[name])


# Given tables whose rows become dozens of cells each: a file of few bytes is one or two tasks, however many cells come of it.
DEALT = {"part": "p_partkey"}
TASK_ROWS = 20_000


def load(spark: SparkSession, sf_dir: str, name: str, known: dict | None = None) -> DataFrame:
    """A given or derived table as a lazy DataFrame; ``known`` keeps row counts and shared tables of one query."""
    known = {} if known is None else known
    if name in known:
        return spark.read.parquet(known[name])
    if name not in TABLES:
        return _dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"), name, known)
    return spark.sql(_sql(name), **{n: load(spark, sf_dir, n, known) for n in _needs(name)})


def _dealt(df: DataFrame, name: str, known: dict, rows: int = TASK_ROWS) -> DataFrame:
    """Rows dealt by key to tasks of about ``rows`` each; a table that is no larger stays as it is read."""
    if name not in DEALT:
        return df
    if ("rows", name) not in known:
        known["rows", name] = df.count()
    n = known["rows", name]
    return df.repartition(-(-n // rows), DEALT[name]) if n > rows else df


def share(spark: SparkSession, sf_dir: str, name: str, known: dict) -> None:
    """Write a derived table once to the session's shared folder, for a query that reads it many times."""
    if name not in known:
        folder = f"{shared_folder(spark)}/shared/{name}-{uuid.uuid4()}"
        load(spark, sf_dir, name, known).write.parquet(folder)
        known[name] = folder
