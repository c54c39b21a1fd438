"""Queries for computed verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.catalog import duck as D
from veritab.catalog.registry import query
from veritab.fixtures import ITEMS
from veritab.functions.rulebook import CLAIM_ONLY_KINDS, calc_method
from veritab.functions.text import split_list
from veritab.operators import judge as J

c = F.col
SHEET = ["sheet"]


def rules(t):
    return t.judge_rules.select(
        "sheet", "item_no", "item", "judge", calc_method(c("calc_text")).alias("calc"),
        split_list(c("extract_text")).alias("extract_fields"), split_list(c("claim_text")).alias("claim_cols"),
    )


def cases(t):
    """Claims with what was extracted for them, in the shape ``judge`` takes."""
    pairs = lambda **kv: F.create_map(*[x for n, v in kv.items() for x in (F.lit(n), c(v))])
    return t.claims.join(t.evidence, "k").select(
        "sheet", "wb", "row", "k",
        pairs(기간="period", 시간="hours", 참여인원="headcount", 참여학생명="names", ISBN="isbn", 학기="term").alias("vals"),
        pairs(시작일="ev_start", 종료일="ev_end", 총시간="total_hours", 참여인원수="ev_headcount", ISBN="ev_isbn", 학기="ev_term").alias("ext"),
        F.struct(c("roster_status").alias("status"), F.split("roster_names", "\\|").alias("names")).alias("roster"),
        F.when(c("links") == "", F.array().cast("array<string>")).otherwise(F.array("links")).alias("links"),
        F.create_map(F.lit(2), F.when(c("prior2") != "", c("prior2"))).alias("prior"),
    )


def verdicts(t, *items: int):
    """Computed verdicts with their rationale; no query shows their remarks."""
    t.share("claim_base")
    return J.judge(cases(t), rules(t).filter(c("item_no").isin(list(items))), SHEET, parts=("verdict", "rationale"))


def slim(df):
    return df.select("row", "item_no", "verdict", "rationale")


# DuckDB: the same decisions per item over the wide tables.
_LINKED = "links <> ''"
_EV = "concat_ws(' ~ ', nullif(ev_start, ''), nullif(ev_end, ''))"
_CD, _ED, _CM, _EM = "list_distinct(cd)", "list_distinct(ed)", "cmm", "emm"
_PREP = f"""base AS (
  SELECT c.*, e.* EXCLUDE (k), {D.dates('period')} AS cd, {_EV} AS ev, {D.dates(_EV)} AS ed,
         {D.months('period')} AS cm0, {D.months(_EV)} AS em0, {D.hours('hours')} AS ch, {D.hours('total_hours')} AS eh,
         {D.number('headcount')} AS cn, {D.hours('ev_headcount')} AS en, {D.roster('roster_status', 'roster_names')} AS rn,
         {D.names('names')} AS nn, {D.isbn('isbn')} AS ci, {D.isbn('ev_isbn')} AS ei, {D.isbn_ok('isbn')} AS iok,
         {D.isbn_ok('ev_isbn')} AS eiok, {D.term('term')} AS ct, {D.term('ev_term')} AS et
  FROM {{claims}} c JOIN {{evidence}} e USING (k)),
prep AS (SELECT *, CASE WHEN len(cm0) > 0 THEN cm0 ELSE list_transform(cd, lambda d: substr(d, 1, 6)) END AS cmm,
                   CASE WHEN len(em0) > 0 THEN em0 ELSE list_transform(ed, lambda d: substr(d, 1, 6)) END AS emm,
                   list_sort(list_distinct(cd)) AS cs, list_sort(list_distinct(ed)) AS es FROM base),
span AS (SELECT *, cs[1] AS a, cs[len(cs)] AS b,
   (cast(substr(cs[len(cs)], 1, 4) as int) - cast(substr(cs[1], 1, 4) as int)) * 12
   + cast(substr(cs[len(cs)], 5, 2) as int) - cast(substr(cs[1], 5, 2) as int)
   - CASE WHEN cast(substr(cs[len(cs)], 7) as int) < cast(substr(cs[1], 7) as int) THEN 1 ELSE 0 END AS mon FROM prep)"""


def _row(*pairs: tuple[str, str, str], last: tuple[str, str]) -> tuple[str, str]:
    """Verdict and rationale CASE expressions from (condition, verdict, rationale)."""
    v = "CASE " + " ".join(f"WHEN {w} THEN '{x}'" for w, x, _ in pairs) + f" ELSE '{last[0]}' END"
    r = "CASE " + " ".join(f"WHEN {w} THEN {y}" for w, _, y in pairs) + f" ELSE {last[1]} END"
    return v, r


_NOLINK = (f"NOT ({_LINKED})", "UNDETERMINED", "'no linked evidence'")
_NUM = lambda a, b: [
    (f"abs({a} - {b}) < 1e-6", "PASS", f"'claim ' || {D.num_text(a)} || ' ↔ evidence ' || {D.num_text(b)}"),
]
_DATES = [
    ("period = ''", "BLANK", "'claim is blank'"),
    ("ev = ''", "UNDETERMINED", "'no evidence value'"),
    ("len(cs) > 0 AND len(es) > 0 AND cs = es", "PASS", D.show_list("cs")),
    ("len(cs) > 0 AND len(es) > 0 AND (list_has_all(cs, es) OR list_has_all(es, cs))", "UNDETERMINED", "'dates partly extracted'"),
    ("len(cs) > 0 AND len(es) > 0", "FAIL", "'dates differ'"),
    ("len(cmm) = 0", "UNDETERMINED", "'claim date not readable'"),
    ("len(emm) = 0", "UNDETERMINED", "'evidence date not readable'"),
    ("list_has_any(cmm, emm)", "PASS", "'months agree'"),
]
_MONTHS = D.show("a") + " || ' ~ ' || " + D.show("b") + " || ' · ' || mon || ' months'"
_BOTH = lambda a, b: f"'claim ' || {D.num_text(a)} || ' ↔ evidence ' || {D.num_text(b)}"
_HEADS = "coalesce(CASE WHEN ev_headcount <> '' THEN en END, cast(rn as double))"
_NAMES = "'claim ' || cast(cn as bigint) || ', names ' || nn"
RULE: dict[int, tuple[str, str]] = {
    3: ("'UNDETERMINED'", "'set by code · cannot be seen in text'"),
    4: _row(("period = ''", "BLANK", "'claim is blank'"), ("len(cd) < 2", "UNDETERMINED", "'dates not readable'"),
            ("mon >= 3", "PASS", _MONTHS), last=("FAIL", _MONTHS)),
    5: _row(_NOLINK, *_DATES, last=("FAIL", "'months differ'")),
    6: _row(_NOLINK, ("hours = ''", "BLANK", "'claim is blank'"), ("ch IS NULL", "UNDETERMINED", "'number not readable'"),
            ("total_hours = '' OR eh IS NULL", "UNDETERMINED", "'no evidence value'"),
            ("abs(ch - eh) < 1e-6", "PASS", _BOTH("ch", "eh")), last=("FAIL", _BOTH("ch", "eh"))),
    7: _row(_NOLINK, ("headcount = ''", "BLANK", "'claim is blank'"), ("cn IS NULL", "UNDETERMINED", "'number not readable'"),
            (f"{_HEADS} IS NULL", "UNDETERMINED", "'no evidence value'"),
            (f"abs(cn - {_HEADS}) < 1e-6", "PASS", _BOTH("cn", _HEADS)), last=("FAIL", _BOTH("cn", _HEADS))),
    8: _row(("headcount = '' OR names = ''", "BLANK", "'claim is blank'"), ("cn IS NULL", "UNDETERMINED", "'number not readable'"),
            ("cast(cn as bigint) = nn", "PASS", _NAMES), last=("FAIL", _NAMES)),
    9: _row(_NOLINK, ("total_hours = ''", "UNDETERMINED", "'no evidence value'"), ("eh IS NULL", "UNDETERMINED", "'number not readable'"),
            ("eh >= 40", "PASS", f"'evidence ' || {D.num_text('eh')} || ' ≥ 40'"), last=("FAIL", f"'evidence ' || {D.num_text('eh')} || ' < 40'")),
    10: _row(("isbn = '' AND ev_isbn = ''", "BLANK", "'claim is blank'"),
             ("CASE WHEN isbn <> '' THEN iok ELSE eiok END IS NULL", "UNDETERMINED", "CASE WHEN isbn <> '' THEN isbn ELSE ev_isbn END"),
             ("CASE WHEN isbn <> '' THEN iok ELSE eiok END", "PASS", "'check digit fits ' || CASE WHEN isbn <> '' THEN ci ELSE ei END"),
             last=("FAIL", "'check digit differs'")),
    11: _row(_NOLINK, ("isbn = ''", "BLANK", "'claim is blank'"), ("ev_isbn = ''", "UNDETERMINED", "'no evidence value'"),
             ("ci = ei", "PASS", "ci"), last=("FAIL", "ci || ' ≠ ' || ei")),
    12: _row(_NOLINK, ("term = ''", "BLANK", "'claim is blank'"), ("ct IS NULL", "UNDETERMINED", "'term not readable'"),
             ("ev_term = ''", "UNDETERMINED", "'no evidence value'"), ("et IS NULL", "UNDETERMINED", "'term not readable'"),
             ("ct = et", "PASS", "ct"), last=("FAIL", "'terms differ'")),
    13: _row(("prior2 IN ('FAIL', 'UNDETERMINED')", "BLANK", "'dependent'"), _NOLINK, *_DATES, last=("FAIL", "'months differ'")),
    14: ("'UNDETERMINED'", "'no method'"),
}


def long_sql(*items: int, extra: str = "") -> str:
    """One SELECT per item over the prepared table."""
    parts = []
    for i in items:
        v, r = RULE[i]
        prefix = "" if i == 3 else "'computed · ' || "
        parts.append(f"SELECT row, {i} AS item_no, {v} AS verdict, {prefix}({r}) AS rationale{extra} FROM span")
    return f"WITH {_PREP} " + " UNION ALL ".join(parts)


def _kind(name: str, *items: int):
    @query(name, long_sql(*items))
    def run(t):
        return slim(verdicts(t, *items))

    return run


CODE_ITEMS = [i for i, _, who, *_ in ITEMS if who == "계산"]
HUMAN_ITEMS = [i for i, _, who, *_ in ITEMS if who == "사람"]

_kind("j01_dispatch", *CODE_ITEMS)
_kind("j04_duration", 4)
_kind("j05_count_of_names", 8)
_kind("j06_threshold", 9)
_kind("j07_date_match", 5)
_kind("j09_number_match", 6)
_kind("j10_roster_stands_in", 7)
_kind("j11_isbn_check", 10)
_kind("j12_isbn_match", 11)
_kind("j13_term_match", 12)
_kind("j14_human_items", 3)


@query("j02_claim_only_kinds", f"WITH {_PREP} " + " UNION ALL ".join(
    f"SELECT row, {i} AS item_no, {RULE[i][0]} AS verdict FROM span WHERE links = ''" for i in (4, 8, 10)))
def j02(t):
    """Rows without any linked file still get the verdicts that need no evidence."""
    unlinked = cases(t).filter(F.size("links") == 0)
    wanted = rules(t).filter(c("calc.kind").isin(CLAIM_ONLY_KINDS))
    return J.judge(unlinked, wanted, SHEET).select("row", "item_no", "verdict")


@query("j03_predecessor", long_sql(13))
def j03(t):
    """The predecessor comes from the long table of model verdicts, not from the claim."""
    snapshot = J.prior_verdicts(model_verdicts(t).filter("item_no < 5"), [])
    with_prior = cases(t).drop("prior").join(snapshot, "row", "left")
    return slim(J.judge(with_prior, rules(t).filter("item_no = 13"), SHEET))


@query("j08_month_fallback", f"""WITH {_PREP}
SELECT row, CASE WHEN len(cmm) = 0 OR len(emm) = 0 THEN 'UNDETERMINED' WHEN list_has_any(cmm, emm) THEN 'PASS' ELSE 'FAIL' END AS verdict,
       CASE WHEN len(es) = 0 THEN 'evidence' ELSE 'claim' END AS short_side
FROM span WHERE period <> '' AND ev <> '' AND links <> '' AND NOT (len(cs) > 0 AND len(es) > 0)""")
def j08(t):
    wanted = rules(t).filter("item_no = 5").select(
        "sheet", "item", c("calc.kind").alias("kind"), c("calc.predecessor").alias("predecessor"),
        c("calc.name_col").alias("name_col"), c("calc.threshold").alias("threshold"), "extract_fields", "claim_cols",
    )
    read = J.read_values(cases(t), wanted, SHEET).filter(
        (c("claim") != "") & (c("evidence") != "") & (F.size("links") > 0)
        & ((F.size("c_days") == 0) | (F.size("e_days") == 0))
    )
    return read.select("row", J.dates_match()["verdict"].alias("verdict"), J.short_side().alias("short_side"))


def model_verdicts(t):
    return t.model_said.select("wb", "sheet", "row", "item_no", "item", "verdict", F.lit("").alias("remark"), F.lit("model").alias("rationale"))


@query("j15_overlay", f"""WITH {_PREP}
SELECT row, 1 AS item_no, 'PASS' AS verdict, 'model' AS rationale FROM span
UNION ALL SELECT row, 2, prior2, 'model' FROM span WHERE prior2 <> ''
UNION ALL """ + " UNION ALL ".join(
    f"SELECT row, {i}, {RULE[i][0]}, " + ("" if i == 3 else "'computed · ' || ") + f"({RULE[i][1]}) FROM span" for i in (3, 5, 6)))
def j15(t):
    return slim(J.overlay(model_verdicts(t), verdicts(t, 3, 5, 6), rules(t), SHEET, SHEET))
