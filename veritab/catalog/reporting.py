"""Queries for reports and the write plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.catalog import answering as A, judging as Q, worksheets as W
from veritab.catalog.evidence import SHARES, shared, sink
from veritab.catalog.registry import query
from veritab.functions import values as V
from veritab.operators import grid as H, guards as G, judge as J, pack as P, report as R, writeplan as WP

c = F.col
ALL_ITEMS = (3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14)


def judged(t, parts=J.PARTS, items=None, worded=None):
    """Model and computed verdicts of every claim, with its workbook; ``parts`` of a decision are made, the others are null.

    ``items``: which rules code applies (all by default), ``worded``: which of them get words.
    """
    t.share("claim_base")
    asked = Q.rules(t) if items is None else Q.rules(t).filter(c("item_no").isin(items))
    code = J.judge(Q.cases(t), asked, Q.SHEET, carry=("wb",), parts=parts, worded=worded)
    return J.overlay(Q.model_verdicts(t), code, Q.rules(t), R.SHEET, Q.SHEET)


_JUDGED = f"""WITH {Q._PREP}, judged AS (SELECT wb, sheet, row, 1 AS item_no, 'PASS' AS verdict, 'model' AS rationale FROM span
UNION ALL SELECT wb, sheet, row, 2, prior2, 'model' FROM span WHERE prior2 <> '' UNION ALL """ + " UNION ALL ".join(
    f"SELECT wb, sheet, row, {i}, {Q.RULE[i][0]}, " + ("" if i == 3 else "'computed · ' || ") + f"({Q.RULE[i][1]}) FROM span" for i in ALL_ITEMS) + ")"


@query("o01_verdict_totals", _JUDGED + """, r AS (SELECT wb, sheet, count(*) AS n_rows, count(*) FILTER (links <> '') AS linked, count(*) FILTER (links = '') AS unlinked,
  count(DISTINCT nullif(links, '')) AS files FROM span GROUP BY ALL)
SELECT r.*, pass, fail, undetermined, blank, coalesce(g.given, 0) AS given FROM r LEFT JOIN (SELECT wb, sheet, count(*) AS given FROM {sheet_files} GROUP BY ALL) g ON g.wb = r.wb AND g.sheet = r.sheet JOIN (SELECT wb, sheet, count(*) FILTER (verdict = 'PASS') AS pass, count(*) FILTER (verdict = 'FAIL') AS fail,
  count(*) FILTER (verdict = 'UNDETERMINED') AS undetermined, count(*) FILTER (verdict = 'BLANK') AS blank FROM judged GROUP BY ALL) v ON v.wb = r.wb AND v.sheet = r.sheet""")
def o01(t):
    said = judged(t, parts=("verdict",))
    rows = t.claims.select(*R.SHEET, "row", "k").join(t.evidence.select("k", F.when(c("links") == "", F.array().cast("array<string>")).otherwise(F.array("links")).alias("links")), "k")
    return R.verdict_totals(said, rows, files=t.sheet_files)


_ALL_STEPS = f"WITH {A.STEPS}, " + W.STEPS.replace("resolved AS", "wresolved AS").replace("FROM resolved", "FROM wresolved").replace("own AS", "wown AS").replace("FROM own", "FROM wown").replace("names AS", "wnames AS").replace("FROM names", "FROM wnames")


@query("o02_attention", _ALL_STEPS + f""", {SHARES}
SELECT wb, sheet, 1 AS section, cast(row as bigint) AS place, 'unknown row' AS code, cast(row as string) AS detail FROM {{answers}} WHERE ord NOT IN (SELECT ord FROM known)
UNION ALL SELECT wb, sheet, 1, row, 'invented file', shown FROM (SELECT wb, sheet, row, array_to_string(list(ref ORDER BY place), ', ') AS shown FROM resolved WHERE name IS NULL GROUP BY ALL)
UNION ALL SELECT wb, sheet, 2, row, 'lowered: ' || reason, item || ' ' || row FROM lowered WHERE reason IS NOT NULL
UNION ALL SELECT wb, sheet, 1, item_no, 'column unresolved', CASE WHEN found = '' THEN item || ' · ' ELSE item || ' · ' || found END FROM colmap WHERE key IS NULL
UNION ALL SELECT '', source, 1, ord, 'text cut', name || ' ' || len || ' ' || share FROM shares WHERE len > share""")
def o02(t):
    f = A.Flow(t)
    tell = lambda df, level, code, detail: df.select(*R.SHEET, c("row").cast("bigint").alias("place"), F.lit(level).alias("level"), code.alias("code"), detail.alias("detail"))
    signals = (
        tell(G.unknown_rows(f.answers, f.rows), "warn", F.lit("unknown row"), c("row").cast("string"))
        .unionByName(tell(G.invented_tags(f.resolved), "warn", F.lit("invented file"), c("shown")))
        .unionByName(tell(f.lowered.filter("reason is not null"), "info", F.concat(F.lit("lowered: "), "reason"), F.concat_ws(" ", "item", c("row").cast("string"))))
    )
    cuts = P.cut_log(shared(t)).join(t.docs.select("source", "ord", "name"), ["source", "ord"]).withColumns({"wb": F.lit(""), "sheet": c("source")})
    return R.attention(signals, W.colmap(t).filter("cols is null"), cuts)


@query("o03_side_by_side", A.steps("""SELECT wb, sheet, row, side, CASE WHEN side = 'claim' THEN links ELSE '' END AS linked_files,
  CASE WHEN side = 'claim' THEN coalesce(confidence, '') ELSE '' END AS confidence, CASE WHEN side = 'claim' THEN coalesce(link_reason, '') ELSE '' END AS link_reason,
  CASE WHEN side = 'claim' THEN coalesce(nullif(trim(period), ''), '(부재)') ELSE '' END AS claim_period,
  CASE WHEN side = 'claim' THEN coalesce(nullif(trim(hours), ''), '(부재)') ELSE '' END AS claim_hours,
  CASE WHEN side = 'evidence' THEN coalesce(nullif(trim(e_hours), ''), '(부재)') ELSE '' END AS evidence_hours,
  CASE WHEN side = 'evidence' THEN CASE WHEN e_status <> '찾음' THEN '(' || e_status || ')' WHEN e_names = '' THEN '(부재)' ELSE replace(e_names, '|', ', ') END ELSE '' END AS evidence_roster,
  CASE WHEN side = 'claim' THEN coalesce(memo, '') ELSE '' END AS memo
FROM (SELECT c.wb, c.sheet, c.row, e.links, c.period, c.hours, e.total_hours AS e_hours, e.roster_status AS e_status, e.roster_names AS e_names, f.confidence, f.link_reason, f.memo
  FROM {claims} c JOIN {evidence} e ON e.k = c.k LEFT JOIN firsta f ON f.wb = c.wb AND f.sheet = c.sheet AND f.row = c.row) x, (SELECT unnest(['claim', 'evidence']) AS side) y"""))
def o03(t):
    t.share("claim_base")
    said = A.Flow(t, "link_reason", "memo").first.select(*G.ROW, "confidence", "link_reason", "memo")
    rows = t.claims.join(t.evidence, "k").withColumnRenamed("links", "linked_files").join(said, G.ROW, "left")
    return R.side_by_side(rows, ["period", "hours"], {
        "hours": V.show_value(c("total_hours")), "roster": V.show_roster(c("roster_status"), F.split("roster_names", "\\|")),
    })


GRID_ITEMS, NOTED = [1, 2, 4, 5, 9], (2,)  # shown, and shown with a note


@query("o04_verdict_grid", _JUDGED + " SELECT wb, sheet, row, " + ", ".join(
    f"coalesce(max(verdict) FILTER (item_no = {i}), '—') AS v{i}" for i in GRID_ITEMS) + ", coalesce(max(rationale) FILTER (item_no = 2), '') AS n2 FROM judged GROUP BY ALL")
def o04(t):
    # every claim has a model verdict, so rules that the grid does not show add no record to it
    grid = R.verdict_grid(judged(t, items=GRID_ITEMS, worded=NOTED), GRID_ITEMS)
    return grid.select(*R.SHEET, "row", *[f"v{i}" for i in GRID_ITEMS], "n2")


@query("o05_unlinked_rows", A.steps("""SELECT wb, sheet, row, coalesce(nullif(link_reason, ''), nullif(memo, ''), '(말이 없음)') AS reason FROM firsta f
WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.wb = f.wb AND l.sheet = f.sheet AND l.row = f.row)"""))
def o05(t):
    f = A.Flow(t, "link_reason", "memo")
    return R.unlinked_rows(f.first, f.links)


@query("o06_unused_files", A.steps("""SELECT u.wb, u.sheet, coalesce(t.name, u.ref) AS file, u.reason FROM {unlinked_files} u
LEFT JOIN tagged t ON t.wb = u.wb AND t.sheet = u.sheet AND t.tag = u.ref
QUALIFY row_number() OVER (PARTITION BY u.wb, u.sheet, coalesce(t.name, u.ref) ORDER BY u.batch, u.ord) = 1"""))
def o06(t):
    return R.unused_file_reasons(G.unlinked_reasons(t.unlinked_files, A.Flow(t).refs))


@query("o07_run_metrics", _ALL_STEPS + ", " + A._ATTEMPTS[len("WITH "):].replace("log AS", "alog AS").replace("FROM log", "FROM alog") + f""", {W.PEOPLE}
SELECT 'rows' AS metric, count(*) AS value FROM {{sheet_rows}} UNION ALL SELECT 'batches', count(*) FROM asked
UNION ALL SELECT 'answered', count(*) FROM firsta UNION ALL SELECT 'lowered', count(*) FROM lowered WHERE reason IS NOT NULL
UNION ALL SELECT 'tokens', cast(sum(cast(floor(len(text) * 0.65) as bigint)) as bigint) FROM {{docs}}
UNION ALL SELECT 'header ' || how, count(*) FROM colmap GROUP BY how
UNION ALL SELECT 'repeats', sum(repeats) FROM outcome UNION ALL SELECT 'stop: ' || stop, count(*) FROM outcome GROUP BY stop
UNION ALL SELECT CASE judge WHEN '계산' THEN 'cells computed' WHEN '사람' THEN 'cells not asked' ELSE 'cells asked' END, count(*) FROM {{judge_rules}} j JOIN {{sheet_rows}} r ON r.sheet = j.sheet GROUP BY 1
UNION ALL SELECT 'people', count(*) FROM (SELECT DISTINCT wb, name, category FROM people WHERE {W.A_NAME}) x""")
def o07(t):
    """Every table is scanned once, and its rows say which metrics they count for."""
    f, one = A.Flow(t), F.lit(1)
    rows = f.rows.groupBy("sheet", "wb", "batch").agg(F.count(one).alias("n"))
    asked = Q.rules(t).groupBy("sheet").agg(*[F.count_if(w).alias(n) for n, w in (
        ("code", c("judge") == J.BY_CODE), ("human", c("judge") == J.BY_HUMAN), ("model", ~c("judge").isin(J.BY_CODE, J.BY_HUMAN)))])
    done = A.outcomes(t)
    return R.metrics(
        R.metric_rows(rows, rows=c("n"), batches=one),
        R.metric_rows(rows.join(asked, "sheet"), **{"cells asked": c("n") * c("model"), "cells computed": c("n") * c("code"), "cells not asked": c("n") * c("human")}),
        R.metric_rows(f.lowered.withColumn("hit", F.when(c("reason").isNotNull(), 1)), lowered=c("hit")),
        R.metric_rows(f.first, answered=one),
        R.metric_rows(t.docs, tokens=P.token_estimate(F.length("text"))),
        W.colmap(t).select(F.concat(F.lit("header "), "how").alias("metric"), one.cast("bigint").alias("value")),
        R.metric_rows(done, repeats=c("repeats")),
        done.select(F.concat(F.lit("stop: "), "stop").alias("metric"), one.cast("bigint").alias("value")),
        R.metric_rows(H.read_roster(t.roster_cells), people=one),
    ).filter("value > 0 OR metric = 'repeats'")


_ECHO = r"^\s*\[([^\]]{1,40})\]\s*"
_SHORT = "regexp_replace(item, ' (제출여부|확인)$', '')"
_SAME = f"({W.nk('item')}, {W.nk(_SHORT)})"


def _once(x: str) -> str:
    said = f"regexp_extract({x}, '{_ECHO}', 1)"
    return (
        f"(CASE WHEN regexp_matches({x}, '{_ECHO}') AND {W.nk(said)} IN {_SAME} "
        f"THEN trim(regexp_replace({x}, '{_ECHO}', '')) ELSE {x} END)"
    )


@query("o08_cell_remarks", A.steps(f"""SELECT wb, sheet, row, item_no, CASE WHEN verdict IN ('FAIL', 'UNDETERMINED') THEN {_once(_once('trim(remark)'))} ELSE '' END AS remark FROM unfolded"""))
def o08(t):
    return A.Flow(t).unfolded.select(*G.ROW, "item_no", R.cell_remark(c("item"), c("verdict"), c("remark")).alias("remark"))


@query("o09_roster_notes", A.steps("""SELECT f.wb, f.sheet, f.row, CASE WHEN l.row IS NULL OR (roster_status = '찾음' AND roster_names <> '') THEN '' ELSE
  CASE roster_status WHEN '명단없음' THEN 'no place with names in the evidence' WHEN '글자깨짐' THEN 'names are there but unreadable' ELSE 'no person could be extracted' END
  || CASE WHEN trim(heads_text) <> '' THEN ' — stated only as 「' || trim(heads_text) || '」' ELSE '' END END AS note
FROM firsta f LEFT JOIN (SELECT DISTINCT wb, sheet, row FROM links) l ON l.wb = f.wb AND l.sheet = f.sheet AND l.row = f.row"""))
def o09(t):
    f = A.Flow(t, "roster_status", "roster_names", "heads_text")
    linked = f.links.select(*G.ROW).distinct().withColumn("has_link", F.lit(True))
    said = R.roster_note(F.coalesce("has_link", F.lit(False)), c("roster_status"), F.split("roster_names", "\\|"), c("heads_text"))
    return f.first.join(linked, G.ROW, "left").select(*G.ROW, said.alias("note"))


# --- write plan -----------------------------------------------------------------------------

def done(t):
    t.share("cells")
    return WP.outcomes(t.grid_verdicts, t.sheet_titles, WP.check_cells(t.cells))


def planned(t):
    return WP.plan(done(t), t.cells, WP.check_cells(t.cells))


_L = W.loose
PLAN = rf"""wnames AS (SELECT DISTINCT wb, sheet_name FROM {{grid_verdicts}}),
wfound AS (SELECT n.wb, n.sheet_name, coalesce(arg_min(s.title, s.ord) FILTER (n.sheet_name = s.title), arg_min(s.title, s.ord) FILTER ({_L('n.sheet_name')} = {_L('s.title')}),
   arg_min(s.title, s.ord) FILTER ({W._EITHER(_L('n.sheet_name'), _L('s.title'))})) AS title FROM wnames n JOIN {{sheet_titles}} s ON s.wb = n.wb GROUP BY ALL),
wchecks AS (SELECT wb, sheet AS title, col, trim(value) AS chk FROM {{cells}} WHERE row = 4 AND pattern = 'solid'),
wdone AS (SELECT v.wb, v.sheet_name, v.row, v.item_no, v.header, v.col, v.verdict, v.remark, f.title,
   CASE WHEN f.title IS NULL THEN 'no such sheet' WHEN v.row IS NULL THEN 'no row number' WHEN v.col IS NULL THEN 'remark only' WHEN k.chk IS NULL THEN 'not a check column'
        WHEN contains(k.chk, '학교') AND contains(k.chk, '의견') THEN 'school opinion kept' ELSE 'write' END AS outcome
  FROM {{grid_verdicts}} v LEFT JOIN wfound f ON f.wb = v.wb AND f.sheet_name = v.sheet_name LEFT JOIN wchecks k ON k.wb = v.wb AND k.title = f.title AND k.col = v.col),
wdirect AS (SELECT d.wb, d.title, d.row, d.col, d.header, d.verdict AS new, coalesce(c.value, '') AS old, false AS is_remark FROM wdone d
   LEFT JOIN {{cells}} c ON c.wb = d.wb AND c.sheet = d.title AND c.row = d.row AND c.col = d.col WHERE outcome = 'write'),
wremark AS (SELECT wb, title, row, '비고' AS header, string_agg('[' || header || '] ' || remark, chr(10) ORDER BY item_no) AS new FROM wdone
   WHERE outcome IN ('write', 'remark only') AND remark <> '' GROUP BY ALL),
wbase AS (SELECT r.wb, r.title, r.row, 12 AS col, r.header, r.new, coalesce(array_to_string(list_filter(list_transform(regexp_split_to_array(c.value, '\n+| / '), lambda p: trim(p)),
   lambda p: p <> '' AND NOT regexp_matches(p, '^\[(계획서 제출여부|일시 일치|학교 의견|총 소요시수|인원)\]')), chr(10)), '') AS old, true AS is_remark
   FROM wremark r LEFT JOIN {{cells}} c ON c.wb = r.wb AND c.sheet = r.title AND c.row = r.row AND c.col = 12),
wplan AS (SELECT * FROM wdirect UNION ALL BY NAME SELECT * FROM wbase)"""


@query("o10_write_plan", f"WITH {PLAN} SELECT wb, title, row, col, header, new, old, is_remark FROM wplan")
def o10(t):
    return planned(t)


@query("o10_write_outcomes", f"WITH {PLAN} SELECT wb, outcome, count(*) AS n FROM wdone GROUP BY ALL")
def o10b(t):
    return WP.outcome_counts(done(t))


@query("o11_remark_column", "SELECT wb, sheet AS title, min(col) AS remark_col FROM {cells} WHERE row = 4 AND pattern = 'solid' AND contains(value, '비고') AND NOT contains(value, '학교') GROUP BY ALL")
def o11(t):
    return WP.remark_columns(WP.check_cells(t.cells))


@query("o12_remark_merge", f"WITH {PLAN} SELECT wb, title, row, CASE WHEN old <> '' THEN old || chr(10) || new ELSE new END AS value FROM wplan WHERE is_remark")
def o12(t):
    return WP.apply_plan(planned(t).filter("is_remark")).select("wb", "title", "row", "value")


@query("o13_apply_policy", f"""WITH {PLAN} SELECT wb, title, count(*) FILTER (is_remark OR trim(old) = '') AS written, count(*) FILTER (NOT is_remark AND trim(old) <> '') AS kept FROM wplan GROUP BY ALL""")
def o13(t):
    return WP.apply_counts(WP.apply_plan(planned(t)))


@query("o14_plan_summary", f"WITH {PLAN} SELECT CASE WHEN is_remark THEN 'remark' ELSE new END AS kind, count(*) AS n FROM wplan GROUP BY ALL")
def o14(t):
    return WP.plan_summary(planned(t))


@query("s11_judgement_report", f"""WITH {PLAN} SELECT wb, title, row, count(*) AS n_cells, string_agg(coalesce(cast(col as string), '') || ':' || coalesce(verdict, '') || ':' || remark, '|' ORDER BY item_no) AS cells
FROM wdone WHERE outcome IN ('write', 'remark only') GROUP BY ALL""")
def s11(t):
    report = R.judgement_report(done(t).filter(c("outcome").isin("write", "remark only")), ["wb", "title"])
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    shown = F.transform("cells", lambda x: F.concat_ws(":", text(x["col"]), text(x["verdict"]), text(x["remark"])))
    return report.select("wb", "title", "row", F.size("cells").alias("n_cells"), F.array_join(shown, "|").alias("cells"))


@query("s11_report_sink", f"""WITH {PLAN} SELECT wb, title AS sheet, row, count(*) AS n_cells, string_agg(coalesce(cast(col as string), '') || ':' || coalesce(verdict, '') || ':' || remark, '|' ORDER BY item_no) AS cells
FROM wdone WHERE outcome IN ('write', 'remark only') GROUP BY ALL""")
def s11_sink(t):
    """Written for all sheets, then for some again, and read back."""
    folder = sink(t, "report")
    report = R.judgement_report(done(t).filter(c("outcome").isin("write", "remark only")), ["wb", "title"]).withColumnRenamed("title", "sheet")
    R.write_report(report, folder)
    R.write_report(report.filter(c("sheet").startswith("③")), folder)
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    shown = F.transform("cells", lambda x: F.concat_ws(":", text(x["col"]), text(x["verdict"]), text(x["remark"])))
    return R.read_report(t.spark, folder, report.schema).select("wb", "sheet", "row", F.size("cells").alias("n_cells"), F.array_join(shown, "|").alias("cells"))
