"""Queries for rule scanning and linting."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.catalog.registry import query
from veritab.functions.rulebook import KINDS, calc_method
from veritab.functions.text import split_list
from veritab.operators import rules as R

c = F.col


def key(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[\s·,\[\]{{}}~\-_.:;/\\「」''""]+', '', 'g'))".replace('""', '"').replace("{{", "{").replace("}}", "}")


def listed(x: str) -> str:
    return (
        f"(CASE WHEN lower(trim({x})) IN ('', '—', '-', '–', '없음', 'none', 'n/a') THEN cast([] as varchar[]) ELSE "
        f"list_filter(list_transform(regexp_split_to_array(trim({x}), '[·|]'), lambda p: trim(p)), lambda p: p <> '') END)"
    )


_KIND = "CASE " + " ".join(
    f"WHEN starts_with(replace(trim(calc_text), ' ', ''), '{k}') OR contains(replace(trim(calc_text), ' ', ''), '·{k}') THEN '{k}'" for k in KINDS
) + " END"

# Rule rows between heading and first non-numeric key; kept = named and first of its number.
SCANNED = """ends AS (SELECT wb, sheet, min(row) AS end_row FROM {rule_rows} WHERE key_cell <> '' AND NOT regexp_full_match(key_cell, '[0-9]+') GROUP BY 1, 2),
scanned AS (SELECT r.* FROM {rule_rows} r LEFT JOIN ends e ON r.wb = e.wb AND r.sheet = e.sheet
            WHERE key_cell <> '' AND (end_row IS NULL OR row < end_row)),
named AS (SELECT *, cast(key_cell as bigint) AS item_no,
                 row_number() OVER (PARTITION BY wb, sheet, cast(key_cell as bigint) ORDER BY row) AS nth FROM scanned WHERE item <> ''),
kept AS (SELECT *, row_number() OVER (PARTITION BY wb, sheet, """ + key("item") + """ ORDER BY row) AS nth_name FROM named WHERE nth = 1)"""

# Aliases: one row per representative and synonym, repeats dropped.
ALIASES = f"""alias_all AS (
  SELECT wb, ord, rep, {key('rep')} AS rep_key, generate_subscripts(names, 1) AS i, unnest(names) AS alias
  FROM (SELECT *, list_prepend(rep, {listed('alias_text')}) AS names FROM {{alias_rows}}) a),
alias_first AS (SELECT * FROM alias_all QUALIFY row_number() OVER (PARTITION BY wb, ord, {key('alias')} ORDER BY i) = 1),
alias_kept AS (SELECT * FROM alias_first QUALIFY dense_rank() OVER (PARTITION BY wb, rep_key ORDER BY ord) = 1)"""

EXPANDED = f"""claimed AS (SELECT wb, sheet, row, item_no, generate_subscripts(l, 1) AS p, unnest(l) AS name
             FROM (SELECT *, {listed('claim_text')} AS l FROM kept) x),
spread AS (SELECT wb, sheet, row, item_no, p, 0 AS i, name AS alias FROM claimed
           UNION ALL SELECT c.wb, c.sheet, row, item_no, p, i, alias FROM claimed c JOIN alias_kept a ON a.wb = c.wb AND a.rep_key = {key('name')}),
wide AS (SELECT * FROM spread QUALIFY row_number() OVER (PARTITION BY wb, sheet, row, {key('alias')} ORDER BY p, i) = 1)"""


def scanned(t):
    return R.scan_rules(t.rule_cells)


def parsed(t):
    return R.parse_rules(scanned(t))


def expanded(t):
    return R.expand_claim_columns(parsed(t), R.scan_aliases(t.alias_rows)[0])


@query("s01_rule_scan", f"""WITH {SCANNED}
SELECT wb, sheet, cast(row as bigint) AS row, key_cell, item, judge, calc_text, extract_text, claim_text, rule_text FROM scanned""")
def s01(t):
    return scanned(t).select(
        "wb", "sheet", c("row").cast("bigint").alias("row"), "key_cell", "item", "judge", "calc_text", "extract_text", "claim_text", "rule_text"
    )


@query("s02_alias_scan", f"""WITH {ALIASES}
SELECT wb, ord + 3 AS ord, 'alias' AS kind, rep, string_agg(alias, '|' ORDER BY i) AS names FROM alias_kept WHERE wb NOT IN ('W3', 'W17') GROUP BY wb, ord, rep
UNION ALL SELECT DISTINCT wb, ord + 3, 'representative_repeated', rep, '' FROM alias_first a
WHERE ord > (SELECT min(ord) FROM alias_first b WHERE b.wb = a.wb AND b.rep_key = a.rep_key) AND wb NOT IN ('W3', 'W17')
UNION ALL SELECT DISTINCT wb, 0, 'no_alias_heading', '대표 이름', '' FROM alias_all WHERE wb IN ('W3', 'W17')""")
def s02(t):
    """From the cells of the alias sheets: heading, rows, aliases, and what is wrong with them."""
    rows, headless = R.alias_table(t.alias_cells)
    aliases, repeated = R.scan_aliases(rows)
    faults = repeated.unionByName(headless)
    return aliases.select("wb", "ord", F.lit("alias").alias("kind"), "rep", F.array_join("names", "|").alias("names")).unionByName(
        faults.select("wb", "ord", c("code").alias("kind"), c("detail").alias("rep"), F.lit("").alias("names"))
    )


@query("r01_list_split", f"""
SELECT k, array_to_string({listed('extract_text')}, '|') AS fields, len({listed('extract_text')}) AS n_fields,
       array_to_string({listed('claim_text')}, '|') AS cols FROM {{rule_rows}}""")
def r01(t):
    fields = split_list(c("extract_text"))
    return t.rule_rows.select(
        "k", F.array_join(fields, "|").alias("fields"), F.size(fields).alias("n_fields"),
        F.array_join(split_list(c("claim_text")), "|").alias("cols"),
    )


@query("r02_calc_method", rf"""
SELECT k, CASE WHEN trim(calc_text) NOT IN ('', '—') THEN {_KIND} END AS kind,
       cast(nullif(regexp_extract(calc_text, '[≥>=]+\s*(\d+(?:\.\d+)?)', 1), '') as double) AS threshold,
       CASE WHEN regexp_matches(calc_text, '[≥>=]+\s*\d') THEN regexp_extract(calc_text, '[≥>=]+\s*\d+(?:\.\d+)?\s*([^\s·]*)', 1) END AS unit,
       cast(nullif(regexp_extract(calc_text, '앞선\s*#?(\d+)', 1), '') as int) AS predecessor,
       nullif(trim(regexp_extract(calc_text, '이름칸\s*=\s*([^·]+)', 1)), '') AS name_col
FROM {{rule_rows}}""")
def r02(t):
    m = calc_method(c("calc_text"))
    return t.rule_rows.withColumn("m", m).select("k", "m.kind", "m.threshold", "m.unit", "m.predecessor", "m.name_col")


@query("r03_alias_expansion", f"""WITH {SCANNED}, {ALIASES}, {EXPANDED}
SELECT wb, sheet, item_no, string_agg(alias, '|' ORDER BY p, i) AS cols FROM wide GROUP BY 1, 2, 3""")
def r03(t):
    return expanded(t).filter(F.size("claim_cols") > 0).select("wb", "sheet", "item_no", F.array_join("claim_cols", "|").alias("cols"))


@query("r04_alias_overlap", f"""WITH {SCANNED}, {ALIASES}, {EXPANDED},
aims AS (SELECT *, first_value(alias) OVER (PARTITION BY wb, sheet, row ORDER BY p, i) AS rep FROM wide),
owned AS (SELECT *, first_value(rep) OVER (PARTITION BY wb, sheet, {key('alias')} ORDER BY row, p, i) AS owner FROM aims)
SELECT wb, sheet, item_no, alias, owner, rep FROM owned WHERE owner <> rep""")
def r04(t):
    return R.alias_overlaps(expanded(t))


FIELDS = f"""common AS (SELECT DISTINCT wb, unnest(['문서번호', '총시간', '작성일']) AS field, unnest([1, 2, 3]) AS i FROM {{rule_rows}} WHERE wbno % 5 <> 4),
mentions AS (SELECT DISTINCT k.wb, k.sheet, 0 AS row, m.i, m.field FROM kept k JOIN common m ON m.wb = k.wb
             UNION ALL SELECT wb, sheet, row, generate_subscripts(l, 1), unnest(l) FROM (SELECT *, {listed('extract_text')} AS l FROM kept) x),
firsts AS (SELECT * FROM mentions QUALIFY row_number() OVER (PARTITION BY wb, sheet, field ORDER BY row, i) = 1)"""


@query("r05_reserved_names", f"""WITH {SCANNED}, {FIELDS}, pairs AS (SELECT * FROM (VALUES ('참여명단', '명단'), ('참여인원수', '인원')) v(reserved, word))
SELECT wb, reserved, string_agg(DISTINCT field, ' · ' ORDER BY field) AS similar
FROM firsts JOIN pairs ON contains(field, word)
WHERE NOT EXISTS (SELECT 1 FROM firsts f WHERE f.wb = firsts.wb AND f.field = reserved) GROUP BY 1, 2""")
def r05(t):
    return R.reserved_name_faults(R.fields_per_sheet(parsed(t), R.common_fields(t.rule_cells)))


@query("r06_row_lint", f"""WITH {SCANNED}
SELECT wb, sheet, cast(row as bigint) AS row, 'no_name' AS code, key_cell AS detail FROM scanned WHERE item = ''
UNION ALL SELECT wb, sheet, row, 'number_repeated', item FROM named WHERE nth > 1
UNION ALL SELECT wb, sheet, row, 'name_repeated', item FROM kept WHERE nth_name > 1
UNION ALL SELECT wb, sheet, row, 'unknown_judge', judge FROM kept WHERE judge NOT IN ('모형', '계산', '사람')
UNION ALL SELECT wb, sheet, row, 'no_method', calc_text FROM kept WHERE judge = '계산' AND ({_KIND}) IS NULL
UNION ALL SELECT wb, sheet, row, 'no_rule_text', item FROM kept WHERE judge <> '사람' AND rule_text = ''
UNION ALL SELECT wb, sheet, row, 'heading_differs', '판정 규칙' FROM {{rule_cells}} WHERE value = '방법' AND col = 9
UNION ALL SELECT wb, sheet, min(row), 'no_mark', coalesce(cast(min(row) FILTER (col = 1 AND value = '#') as varchar), '') FROM {{rule_cells}}
  WHERE sheet NOT IN ('개요', '열 낱말', '종합표', '추출 필드', '개정 이력') GROUP BY wb, sheet HAVING count(*) FILTER (col = 1 AND value = '#' AND row <= 12) = 0""")
def r06(t):
    return R.lint(t.rule_cells, scanned(t))


@query("r07_common_fields", f"""
SELECT wb, array_to_string({listed("regexp_extract(value, '공통으로 뽑을 값: (.+)', 1)")}, '|') AS fields
FROM {{rule_cells}} WHERE sheet = '개요' AND contains(value, '공통으로 뽑을 값')""")
def r07(t):
    return R.common_fields(t.rule_cells).select("wb", F.array_join("fields", "|").alias("fields"))


@query("r08_fields_per_sheet", f"""WITH {SCANNED}, {FIELDS}
SELECT wb, sheet, string_agg(field, '|' ORDER BY row, i) AS fields FROM firsts GROUP BY 1, 2""")
def r08(t):
    return R.fields_per_sheet(parsed(t), R.common_fields(t.rule_cells)).select("wb", "sheet", F.array_join("fields", "|").alias("fields"))


@query("r09_rule_summary", f"""WITH {SCANNED}
SELECT wb, sheet, count(*) AS items, count(*) FILTER (judge NOT IN ('계산', '사람')) AS model,
       count(*) FILTER (judge = '계산') AS code, count(*) FILTER (judge = '사람') AS human FROM kept GROUP BY 1, 2""")
def r09(t):
    return R.summary(parsed(t))
