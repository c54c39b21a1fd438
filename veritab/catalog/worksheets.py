"""Queries for worksheets."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.catalog.registry import query
from veritab.functions.text import name_key, unnumbered_key
from veritab.operators import grid as H
from veritab.session import materialize

c = F.col
SHEET = H.SHEET


def nk(x: str) -> str:
    return rf"lower(regexp_replace(nfc_normalize({x}), '[\s·,\[\]{{}}~\-_.:;\x22''’‘“”/\\「」]+', '', 'g'))".replace("{{}}", r"\{\}")


def un(x: str) -> str:
    return nk(f"regexp_replace(trim({x}), '^[①-⑳㉠-㉿]+', '')")


def loose(x: str) -> str:
    return rf"regexp_replace({x}, '[\s.·\-_()①②③④⑤⑥⑦⑧⑨⑩0-9]+', '', 'g')"


_EITHER = lambda a, b: f"(contains({a}, {b}) OR contains({b}, {a}))"

# Header facts are the same for every derived sheet, but each step below computes them.
STEPS = f"""counts AS (SELECT wb, sheet, row, count(*) FILTER (row <= 30 AND pattern = 'solid' AND upper(fill_rgb) IN ('FFFCE4D6', 'FCE4D6', '00FCE4D6')) AS np,
                    count(*) FILTER (row <= 30 AND value <> '') AS nf FROM {{cells}} GROUP BY ALL),
heads AS (SELECT wb, sheet, CASE WHEN max(np) > 0 THEN arg_max(row, np * 1000 - row) WHEN max(nf) > 0 THEN arg_max(row, nf * 1000 - row) ELSE 1 END AS head_row FROM counts GROUP BY ALL),
head AS (SELECT c.wb, c.sheet, c.row, c.col, c.value, c.pattern = 'solid' AS painted FROM {{cells}} c JOIN heads h ON h.wb = c.wb AND h.sheet = c.sheet AND h.head_row = c.row),
checks AS (SELECT wb, sheet, header, min(col) AS col FROM (
    SELECT *, last_value(nullif(trim(value), '') IGNORE NULLS) OVER (PARTITION BY wb, sheet ORDER BY col ROWS UNBOUNDED PRECEDING) AS header FROM head) x
  WHERE painted AND header IS NOT NULL GROUP BY ALL),
lastcol AS (SELECT wb, sheet, max(col) AS last_col FROM {{cells}} GROUP BY ALL),
spans AS (SELECT h.wb, h.sheet, h.col, trim(h.value) AS header, {nk('h.value')} AS key, coalesce(m.c1, h.col) AS l, coalesce(m.c2, h.col) AS r0, last_col,
    CASE WHEN coalesce(m.c2, h.col) > coalesce(m.c1, h.col)
         THEN coalesce((SELECT min(s.col) - 1 FROM head s WHERE s.wb = h.wb AND s.sheet = h.sheet AND s.col > m.c2 AND (s.painted OR s.value <> '')), last_col)
         ELSE h.col END AS r
  FROM head h JOIN lastcol USING (wb, sheet) LEFT JOIN {{merges}} m ON m.wb = h.wb AND m.sheet = h.sheet AND h.row BETWEEN m.r1 AND m.r2 AND h.col BETWEEN m.c1 AND m.c2
  WHERE NOT painted AND value <> ''),
headers AS (SELECT * FROM spans QUALIFY row_number() OVER (PARTITION BY wb, sheet, key ORDER BY col) = 1),
hcols AS (SELECT wb, sheet, key, header, col AS first_col, unnest(generate_series(l, r)) AS col FROM headers),
covered AS (SELECT x.* FROM hcols x WHERE NOT EXISTS (SELECT 1 FROM head s WHERE s.wb = x.wb AND s.sheet = x.sheet AND s.col = x.col AND s.painted)),
names AS (SELECT wb, sheet, item_no, item, generate_subscripts(l, 1) AS i, unnest(l) AS alias, l[1] AS rep FROM (SELECT *, string_split(claim_text, '|') AS l FROM {{grid_items}} WHERE claim_text <> '') x),
same AS (SELECT n.*, h.key, h.header FROM names n JOIN headers h ON h.wb = n.wb AND h.sheet = n.sheet AND h.key = {nk('n.alias')} QUALIFY row_number() OVER (PARTITION BY n.wb, n.sheet, n.item_no ORDER BY i) = 1),
near AS (SELECT n.*, h.key, h.header, h.col, count(*) OVER (PARTITION BY n.wb, n.sheet, n.item_no, n.i) AS n_hits FROM names n JOIN headers h ON h.wb = n.wb AND h.sheet = n.sheet AND {_EITHER('h.key', nk('n.alias'))}),
uniq AS (SELECT * FROM near WHERE n_hits = 1 QUALIFY row_number() OVER (PARTITION BY wb, sheet, item_no ORDER BY i) = 1),
many AS (SELECT wb, sheet, item_no, array_to_string(list(header ORDER BY col), ' · ') AS shown, count(*) AS n_many FROM (
   SELECT *, min(i) OVER (PARTITION BY wb, sheet, item_no) AS i0 FROM near WHERE n_hits > 1) x WHERE i = i0 GROUP BY ALL),
resolved AS (SELECT n.wb, n.sheet, n.item_no, n.item, n.rep, CASE WHEN s.key IS NOT NULL THEN 'exact' WHEN u.key IS NOT NULL THEN 'similar' WHEN m.shown IS NOT NULL THEN 'ambiguous' ELSE 'not found' END AS how,
   coalesce(s.key, u.key) AS key, coalesce(s.header, u.header, m.shown, '') AS found, CASE WHEN coalesce(s.key, u.key) IS NOT NULL THEN 1 ELSE coalesce(m.n_many, 0) END AS n_found
  FROM (SELECT DISTINCT wb, sheet, item_no, item, rep FROM names) n LEFT JOIN same s USING (wb, sheet, item_no) LEFT JOIN uniq u USING (wb, sheet, item_no) LEFT JOIN many m USING (wb, sheet, item_no)),
colmap AS (SELECT * FROM resolved r WHERE NOT EXISTS (SELECT 1 FROM resolved p WHERE p.wb = r.wb AND p.sheet = r.sheet AND p.rep = r.rep AND p.key IS NOT NULL AND p.item_no < r.item_no)),
mapped AS (SELECT m.wb, m.sheet, m.rep, v.col, count(*) OVER (PARTITION BY m.wb, m.sheet, m.rep) AS n_cols FROM colmap m JOIN covered v ON v.wb = m.wb AND v.sheet = m.sheet AND v.key = m.key),
own AS (SELECT c.wb, c.sheet, c.row, m.rep, string_agg(trim(c.value), ', ' ORDER BY c.col) AS txt FROM {{cells}} c JOIN mapped m ON m.wb = c.wb AND m.sheet = c.sheet AND m.col = c.col
        JOIN heads h ON h.wb = c.wb AND h.sheet = c.sheet WHERE c.row > h.head_row AND trim(c.value) <> '' GROUP BY ALL),
inherit AS (SELECT g.wb, g.sheet, g.row, m.rep, trim(c.value) AS txt FROM (SELECT *, unnest(generate_series(r1, r2)) AS row FROM {{merges}}) g
        JOIN mapped m ON m.wb = g.wb AND m.sheet = g.sheet AND m.col BETWEEN g.c1 AND g.c2 AND m.n_cols = 1
        JOIN {{cells}} c ON c.wb = g.wb AND c.sheet = g.sheet AND c.row = g.r1 AND c.col = g.c1 JOIN heads h ON h.wb = g.wb AND h.sheet = g.sheet WHERE g.row > h.head_row AND c.value <> ''),
allvals AS (SELECT wb, sheet, row, rep, txt, false AS inherited FROM own UNION ALL
   SELECT * , true FROM inherit i WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.wb = i.wb AND o.sheet = i.sheet AND o.row = i.row AND o.rep = i.rep)),
kept0 AS (SELECT DISTINCT wb, sheet, row FROM allvals UNION SELECT wb, sheet, head_row FROM heads),
gaps AS (SELECT *, lead(row) OVER (PARTITION BY wb, sheet ORDER BY row) AS next_row FROM kept0),
ends AS (SELECT wb, sheet, coalesce(min(row) FILTER (next_row - row > 20), max(row)) AS last_row FROM gaps GROUP BY ALL),
vals AS (SELECT v.* FROM allvals v JOIN ends e ON e.wb = v.wb AND e.sheet = v.sheet WHERE v.row <= e.last_row)"""


def steps(sql: str) -> str:
    return f"WITH {STEPS} {sql}"


def items(t):
    return t.grid_items.withColumn("names", F.when(c("claim_text") == "", F.array().cast("array<string>")).otherwise(F.split("claim_text", "\\|"))).drop("claim_text")


def headers(t):
    t.share("cells")
    return H.data_headers(t.cells, t.merges)


def resolved(t):
    return H.resolve_columns(items(t), headers(t))


def colmap(t):
    return H.column_map(resolved(t))


def all_values(t):
    t.share("cells")
    return H.read_values(t.cells, t.merges, materialize(colmap(t)))


def claims_long(t):
    values = materialize(all_values(t))
    return H.claim_values(values, H.end_rows(values, H.header_rows(t.cells)))


def checks(t):
    t.share("cells")
    return H.check_columns(H.header_cells(t.cells))


@query("h01_name_key", f"SELECT wb, sheet, row, col, {nk('value')} AS key FROM {{cells}} WHERE value <> ''")
def h01(t):
    return t.cells.filter("value <> ''").select("wb", "sheet", "row", "col", name_key(c("value")).alias("key"))


@query("h02_unnumbered_key", f"""SELECT wb, title, {un('title')} AS key FROM {{sheet_titles}}
UNION ALL SELECT wb, concat('⑧ ', cast(k as string), sheet), {un("concat('⑧ ', cast(k as string), sheet)")} FROM {{rule_rows}}""")
def h02(t):
    more = t.rule_rows.select("wb", F.concat(F.lit("⑧ "), c("k").cast("string"), "sheet").alias("title"))
    return t.sheet_titles.select("wb", "title").unionByName(more).select("wb", "title", unnumbered_key(c("title")).alias("key"))


@query("h03_sheet_resolve", f"""WITH pairs AS (SELECT g.wb, g.name, s.title, s.ord, {nk('g.name')} = {nk('s.title')} AS same, {un('g.name')} = {un('s.title')} AS plain,
  {_EITHER(un('g.name'), un('s.title'))} AS near FROM {{sheet_targets}} g JOIN {{sheet_titles}} s ON s.wb = g.wb)
SELECT wb, name, coalesce(arg_min(title, ord) FILTER (same), CASE WHEN count(*) FILTER (plain) = 1 THEN any_value(title) FILTER (plain) END,
  CASE WHEN count(*) FILTER (near) = 1 THEN any_value(title) FILTER (near) END) AS title FROM pairs GROUP BY ALL""")
def h03(t):
    return H.resolve_sheet(t.sheet_targets, t.sheet_titles)


@query("h04_sheet_resolve_loosely", f"""WITH pairs AS (SELECT g.wb, g.name, s.title, s.ord, g.name = s.title AS same, {loose('g.name')} = {loose('s.title')} AS plain,
  {loose('g.name')} <> '' AND {_EITHER(loose('g.name'), loose('s.title'))} AS near FROM {{sheet_targets}} g JOIN {{sheet_titles}} s ON s.wb = g.wb)
SELECT wb, name, coalesce(arg_min(title, ord) FILTER (same), arg_min(title, ord) FILTER (plain), arg_min(title, ord) FILTER (near)) AS title FROM pairs GROUP BY ALL""")
def h04(t):
    return H.resolve_sheet_loosely(t.sheet_targets, t.sheet_titles)


@query("h05_header_row", steps("SELECT wb, sheet, cast(head_row as bigint) AS head_row FROM heads"))
def h05(t):
    return H.header_rows(t.cells)


@query("h05_missing_headers", """SELECT wb, sheet, cast(min(row) FILTER (value <> '' OR pattern = 'solid') as bigint) AS first_row FROM {cells}
GROUP BY wb, sheet HAVING count(*) FILTER (row <= 30 AND (value <> '' OR pattern = 'solid')) = 0""")
def h05_missing(t):
    return H.missing_headers(t.cells)


@query("h06_check_columns", steps("SELECT wb, sheet, header, col FROM checks"))
def h06(t):
    return checks(t)


@query("h07_data_headers", steps("SELECT wb, sheet, key, header, col FROM headers"))
def h07(t):
    return headers(t).drop("cols")


@query("h08_merged_headers", steps("SELECT wb, sheet, key, string_agg(cast(col as string), ',' ORDER BY col) AS cols FROM covered GROUP BY ALL"))
def h08(t):
    return headers(t).select(*SHEET, "key", F.array_join(F.transform("cols", lambda x: x.cast("string")), ",").alias("cols"))


@query("h09_exact_columns", steps("SELECT wb, sheet, item_no, found FROM resolved WHERE how = 'exact'"))
def h09(t):
    return resolved(t).filter(c("how") == H.EXACT).select(*SHEET, "item_no", "found")


@query("h10_containing_columns", steps("SELECT wb, sheet, item_no, how, found, n_found FROM resolved WHERE how <> 'exact'"))
def h10(t):
    return resolved(t).filter(c("how") != H.EXACT).select(*SHEET, "item_no", "how", "found", "n_found")


@query("h11_column_map", steps("SELECT wb, sheet, item_no, rep, how, found, n_found FROM colmap"))
def h11(t):
    return colmap(t).select(*SHEET, "item_no", "rep", "how", "found", "n_found")


@query("h12_resolution_counts", steps("""SELECT wb, sheet, count(*) FILTER (how = 'exact') AS exact, count(*) FILTER (how = 'similar') AS similar,
  count(*) FILTER (how = 'ambiguous') AS ambiguous, count(*) FILTER (how = 'not found') AS not_found FROM colmap GROUP BY ALL"""))
def h12(t):
    return H.resolution_counts(colmap(t))


@query("h13_orphan_headers", steps("""SELECT wb, sheet, header FROM headers h WHERE NOT EXISTS (SELECT 1 FROM covered v JOIN mapped m ON m.wb = v.wb AND m.sheet = v.sheet AND m.col = v.col
    WHERE v.wb = h.wb AND v.sheet = h.sheet AND v.key = h.key) AND NOT regexp_matches(key, '^(번호|연번|순번|no|차년도|분야|학교|비고|차수|구분)')"""))
def h13(t):
    found = materialize(headers(t))
    return H.orphan_headers(found, H.column_map(H.resolve_columns(items(t), found)))


@query("h14_row_values", steps("SELECT wb, sheet, row, rep, txt AS text FROM vals"))
def h14(t):
    return claims_long(t).drop("inherited")


@query("h15_merge_fill", steps("SELECT wb, sheet, row, rep, txt AS text FROM allvals WHERE inherited"))
def h15(t):
    return all_values(t).filter("inherited").drop("inherited")


@query("h16_blank_run_stop", steps("SELECT wb, sheet, cast(last_row as bigint) AS last_row FROM ends"))
def h16(t):
    return H.end_rows(materialize(all_values(t)), H.header_rows(t.cells))


@query("h17_dropped_rows", steps("""SELECT DISTINCT c.wb, c.sheet, c.row FROM {cells} c JOIN heads h USING (wb, sheet) JOIN ends e USING (wb, sheet)
WHERE c.value <> '' AND c.row > h.head_row
  AND NOT EXISTS (SELECT 1 FROM head s WHERE s.wb = c.wb AND s.sheet = c.sheet AND s.col = c.col AND s.painted)
  AND NOT EXISTS (SELECT 1 FROM vals v WHERE v.wb = c.wb AND v.sheet = c.sheet AND v.row = c.row)"""))
def h17(t):
    values, heads = materialize(all_values(t)), H.header_rows(t.cells)
    return H.dropped_rows(t.cells, values, heads, H.end_rows(values, heads))


# People of the roster sheets: the columns of names and categories, then one record a row.
PEOPLE = f"""hd AS (SELECT wb, col, {nk('value')} AS key FROM {{roster_cells}} WHERE row = 1),
cols AS (SELECT wb, coalesce(min(col) FILTER (key = '성명'), min(col) FILTER (contains(key, '참여학생'))) AS nc, min(col) FILTER (contains(key, '구분')) AS cc FROM hd GROUP BY ALL),
people AS (SELECT c.wb, c.row, max(value) FILTER (col = nc) AS name, coalesce(max(value) FILTER (col = cc), '') AS category FROM {{roster_cells}} c JOIN cols USING (wb) WHERE row > 1 GROUP BY ALL)"""
A_NAME = "len(name) BETWEEN 2 AND 12 AND NOT regexp_full_match(name, '[0-9]+')"


@query("h18_roster", f"WITH {PEOPLE} SELECT wb, '별첨1 명단' AS sheet, min(row) AS row, name, category FROM people WHERE {A_NAME} GROUP BY wb, name, category")
def h18(t):
    return H.read_roster(t.roster_cells)


@query("h18_roster_sheets", f"""WITH g AS (SELECT DISTINCT wb, n, CASE n WHEN 1 THEN '별첨1 명단' ELSE '별첨1' END AS name FROM {{sheet_titles}}, (SELECT unnest([1, 2]) AS n) x),
pairs AS (SELECT g.wb, g.n, s.title, s.ord, {nk('g.name')} = {nk('s.title')} AS same, {un('g.name')} = {un('s.title')} AS plain,
  {_EITHER(un('g.name'), un('s.title'))} AS near FROM g JOIN {{sheet_titles}} s ON s.wb = g.wb),
found AS (SELECT wb, n, coalesce(arg_min(title, ord) FILTER (same), CASE WHEN count(*) FILTER (plain) = 1 THEN any_value(title) FILTER (plain) END,
  CASE WHEN count(*) FILTER (near) = 1 THEN any_value(title) FILTER (near) END) AS title FROM pairs GROUP BY wb, n)
SELECT wb, arg_min(title, n) AS title FROM found WHERE title IS NOT NULL GROUP BY wb""")
def h18_sheets(t):
    return H.roster_sheets(t.sheet_titles)


@query("h19_sheet_overview", steps("""SELECT s.wb, s.sheet, (SELECT count(DISTINCT row) FROM vals v WHERE v.wb = s.wb AND v.sheet = s.sheet) AS n_rows,
  (SELECT count(*) FROM checks k WHERE k.wb = s.wb AND k.sheet = s.sheet) AS n_checks FROM (SELECT DISTINCT wb, sheet FROM {grid_items}) s"""))
def h19(t):
    return H.sheet_overview(claims_long(t), checks(t), t.grid_items.select(*SHEET).distinct())


@query("h20_item_placement", steps(f"""SELECT g.wb, g.sheet, g.item_no, g.item,
  coalesce((SELECT max(k.col) FROM checks k WHERE k.wb = g.wb AND k.sheet = g.sheet AND {nk('k.header')} = {nk('g.item')}),
           (SELECT CASE WHEN count(DISTINCT {nk('k.header')}) = 1 THEN max(k.col) END FROM checks k WHERE k.wb = g.wb AND k.sheet = g.sheet AND {_EITHER(nk('k.header'), nk('g.item'))})) AS col
FROM {{grid_items}} g"""))
def h20(t):
    return H.place_items(items(t).drop("names"), checks(t))
