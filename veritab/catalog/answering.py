"""Queries for answer scanning and validation."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from veritab.catalog import duck as D
from veritab.catalog.judging import rules
from veritab.catalog.registry import query
from veritab.operators import guards as G
from veritab.session import materialize
from veritab.sources import answers as A

c = F.col
ROW = G.ROW


class Flow:
    """The validation steps in order, each a lazy DataFrame. What several steps read is
    written once, without columns that no step reads; a query that reads judgements or links only once takes them unwritten."""

    def __init__(self, t, *said):
        """``said``: columns of the answers that the query reads besides those of the steps."""
        self.t, self.said = t, ["ord", "batch", "tags", "confidence", *said]
        t.share("sheet_rows")
        self.rows = t.sheet_rows
        self.answers = t.answers.withColumn("tags", F.when(c("tags") == "", F.array().cast("array<string>")).otherwise(F.split("tags", "\\|")))

    @cached_property
    def known(self):
        return G.known_rows(self.answers, self.rows)

    @cached_property
    def first(self):
        return materialize(G.first_answers(self.known.select(*ROW, *self.said)))

    @cached_property
    def tagged(self):
        return G.file_tags(self.t.sheet_files)

    @cached_property
    def refs(self):
        return materialize(G.file_refs(self.tagged))

    @cached_property
    def resolved(self):
        return G.resolve_links(self.first, self.refs)

    @cached_property
    def own_links(self):
        return G.links(self.resolved)

    @cached_property
    def unfolded(self):
        said = self.t.answer_judgements.join(self.first.select(*ROW, "ord"), [*ROW, "ord"], "left_semi")
        return G.unfold(said, rules(self.t))

    @cached_property
    def judged(self):
        return G.name_provenance(self.unfolded, self.refs)

    @cached_property
    def named(self):
        return materialize(self.judged)

    @cached_property
    def linked(self):
        return G.rescue_links(self.own_links, self.__dict__.get("named", self.judged))[0]

    @cached_property
    def links(self):
        return materialize(self.linked)

    @cached_property
    def lowered(self):
        named = self.named
        return G.downgrade(G.with_link_facts(named, self.first, self.__dict__.get("links", self.linked)))

    @cached_property
    def values(self):
        v = F.create_map(*[x for n in ("company", "hours", "period", "heads") for x in (F.lit(n), c(n))])
        return self.rows.select(*ROW, v.alias("vals"))

    @cached_property
    def final(self):
        self.named, self.links  # noqa: B018  both are read several times, links of judgements once written
        return G.lower_borrowed(G.prefix_provenance(self.lowered), G.borrowed_rows(self.links, self.values))


# DuckDB: the same steps as CTEs over the derived tables.
_CODE = "CASE said WHEN 'O' THEN 'PASS' WHEN 'X' THEN 'FAIL' WHEN '확인 불가' THEN 'UNDETERMINED' WHEN '공란' THEN 'BLANK' ELSE said END"
STEPS = f"""known AS (SELECT a.* FROM {{answers}} a WHERE EXISTS (SELECT 1 FROM {{sheet_rows}} r WHERE r.wb = a.wb AND r.sheet = a.sheet AND r.row = a.row)),
firsta AS (SELECT * FROM known QUALIFY row_number() OVER (PARTITION BY wb, sheet, row ORDER BY ord) = 1),
tagged AS (SELECT *, 'file_' || lpad(cast(row_number() OVER (PARTITION BY wb, sheet ORDER BY ord) as varchar),
             cast(greatest(2, len(cast(count(*) OVER (PARTITION BY wb, sheet) as varchar))) as int), '0') AS tag FROM {{sheet_files}}),
cited AS (SELECT wb, sheet, row, ord, batch, generate_subscripts(l, 1) - 1 AS place, unnest(l) AS ref
          FROM (SELECT *, string_split(tags, '|') AS l FROM firsta WHERE tags <> '') x),
resolved AS (SELECT c.*, coalesce(t1.name, t2.name) AS name FROM cited c
             LEFT JOIN tagged t1 ON t1.wb = c.wb AND t1.sheet = c.sheet AND t1.tag = c.ref
             LEFT JOIN tagged t2 ON t2.wb = c.wb AND t2.sheet = c.sheet AND t2.name = c.ref),
own AS (SELECT wb, sheet, row, name, min(place) AS place FROM resolved WHERE name IS NOT NULL GROUP BY ALL),
unfolded AS (SELECT j.wb, j.sheet, j.row, j.item_no, r.item, {_CODE} AS verdict,
               CASE WHEN trim(provenance) = '없음' THEN '' ELSE trim(provenance) END AS provenance,
               rationale, remark
             FROM {{answer_judgements}} j JOIN firsta f ON f.ord = j.ord
             JOIN {{judge_rules}} r ON r.sheet = j.sheet AND r.item_no = j.item_no AND r.judge = '모형' WHERE trim(said) <> ''),
named AS (SELECT u.* EXCLUDE (provenance), coalesce(t1.name, t2.name, '') AS provenance FROM unfolded u
          LEFT JOIN tagged t1 ON t1.wb = u.wb AND t1.sheet = u.sheet AND t1.tag = u.provenance
          LEFT JOIN tagged t2 ON t2.wb = u.wb AND t2.sheet = u.sheet AND t2.name = u.provenance),
rescued AS (SELECT wb, sheet, row, provenance AS name, min(item_no) AS item_no FROM named n WHERE provenance <> ''
            AND NOT EXISTS (SELECT 1 FROM own o WHERE o.wb = n.wb AND o.sheet = n.sheet AND o.row = n.row AND o.name = n.provenance) GROUP BY ALL),
links AS (SELECT wb, sheet, row, name, place FROM own UNION ALL SELECT wb, sheet, row, name, item_no + 100000 FROM rescued),
facts AS (SELECT n.*, f.confidence, (SELECT count(*) FROM links l WHERE l.wb = n.wb AND l.sheet = n.sheet AND l.row = n.row) AS n_links
          FROM named n JOIN firsta f ON f.wb = n.wb AND f.sheet = n.sheet AND f.row = n.row),
why AS (SELECT *, CASE WHEN verdict NOT IN ('PASS', 'FAIL') THEN NULL WHEN trim(rationale) = '' THEN 'no_rationale' WHEN n_links = 0 THEN 'no_link'
                       WHEN verdict = 'FAIL' AND confidence NOT IN ('높음', '보통') THEN 'weak_link' END AS reason FROM facts),
lowered AS (SELECT * EXCLUDE (verdict, rationale, remark), CASE WHEN reason IS NULL THEN verdict ELSE 'UNDETERMINED' END AS verdict, CASE WHEN reason IS NOT NULL THEN verdict END AS was,
              CASE WHEN reason IS NULL THEN rationale WHEN trim(rationale) = '' THEN 'lowered by code' ELSE trim(rationale) || ' · lowered by code' END AS rationale,
              CASE WHEN reason IS NULL THEN remark WHEN trim(remark) <> '' THEN trim(remark) ELSE {D.short_item('item')} || ': not decided' END AS remark FROM why),
prefixed AS (SELECT * EXCLUDE (rationale), CASE WHEN provenance <> '' AND NOT starts_with(rationale, '「') THEN trim('「' || provenance || '」 ' || rationale) ELSE rationale END AS rationale FROM lowered),
borrowed AS (SELECT a.wb, a.sheet, a.row, min(b.row) AS larger_row FROM (SELECT r.*, name FROM {{sheet_rows}} r JOIN links l USING (wb, sheet, row)) a
             JOIN (SELECT r.*, name FROM {{sheet_rows}} r JOIN links l USING (wb, sheet, row)) b ON a.wb = b.wb AND a.sheet = b.sheet AND a.name = b.name AND a.row <> b.row
             WHERE (a.company = '' OR a.company = b.company) AND (a.hours = '' OR a.hours = b.hours) AND (a.period = '' OR a.period = b.period) AND (a.heads = '' OR a.heads = b.heads)
               AND (a.company = '')::int + (a.hours = '')::int + (a.period = '')::int + (a.heads = '')::int
                 > (b.company = '')::int + (b.hours = '')::int + (b.period = '')::int + (b.heads = '')::int GROUP BY ALL),
final AS (SELECT p.* EXCLUDE (verdict, rationale, remark), CASE WHEN larger_row IS NOT NULL AND verdict IN ('PASS', 'FAIL') THEN larger_row END AS lowered_for,
            CASE WHEN larger_row IS NOT NULL AND verdict IN ('PASS', 'FAIL') THEN 'UNDETERMINED' ELSE verdict END AS verdict,
            CASE WHEN larger_row IS NOT NULL AND verdict IN ('PASS', 'FAIL') THEN {D.short_item('item')} || ': all values of this row are in row ' || larger_row ELSE remark END AS remark,
            CASE WHEN larger_row IS NOT NULL AND verdict IN ('PASS', 'FAIL') THEN rationale || ' · lowered by code (borrowed evidence)' ELSE rationale END AS rationale
          FROM prefixed p LEFT JOIN borrowed b ON b.wb = p.wb AND b.sheet = p.sheet AND b.row = p.row)"""


def steps(sql: str) -> str:
    """Steps, then ``sql``, which may add CTEs of its own after a leading comma."""
    return f"WITH {STEPS}{sql.lstrip() if sql.lstrip().startswith(',') else ' ' + sql}"


@query("s09_answer_scan", """
SELECT a.ord, row, replace(tags, '|', ',') AS tags, link_reason, confidence, memo, total_hours, roster_status,
       replace(roster_names, '|', ',') AS roster_names, j1.said AS v1, j2.rationale AS why2
FROM {answers} a JOIN (SELECT ord, said FROM {answer_judgements} WHERE item_no = 1) j1 USING (ord)
JOIN (SELECT ord, rationale FROM {answer_judgements} WHERE item_no = 2) j2 USING (ord)""")
def s09(t):
    scanned = A.scan_answers(t.answer_json)
    field = lambda v, n: F.get_json_object(F.try_element_at("said", F.lit(v)), f"$.{n}")
    return scanned.select(
        "ord", "row", F.array_join("tags", ",").alias("tags"), "link_reason", "confidence", "memo",
        F.try_element_at("ext", F.lit("총시간")).alias("total_hours"), c("roster.status").alias("roster_status"),
        F.array_join("roster.names", ",").alias("roster_names"), field("v1", A.VERDICT).alias("v1"), field("v2", A.RATIONALE).alias("why2"),
    )


@query("g01_unknown_rows", steps("""
SELECT ord, row, 'dropped' AS outcome FROM {answers} WHERE ord NOT IN (SELECT ord FROM known) UNION ALL SELECT ord, row, 'kept' FROM known"""))
def g01(t):
    f = Flow(t)
    tell = lambda df, what: df.select("ord", "row", F.lit(what).alias("outcome"))
    return tell(G.unknown_rows(f.answers, f.rows), "dropped").unionByName(tell(f.known, "kept"))


@query("g02_repeated_rows", steps("""
SELECT ord, row, 'kept' AS outcome FROM firsta UNION ALL SELECT ord, row, 'dropped' FROM known WHERE ord NOT IN (SELECT ord FROM firsta)"""))
def g02(t):
    f = Flow(t)
    tell = lambda df, what: df.select("ord", "row", F.lit(what).alias("outcome"))
    return tell(f.first, "kept").unionByName(tell(G.repeated_rows(f.known), "dropped"))


@query("g03_tag_to_name", steps("SELECT wb, sheet, row, place, ref AS cited, name FROM resolved"))
def g03(t):
    return Flow(t).resolved


@query("g04_invented_tags", steps("""
SELECT wb, sheet, row, count(*) AS n, array_to_string(list(ref ORDER BY place), ', ') AS shown FROM resolved WHERE name IS NULL GROUP BY ALL"""))
def g04(t):
    return G.invented_tags(Flow(t).resolved)


@query("g05_judgement_unfold", steps("SELECT wb, sheet, row, item_no, item, verdict, provenance, rationale, remark FROM unfolded"))
def g05(t):
    return Flow(t).unfolded.drop("ord")


@query("g06_provenance_rescue", steps("""
SELECT wb, sheet, row, arg_min(name, item_no) AS first_file, count(*) AS n FROM rescued GROUP BY ALL"""))
def g06(t):
    f = Flow(t)
    return G.rescue_signals(G.rescue_links(f.own_links, f.named)[1])


def _lowered(name: str, reason: str):
    @query(name, steps(f"SELECT wb, sheet, row, item_no, was, verdict FROM lowered WHERE reason = '{reason}'"))
    def run(t):
        return Flow(t).lowered.filter(c("reason") == reason).select(*ROW, "item_no", "was", "verdict")

    return run


_lowered("g07_no_rationale", "no_rationale")
_lowered("g08_no_link", "no_link")
_lowered("g09_weak_link", "weak_link")


@query("g10_downgrade_records", steps("SELECT wb, sheet, row, item_no, reason, verdict, remark, rationale FROM lowered"))
def g10(t):
    return Flow(t).lowered.select(*ROW, "item_no", "reason", "verdict", "remark", "rationale")


@query("g11_provenance_prefix", steps("SELECT wb, sheet, row, item_no, rationale FROM prefixed"))
def g11(t):
    return G.prefix_provenance(Flow(t).lowered).select(*ROW, "item_no", "rationale")


@query("g12_borrowed_evidence", steps("SELECT wb, sheet, row, item_no, verdict, remark, rationale, lowered_for FROM final"))
def g12(t):
    return Flow(t).final.select(*ROW, "item_no", "verdict", "remark", "rationale", "lowered_for")


@query("g13_shared_files", steps("""
, used AS (SELECT l.*, f.batch, f.ord FROM links l JOIN firsta f ON f.wb = l.wb AND f.sheet = l.sheet AND f.row = l.row)
SELECT wb, sheet, batch, name, count(*) OVER (PARTITION BY wb, sheet, batch, name) AS n_rows, row FROM used QUALIFY n_rows > 1"""))
def g13(t):
    f = Flow(t)
    return G.shared_files(f.links, f.first)


@query("g14_missing_rows", steps("""
, gone AS (SELECT wb, sheet, row FROM {sheet_rows} EXCEPT SELECT wb, sheet, row FROM firsta)
SELECT wb, sheet, row, 'err' AS level FROM gone"""))
def g14(t):
    f = Flow(t)
    return G.missing_alert(G.missing_rows(f.rows, f.first))


@query("g15_unused_files", steps("SELECT wb, sheet, name FROM {sheet_files} EXCEPT SELECT wb, sheet, name FROM links"))
def g15(t):
    f = Flow(t)
    return G.unused_files(t.sheet_files, f.links)


@query("g16_blank_batches", steps("""
SELECT wb, sheet, batch FROM known GROUP BY ALL HAVING bool_and(tags = '' AND trim(link_reason) = '')"""))
def g16(t):
    return G.blank_batches(Flow(t).known)


@query("g17_ask_again", steps("""
, missing AS (SELECT r.wb, r.sheet, r.batch, count(*) AS missing FROM {sheet_rows} r WHERE NOT EXISTS (SELECT 1 FROM {answers} a WHERE a.wb = r.wb AND a.sheet = r.sheet AND a.row = r.row) GROUP BY ALL),
blanks AS (SELECT wb, sheet, batch FROM known GROUP BY ALL HAVING bool_and(tags = '' AND trim(link_reason) = ''))
SELECT wb, sheet, batch, coalesce(missing, 0) AS missing, b.wb IS NOT NULL AS blank FROM missing m FULL JOIN (SELECT *, wb AS w FROM blanks) b USING (wb, sheet, batch)""").replace("b.wb IS NOT NULL", "w IS NOT NULL"))
def g17(t):
    f = Flow(t)
    return G.ask_again(G.row_batches(f.rows.select(*ROW)), f.answers, attempt=1)


_ATTEMPTS = """WITH asked AS (SELECT wb, sheet, batch, count(*) AS asked FROM {sheet_rows} GROUP BY ALL),
log AS (SELECT a.wb, a.sheet, a.batch, a.attempt, any_value(asked) - count(DISTINCT r.row) AS missing, max(finish) AS finish,
    count(DISTINCT r.row) > 0 AND NOT coalesce(bool_or(tags <> '' OR trim(link_reason) <> '') FILTER (r.row IS NOT NULL), false) AS blank
  FROM {attempts} a JOIN asked q ON q.wb = a.wb AND q.sheet = a.sheet AND q.batch = a.batch
  LEFT JOIN {sheet_rows} r ON r.wb = a.wb AND r.sheet = a.sheet AND r.batch = a.batch AND r.row = a.row GROUP BY 1, 2, 3, 4),
picked AS (SELECT *, row_number() OVER (PARTITION BY wb, sheet, batch ORDER BY missing = 0 AND NOT blank DESC,
    CASE WHEN missing = 0 AND NOT blank THEN attempt ELSE -attempt END) AS nth FROM log WHERE attempt <= 3),
outcome AS (SELECT wb, sheet, batch, attempt, attempt - 1 AS repeats, missing, blank, CASE WHEN missing = 0 AND NOT blank THEN 'answered' WHEN attempt <= 2 THEN 'ask again'
    WHEN blank AND missing = 0 THEN 'blank to the end' ELSE 'limit' END AS stop, finish FROM picked WHERE nth = 1)"""


def outcomes(t):
    said = t.attempts.withColumn("tags", F.when(c("tags") == "", F.array().cast("array<string>")).otherwise(F.split("tags", "\\|")))
    return G.attempt_outcomes(G.attempt_log(t.sheet_rows.select(*ROW, "batch"), said))


@query("g17_attempt_outcomes", _ATTEMPTS + " SELECT * FROM outcome")
def g17_outcomes(t):
    return outcomes(t)


@query("g17_batches_to_ask", _ATTEMPTS + """ SELECT DISTINCT r.wb, r.sheet, r.batch, coalesce(attempt, 0) + 1 AS attempt FROM {sheet_rows} r
LEFT JOIN outcome o ON o.wb = r.wb AND o.sheet = r.sheet AND o.batch = r.batch WHERE stop IS NULL OR stop = 'ask again'""")
def g17_due(t):
    return G.batches_to_ask(t.sheet_rows, outcomes(t))


@query("g18_unlinked_reasons", steps("""
SELECT u.wb, u.sheet, coalesce(t.name, u.ref) AS file, u.batch, u.ord, u.reason FROM {unlinked_files} u
LEFT JOIN tagged t ON t.wb = u.wb AND t.sheet = u.sheet AND t.tag = u.ref
QUALIFY row_number() OVER (PARTITION BY u.wb, u.sheet, coalesce(t.name, u.ref) ORDER BY u.batch, u.ord) = 1"""))
def g18(t):
    return G.unlinked_reasons(t.unlinked_files, Flow(t).refs)


@query("g19_answer_summary", steps("""
SELECT f.wb, f.sheet, count(*) AS answered,
       coalesce(any_value(l.linked), 0) AS linked, coalesce(any_value(pass), 0) AS pass, coalesce(any_value(fail), 0) AS fail,
       coalesce(any_value(undetermined), 0) AS undetermined, coalesce(any_value(blank), 0) AS blank
FROM firsta f LEFT JOIN (SELECT wb, sheet, count(DISTINCT row) AS linked FROM links GROUP BY ALL) l ON l.wb = f.wb AND l.sheet = f.sheet
LEFT JOIN (SELECT wb, sheet, count(*) FILTER (verdict = 'PASS') AS pass, count(*) FILTER (verdict = 'FAIL') AS fail,
           count(*) FILTER (verdict = 'UNDETERMINED') AS undetermined, count(*) FILTER (verdict = 'BLANK') AS blank FROM final GROUP BY ALL) v ON v.wb = f.wb AND v.sheet = f.sheet
GROUP BY ALL"""))
def g19(t):
    f = Flow(t)
    final = f.final
    return G.answer_summary(f.first, f.links, final)


@query("p06_file_tags", steps("SELECT wb, sheet, ord, name, tag FROM tagged"))
def p06(t):
    return Flow(t).tagged


@query("p07_row_batches", """
SELECT wb, sheet, row, cast(floor((row_number() OVER (PARTITION BY wb, sheet ORDER BY row) - 1) / 8) as bigint) AS batch FROM {sheet_rows}""")
def p07(t):
    return G.row_batches(t.sheet_rows.select(*ROW))


@query("p08_ownership", steps("""
SELECT t.wb, t.sheet, t.tag, l.row, f.batch + 1 AS visible_from FROM tagged t
LEFT JOIN links l ON l.wb = t.wb AND l.sheet = t.sheet AND l.name = t.name
LEFT JOIN firsta f ON f.wb = l.wb AND f.sheet = l.sheet AND f.row = l.row"""))
def p08(t):
    f = Flow(t)
    return G.ownership(f.linked, f.first, f.tagged)
