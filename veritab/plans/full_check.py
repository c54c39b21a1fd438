"""The whole check: worksheets, rule book, files and model answers to verdicts and writes.

Steps that several later ones read go through ``keep`` (``session.materialize`` on a
cluster), which writes them at once; nothing comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from veritab.functions.text import blank_to_empty
from veritab.operators import grid as H, guards as G, judge as J, report as R, rules as RB, writeplan as WP
from veritab.plans.evidence import Evidence
from veritab.session import materialize
from veritab.sources import answers as A

SHEET = ["wb", "sheet"]
ROW = [*SHEET, "row"]
c = F.col


@dataclass
class Checked:
    """Results of a run; what several of them read was written by ``keep``, the rest is lazy."""

    rules: DataFrame
    columns: DataFrame
    claims: DataFrame
    links: DataFrame
    judged: DataFrame
    signals: DataFrame
    writes: DataFrame


def book_of_workbooks(rules: DataFrame, titles: DataFrame) -> DataFrame:
    """``(wb, book)``: the rule book with the workbook's own name, else the first by name."""
    books = rules.select(c("wb").alias("book")).distinct()
    own = titles.select("wb").distinct().join(books, c("wb") == c("book"), "left")
    return own.select("wb", F.coalesce("book", books.agg(F.min("book")).scalar()).alias("book"))


def rules_for_sheets(rules: DataFrame, titles: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """Rules under the workbook and sheet title they apply to; ``books`` (wb, book) says which rule book serves which workbook."""
    books = book_of_workbooks(rules, titles) if books is None else books
    named = rules.withColumnsRenamed({"wb": "book", "sheet": "name"})
    targets = books.join(named.select("book", "name").distinct(), "book").select("wb", "name")
    found = H.resolve_sheet(targets, titles).filter(c("title").isNotNull()).join(books, "wb")
    return found.join(named, ["book", "name"]).drop("book", "name").withColumnRenamed("title", "sheet")


def claims_of(cells: DataFrame, merges: DataFrame, rules: DataFrame, keep) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(column map, claim rows with their values as a map, rows left out, headers no rule asked for)."""
    items = rules.select(*SHEET, "item_no", "item", c("claim_cols").alias("names"))
    wanted = cells.join(rules.select(*SHEET).distinct(), SHEET, "left_semi")
    headers = keep(H.data_headers(wanted, merges))
    columns = keep(H.column_map(H.resolve_columns(items, headers)))
    values = keep(H.read_values(wanted, merges, columns))
    heads = H.header_rows(wanted)
    ends = keep(H.end_rows(values, heads))
    rows = H.claim_values(values, ends).groupBy(*ROW).agg(  # one entry per rule column of the row
        F.map_from_entries(F.collect_list(F.struct("rep", "text"))).alias("vals")
    )
    return columns, keep(rows), H.dropped_rows(wanted, values, heads, ends), H.orphan_headers(headers, columns)


def run(cells: DataFrame, merges: DataFrame, titles: DataFrame, rule_cells: DataFrame, alias_rows: DataFrame,
        files: DataFrame, answer_json: DataFrame, overwrite: bool = True, keep=materialize, books: DataFrame | None = None,
        unlinked: DataFrame | None = None, evidence: Evidence | None = None) -> Checked:
    """``titles``: wb, ord, title. ``files``: wb, sheet, ord, name. ``answer_json``: wb, sheet, ord, batch, body.

    ``books`` (wb, book) names the rule book of a workbook. ``unlinked`` (wb, sheet, batch, ord, ref, reason): why the
    answers left a file unlinked. ``evidence``: what reading and packing the files found, see ``plans.evidence``.
    """
    scanned = keep(RB.scan_rules(rule_cells))
    aliases, alias_faults = RB.scan_aliases(alias_rows)
    book = RB.expand_claim_columns(RB.parse_rules(scanned), aliases)
    rules = keep(rules_for_sheets(book, titles, books))
    columns, claims, dropped, orphans = claims_of(cells, merges, rules, keep)

    answers = A.scan_answers(answer_json)
    known = G.known_rows(answers, claims)
    first = keep(G.first_answers(known))
    refs = keep(G.file_refs(G.file_tags(files)))
    resolved = keep(G.resolve_links(first, refs))
    named = keep(G.name_provenance(G.unfold(A.unfold_judgements(first), rules, tuple(SHEET)), refs))
    links, rescued = G.rescue_links(G.links(resolved), named)
    links = keep(links)
    lowered = keep(G.downgrade(G.with_link_facts(named, first, links)))
    borrowed = keep(G.borrowed_rows(links, claims))
    model = keep(G.lower_borrowed(G.prefix_provenance(lowered), borrowed))

    per_row = links.groupBy(*ROW).agg(F.collect_set("name").alias("links"))  # files of one row
    cases = (
        claims.join(first.select(*ROW, "ext", "roster"), ROW).join(per_row, ROW, "left").join(J.prior_verdicts(model, SHEET), ROW, "left")
    )
    judged = keep(J.overlay(model, J.judge(cases, rules, SHEET), rules, SHEET, SHEET))

    tell = lambda df, level, code, detail: df.select(*SHEET, F.lit(level).alias("level"), F.lit(code).alias("code"), detail.alias("detail"))
    number = c("row").cast("string")
    signals = (
        tell(G.unknown_rows(answers, claims), "warn", "unknown row", number)
        .unionByName(tell(A.rejected_answers(answer_json), "err", "answer not readable", F.concat_ws(" · ", "reason", "key")))
        .unionByName(tell(G.shared_files(links, first), "info", "file used by several rows", F.concat_ws(" ", "name", number)))
        .unionByName(tell(G.blank_batches(known), "err", "batch without any link or reason", c("batch").cast("string")))
        .unionByName(tell(G.repeated_rows(known), "warn", "repeated row", number))
        .unionByName(tell(G.invented_tags(resolved), "warn", "invented file", c("shown")))
        .unionByName(tell(G.rescue_signals(rescued), "info", "file taken from a judgement", c("first_file")))
        .unionByName(tell(lowered.filter("reason is not null"), "info", "lowered", F.concat_ws(" ", "item", number, "reason")))
        .unionByName(tell(borrowed, "warn", "borrowed evidence", number))
        .unionByName(tell(G.missing_alert(G.missing_rows(claims, first)), "err", "row without answer", number))
        .unionByName(tell(G.unused_files(files, links), "info", "unused file", c("name")))
        .unionByName(tell(dropped, "warn", "row in unknown columns only", number))
        .unionByName(tell(columns.filter("cols is null"), "warn", "column unresolved", F.concat_ws(" · ", "item", "how", "found")))
        .unionByName(tell(orphans, "info", "header no rule asks for", c("header")))
        .unionByName(tell(H.missing_headers(cells.join(rules.select(*SHEET).distinct(), SHEET, "left_semi")), "err", "no header found", c("first_row").cast("string")))
        .unionByName(tell(RB.lint(rule_cells, scanned), "warn", "rule book", F.concat_ws(" · ", "code", number, "detail")))
        .unionByName(tell(alias_faults.withColumn("sheet", F.lit(RB.ALIAS_SHEET)), "warn", "alias sheet", F.concat_ws(" · ", "code", "detail")))
    )
    if unlinked is not None:
        signals = signals.unionByName(tell(G.unlinked_reasons(unlinked, refs), "info", "file left unlinked", F.concat_ws(" · ", "file", "reason")))
    if evidence is not None:
        signals = signals.unionByName(tell(evidence.cuts, "warn", "text cut", F.concat_ws(" ", "name", c("total_chars").cast("string"), c("kept_chars").cast("string"))))
        signals = signals.unionByName(tell(evidence.problems, "err", "file not read", F.concat_ws(" · ", "name", "status")))
        signals = signals.unionByName(tell(evidence.over, "err", "evidence over the limit", F.concat_ws(" ", c("batch").cast("string"), c("tokens").cast("string"))))
    return Checked(rules, columns, claims, links, judged, signals, writes(cells, titles, rules, judged, first, per_row, overwrite))


def writes(cells: DataFrame, titles: DataFrame, rules: DataFrame, judged: DataFrame, answers: DataFrame, row_files: DataFrame, overwrite: bool) -> DataFrame:
    """Every check cell and remark with its value after writing."""
    placed = H.place_items(rules.select(*SHEET, "item_no", "item"), H.check_columns(H.header_cells(cells)))
    cols = ["wb", "sheet_name", "title", "row", "item_no", "header", "col", "verdict", "remark"]
    said = judged.join(placed.filter("col is not null").select(*SHEET, "item_no", "col"), [*SHEET, "item_no"]).select(
        "wb", c("sheet").alias("sheet_name"), c("sheet").alias("title"), "row", "item_no", c("item").alias("header"), "col", "verdict",
        R.cell_remark(c("item"), c("verdict"), c("remark")).alias("remark"),
    )
    note = R.roster_note(F.lit(True), c("roster.status"), c("roster.names"), blank_to_empty(F.try_element_at("ext", F.lit(J.HEADCOUNT_FIELD))))
    people = answers.join(row_files, ROW, "left_semi").select(
        "wb", c("sheet").alias("sheet_name"), c("sheet").alias("title"), "row", F.lit(1 << 20).cast("bigint").alias("item_no"), F.lit("인원").alias("header"),
        F.lit(None).cast("int").alias("col"), F.lit(None).cast("string").alias("verdict"), note.alias("remark"),
    )
    checks = WP.check_cells(cells)
    done = WP.outcomes(said.select(*cols).unionByName(people.select(*cols)), titles, checks)
    return WP.apply_plan(WP.plan(done, cells, checks), overwrite)
