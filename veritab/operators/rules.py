"""The rule book: from worksheet cells to typed rules, aliases and faults."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veritab.functions.rulebook import calc_method
from veritab.functions.text import DIGITS_ONLY, ascii_digits, blank_to_empty, rule_key, split_list, strip
from veritab.operators.first import distinct_by_key, keep_first, mark_first
from veritab.operators.judge import BY_CODE, BY_HUMAN, BY_MODEL, HEADCOUNT_FIELD, ROSTER_FIELD

SHEET = ["wb", "sheet"]
MARK, MARK_ROWS, ALIAS_ROWS = "#", 12, 10  # defaults of the argument ``depth``
# Headings of a rule table by column, and sheets that hold no rules.
HEADINGS = ["#", "검수 항목", "판정주체", "셈법", "대조 축", "증빙 문서", "추출 필드", "엑셀 대조 열",
            "판정 규칙", "O", "X", "확인 불가", "공란", "비고 문구"]
OVERVIEW, ALIAS_SHEET, ALIAS_HEADING = "개요", "열 낱말", "대표 이름"
SIDE_SHEETS = [OVERVIEW, "열 낱말", "종합표", "추출 필드", "개정 이력"]
COLUMNS = ["key_cell", "item", "judge", "calc_text", "axis", "document", "extract_text", "claim_text",
           "rule_text", "say_pass", "say_fail", "say_undetermined", "say_blank", "remark_text"]
COMMON_FIELDS = "(?U)공통으로\\s*뽑을\\s*값\\s*[:：]\\s*(.+)"
LOOKALIKES = [(ROSTER_FIELD, "명단"), (HEADCOUNT_FIELD, "인원")]

c = F.col


def table_rows(cells: DataFrame) -> DataFrame:
    """One row per worksheet row of a possible rule sheet, its first 14 cells as columns."""
    text = [F.coalesce(F.max(F.when(c("col") == i, strip(c("value")))), F.lit("")).alias(n) for i, n in enumerate(COLUMNS, 1)]
    return (
        cells.filter(c("col").between(1, len(COLUMNS)) & ~strip(c("sheet")).isin(SIDE_SHEETS))
        .groupBy(*SHEET, "row").agg(*text)
    )


def mark_rows(rows: DataFrame, depth: int = MARK_ROWS) -> DataFrame:
    """The heading row of every rule sheet: the first ``#`` in the first ``depth`` rows of column 1."""
    return (
        rows.filter((c("row") <= depth) & (c("key_cell") == MARK))
        .groupBy(*SHEET).agg(F.min("row").alias("head_row"))
    )


def unmarked_sheets(cells: DataFrame, depth: int = MARK_ROWS) -> DataFrame:
    """Possible rule sheets without a mark in their first ``depth`` rows; ``detail`` is the row of a later one."""
    mark = F.when((c("col") == 1) & (strip(c("value")) == MARK), c("row"))
    sheets = cells.filter(~strip(c("sheet")).isin(SIDE_SHEETS)).groupBy(*SHEET).agg(F.min("row").cast("bigint").alias("row"), F.min(mark).alias("at"))
    late = sheets.filter(c("at").isNull() | (c("at") > depth))
    return late.select(*SHEET, "row", F.lit("no_mark").alias("code"), F.coalesce(c("at").cast("string"), F.lit("")).alias("detail"))


def scan_rules(cells: DataFrame, depth: int = MARK_ROWS) -> DataFrame:
    """Rule rows below the mark, up to the first key that is not a number."""
    rows = table_rows(cells)
    below = rows.join(mark_rows(rows, depth), SHEET).filter((c("row") > c("head_row")) & (c("key_cell") != ""))
    ends = below.filter(~c("key_cell").rlike(DIGITS_ONLY)).groupBy(*SHEET).agg(F.min("row").alias("end_row"))
    return (
        below.join(ends, SHEET, "left")
        .filter(c("end_row").isNull() | (c("row") < c("end_row"))).drop("head_row", "end_row")
    )


def parse_rules(rows: DataFrame) -> DataFrame:
    """Typed rules. Rows without a name and repeated numbers are left out (see ``lint``)."""
    told = ["row", "item", "judge", "calc_text", "extract_text", "claim_text", "rule_text"]  # a record that is kept whole cannot be pruned later
    named = rows.filter(c("item") != "").select(*SHEET, ascii_digits(c("key_cell")).try_cast("bigint").alias("item_no"), *told)
    return keep_first(named, [*SHEET, "item_no"], ["row"]).select(
        *SHEET, "row", "item_no", "item",
        F.when(c("judge").isin(BY_MODEL, BY_CODE, BY_HUMAN), c("judge")).otherwise(BY_MODEL).alias("judge"),
        calc_method(c("calc_text")).alias("calc"), split_list(c("extract_text")).alias("extract_fields"),
        split_list(c("claim_text")).alias("claim_cols"), "rule_text",
    )


def lint(cells: DataFrame, rows: DataFrame, depth: int = MARK_ROWS) -> DataFrame:
    """Faults of the rule tables as (wb, sheet, row, code, detail); a sheet without a mark is one."""
    found = heading_faults(cells, depth).unionByName(row_faults(rows)).unionByName(empty_tables(cells, rows, depth))
    return found.unionByName(unmarked_sheets(cells, depth))


def heading_faults(cells: DataFrame, depth: int = MARK_ROWS) -> DataFrame:
    all_rows = table_rows(cells)
    heads = all_rows.join(mark_rows(all_rows, depth).withColumnRenamed("head_row", "row"), [*SHEET, "row"])
    wrong = [
        F.when(~F.contains(rule_key(c(n)), rule_key(F.lit(h))), F.struct(F.lit("heading_differs").alias("code"), F.lit(h).alias("detail")))
        for n, h in zip(COLUMNS, HEADINGS)
    ]
    return heads.select(*SHEET, c("row").cast("bigint").alias("row"), F.inline(F.array_compact(F.array(*wrong))))


def row_faults(rows: DataFrame) -> DataFrame:
    """All faults of a rule row at once; a skipped row is not looked at further."""
    numbered = rows.withColumns({"item_no": ascii_digits(c("key_cell")).try_cast("bigint"), "item_key": rule_key(c("item"))})
    by_number = numbered.filter(c("item") != "").groupBy(*SHEET, "item_no").agg(F.min("row").alias("number_row"))
    placed = numbered.join(by_number, [*SHEET, "item_no"], "left")
    named, kept = c("item") != "", (c("item") != "") & (c("row") == c("number_row"))
    by_name = placed.filter(kept).groupBy(*SHEET, "item_key").agg(F.min("row").alias("name_row"))
    fault = lambda when, code, detail: F.when(when, F.struct(F.lit(code).alias("code"), c(detail).alias("detail")))
    found = F.array(
        fault(~named, "no_name", "key_cell"),
        fault(named & ~kept, "number_repeated", "item"),
        fault(kept & (c("row") > c("name_row")), "name_repeated", "item"),
        fault(kept & ~c("judge").isin(BY_MODEL, BY_CODE, BY_HUMAN), "unknown_judge", "judge"),
        fault(kept & (c("judge") == BY_CODE) & calc_method(c("calc_text"))["kind"].isNull(), "no_method", "calc_text"),
        fault(kept & (c("judge") != BY_HUMAN) & (c("rule_text") == ""), "no_rule_text", "item"),
    )
    return placed.join(by_name, [*SHEET, "item_key"], "left").select(
        *SHEET, c("row").cast("bigint").alias("row"), F.inline(F.array_compact(found))
    )


def empty_tables(cells: DataFrame, rows: DataFrame, depth: int = MARK_ROWS) -> DataFrame:
    """Rule sheets of which no item could be read."""
    marks = mark_rows(table_rows(cells), depth)
    return marks.join(rows.filter(c("item") != ""), SHEET, "left_anti").select(
        *SHEET, c("head_row").cast("bigint").alias("row"), F.lit("no_items").alias("code"), F.lit("").alias("detail")
    )


def alias_table(cells: DataFrame, depth: int = ALIAS_ROWS) -> tuple[DataFrame, DataFrame]:
    """(alias rows, faults) of the alias sheet of each workbook, given as cells.

    The table begins below the first row, among the first ``depth``, whose first cell is the heading; its rows are
    (wb, ord, rep, alias_text). A workbook whose alias sheet has no such row leaves a fault and no aliases.
    """
    text = lambda i: F.coalesce(F.max(F.when(c("col") == i, strip(c("value")))), F.lit(""))
    rows = cells.filter((strip(c("sheet")) == ALIAS_SHEET) & c("col").isin(1, 2)).groupBy("wb", c("row").cast("bigint").alias("ord")).agg(text(1).alias("rep"), text(2).alias("alias_text"))
    is_head = (c("ord") <= depth) & (rule_key(c("rep")) == rule_key(F.lit(ALIAS_HEADING)))
    heads = rows.groupBy("wb").agg(F.min(F.when(is_head, c("ord"))).alias("head"))
    faults = heads.filter(c("head").isNull()).select("wb", F.lit(0).cast("bigint").alias("ord"), F.lit("no_alias_heading").alias("code"), F.lit(ALIAS_HEADING).alias("detail"))
    return rows.join(heads, "wb").filter((c("ord") > c("head")) & (c("rep") != "")).drop("head"), faults


def scan_aliases(alias_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(aliases, faults). An alias row is a representative name and its synonyms."""
    named = alias_rows.withColumn("rep", blank_to_empty(c("rep"))).filter(c("rep") != "")
    listed = named.select(
        "wb", "ord", "rep", rule_key(c("rep")).alias("rep_key"),
        distinct_by_key(F.concat(F.array("rep"), split_list(c("alias_text"))), rule_key).alias("names"),
    )
    aliases = keep_first(listed, ["wb", "rep_key"], ["ord"])
    later = mark_first(listed, ["wb", "rep_key"], ["ord"]).filter("not is_first")
    return aliases, later.select("wb", "ord", F.lit("representative_repeated").alias("code"), c("rep").alias("detail"))


def expand_claim_columns(rules: DataFrame, aliases: DataFrame) -> DataFrame:
    """Follow every claim column by its synonyms; only representatives expand."""
    names = rules.select(*SHEET, "row", F.posexplode("claim_cols").alias("i", "name")).withColumn("rep_key", rule_key(c("name")))
    found = names.join(aliases.select("wb", "rep_key", "names"), ["wb", "rep_key"], "left")
    spread = F.concat(F.array("name"), F.coalesce("names", F.array().cast("array<string>")))
    lists = found.groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(F.struct("i", spread.alias("all")))).alias("l"))
    flat = F.flatten(F.transform("l", lambda x: x["all"]))
    wide = lists.select(*SHEET, "row", distinct_by_key(flat, rule_key).alias("wide"))
    return (
        rules.join(wide, [*SHEET, "row"], "left")
        .withColumn("claim_cols", F.coalesce("wide", "claim_cols")).drop("wide")
    )


def alias_overlaps(rules: DataFrame) -> DataFrame:
    """Two items of a sheet that aim at the same header under different names."""
    aims = rules.select(
        *SHEET, "row", "item_no", F.try_element_at("claim_cols", F.lit(1)).alias("rep"), F.posexplode("claim_cols").alias("i", "alias")
    ).withColumn("alias_key", rule_key(c("alias")))
    owners = aims.groupBy(*SHEET, "alias_key").agg(F.min_by("rep", F.struct("row", "i")).alias("owner"))
    return aims.join(owners, [*SHEET, "alias_key"]).filter(c("owner") != c("rep")).select(*SHEET, "item_no", "alias", "owner", "rep")


def common_fields(cells: DataFrame) -> DataFrame:
    """Fields extracted for every sheet, from the first such line of the overview."""
    lines = cells.filter((strip(c("sheet")) == OVERVIEW) & (c("col") == 1)).withColumn(
        "said", F.regexp_extract("value", COMMON_FIELDS, 1)
    )
    return lines.filter(c("said") != "").groupBy("wb").agg(F.min_by("said", "row").alias("said")).select(
        "wb", split_list(c("said")).alias("fields")
    )


def fields_per_sheet(rules: DataFrame, common: DataFrame) -> DataFrame:
    """Every field of a sheet once, common ones first, in order of first mention.

    The list per sheet is as long as the vocabulary of its rules.
    """
    own = rules.select(*SHEET, c("row").alias("at"), F.posexplode("extract_fields").alias("i", "field"))
    shared = rules.select(*SHEET).distinct().join(common, "wb").select(*SHEET, F.lit(0).alias("at"), F.posexplode("fields").alias("i", "field"))
    firsts = own.unionByName(shared).groupBy(*SHEET, "field").agg(F.min(F.struct("at", "i")).alias("first"))
    return firsts.groupBy(*SHEET).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "field"))), lambda x: x["field"]).alias("fields")
    )


def reserved_name_faults(fields: DataFrame) -> DataFrame:
    """A name that code knows is missing while a similar one is used."""
    used = fields.select("wb", F.explode("fields").alias("field")).distinct()
    checks = [
        used.groupBy("wb").agg(
            F.max(c("field") == name).alias("exact"),
            F.array_join(F.array_sort(F.collect_set(F.when(c("field").contains(word), c("field")))), " · ").alias("similar"),
        ).filter(~c("exact") & (c("similar") != "")).select("wb", F.lit(name).alias("reserved"), "similar")
        for name, word in LOOKALIKES
    ]
    return checks[0].unionByName(checks[1])


def summary(rules: DataFrame) -> DataFrame:
    """Items per sheet by who judges them."""
    who = [(BY_MODEL, "model"), (BY_CODE, "code"), (BY_HUMAN, "human")]
    return rules.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("items"), *[F.count_if(c("judge") == j).alias(n) for j, n in who])
