"""What people read: totals, attention list, side by side, verdict grid, leftovers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from veritab.functions.text import blank_to_empty, name_key, short_item
from veritab.functions.values import ABSENT, ROSTER_FOUND
from veritab.operators.judge import BLANK, FAIL, PASS, UNDETERMINED
from veritab.sources.files import replace_sheets

SHEET = ["wb", "sheet"]
VERDICTS = (PASS, FAIL, UNDETERMINED, BLANK)
# Fixed values of the report.
NO_WORD, NO_ANSWER = "(말이 없음)", "—"
ECHO = "(?U)^\\s*\\[([^\\]]{1,40})\\]\\s*"

c = F.col


def verdict_totals(judged: DataFrame, rows: DataFrame, keys: list[str] = SHEET, files: DataFrame | None = None) -> DataFrame:
    """Rows, linked and unlinked rows, files linked, and how often each verdict; with ``files`` also how many a sheet has."""
    linked = F.coalesce(F.size("links"), F.lit(0)) > 0
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(linked).alias("linked"), F.count_if(~linked).alias("unlinked"))
    used = rows.select(*keys, F.explode("links").alias("file")).groupBy(*keys).agg(F.countDistinct("file").alias("files"))
    verdicts = judged.groupBy(*keys).agg(*[F.count_if(c("verdict") == v).alias(v.lower()) for v in VERDICTS])
    out = counts.join(used, keys, "left").join(verdicts, keys, "left")
    if files is not None:
        out = out.join(files.groupBy(*keys).agg(F.count(F.lit(1)).alias("given")), keys, "left")
    return out.na.fill(0)


def attention(signals: DataFrame, unresolved: DataFrame, cuts: DataFrame) -> DataFrame:
    """Errors, warnings, unresolved columns and cut files first; the rest is for information.

    ``signals``: wb, sheet, place, level, code, detail. Sort by section, then place (a row, an item or a file), to read.
    """
    shape = lambda df, section, place, code, detail: df.select(
        *SHEET, section.alias("section"), place.cast("bigint").alias("place"), code.alias("code"), detail.alias("detail")
    )
    urgent = F.when(c("level").isin("err", "warn"), 1).otherwise(2)
    return (
        shape(signals, urgent, c("place"), c("code"), c("detail"))
        .unionByName(shape(unresolved, F.lit(1), c("item_no"), F.lit("column unresolved"), F.concat_ws(" · ", "item", "found")))
        .unionByName(shape(cuts, F.lit(1), c("ord"), F.lit("text cut"), F.concat_ws(" ", "name", c("total_chars").cast("string"), c("kept_chars").cast("string"))))
    )


def side_by_side(rows: DataFrame, claimed: list[str], extracted: dict[str, Column]) -> DataFrame:
    """Two records per claim, the claimed values above the extracted ones; how it was linked stands with the claim."""
    shown = lambda v: F.coalesce(F.nullif(blank_to_empty(v), F.lit("")), F.lit(ABSENT))
    claim = c("side") == "claim"
    return rows.withColumn("side", F.explode(F.array(F.lit("claim"), F.lit("evidence")))).select(
        *SHEET, "row", "side", *[F.when(claim, F.coalesce(n, F.lit(""))).otherwise("").alias(n) for n in ("linked_files", "confidence", "link_reason")],
        *[F.when(claim, shown(c(n))).otherwise("").alias(f"claim_{n}") for n in claimed],
        *[F.when(~claim, v).otherwise("").alias(f"evidence_{n}") for n, v in extracted.items()],
        F.when(claim, F.coalesce("memo", F.lit(""))).otherwise("").alias("memo"),
    )


def note(remark: Column, rationale: Column) -> Column:
    return F.concat_ws(" / ", F.nullif(remark, F.lit("")), F.nullif(rationale, F.lit("")))


def verdict_grid(judged: DataFrame, items: list[int], keys: list[str] = SHEET) -> DataFrame:
    """One record per row, verdict and note per item; no answer shows as a dash.

    ``items`` is the list of item numbers of the rule book, so no scan is needed to pivot.
    """
    wide = judged.groupBy(*keys, "row").pivot("item_no", items).agg(
        F.min("verdict").alias("verdict"), F.min(note(c("remark"), c("rationale"))).alias("note")
    )
    return wide.select(
        *keys, "row",
        *[F.coalesce(c(f"`{i}_verdict`"), F.lit(NO_ANSWER)).alias(f"v{i}") for i in items],
        *[F.coalesce(c(f"`{i}_note`"), F.lit("")).alias(f"n{i}") for i in items],
    )


def unlinked_rows(answers: DataFrame, row_links: DataFrame) -> DataFrame:
    """Rows without a file, with the reason given, the memo, or a placeholder."""
    given = lambda n: F.nullif(c(n), F.lit(""))
    return answers.join(row_links, [*SHEET, "row"], "left_anti").select(
        *SHEET, "row", F.coalesce(given("link_reason"), given("memo"), F.lit(NO_WORD)).alias("reason")
    )


def unused_file_reasons(reasons: DataFrame) -> DataFrame:
    return reasons.select(*SHEET, "file", "reason")


def metric_rows(df: DataFrame, **values: Column) -> DataFrame:
    """``(metric, value)`` rows of one table, several for each of its rows; a null value is none."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), v.cast("bigint").alias("value")) for n, v in values.items()])
    return df.select(F.inline(F.filter(pairs, lambda p: p["value"].isNotNull())))


def metrics(*tagged: DataFrame) -> DataFrame:
    """Sums of all metric rows in one aggregation; each table is scanned once, whatever it counts."""
    out = tagged[0]
    for more in tagged[1:]:
        out = out.unionByName(more)
    return out.groupBy("metric").agg(F.sum("value").alias("value"))


def cell_remark(item: Column, verdict: Column, remark: Column) -> Column:
    """Only what needs a hand: FAIL and UNDETERMINED, without an echoed ``[item]``, up to twice."""

    def without_echo(text: Column) -> Column:
        said = name_key(F.regexp_extract(text, ECHO, 1))
        echoed = text.rlike(ECHO) & ((said == name_key(item)) | (said == name_key(short_item(item))))
        return F.when(echoed, blank_to_empty(F.regexp_replace(text, ECHO, ""))).otherwise(text)

    text = blank_to_empty(remark)
    return F.when(verdict.isin(FAIL, UNDETERMINED), without_echo(without_echo(text))).otherwise("")


def roster_note(linked: Column, status: Column, names: Column, headcount: Column) -> Column:
    """What to say when files are linked but no names came out of them."""
    people = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: blank_to_empty(n) != "")
    said = (
        F.when(status == "명단없음", "no place with names in the evidence")
        .when(status == "글자깨짐", "names are there but unreadable")
        .otherwise("no person could be extracted")
    )
    stated = blank_to_empty(headcount)
    text = F.concat(said, F.when(stated != "", F.concat(F.lit(" — stated only as 「"), stated, F.lit("」"))).otherwise(""))
    silent = ~linked | status.isNull() | ((status == ROSTER_FOUND) & (F.size(people) > 0))
    return F.when(silent, "").otherwise(text)


def judgement_report(cells: DataFrame, keys: list[str] = SHEET) -> DataFrame:
    """One record per row with its cells in item order; rows without cells do not appear.

    ``cells``: keys, row, item_no, col, header, verdict, remark. A row has one cell per rule.
    """
    return cells.groupBy(*keys, "row").agg(
        F.array_sort(F.collect_list(F.struct("item_no", "col", "header", "verdict", "remark"))).alias("cells")
    )


def write_report(report: DataFrame, path: str) -> None:
    """Replace only the sheets that this run produced."""
    replace_sheets(report, path, "json", report.schema)


def read_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The report as written; ``schema`` is that of ``judgement_report``."""
    return spark.read.schema(schema).json(path)
