"""Plan what goes into which check cell, and what stays as it is.

``verdicts``: (wb, sheet_name, row, item_no, header, col, verdict, remark); a null column
means the remark is all there is to say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritab.functions.text import blank_to_empty, strip
from veritab.operators.grid import CHECK_COLOURS, header_rows, resolve_sheet_loosely
from veritab.operators.judge import BLANK

SHEET = ["wb", "title"]
REMARK, SCHOOL, OPINION = "비고", "학교", "의견"  # fixed values: words of protected headers

c = F.col


def check_cells(cells: DataFrame) -> DataFrame:
    """Coloured cells of the header row with their own text."""
    heads = header_rows(cells).withColumnRenamed("head_row", "row")
    coloured = (c("pattern") == "solid") & F.upper("fill_rgb").isin(CHECK_COLOURS)
    return cells.join(heads, ["wb", "sheet", "row"]).filter(coloured).select(
        "wb", c("sheet").alias("title"), "col", strip(F.replace(F.coalesce("value", F.lit("")), F.lit("\n"), F.lit(" "))).alias("check")
    )


def remark_columns(checks: DataFrame) -> DataFrame:
    """First check column of a sheet that says remark and does not belong to the school."""
    return checks.filter(c("check").contains(REMARK) & ~c("check").contains(SCHOOL)).groupBy(*SHEET).agg(F.min("col").alias("remark_col"))


def outcomes(verdicts: DataFrame, titles: DataFrame, checks: DataFrame) -> DataFrame:
    """Every verdict with the sheet it goes to and whether it may be written."""
    names = verdicts.select("wb", c("sheet_name").alias("name")).distinct()
    found = resolve_sheet_loosely(names, titles).withColumnRenamed("name", "sheet_name")
    placed = verdicts.drop("title").join(found, ["wb", "sheet_name"], "left").join(checks, [*SHEET, "col"], "left")
    protected = c("check").contains(SCHOOL) & c("check").contains(OPINION)
    outcome = (
        F.when(c("title").isNull(), "no such sheet").when(c("row").isNull(), "no row number")
        .when(c("col").isNull(), "remark only").when(c("check").isNull(), "not a check column")
        .when(protected, "school opinion kept").otherwise("write")
    )
    return placed.withColumn("outcome", outcome)


def outcome_counts(done: DataFrame) -> DataFrame:
    return done.groupBy("wb", "outcome").agg(F.count(F.lit(1)).alias("n"))


def existing(cells: DataFrame) -> DataFrame:
    return cells.select("wb", c("sheet").alias("title"), "row", "col", c("value").alias("old"))


def base_remark(old: Column, own_heads: Column) -> Column:
    """The part of a remark that others wrote: own ``[item]`` pieces are taken out."""
    pieces = F.filter(F.transform(F.split(blank_to_empty(old), "\\n+| / "), strip), lambda p: p != "")
    head = lambda p: strip(F.regexp_extract(p, "^\\[([^\\]]+)\\]", 1))
    return F.array_join(F.filter(pieces, lambda p: ~((head(p) != "") & F.array_contains(own_heads, head(p)))), "\n")


def plan(done: DataFrame, cells: DataFrame, checks: DataFrame) -> DataFrame:
    """Cell writes: (wb, title, row, col, header, new, old, is_remark)."""
    old = existing(cells)
    at = [*SHEET, "row", "col"]
    direct = done.filter(c("outcome") == "write").join(old, at, "left").select(
        *at, "header", c("verdict").alias("new"), F.coalesce("old", F.lit("")).alias("old"), F.lit(False).alias("is_remark")
    )
    noted = done.filter(c("outcome").isin("write", "remark only") & (F.coalesce("remark", F.lit("")) != ""))
    lines = noted.groupBy(*SHEET, "row").agg(F.array_sort(F.collect_list(  # one line per rule of the row
        F.struct("item_no", F.concat(F.lit("["), c("header"), F.lit("] "), c("remark")).alias("said"))
    )).alias("l"))
    heads = done.filter(c("title").isNotNull()).groupBy(*SHEET).agg(F.collect_set("header").alias("heads"))  # the sheet's rule names
    remarks = (
        lines.join(remark_columns(checks).withColumnRenamed("remark_col", "col"), SHEET).join(heads, SHEET).join(old, at, "left")
        .select(
            *at, F.lit(REMARK).alias("header"), F.array_join(F.transform("l", lambda x: x["said"]), "\n").alias("new"),
            base_remark(F.coalesce("old", F.lit("")), c("heads")).alias("old"), F.lit(True).alias("is_remark"),
        )
    )
    return direct.unionByName(remarks)


def apply_plan(planned: DataFrame, overwrite: bool = False) -> DataFrame:
    """Value of each planned cell after writing. Remarks are put together anew each time,
    so writing twice changes nothing; a filled check cell stays unless told otherwise."""
    both = F.concat_ws("\n", F.nullif(blank_to_empty(c("old")), F.lit("")), F.nullif(blank_to_empty(c("new")), F.lit("")))
    skip = ~c("is_remark") & (blank_to_empty(c("old")) != "") & F.lit(not overwrite)
    value = F.when(c("is_remark"), F.nullif(both, F.lit(""))).when(skip, c("old")).when(F.coalesce("new", F.lit(BLANK)) != BLANK, c("new"))
    return planned.withColumns({"value": value, "action": F.when(skip, "kept").otherwise("written")})


def apply_counts(applied: DataFrame) -> DataFrame:
    return applied.groupBy(*SHEET).agg(F.count_if(c("action") == "written").alias("written"), F.count_if(c("action") == "kept").alias("kept"))


def plan_summary(planned: DataFrame) -> DataFrame:
    kind = F.when(c("is_remark"), "remark").otherwise(F.coalesce("new", F.lit(BLANK)))
    return planned.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))
