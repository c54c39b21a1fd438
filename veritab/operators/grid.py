"""Worksheets: find the sheet, the header row, the columns and the claim rows.

``cells`` is long: (wb, sheet, row, col, value, fill_rgb, pattern); ``merges`` holds
(wb, sheet, r1, r2, c1, c2). Only the header row of a sheet is ever gathered into one
record; a worksheet has at most 16,384 columns. Data rows stay long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from veritab.functions.text import DIGITS_ONLY, loose_sheet_key, name_key, strip, unnumbered_key
from veritab.operators.first import keep_first, previous_value
from veritab.session import materialize

SHEET = ["wb", "sheet"]
HEAD_SCAN, BLANK_RUN = 30, 20  # defaults of the arguments ``depth`` and ``run``
PIECE = 4096
# The check colour, headers that are never compared, and names of the roster and its columns.
CHECK_COLOURS = ["FFFCE4D6", "FCE4D6", "00FCE4D6"]
SIDE_HEADERS = ["번호", "연번", "순번", "no", "차년도", "분야", "학교", "비고", "학교 의견", "차수", "구분"]
ROSTER_SHEETS = ("별첨1 명단", "별첨1")
ROSTER_NAMES = ["성명", "이름", "학생명", "참여학생"]
ROSTER_CATEGORIES = ["학생분류", "구분", "재직", "유형"]
EXACT, SIMILAR, AMBIGUOUS, NOT_FOUND = "exact", "similar", "ambiguous", "not found"

c = F.col
contains_either = lambda a, b: F.contains(a, b) | F.contains(b, a)
painted = lambda: (c("pattern") == "solid") & F.upper("fill_rgb").isin(CHECK_COLOURS)
filled = lambda: F.coalesce(c("value"), F.lit("")) != ""


# --- sheets -------------------------------------------------------------------------------

def _books(targets: DataFrame, titles: DataFrame, key) -> DataFrame:
    """A workbook's wanted names and its sheet list in sheet order, in one record: a book has a few hundred sheets at most."""
    listed = titles.groupBy("wb").agg(
        F.array_sort(F.collect_list(F.struct("ord", "title", key(c("title")).alias("k"), unnumbered_key(c("title")).alias("u")))).alias("titles")
    )
    wanted = targets.groupBy("wb").agg(F.collect_list(F.struct("name", key(c("name")).alias("k"), unnumbered_key(c("name")).alias("u"))).alias("wanted"))
    return wanted.join(listed, "wb")


def _found_titles(books: DataFrame, title) -> DataFrame:
    """``title`` of each wanted name, found within the book's record."""
    found = F.transform("wanted", lambda w: F.struct(w["name"].alias("name"), title(w).alias("title")))
    return books.select("wb", F.explode(found).alias("x")).select("wb", "x.name", "x.title")


def resolve_sheet(targets: DataFrame, titles: DataFrame) -> DataFrame:
    """Exact key, else the only sheet with that name unnumbered, else the only one containing it."""
    first = lambda keep: F.get(F.filter("titles", keep), F.lit(0))["title"]
    only = lambda keep: F.when(F.size(F.filter("titles", keep)) == 1, first(keep))
    return _found_titles(_books(targets, titles, name_key), lambda w: F.coalesce(
        first(lambda t: t["k"] == w["k"]), only(lambda t: t["u"] == w["u"]),
        only(lambda t: (w["u"] != "") & contains_either(t["u"], w["u"])),
    ))


def resolve_sheet_loosely(targets: DataFrame, titles: DataFrame) -> DataFrame:
    """Write side: same text, else same loose key, else the first containing one."""
    first = lambda keep: F.get(F.filter("titles", keep), F.lit(0))["title"]
    return _found_titles(_books(targets, titles, loose_sheet_key), lambda w: F.coalesce(
        first(lambda t: t["title"] == w["name"]), first(lambda t: t["k"] == w["k"]),
        first(lambda t: (w["k"] != "") & contains_either(t["k"], w["k"])),
    ))


def roster_sheets(titles: DataFrame, names: tuple[str, ...] = ROSTER_SHEETS) -> DataFrame:
    """``(wb, title)`` of each workbook's roster: the sheet of the first of ``names`` that finds one."""
    wanted = titles.select("wb").distinct().select("wb", F.explode(F.array(*[F.lit(n) for n in names])).alias("name"))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), c("name"))
    found = resolve_sheet(wanted, titles).filter(c("title").isNotNull())
    return found.groupBy("wb").agg(F.min_by("title", place).alias("title"))


# --- header row ---------------------------------------------------------------------------

def _top_rows(cells: DataFrame, depth: int) -> DataFrame:
    """Painted and filled cells of each of the first ``depth`` rows; the rows below count as one without any, so no sheet is missing."""
    top = c("row") <= depth
    return cells.groupBy(*SHEET, F.least("row", F.lit(depth + 1)).cast("bigint").alias("row")).agg(
        F.count_if(top & painted()).alias("n_painted"), F.count_if(top & filled()).alias("n_filled")
    )


def header_rows(cells: DataFrame, depth: int = HEAD_SCAN) -> DataFrame:
    """The row with most check-coloured cells near the top, else with most text, else the first."""
    best = _top_rows(cells, depth).groupBy(*SHEET).agg(
        F.max(F.struct("n_painted", (-c("row")).alias("at"))).alias("p"), F.max(F.struct("n_filled", (-c("row")).alias("at"))).alias("t")
    )
    row = F.when(c("p.n_painted") > 0, -c("p.at")).when(c("t.n_filled") > 0, -c("t.at")).otherwise(1)
    return best.select(*SHEET, row.cast("bigint").alias("head_row"))


def missing_headers(cells: DataFrame, depth: int = HEAD_SCAN) -> DataFrame:
    """Sheets whose first ``depth`` rows hold neither text nor colour, with the first row that has some."""
    empty = _top_rows(cells, depth).groupBy(*SHEET).agg(F.max(F.greatest("n_painted", "n_filled")).alias("n")).filter("n = 0").select(*SHEET)
    first = cells.filter(filled() | painted()).groupBy(*SHEET).agg(F.min("row").cast("bigint").alias("first_row"))
    return empty.join(first, SHEET, "left")


def header_cells(cells: DataFrame, depth: int = HEAD_SCAN) -> DataFrame:
    """Cells of the header row, which is one of the first ``depth`` rows; those below are not shuffled for it."""
    heads = header_rows(cells, depth).withColumnRenamed("head_row", "row")
    return cells.filter(c("row") <= max(depth, 1)).join(heads, [*SHEET, "row"]).select(*SHEET, "row", "col", F.coalesce("value", F.lit("")).alias("value"), painted().alias("painted"))


def check_columns(head: DataFrame) -> DataFrame:
    """Coloured header cells by name; a blank one carries the name on its left."""
    carried = F.last(F.when(c("value") != "", strip(c("value"))), ignorenulls=True).over(Window.partitionBy(*SHEET).orderBy("col"))
    named = head.withColumn("header", carried).filter(c("painted") & c("header").isNotNull())
    return keep_first(named.select(*SHEET, "header", "col"), [*SHEET, "header"], ["col"])


def _spans_at(head: DataFrame, merges: DataFrame) -> DataFrame:
    """Header cells with the merge ``(c1, c2)`` they lie in, null for none.

    Merges that cross the header row and its cells are one stream by column; the widest merge begun
    so far is carried along it, so nothing is unrolled. A row has at most 16,384 columns.
    """
    crossing = merges.join(head.select(*SHEET, "row").distinct(), SHEET).filter("row between r1 and r2")
    begun = crossing.select(*SHEET, c("c1").alias("col"), F.lit(0).alias("kind"), F.struct(c("c2").alias("to"), c("c1").alias("from")).alias("span"))
    here = head.select(*SHEET, "col", F.lit(1).alias("kind"), F.lit(None).cast(begun.schema["span"].dataType).alias("span"), "row", "value", "painted")
    widest = F.max("span").over(Window.partitionBy(*SHEET).orderBy("col", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    swept = here.unionByName(begun, allowMissingColumns=True).withColumn("open", widest).filter("kind = 1")
    inside = c("open.to") >= c("col")
    return swept.select(*SHEET, "row", "col", "value", "painted", F.when(inside, c("open.from")).alias("c1"), F.when(inside, c("open.to")).alias("c2"))


def data_headers(cells: DataFrame, merges: DataFrame, depth: int = HEAD_SCAN) -> DataFrame:
    """Headers that are not check columns, with the columns each one covers.

    A merged header covers its merge and spills right over blank headers up to the next
    header or check column; a single cell never spreads. The leftmost of equals wins.
    """
    head = materialize(header_cells(cells, depth))
    frame = head.groupBy(*SHEET).agg(
        F.array_sort(F.collect_list(F.when(c("painted") | (c("value") != ""), c("col")))).alias("stops"),
        F.collect_list(F.when(c("painted"), c("col"))).alias("checks"),
    ).join(cells.groupBy(*SHEET).agg(F.max("col").alias("last_col")), SHEET)
    wide = (
        _spans_at(head, merges).filter(~c("painted") & (c("value") != "")).join(frame, SHEET)
        .withColumns({"left": F.coalesce("c1", "col"), "right": F.coalesce("c2", "col")})
    )
    after = F.array_min(F.filter("stops", lambda s: s > c("right")))
    end = F.when(c("right") > c("left"), F.coalesce(after - 1, c("last_col"))).otherwise(c("right"))
    covered = F.filter(F.sequence("left", F.least(F.greatest(end, c("left")), F.greatest("last_col", "left"))), lambda x: ~F.array_contains("checks", x))
    listed = wide.select(
        *SHEET, "col", name_key(c("value")).alias("key"), strip(c("value")).alias("header"),
        F.when(F.size(covered) > 0, covered).otherwise(F.array("col")).alias("cols"),
    )
    return keep_first(listed, [*SHEET, "key"], ["col"])


# --- columns of the rules -------------------------------------------------------------------

def resolve_columns(items: DataFrame, headers: DataFrame) -> DataFrame:
    """For each item's names: exact header, else the only containing one, else why not.

    ``items``: (wb, sheet, item_no, item, names). A sheet's items and its headers are one record
    (at most 16,384 columns), in which all names are matched: no pair of name and header and no
    copy of a header list is ever a row. ``found`` of an ambiguous item names all of its
    ``n_found`` candidates in order.
    """
    per_sheet = headers.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("col", "key", "header", "cols"))).alias("headers"))
    flat = items.select(*SHEET, "item_no", "item", F.posexplode("names").alias("i", "alias")).withColumn("k", name_key(c("alias")))
    tried_names = flat.groupBy(*SHEET, "item_no", "item").agg(F.array_sort(F.collect_list(F.struct("i", "alias", "k"))).alias("names"))
    asked = tried_names.groupBy(*SHEET).agg(F.collect_list(F.struct("item_no", "item", "names")).alias("asked"))
    both = asked.join(per_sheet, SHEET, "left").withColumn("headers", F.coalesce("headers", F.array().cast(per_sheet.schema["headers"].dataType)))
    first = lambda tried, keep: F.get(F.filter(tried, keep), F.lit(0))

    def tried(item):
        same = F.transform(item["names"], lambda n: F.filter("headers", lambda h: h["key"] == n["k"]))
        near = F.transform(item["names"], lambda n: F.filter("headers", lambda h: (n["k"] != "") & contains_either(h["key"], n["k"])))
        return F.struct(
            item["item_no"].alias("item_no"), item["item"].alias("item"), F.get(item["names"], F.lit(0))["alias"].alias("rep"),
            first(same, lambda hs: F.size(hs) > 0).alias("same"), first(near, lambda hs: F.size(hs) == 1).alias("near"), first(near, lambda hs: F.size(hs) > 1).alias("many"),
        )

    best = both.select(*SHEET, F.explode(F.transform("asked", tried)).alias("x")).select(*SHEET, "x.*")
    hit = F.coalesce(F.get("same", F.lit(0)), F.get("near", F.lit(0)))
    shown = F.array_join(F.transform("many", lambda h: h["header"]), " · ")
    how = F.when(c("same").isNotNull(), EXACT).when(c("near").isNotNull(), SIMILAR).when(c("many").isNotNull(), AMBIGUOUS).otherwise(NOT_FOUND)
    return best.select(
        *SHEET, "item_no", "item", "rep", how.alias("how"), hit["cols"].alias("cols"), F.coalesce(hit["header"], shown, F.lit("")).alias("found"),
        F.when(hit.isNotNull(), 1).otherwise(F.coalesce(F.size("many"), F.lit(0))).cast("bigint").alias("n_found"),
    )


def column_map(resolved: DataFrame) -> DataFrame:
    """What was tried per representative name, up to and including its first success."""
    done = resolved.filter(c("cols").isNotNull()).groupBy(*SHEET, "rep").agg(F.min("item_no").alias("done"))
    return resolved.join(done, [*SHEET, "rep"], "left").filter(c("done").isNull() | (c("item_no") <= c("done"))).drop("done")


def resolution_counts(colmap: DataFrame) -> DataFrame:
    return colmap.groupBy(*SHEET).agg(*[F.count_if(c("how") == h).alias(h.replace(" ", "_")) for h in (EXACT, SIMILAR, AMBIGUOUS, NOT_FOUND)])


def mapped_columns(colmap: DataFrame) -> DataFrame:
    return colmap.filter(c("cols").isNotNull()).select(*SHEET, "rep", F.size("cols").alias("n_cols"), F.posexplode("cols").alias("place", "col"))


def orphan_headers(headers: DataFrame, colmap: DataFrame) -> DataFrame:
    """Headers no rule asked for, except serial numbers and the like."""
    used = mapped_columns(colmap).select(*SHEET, "col").distinct()
    claimed = headers.select(*SHEET, "key", F.explode("cols").alias("col")).join(used, [*SHEET, "col"], "left_semi")
    side = F.lit(False)
    for word in SIDE_HEADERS:
        side = side | c("key").startswith(name_key(F.lit(word)))
    return headers.filter((c("header") != "") & ~side).join(claimed, [*SHEET, "key"], "left_anti").select(*SHEET, "header")


def place_items(items: DataFrame, checks: DataFrame) -> DataFrame:
    """Check column of each rule item: same key, else the only containing one, else null; matched in one record a sheet."""
    keyed = checks.groupBy(*SHEET, name_key(c("header")).alias("key")).agg(F.max("col").alias("col"))  # equal keys: the later header stands
    per_sheet = keyed.groupBy(*SHEET).agg(F.array_sort(F.collect_list(F.struct("col", "key"))).alias("checks"))
    asked = items.groupBy(*SHEET).agg(F.collect_list(F.struct("item_no", "item", name_key(c("item")).alias("k"))).alias("asked"))

    def placed(item):
        same = F.filter("checks", lambda h: h["key"] == item["k"])
        near = F.filter("checks", lambda h: (item["k"] != "") & contains_either(h["key"], item["k"]))
        col = F.coalesce(F.try_element_at(same, F.lit(-1))["col"], F.when(F.size(near) == 1, F.get(near, F.lit(0))["col"]))
        return F.struct(item["item_no"].alias("item_no"), item["item"].alias("item"), col.alias("col"))

    return asked.join(per_sheet, SHEET, "left").select(*SHEET, F.explode(F.transform("asked", placed)).alias("x")).select(*SHEET, "x.*")


# --- claim rows -----------------------------------------------------------------------------

def merged_values(cells: DataFrame, merges: DataFrame, columns: DataFrame, heads: DataFrame) -> DataFrame:
    """What single-column names inherit inside a merge: one row for each covered claim row.

    The columns of a merge are compared with the few that a sheet's rules name, in the merge's record.
    Its rows end at the sheet's last filled row, so a merge down to the end of a
    worksheet adds none below it; what is left is dealt in pieces of ``PIECE`` rows.
    """
    named = columns.filter("n_cols = 1").groupBy(*SHEET).agg(F.collect_list(F.struct("col", "rep")).alias("named"))
    last = cells.filter(filled()).groupBy(*SHEET).agg(F.max("row").alias("last_row"))
    under = merges.join(heads.join(named, SHEET).join(last, SHEET), SHEET).withColumns({
        "first": F.greatest("r1", c("head_row") + 1), "end": F.least("r2", "last_row"),
        "named": F.filter("named", lambda x: x["col"].between(c("c1"), c("c2"))),
    }).filter((F.size("named") > 0) & (c("first") <= c("end")))
    corner = cells.filter(filled()).select(*SHEET, c("row").alias("r1"), c("col").alias("c1"), strip(c("value")).alias("inherited"))
    pieces = under.join(corner, [*SHEET, "r1", "c1"]).select(*SHEET, "named", "end", "inherited", F.explode(F.sequence("first", "end", F.lit(PIECE).cast("bigint"))).alias("from"))
    if_long = pieces.repartition(*SHEET, "from")
    rows = if_long.select(*SHEET, "named", "inherited", F.explode(F.sequence("from", F.least(c("from") + PIECE - 1, c("end")))).alias("row"))
    return rows.select(*SHEET, "row", F.explode("named.rep").alias("rep"), "inherited")


def read_values(cells: DataFrame, merges: DataFrame, colmap: DataFrame, depth: int = HEAD_SCAN) -> DataFrame:
    """Long claims: (wb, sheet, row, rep, text, inherited) before the blank-run stop."""
    heads, columns = materialize(header_rows(cells, depth)), mapped_columns(colmap)
    asked = columns.join(heads, SHEET).select(*SHEET, "col", "rep", "place", "head_row")  # a few columns a sheet, so cells are shuffled for one join
    said = cells.filter(filled()).join(asked, [*SHEET, "col"]).filter(c("row") > c("head_row"))
    own = (
        said.groupBy(*SHEET, "row", "rep")
        .agg(F.array_sort(F.collect_list(F.struct("place", strip(c("value")).alias("v")))).alias("vs"))  # one row's cells under one header
        .select(*SHEET, "row", "rep", F.array_join(F.filter(F.transform("vs", lambda x: x["v"]), lambda v: v != ""), ", ").alias("text"), F.lit(False).alias("inherited"))
    )
    # which names have cells of their own is known without their texts, so whoever asks for inherited ones only puts no texts together
    merged = materialize(merged_values(cells, merges, columns, heads))
    own = own.join(merged.select(*SHEET, "row", "rep"), [*SHEET, "row", "rep"], "left")  # an own text comes once for each merge over its row, as merges that are given twice do
    fill = merged.join(said.select(*SHEET, "row", "rep"), [*SHEET, "row", "rep"], "left_anti")
    both = own.unionByName(fill.select(*SHEET, "row", "rep", c("inherited").alias("text"), F.lit(True).alias("inherited")))
    return both.filter(c("text") != "")


def end_rows(values: DataFrame, heads: DataFrame, run: int = BLANK_RUN) -> DataFrame:
    """Last claim row of each sheet: the one before the first run of ``run`` empty rows."""
    kept = values.select(*SHEET, c("row").cast("bigint").alias("row")).unionByName(heads.select(*SHEET, c("head_row").alias("row"))).distinct()
    gaps = previous_value(kept, SHEET, "row", "before").filter(c("row") - c("before") > run)
    first_gap = gaps.groupBy(*SHEET).agg(F.min("before").alias("last_row"))
    last = kept.groupBy(*SHEET).agg(F.max("row").alias("max_row"))
    return last.join(first_gap, SHEET, "left").select(*SHEET, F.coalesce("last_row", "max_row").alias("last_row"))


def claim_values(values: DataFrame, ends: DataFrame) -> DataFrame:
    return values.join(ends, SHEET).filter(c("row") <= c("last_row")).drop("last_row")


def dropped_rows(cells: DataFrame, values: DataFrame, heads: DataFrame, ends: DataFrame) -> DataFrame:
    """Rows below the header that hold something and are no claim rows: filled only in columns
    no rule knows, or after the run of empty rows that ends a sheet."""
    checks = header_cells(cells).filter("painted").select(*SHEET, "col")
    held = (
        cells.filter(filled()).join(heads, SHEET).join(ends, SHEET)
        .filter(c("row") > c("head_row"))
        .join(checks, [*SHEET, "col"], "left_anti").select(*SHEET, "row").distinct()
    )
    return held.join(claim_values(values, ends), [*SHEET, "row"], "left_anti")


def sheet_overview(values: DataFrame, checks: DataFrame, sheets: DataFrame) -> DataFrame:
    """Per sheet of the rules: claim rows and check columns."""
    rows = values.select(*SHEET, "row").distinct().groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_rows"))
    cols = checks.groupBy(*SHEET).agg(F.count(F.lit(1)).alias("n_checks"))
    return sheets.join(rows, SHEET, "left").join(cols, SHEET, "left").na.fill(0)


# --- roster ---------------------------------------------------------------------------------

def pick_column(head: DataFrame, words: list[str], name: str) -> DataFrame:
    """Column whose header equals one of the words, else the only one that contains one."""
    keyed = keep_first(
        head.filter(c("value") != "").select(*SHEET, "col", name_key(strip(c("value"))).alias("key")), [*SHEET, "key"], ["col"]
    )
    exact, near = [], []
    for w in words:
        k = name_key(F.lit(w))
        exact.append(F.min(F.when(c("key") == k, c("col"))))
        near.append(F.when(F.count_if(c("key").contains(k)) == 1, F.min(F.when(c("key").contains(k), c("col")))))
    return keyed.groupBy(*SHEET).agg(F.coalesce(*exact, *near).alias(name))


def read_roster(cells: DataFrame) -> DataFrame:
    """Names of 2 to 12 characters with their category, each pair once, first kept."""
    head = header_cells(cells)
    picked = pick_column(head, ROSTER_NAMES, "name_col").join(pick_column(head, ROSTER_CATEGORIES, "cat_col"), SHEET)
    below = cells.join(header_rows(cells), SHEET).filter(c("row") > c("head_row")).join(picked, SHEET)
    rows = below.filter((c("col") == c("name_col")) | (c("col") == c("cat_col"))).groupBy(*SHEET, "row").agg(
        F.max(F.when(c("col") == c("name_col"), strip(c("value")))).alias("name"),
        F.coalesce(F.max(F.when(c("col") == c("cat_col"), strip(c("value")))), F.lit("")).alias("category"),
    )
    people = rows.filter(F.length("name").between(2, 12) & ~c("name").rlike(DIGITS_ONLY))
    return keep_first(people, [*SHEET, "name", "category"], ["row"])
