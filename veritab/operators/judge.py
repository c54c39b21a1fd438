"""Verdicts that code can compute: dates, numbers, counts, durations, ISBNs, terms.

``judge`` takes one row per claim and one row per rule and returns one row per pair of
the same sheet. Everything is a column expression; the only shuffle is the join of the
rules, one record per sheet. Each text of a claim is read once, however many rules look at it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritab.functions import values as V
from veritab.functions.rulebook import CLAIM_ONLY_KINDS
from veritab.functions.text import ascii_digits, blank_to_empty, compose_units, let, short_item

PASS, FAIL, UNDETERMINED, BLANK = "PASS", "FAIL", "UNDETERMINED", "BLANK"

# Field names whose meaning the engine knows.
ROSTER_FIELD = "참여명단"
HEADCOUNT_FIELD = "참여인원수"
ISBN_FIELD = "ISBN"
TERM_FIELD = "학기"
HOUR_WORD = "시간"
DEFAULT_MONTHS = 3
EPSILON = 1e-6

BY_MODEL, BY_CODE, BY_HUMAN = "모형", "계산", "사람"  # fixed values: who judges a rule


PARTS = ("verdict", "remark", "rationale")  # of a decision


def _out(verdict: str, rationale: Column | str, remark: Column | str = "") -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(verdict).alias("verdict"), as_col(remark).alias("remark"), as_col(rationale).alias("rationale")
    )


def _only(parts: tuple[str, ...], worded: tuple[int, ...] | None):
    """Decisions of which only ``parts`` are made, the others are null: words cost more than the verdict.

    With ``worded`` only these items get words.
    """
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    none = F.lit(None).cast("string")
    said = (lambda v: v) if worded is None else lambda v: F.when(F.col("item_no").isin(list(worded)), v)

    def out(verdict: str, rationale: Column | str, remark: Column | str = "") -> Column:
        word = lambda n, v: (said(as_col(v)) if n in parts else none).alias(n)
        return F.struct(F.lit(verdict).alias("verdict"), word("remark", remark), word("rationale", rationale))

    return out


# How a text is read; a reading fills one field of ``_reading`` besides the text itself.
DAYS, HOURS, NUMBER, ISBN, TERM, TEXT = "days", "hours", "number", "isbn", "term", "text"


def _needs(asked: DataFrame) -> DataFrame:
    """Rules with what they read: ``c_need`` of the claim, ``e_need`` of the evidence, each how and from which fields."""
    kind = F.col("kind")
    claimed = (
        F.when(kind.isin("날짜", "기간"), DAYS).when((kind == "수") & F.col("item").contains(HOUR_WORD), HOURS)
        .when(kind.isin("수", "이름개수"), NUMBER).when(kind.isin("ISBN유효", "ISBN같음"), ISBN).when(kind == "학기", TERM).otherwise(TEXT)
    )
    given = (
        F.when(kind == "날짜", DAYS).when(kind.isin("수", "값"), HOURS).when(kind.isin("ISBN유효", "ISBN같음"), ISBN).when(kind == "학기", TERM).otherwise(TEXT)
    )
    fields = F.when(kind.isin("ISBN유효", "ISBN같음"), F.array(F.lit(ISBN_FIELD))).when(kind == "학기", F.array(F.lit(TERM_FIELD))).otherwise(F.col("extract_fields"))
    need = lambda how, cols: F.struct(how.alias("how"), F.coalesce(cols, F.array().cast("array<string>")).alias("cols"))
    return asked.withColumns({"c_need": need(claimed, F.col("claim_cols")), "e_need": need(given, fields)})


SIDES = {"c": "claim", "e": "evidence"}


def _with_readings(rows: DataFrame) -> DataFrame:
    """Columns ``c_days``, ``c_number``, ``c_isbn``, ``c_isbn_ok``, ``c_term`` of the claim, read as ``c_how`` says, and the same of the evidence.

    They give what ``V.dates_in`` and its neighbours give, in columns that follow one another: what several
    expressions look at is a column, not a variable of a lambda, whose body Spark would interpret row by row.
    Each step may write the row once, so both sides take it together.
    """
    def step(of) -> DataFrame:  # ``of(at, name, text)``: new columns of a side
        new = {}
        for side, text in SIDES.items():
            name = lambda n, side=side: F.col(f"_{side}_{n}")
            at = lambda kinds, value, side=side: F.when(F.col(f"{side}_how").isin(kinds), value)
            new |= {n.format(side): v for n, v in of(at, name, F.col(text)).items()}
        return rows.withColumns(new)

    rows = step(lambda at, name, text: {"_{}_composed": at([DAYS, TERM], compose_units(text)), "_{}_plain": at([HOURS], ascii_digits(text))})
    rows = step(lambda at, name, text: {"_{}_dated": at([DAYS, TERM], ascii_digits(name("composed")))})
    rows = step(lambda at, name, text: {
        "_{}_found": at([DAYS], V.raw_days(name("dated"))), "_{}_tagged": at([HOURS], V.tagged_hours(name("plain"))), "_{}_isbn": at([ISBN], V.isbn_digits(text))})
    rows = step(lambda at, name, text: {
        "_{}_read": at([DAYS], V.whole_days(name("found"))), "_{}_end": at([DAYS], V.end_day(name("dated"))),
        "_{}_total": F.when(F.size(name("tagged")) > 0, V.total(name("tagged"))),
        "_{}_numbers": F.coalesce(at([NUMBER], V.raw_numbers(text)), F.when(F.size(name("tagged")) == 0, V.raw_numbers(name("plain")))),
        "_{}_checked": at([ISBN], ascii_digits(name("isbn"))),
    }).withColumn("n_names", F.when(F.col("kind") == "이름개수", V.name_count(F.col("name_text"))))
    rows = step(lambda at, name, text: {
        "{}_days": at([DAYS], V.with_end_day(name("read"), name("end"))), "{}_number": F.coalesce(name("total"), V.only_number(name("numbers"))),
        "{}_isbn": name("isbn"), "{}_isbn_ok": at([ISBN], V.isbn_fits(name("checked"))), "{}_term": at([TERM], V.term_in(name("dated"))),
    })
    return rows.drop(*[n for n in rows.columns if n.startswith(("_c_", "_e_"))])


def read_values(claims: DataFrame, asked: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per claim and rule with everything that a check of its kind reads.

    ``claims``: keys, row, carried columns, vals, ext, roster, links, prior. ``asked``: keys and the rule columns (kind,
    threshold, predecessor, name_col, item, extract_fields, claim_cols and any others). The rules of a sheet
    are one record, so each claim meets them once; the texts that rules look at are found once for each claim and
    set of columns, then rules become rows and each row's two texts are read.
    """
    c = F.col
    told = [n for n in asked.columns if n not in keys]
    books = _needs(asked).groupBy(*keys).agg(F.collect_list(F.struct(*told, "c_need", "e_need")).alias("_rules"))  # a few dozen rules a sheet
    each = lambda side: F.array_distinct(F.transform("_rules", lambda r: r[f"{side}_need"]))
    books = books.withColumns({"_c": each("c"), "_e": each("e")})
    at = lambda side: lambda r: F.array_position(f"_{side}", r[f"{side}_need"]) - 1
    placed = F.transform("_rules", lambda r: F.struct(
        *[r[n].alias(n) for n in told], r["c_need"]["how"].alias("c_how"), r["e_need"]["how"].alias("e_how"), at("c")(r).cast("int").alias("_ci"), at("e")(r).cast("int").alias("_ei")))
    counts_people = lambda r: (r["kind"] == "수") & F.array_contains(r["extract_fields"], ROSTER_FIELD)
    books = books.withColumns({"_rules": placed, "_counts_people": F.exists("_rules", counts_people)})

    # Lists and objects are no scalars: a look-up for one value goes on to the next field.
    scalar = lambda fields: F.filter(fields, lambda f: ~((f == ROSTER_FIELD) & c("roster").isNotNull()) & ~V.is_nested(F.try_element_at(c("ext"), f)))
    evidence = lambda n: F.when(n["how"] == DAYS, V.joined_filled(c("ext"), n["cols"])).when(n["how"].isin(ISBN, TERM), V.first_filled(c("ext"), n["cols"])).otherwise(
        V.first_filled(c("ext"), scalar(n["cols"])))
    listed = F.try_element_at(c("ext"), F.lit(ROSTER_FIELD))
    roster_n = F.coalesce(
        V.roster_count(c("roster.status"), c("roster.names")),
        F.when(c("roster").isNull() & V.is_nested(listed), V.roster_count_of_list(F.from_json(listed, "array<string>")))
        .when(c("roster").isNull(), V.roster_count_of_text(listed)),
    )
    read = claims.join(books, keys).withColumns({
        "_c": F.transform("_c", lambda n: V.first_filled(c("vals"), n["cols"])), "_e": F.transform("_e", evidence), "_people": F.when(c("_counts_people"), roster_n),
    })
    held = ["row", "links", "vals", "prior", "_c", "_e", "_people"]
    rows = read.select(*keys, *carry, *held, F.explode("_rules").alias("_x")).select(*keys, *carry, *held, "_x.*").withColumns({
        "claim": F.get("_c", c("_ci")), "evidence": F.get("_e", c("_ei")), "prior_verdict": F.try_element_at(c("prior"), c("predecessor")),
        "name_text": F.when(c("kind") == "이름개수", blank_to_empty(F.try_element_at(c("vals"), c("name_col")))),
        "roster_n": F.when((c("kind") == "수") & F.array_contains("extract_fields", ROSTER_FIELD), c("_people")),
    }).drop("vals", "prior", "_c", "_e", "_ci", "_ei", "_people")
    rows = _with_readings(rows).drop("c_how", "e_how")
    kind = c("kind")
    for_kinds = lambda kinds, reading: F.when(kind.isin(kinds), reading)
    reads = rows.withColumns({
        "e_number": F.coalesce(F.when(c("evidence") != "", c("e_number")), c("roster_n").cast("double")),
        "isbn_text": for_kinds(["ISBN유효"], F.when(c("claim") != "", c("claim")).otherwise(c("evidence"))),
        "isbn_ok": for_kinds(["ISBN유효"], F.when(c("claim") != "", c("c_isbn_ok")).otherwise(c("e_isbn_ok"))),
    }).drop("c_isbn_ok", "e_isbn_ok")
    month = lambda ds: F.array_distinct(F.transform(ds, lambda d: F.substring(d, 1, 6)))
    months = lambda text, ds: let(
        V.months_in(text), lambda m: F.when(F.size(m) > 0, F.array_distinct(m)).otherwise(month(ds))
    )
    part = lambda d, at, n: F.substring(d, at, n).cast("int")
    a, b = F.array_min("c_days"), F.array_max("c_days")
    short = (kind == "날짜") & ((F.size("c_days") == 0) | (F.size("e_days") == 0))
    return reads.withColumns({
        "first_day": for_kinds(["기간"], a),
        "last_day": for_kinds(["기간"], b),
        "length": F.when(
            (kind == "기간") & (F.size("c_days") > 1),
            (part(b, 1, 4) - part(a, 1, 4)) * 12
            + (part(b, 5, 2) - part(a, 5, 2))
            - F.when(part(b, 7, 2) < part(a, 7, 2), 1).otherwise(0),
        ),
        "c_extra": for_kinds(["날짜"], F.size(F.array_except("c_days", "e_days"))),
        "e_extra": for_kinds(["날짜"], F.size(F.array_except("e_days", "c_days"))),
        "c_months": F.when(short, months(c("claim"), c("c_days"))).when(kind == "날짜", month(c("c_days"))),
        "e_months": F.when(short, months(c("evidence"), c("e_days"))).when(kind == "날짜", month(c("e_days"))),
    })


# Decisions per kind, over the columns of ``read_values``.

def _words(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def duration(out=_out) -> Column:
    """Length of the claimed period in whole months against a threshold."""
    c = F.col
    limit = F.coalesce(c("threshold"), F.lit(float(DEFAULT_MONTHS)))
    said = _words(V.show_date(c("first_day")), " ~ ", V.show_date(c("last_day")), " · ", c("length").cast("string"), " months")
    return (
        F.when(c("claim") == "", out(BLANK, "claim is blank", "no period in the claim"))
        .when(c("length").isNull(), out(UNDETERMINED, "dates not readable", _words("no two dates in ", c("claim"))))
        .when(c("length") >= limit, out(PASS, said))
        .otherwise(out(FAIL, said, _words(said, " — under ", V.show_number(limit), " months")))
    )


def count_of_names(out=_out) -> Column:
    """Claimed head-count against the names written in the same claim."""
    c, whole = F.col, F.col("c_number").cast("bigint")
    said = _words("claim ", whole.cast("string"), ", names ", c("n_names").cast("string"))
    return (
        F.when((c("claim") == "") | (c("name_text") == ""), out(BLANK, "claim is blank", "head-count or names missing in the claim"))
        .when(whole.isNull(), out(UNDETERMINED, "number not readable", _words("no number in ", c("claim"))))
        .when(whole == c("n_names"), out(PASS, said))
        .otherwise(out(FAIL, said, said))
    )


def threshold(out=_out) -> Column:
    """An extracted value against a least value."""
    c, v = F.col, F.col("e_number")
    least = F.coalesce(c("threshold"), F.lit(0.0))
    said = lambda sign: _words("evidence ", V.show_number(v), sign, V.show_number(least))
    return (
        F.when(c("evidence") == "", out(UNDETERMINED, "no evidence value", "value not extracted"))
        .when(v.isNull(), out(UNDETERMINED, "number not readable", _words("no single number in ", c("evidence"))))
        .when(v >= least, out(PASS, said(" ≥ ")))
        .otherwise(out(FAIL, said(" < "), said(" < ")))
    )


def dates_match(out=_out) -> Column:
    """Days must agree as sets; months count only where a side has no full day."""
    c = F.col
    days = lambda side: V.show_dates(F.array_distinct(f"{side}_days"))
    both = _words("claim ", days("c"), " ↔ evidence ", days("e"))
    months = _words("claim ", V.show_dates(c("c_months")), " ↔ evidence ", V.show_dates(c("e_months")))
    same_months = F.array_sort("c_months") == F.array_sort("e_months")
    return (
        F.when(c("claim") == "", out(BLANK, "claim is blank", "no value in the claim"))
        .when(c("evidence") == "", out(UNDETERMINED, "no evidence value", "date not extracted"))
        .when(
            (F.size("c_days") > 0) & (F.size("e_days") > 0),
            F.when((c("c_extra") == 0) & (c("e_extra") == 0), out(PASS, days("c")))
            .when((c("c_extra") == 0) | (c("e_extra") == 0), out(UNDETERMINED, "dates partly extracted", both))
            .otherwise(out(FAIL, "dates differ", F.when(same_months, _words(both, " — same month, other day")).otherwise(both))),
        )
        .when(F.size("c_months") == 0, out(UNDETERMINED, "claim date not readable", _words("no date in claim ", c("claim"))))
        .when(F.size("e_months") == 0, out(UNDETERMINED, "evidence date not readable", _words("no date in evidence ", c("evidence"))))
        .when(F.arrays_overlap("c_months", "e_months"), out(PASS, "months agree", _words(short_side(), " gives only a month")))
        .otherwise(out(FAIL, "months differ", months))
    )


def short_side() -> Column:
    """Which side gave no full day."""
    return F.when(F.size("e_days") == 0, F.lit("evidence")).otherwise(F.lit("claim"))


def numbers_match(out=_out) -> Column:
    c, a, b = F.col, F.col("c_number"), F.col("e_number")
    said = _words("claim ", V.show_number(a), " ↔ evidence ", V.show_number(b))
    return (
        F.when(c("claim") == "", out(BLANK, "claim is blank", "no value in the claim"))
        .when(a.isNull(), out(UNDETERMINED, "number not readable", _words("no number in ", c("claim"))))
        .when(b.isNull(), out(UNDETERMINED, "no evidence value", "number not extracted"))
        .when(F.abs(a - b) < EPSILON, out(PASS, said))
        .otherwise(out(FAIL, said, said))
    )


def isbn_check(out=_out) -> Column:
    c, text = F.col, F.col("isbn_text")
    digits = V.isbn_digits(text)
    return (
        F.when(blank_to_empty(text) == "", out(BLANK, "claim is blank", "no ISBN in the claim"))
        .when(c("isbn_ok").isNull(), out(UNDETERMINED, text, _words("ISBN digits: ", F.length(digits).cast("string"))))
        .when(c("isbn_ok"), out(PASS, _words("check digit fits ", digits)))
        .otherwise(out(FAIL, "check digit differs", _words("check digit differs in ", text)))
    )


def isbn_match(out=_out) -> Column:
    c, a, b = F.col, F.col("c_isbn"), F.col("e_isbn")
    return (
        F.when(c("claim") == "", out(BLANK, "claim is blank", "no ISBN in the claim"))
        .when(c("evidence") == "", out(UNDETERMINED, "no evidence value", "ISBN not extracted"))
        .when(a == b, out(PASS, a))
        .otherwise(out(FAIL, _words(a, " ≠ ", b), _words(c("claim"), " ↔ ", c("evidence"))))
    )


def term_match(out=_out) -> Column:
    c, a, b = F.col, F.col("c_term"), F.col("e_term")
    return (
        F.when(c("claim") == "", out(BLANK, "claim is blank", "no term in the claim"))
        .when(a.isNull(), out(UNDETERMINED, "term not readable", _words("no term in claim ", c("claim"))))
        .when(c("evidence") == "", out(UNDETERMINED, "no evidence value", "term not extracted"))
        .when(b.isNull(), out(UNDETERMINED, "term not readable", _words("no term in evidence ", c("evidence"))))
        .when(a == b, out(PASS, a))
        .otherwise(out(FAIL, "terms differ", _words("claim ", a, " ↔ evidence ", b)))
    )


def dispatch(out=_out) -> Column:
    """The whole decision: no method, then predecessor, then missing link, then the kind."""
    c, kind = F.col, F.col("kind")
    return (
        F.when(kind.isNull(), out(UNDETERMINED, "no method", _words(short_item(c("item")), ": the rule names no method")))
        .when(c("prior_verdict").isin(FAIL, UNDETERMINED), out(BLANK, "dependent", _words("item ", c("predecessor").cast("string"), " is ", c("prior_verdict"))))
        .when(
            ~kind.isin(CLAIM_ONLY_KINDS) & (F.coalesce(F.size("links"), F.lit(0)) < 1),
            out(UNDETERMINED, "no linked evidence", "no linked file to compare with"),
        )
        .when(kind == "기간", duration(out))
        .when(kind == "이름개수", count_of_names(out))
        .when(kind == "값", threshold(out))
        .when(kind == "날짜", dates_match(out))
        .when(kind == "수", numbers_match(out))
        .when(kind == "ISBN유효", isbn_check(out))
        .when(kind == "ISBN같음", isbn_match(out))
        .when(kind == "학기", term_match(out))
        .otherwise(out(UNDETERMINED, "method not built", short_item(c("item"))))
    )


def judge(claims: DataFrame, rules: DataFrame, keys: list[str], carry: tuple[str, ...] = (), parts: tuple[str, ...] = PARTS, worded: tuple[int, ...] | None = None) -> DataFrame:
    """Computed and human verdicts, long format. ``keys`` name the sheet in both tables,
    ``carry`` more columns of the claims to keep. Of ``parts`` left out, and of items not in ``worded``
    where it is given, remark and rationale are null.

    The rule side is the small one; no broadcast is forced, adaptive execution uses its
    measured size and splits a sheet that holds most of the claims.
    """
    out = _out if tuple(parts) == PARTS and worded is None else _only(tuple(parts), worded)
    human = out(
        UNDETERMINED,
        "set by code · cannot be seen in text",
        F.concat(short_item(F.col("item")), F.lit(": needs a human eye")),
    )
    asked = rules.filter(F.col("judge").isin(BY_CODE, BY_HUMAN)).select(
        *keys, "item_no", "item", "judge", "extract_fields", "claim_cols",
        F.col("calc.kind").alias("kind"), F.col("calc.threshold").alias("threshold"),
        F.col("calc.predecessor").alias("predecessor"), F.col("calc.name_col").alias("name_col"),
    )
    return (
        read_values(claims, asked, keys, carry)
        .withColumn("out", F.when(F.col("judge") == BY_HUMAN, human).otherwise(dispatch(out)))
        .select(
            *keys, *carry, "row", "item_no", "item", "out.verdict", "out.remark",
            F.when(F.col("judge") == BY_HUMAN, F.col("out.rationale"))
            .otherwise(F.concat(F.lit("computed · "), F.col("out.rationale"))).alias("rationale"),
        )
    )


def prior_verdicts(judgements: DataFrame, keys: list[str]) -> DataFrame:
    """Model verdicts of each row as one small map, taken before code adds its own.

    A row that says an item twice keeps one verdict, the smallest; the map holds one entry for
    each item of a sheet.
    """
    one = judgements.groupBy(*keys, "row", "item_no").agg(F.min("verdict").alias("verdict"))
    return one.groupBy(*keys, "row").agg(
        F.map_from_entries(F.collect_list(F.struct("item_no", "verdict"))).alias("prior")
    )


def overlay(model: DataFrame, computed: DataFrame, rules: DataFrame, keys: list[str], rule_keys: list[str]) -> DataFrame:
    """Computed and human verdicts replace what the model said on the same items.

    Who judges an item is a fact of the rule, so only the small rule table is needed to
    drop the model's word; the judgements themselves are not shuffled.
    """
    cols = [*keys, "row", "item_no", "item", "verdict", "remark", "rationale"]
    by_code = rules.filter(F.col("judge").isin(BY_CODE, BY_HUMAN)).select(*rule_keys, "item_no")
    kept = model.join(by_code, [*rule_keys, "item_no"], "left_anti")
    return kept.select(*cols).unionByName(computed.select(*cols))
