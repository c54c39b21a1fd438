"""Queries for the value readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.catalog import duck as D
from veritab.catalog.registry import query
from veritab.functions import values as V
from veritab.functions.text import short_item
from veritab.operators.judge import ROSTER_FIELD

c = F.col


@query("f01_full_year", rf"""
SELECT k, {D.year("cast(nullif(regexp_extract(period, '^([0-9]+)', 1), '') as int)")} AS year FROM {{claims}}""")
def f01(t):
    y = F.nullif(F.regexp_extract("period", "^([0-9]+)", 1), F.lit("")).cast("int")
    return t.claims.select("k", V.full_year(y).alias("year"))


@query("f02_dates_in_text", f"""
SELECT k, array_to_string({D.dates('period')}, '|') AS dates, len({D.dates('period')}) AS n FROM {{claims}}""")
def f02(t):
    ds = V.dates_in(c("period"))
    return t.claims.select("k", F.array_join(ds, "|").alias("dates"), F.size(ds).alias("n"))


@query("f03_months_in_text", f"""
SELECT k, array_to_string({D.months('period')}, '|') AS months FROM {{claims}}""")
def f03(t):
    return t.claims.select("k", F.array_join(V.months_in(c("period")), "|").alias("months"))


@query("f04_single_number", rf"""
SELECT k, {D.number('headcount')} AS headcount, {D.number('hours')} AS hours,
       {D.number('ev_headcount')} AS evidence,
       coalesce(cast(nullif(regexp_extract(ev_headcount, '([0-9]+(?:\.[0-9]+)?)\s*(?:명)', 1), '') as double),
                {D.number('ev_headcount')}) AS hinted
FROM {{claims}} JOIN {{evidence}} USING (k)""")
def f04(t):
    return t.claims.join(t.evidence, "k").select(
        "k", V.single_number(c("headcount")).alias("headcount"), V.single_number(c("hours")).alias("hours"),
        V.single_number(c("ev_headcount")).alias("evidence"), V.single_number(c("ev_headcount"), "명").alias("hinted"),
    )


@query("f05_hours", f"""
SELECT k, {D.hours('hours')} AS claimed, {D.hours('total_hours')} AS evidence
FROM {{claims}} JOIN {{evidence}} USING (k)""")
def f05(t):
    return t.claims.join(t.evidence, "k").select(
        "k", V.hours(c("hours")).alias("claimed"), V.hours(c("total_hours")).alias("evidence")
    )


@query("f06_name_count", f"SELECT k, {D.names('names')} AS n FROM {{claims}}")
def f06(t):
    return t.claims.select("k", V.name_count(c("names")).alias("n"))


@query("f07_roster_count", f"""
SELECT k, {D.roster('roster_status', 'roster_names')} AS found,
       {D.roster("'찾음'", 'roster_names')} AS of_list,
       nullif({D.names("replace(roster_names, '|', ', ')")}, 0) AS of_text
FROM {{evidence}}""")
def f07(t):
    people = F.split("roster_names", "\\|")
    return t.evidence.select(
        "k", V.roster_count(c("roster_status"), people).alias("found"), V.roster_count_of_list(people).alias("of_list"),
        V.roster_count_of_text(F.replace("roster_names", F.lit("|"), F.lit(", "))).alias("of_text"),
    )


@query("f08_isbn_digits", f"SELECT k, {D.isbn('isbn')} AS digits FROM {{claims}}")
def f08(t):
    return t.claims.select("k", V.isbn_digits(c("isbn")).alias("digits"))


@query("f09_isbn_valid", f"SELECT k, cast({D.isbn_ok('isbn')} as string) AS ok FROM {{claims}}")
def f09(t):
    return t.claims.select("k", V.isbn_valid(c("isbn")).cast("string").alias("ok"))


@query("f10_term", f"""
SELECT k, {D.term('term')} AS claimed, {D.term('ev_term')} AS evidence FROM {{claims}} JOIN {{evidence}} USING (k)""")
def f10(t):
    return t.claims.join(t.evidence, "k").select(
        "k", V.term(c("term")).alias("claimed"), V.term(c("ev_term")).alias("evidence")
    )


@query("f11_date_display", f"""
SELECT k, {D.show_list(D.dates('period'))} AS days, {D.show_list(D.months('period'))} AS months FROM {{claims}}""")
def f11(t):
    return t.claims.select(
        "k", V.show_dates(V.dates_in(c("period"))).alias("days"), V.show_dates(V.months_in(c("period"))).alias("months")
    )


@query("f12_short_item", f"""
SELECT k, coalesce(nullif({D.short_item('item')}, ''), item) AS short FROM {{rule_rows}}""")
def f12(t):
    return t.rule_rows.select("k", short_item(c("item")).alias("short"))


@query("f13_first_claim_value", """
SELECT k, coalesce(nullif(trim(isbn), ''), nullif(trim(hours), ''), nullif(trim(headcount), ''), '') AS value FROM {claims}""")
def f13(t):
    vals = F.create_map(F.lit("ISBN"), "isbn", F.lit("시간"), "hours", F.lit("참여인원"), "headcount")
    cols = F.array(F.lit("ISBN"), F.lit("없는 열"), F.lit("시간"), F.lit("참여인원"))
    return t.claims.select("k", V.first_filled(vals, cols).alias("value"))


@query("f14_first_evidence_value", """
SELECT k, coalesce(nullif(trim(ev_headcount), ''), nullif(trim(total_hours), ''), nullif(trim(ev_isbn), ''), '') AS value
FROM {evidence}""")
def f14(t):
    ext = F.create_map(
        F.lit(ROSTER_FIELD), "roster_names", F.lit("인원"), "ev_headcount", F.lit("총시간"), "total_hours", F.lit("ISBN"), "ev_isbn"
    )
    fields = F.array(*[F.lit(n) for n in (ROSTER_FIELD, "인원", "총시간", "ISBN")])
    return t.evidence.select("k", V.first_filled(ext, F.filter(fields, lambda f: f != ROSTER_FIELD)).alias("value"))


@query("f15_value_display", """
SELECT k, CASE WHEN roster_status <> '' AND roster_status <> '찾음' THEN '(' || roster_status || ')'
               WHEN roster_names = '' THEN '(부재)' ELSE replace(roster_names, '|', ', ') END AS roster,
       coalesce(nullif(trim(total_hours), ''), '(부재)') AS hours
FROM {evidence}""")
def f15(t):
    return t.evidence.select(
        "k", V.show_roster(c("roster_status"), F.split("roster_names", "\\|")).alias("roster"),
        V.show_value(c("total_hours")).alias("hours"),
    )
