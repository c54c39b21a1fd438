"""Readers that turn free text into dates, months, numbers, counts, ISBNs and terms.

Dates stay text: ``YYYYMMDD`` for a day, ``YYYYMM`` for a month. There is no calendar
check on purpose, an impossible day must survive so that it can be reported.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veritab.functions.text import (
    DIGITS_ONLY,
    ascii_digits,
    blank_to_empty,
    compose_units,
    let,
    strip,
)

# The notations of days, months, hours and terms.
DAY = "(?U)\\d{2,4}\\s*[.\\-/년]\\s*\\d{1,2}\\s*[.\\-/월]\\s*\\d{1,2}"
LAST_DAY = "(?U)[~\\-–]\\s*(\\d{1,2})\\s*[.\\-/일]?\\s*\\z"
MONTH = "(?U)\\d{4}\\s*[.\\-/년]\\s*\\d{1,2}(?!\\s*[.\\-/]?\\s*\\d)"
NUMBER = "[0-9]+(?:\\.[0-9]+)?"
HOURS = "(?U)([0-9]+(?:\\.[0-9]+)?)\\s*(?:시간|H|h)"
TIMES = "[×xX*]"
TERM_LONG = "(?U)(\\d{2,4})\\s*(?:학년도)?\\s*[-.\\s]?\\s*(\\d)\\s*학기"
TERM_SHORT = "(?U)(\\d{2,4})\\s*[-.]\\s*([12])\\b"
NAME_BREAK = "[,·、/\\n;]+"
ROSTER_FOUND = "찾음"


def full_year(y: Column) -> Column:
    return F.when(y < 1000, y + 2000).otherwise(y)


def _dated(c: Column) -> Column:
    return let(F.coalesce(c, F.lit("")), lambda s: let(compose_units(s), ascii_digits))


def _year_text(digits: Column) -> Column:
    return F.lpad(full_year(digits.cast("int")).cast("string"), 4, "0")


def _two(digits: Column) -> Column:
    return F.lpad(digits, 2, "0")


def raw_days(text: Column) -> Column:
    """Every day as it is written."""
    return F.regexp_extract_all(text, F.lit(DAY), F.lit(0))


def end_day(text: Column) -> Column:
    """The day behind the last ``~``, empty for none."""
    return F.regexp_extract(text, LAST_DAY, 1)


def whole_days(raw: Column) -> Column:
    """``YYYYMMDD`` of each day as it is written."""
    day = lambda part: F.concat(_year_text(part[0]), _two(part[1]), _two(part[2]))
    return F.transform(raw, lambda match: let(F.split(match, "[^0-9]+"), day))


def with_end_day(days: Column, end: Column) -> Column:
    """A lone day followed by ``~DD`` also gives the end day."""
    tail = F.concat(F.substring(F.try_element_at(days, F.lit(1)), 1, 6), _two(end))
    return F.when((F.size(days) == 1) & (end != ""), F.array_append(days, tail)).otherwise(days)


def dates_in(c: Column) -> Column:
    """Every day in the text; a lone day followed by ``~DD`` also gives the end day."""
    read = lambda text: F.struct(whole_days(raw_days(text)).alias("found"), end_day(text).alias("end"))
    return let(_dated(c), lambda text: let(read(text), lambda s: with_end_day(s["found"], s["end"])))


def months_in(c: Column) -> Column:
    """Months that are not followed by a day."""

    def one(match: Column) -> Column:
        part = F.split(match, "[^0-9]+")
        return F.concat(F.lpad(part[0], 4, "0"), _two(part[1]))

    return F.transform(F.regexp_extract_all(_dated(c), F.lit(MONTH), F.lit(0)), one)


def only_number(values: Column) -> Column:
    return F.when(F.size(values) == 1, F.try_element_at(values, F.lit(1)).try_cast("double"))


def _numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def raw_numbers(c: Column) -> Column:
    """Every number of a text as it is written, without commas."""
    return _numbers(ascii_digits(F.regexp_replace(F.coalesce(c, F.lit("")), ",", "")))


def single_number(c: Column, hint: str | None = None) -> Column:
    """The one number of a text, null when there is none or a choice to make."""
    if hint is None:
        return let(raw_numbers(c), only_number)
    text = ascii_digits(F.regexp_replace(F.coalesce(c, F.lit("")), ",", ""))
    hinted = lambda s: F.regexp_extract(s, f"(?iU)({NUMBER})\\s*(?:{hint})", 1).try_cast("double")
    return let(text, lambda s: F.coalesce(hinted(s), let(_numbers(s), only_number)))


def tagged_hours(text: Column) -> Column:
    """Numbers that are said to be hours; null for a product, which is never multiplied out."""
    return F.when(~text.rlike(TIMES), F.regexp_extract_all(text, F.lit(HOURS), F.lit(1)))


def total(pieces: Column) -> Column:
    return F.when(F.size(pieces) > 0, F.aggregate(pieces, F.lit(0.0), lambda acc, x: acc + x.cast("double")))


def hours(c: Column) -> Column:
    """Hours; tagged pieces add up, a product is never multiplied out."""
    read = lambda text: let(tagged_hours(text), lambda ps: F.when(ps.isNotNull(), F.coalesce(total(ps), single_number(text))))
    return let(F.coalesce(c, F.lit("")), lambda s: let(ascii_digits(s), read))


def name_count(c: Column) -> Column:
    """Names in a cell: 2 to 30 characters and not a bare number."""
    pieces = F.transform(F.split(blank_to_empty(c), NAME_BREAK), strip)
    return F.size(
        F.filter(pieces, lambda x: (F.length(x) > 1) & (F.length(x) <= 30) & ~x.rlike(DIGITS_ONLY))
    )


def roster_count(status: Column, names: Column) -> Column:
    """People on an extracted roster. Found-but-empty is unknown, not zero."""
    n = F.size(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: blank_to_empty(x) != ""))
    return F.when((status == ROSTER_FOUND) & (n > 0), n)


def roster_count_of_list(names: Column) -> Column:
    return roster_count(F.lit(ROSTER_FOUND), names)


def roster_count_of_text(text: Column) -> Column:
    return F.nullif(name_count(text), F.lit(0))


def is_nested(c: Column) -> Column:
    """True for the JSON text of a list or an object, as a map of texts keeps them."""
    text = blank_to_empty(c)
    return (text.startswith("[") & F.from_json(text, "array<string>").isNotNull()) | (
        text.startswith("{") & F.from_json(text, "map<string,string>").isNotNull()
    )


def isbn_digits(c: Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(c, F.lit("")), "[^\\p{Nd}Xx]", ""))


def isbn_fits(d: Column) -> Column:
    """Whether the check digit of ISBN digits is right; null for any other length."""

    def digit(i: int) -> Column:
        ch = F.substring(d, i, 1)
        return F.when(ch == "X", 10).otherwise(ch.try_cast("int"))

    sum13 = sum((digit(i) * (1 if i % 2 else 3) for i in range(1, 13)), F.lit(0))
    sum10 = sum((digit(i) * (11 - i) for i in range(1, 11)), F.lit(0))
    return F.when(d.rlike("^[0-9]{13}$"), (10 - sum13 % 10) % 10 == digit(13)).when(
        F.length(d) == 10, sum10 % 11 == 0
    )


def isbn_valid(c: Column) -> Column:
    """Check digit of an ISBN-13 or ISBN-10; null for any other length."""
    return let(ascii_digits(isbn_digits(c)), isbn_fits)


def term_in(text: Column) -> Column:
    """School term of a text with plain digits and composed units."""

    def read(pattern: str) -> Column:
        year, number = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
        return F.when(year != "", F.concat_ws("-", full_year(year.cast("int")).cast("string"), number))

    return F.coalesce(read(TERM_LONG), read(TERM_SHORT))


def term(c: Column) -> Column:
    """School term as ``year-number``; null when unreadable."""
    return let(_dated(c), term_in)


def show_date(d: Column) -> Column:
    day = F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2), F.substr(d, F.lit(7)))
    return F.when(F.length(d) == 8, day).otherwise(
        F.concat_ws("-", F.substring(d, 1, 4), F.substring(d, 5, 2))
    )


def show_dates(ds: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(ds), show_date), " ~ ")


def show_number(v: Column) -> Column:
    """A number as people write it: no trailing ``.0``."""
    whole = v.cast("bigint")
    return F.when(v == whole, whole.cast("string")).otherwise(v.cast("string"))


def filled(vals: Column, names: Column) -> Column:
    """Non-empty values of a map, in the order of the given keys."""
    keys = F.coalesce(names, F.array().cast("array<string>"))
    found = F.transform(keys, lambda n: blank_to_empty(F.try_element_at(vals, n)))
    return F.filter(found, lambda v: v != "")


def first_filled(vals: Column, names: Column) -> Column:
    """First non-empty value of a map over an ordered list of keys, else empty text."""
    return F.coalesce(F.try_element_at(filled(vals, names), F.lit(1)), F.lit(""))


def joined_filled(vals: Column, names: Column, sep: str = " ~ ") -> Column:
    return F.array_join(filled(vals, names), sep)


ABSENT = "(부재)"  # fixed value: shown for a value that was not extracted


def show_roster(status: Column, names: Column) -> Column:
    shown = F.array_join(F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: blank_to_empty(x) != ""), ", ")
    return F.when((F.coalesce(status, F.lit("")) != "") & (status != ROSTER_FOUND), F.concat(F.lit("("), status, F.lit(")"))).otherwise(
        F.when(shown == "", F.lit(ABSENT)).otherwise(shown)
    )


def show_value(c: Column) -> Column:
    text = blank_to_empty(c)
    return F.when(text == "", F.lit(ABSENT)).otherwise(text)
