"""DuckDB expressions of the value readers, written apart from the Spark ones."""

from __future__ import annotations

# Fixed values, here and in the functions below: the notations of days, months, hours, names, ISBNs and terms,
# as in ``functions/values.py``, restated for this engine's pattern language.
_DAY = r"\d{2,4}\s*[.\-/년]\s*\d{1,2}\s*[.\-/월]\s*\d{1,2}"


def year(y: str) -> str:
    return f"(CASE WHEN {y} < 1000 THEN {y} + 2000 ELSE {y} END)"


def dates(x: str) -> str:
    """List of YYYYMMDD."""
    y = year("cast(regexp_extract(m, '^([0-9]+)', 1) as int)")
    month = "lpad(regexp_extract(m, '^[0-9]+[^0-9]+([0-9]+)', 1), 2, '0')"
    day = "lpad(regexp_extract(m, '([0-9]+)$', 1), 2, '0')"
    found = (
        f"list_transform(regexp_extract_all({x}, '{_DAY}'), "
        f"lambda m: lpad(cast({y} as varchar), 4, '0') || {month} || {day})"
    )
    tail = rf"regexp_extract({x}, '[~\-–]\s*(\d{{1,2}})\s*[.\-/일]?\s*$', 1)"
    return (
        f"(CASE WHEN len({found}) = 1 AND {tail} <> '' "
        f"THEN list_append({found}, substr({found}[1], 1, 6) || lpad({tail}, 2, '0')) ELSE {found} END)"
    )


def months(x: str) -> str:
    """No lookahead in RE2: take the optional day along and drop what has one."""
    pattern = r"\d{4}\s*[.\-/년]\s*\d{1,2}(?:\s*[.\-/]?\s*\d)?"
    whole = r"^(\d{4})\s*[.\-/년]\s*(\d{1,2})$"
    return (
        f"list_transform(list_filter(regexp_extract_all({x}, '{pattern}'), lambda m: regexp_full_match(m, '{whole}')), "
        f"lambda m: regexp_extract(m, '{whole}', 1) || lpad(regexp_extract(m, '{whole}', 2), 2, '0'))"
    )


def number(x: str) -> str:
    found = rf"regexp_extract_all(replace({x}, ',', ''), '\d+(?:\.\d+)?')"
    return f"(CASE WHEN len({found}) = 1 THEN cast({found}[1] as double) END)"


def hours(x: str) -> str:
    pieces = rf"regexp_extract_all({x}, '(\d+(?:\.\d+)?)\s*(?:시간|H|h)', 1)"
    return (
        f"(CASE WHEN regexp_matches({x}, '[×xX*]') THEN NULL WHEN len({pieces}) > 0 "
        f"THEN list_sum(list_transform({pieces}, lambda p: cast(p as double))) ELSE {number(x)} END)"
    )


def names(x: str) -> str:
    return (
        f"len(list_filter(list_transform(regexp_split_to_array({x}, '[,·、/\\n;]+'), lambda p: trim(p)), "
        r"lambda p: len(p) BETWEEN 2 AND 30 AND NOT regexp_matches(p, '^[0-9]+$')))"
    )


def roster(status: str, names_: str) -> str:
    n = f"len(list_filter(string_split({names_}, '|'), lambda p: trim(p) <> ''))"
    return f"(CASE WHEN {status} = '찾음' AND {n} > 0 THEN {n} END)"


def isbn(x: str) -> str:
    return f"upper(regexp_replace({x}, '[^0-9Xx]', '', 'g'))"


def isbn_ok(x: str) -> str:
    d = isbn(x)
    at = lambda i: f"cast(nullif(replace(substr({d}, {i}, 1), 'X', '10'), '') as int)"
    s13 = " + ".join(f"{at(i)} * {1 if i % 2 else 3}" for i in range(1, 13))
    s10 = " + ".join(f"{at(i)} * {11 - i}" for i in range(1, 11))
    return (
        f"(CASE WHEN regexp_full_match({d}, '[0-9]{{13}}') THEN (({s13}) + {at(13)}) % 10 = 0 "
        f"WHEN len({d}) = 10 THEN ({s10}) % 11 = 0 END)"
    )


def term(x: str) -> str:
    long_ = r"(\d{2,4})\s*(?:학년도)?\s*[-.\s]?\s*(\d)\s*학기"
    short = r"(\d{2,4})\s*[-.]\s*([12])(?:[^0-9A-Za-z_]|$)"
    one = lambda p: (
        f"CASE WHEN regexp_matches({x}, '{p}') THEN "
        f"cast({year(f'cast(regexp_extract({x}, {chr(39)}{p}{chr(39)}, 1) as int)')} as varchar) || '-' || regexp_extract({x}, '{p}', 2) END"
    )
    return f"coalesce({one(long_)}, {one(short)})"


def show(d: str) -> str:
    return (
        f"(CASE WHEN len({d}) = 8 THEN substr({d}, 1, 4) || '-' || substr({d}, 5, 2) || '-' || substr({d}, 7) "
        f"ELSE substr({d}, 1, 4) || '-' || substr({d}, 5, 2) END)"
    )


def show_list(ds: str) -> str:
    return f"array_to_string(list_transform(list_sort({ds}), lambda d: {show('d')}), ' ~ ')"


def num_text(v: str) -> str:
    return f"(CASE WHEN {v} = floor({v}) THEN cast(cast({v} as bigint) as varchar) ELSE cast({v} as varchar) END)"


def short_item(x: str) -> str:
    base = rf"regexp_replace(trim({x}), '\s*\([^)]*\)\s*$', '')"
    return rf"trim(regexp_replace({base}, '( 제시 여부| 포함 여부| 제출여부| 일치| 여부| 확인)$', ''))"
