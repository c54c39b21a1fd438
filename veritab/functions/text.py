"""Text helpers as Column expressions: trimming, keys, names, quality ratios."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# Character sets by rule, not by list: what Unicode calls space, digit, decimal.
_ALL = [chr(i) for i in range(sys.maxunicode + 1)]
WHITESPACE = "".join(c for c in _ALL if c.isspace())
_DECIMALS = [c for c in _ALL if c.isdecimal() and c > "\x7f"]
_OTHER_DIGITS = "".join(c for c in _ALL if c.isdigit() and not c.isdecimal())
del _ALL

DIGITS_ONLY = f"^[\\p{{Nd}}{_OTHER_DIGITS}]+$"

# Item-name endings that a short name drops, tried in this order.
ITEM_SUFFIXES = [" 제시 여부", " 포함 여부", " 제출여부", " 일치", " 여부", " 확인"]
# Words that mean "nothing here" in a rule cell.
NONE_MARKERS = ["", "—", "-", "–", "없음", "none", "n/a"]


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times, so that expressions stay small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trim every kind of Unicode blank, not only U+0020."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_empty(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit("")))


def ascii_digits(c: Column) -> Column:
    """Rewrite decimal digits of any script as 0-9 so that casts can read them."""
    return F.when(
        c.rlike("[\\p{Nd}&&[^0-9]]"),
        F.translate(c, "".join(_DECIMALS), "".join(str(unicodedata.decimal(d)) for d in _DECIMALS)),
    ).otherwise(c)


@F.pandas_udf(StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


# Blocks in which no character changes under NFC and nothing combines.
_NFC_SAFE = (
    "^[\\u0000-\\u02ff\\u2010-\\u2027\\u2030-\\u205e\\u2190-\\u21ff\\u2460-\\u24ff"
    "\\u3000-\\u3029\\u3131-\\u318e\\u3200-\\u33ff\\u4e00-\\u9fff\\uac00-\\ud7a3\\uff01-\\uffef]*$"
)


def nfc(c: Column) -> Column:
    """Canonical composition. Only text that may change is sent to Python; the rest
    travels as nulls, so the Arrow batches stay almost empty on clean data."""
    return F.coalesce(_nfc(F.when(~c.rlike(_NFC_SAFE), c)), c)


# Decomposed spellings of the units that the date and term readers look for, with the
# final consonant that must not follow. Exact for those readers, and stays in the JVM.
_UNIT_SYLLABLES = ["년", "월", "일", "학", "도", "기"]


def compose_units(c: Column) -> Column:
    out = c
    for syllable in _UNIT_SYLLABLES:
        jamo = unicodedata.normalize("NFD", syllable)
        forms = jamo if len(jamo) == 2 else f"(?:{jamo}|{unicodedata.normalize('NFC', jamo[:2])}{jamo[2]})"
        guard = "(?![\\u11a8-\\u11c2])" if len(jamo) == 2 else ""
        out = F.regexp_replace(out, forms + guard, syllable)
    return F.when(c.rlike("[\\u1100-\\u11ff]"), out).otherwise(c)


# --- keys ---------------------------------------------------------------------------

# The characters that comparison keys leave out.
_KEY_DROP = "(?U)[\\s·,\\[\\]{}~\\-_.:;\"'’‘“”/\\\\「」]+"
_RULE_KEY_DROP = "(?U)[\\s·,\\[\\]{}~\\-_.:;/\\\\「」'\"]+"
_LOOSE_KEY_DROP = "(?U)[\\s.·\\-_()①②③④⑤⑥⑦⑧⑨⑩0-9]+"


def name_key(c: Column) -> Column:
    """Header comparison key. Parentheses stay: they tell a count from a name."""
    return F.lower(F.regexp_replace(nfc(F.coalesce(c, F.lit(""))), _KEY_DROP, ""))


def unnumbered_key(c: Column) -> Column:
    """Name key after dropping a leading circled number."""
    text = strip(nfc(F.coalesce(c, F.lit(""))))
    return F.lower(F.regexp_replace(F.regexp_replace(text, "^[①-⑳㉠-㉿]+", ""), _KEY_DROP, ""))


def rule_key(c: Column) -> Column:
    """Key for names inside the rule book (no composition, straight quotes only)."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), _RULE_KEY_DROP, ""))


def loose_sheet_key(c: Column) -> Column:
    """Key of the write side: digits, circled digits and parentheses go too."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), _LOOSE_KEY_DROP, "")


# --- rule-cell text -----------------------------------------------------------------

def split_list(c: Column) -> Column:
    """``A · B | C`` to an array; a "none" marker gives an empty array."""

    def pieces(s: Column) -> Column:
        parts = F.filter(F.transform(F.split(s, "[·|]"), strip), lambda x: x != "")
        return F.when(F.lower(s).isin(NONE_MARKERS), F.array().cast("array<string>")).otherwise(parts)

    return let(blank_to_empty(c), pieces)


def short_item(c: Column) -> Column:
    """Item name without its trailing parenthesis and one known ending."""
    base = F.regexp_replace(blank_to_empty(c), "(?U)\\s*\\([^)]*\\)\\s*\\z", "")
    ending = "(?:" + "|".join(ITEM_SUFFIXES) + ")\\z"
    short = strip(F.regexp_replace(base, ending, ""))
    return F.coalesce(F.nullif(short, F.lit("")), c)


# --- document text ------------------------------------------------------------------

def jamo_ratio(c: Column) -> Column:
    """Share of loose jamo among Hangul characters; 0 without Hangul."""
    jamo = F.regexp_count(c, F.lit("[\\u1100-\\u11ff\\u3130-\\u318f]"))
    syllables = F.regexp_count(c, F.lit("[\\uac00-\\ud7a3]"))
    return F.when(jamo + syllables > 0, jamo / (jamo + syllables)).otherwise(F.lit(0.0))


def squeeze(c: Column) -> Column:
    """LF line ends, no trailing blanks, at most one empty line in a row."""
    unix = F.replace(c, F.lit("\r\n"), F.lit("\n"))
    lines = F.regexp_replace(unix, "(?U)[\\s&&[^\\n]]+(?=\\n|\\z)", "")
    return strip(F.regexp_replace(lines, "\\n{3,}", "\n\n"))


def safe_name(c: Column, limit: int = 60) -> Column:
    return F.substring(F.regexp_replace(c, "[\\\\/:*?\"<>|\\r\\n\\t]+", "_"), 1, limit)


def natural_key(c: Column) -> Column:
    """Sortable text in which every digit run is as wide as a 64-bit number."""
    padded = F.regexp_replace(c, "([0-9]+)", "00000000000000000000$1")
    return F.regexp_replace(padded, "0+([0-9]{20})(?![0-9])", "$1")


def file_ext(c: Column) -> Column:
    """Lower-cased suffix with its dot; empty for none and for dot-files."""
    return F.lower(F.regexp_extract(c, "[^/](\\.[^./]+)$", 1))


def file_stem(c: Column) -> Column:
    return F.regexp_replace(c, "(?<=[^/])\\.[^./]+$", "")


def base_name(c: Column) -> Column:
    return F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("/")), "([^/]*)$", 1)


# --- file names garbled by a wrong charset ------------------------------------------

# The charsets that UTF-8 names were read with, tried in this order.
WRONG_CHARSETS = ["x-windows-949", "IBM437", "ISO-8859-1"]


def repair_name(name: Column) -> Column:
    """Undo UTF-8 read as CP949, CP437 or Latin-1; empty when nothing fits.

    A charset fits if the name comes back from its bytes and these are whole UTF-8 with Hangul in
    it. Needs the charset switches of ``session.SETTINGS``.
    """

    def undone(charset: str) -> Column:
        raw = F.encode(name, charset)
        text = F.decode(raw, "UTF-8")
        fits = (F.decode(raw, charset) == name) & (F.encode(text, "UTF-8") == raw)
        return F.when(fits & (text != name) & text.rlike("[\uac00-\ud7a3]"), text)

    return F.when(name.isNotNull(), F.coalesce(*[undone(x) for x in WRONG_CHARSETS], F.lit("")))
