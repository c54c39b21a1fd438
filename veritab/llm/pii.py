"""Operator 9, personal data replaced by format-preserving Feistel pseudonyms.

One pattern finds candidates: secrets with a name or a known prefix, e-mail addresses, account
numbers (IBAN), payment cards, social security and telephone numbers, IPv4 addresses and dates
in figures or with the name of the month. README lists the notations that are not looked for.
A candidate must hold as such (Luhn and modulo-97 checks, real calendar days, octets up to
255), then its free symbols are permuted by a keyed Feistel network within their format: a digit
stays a digit, a letter keeps its case, separators, country codes, key names and top-level
domains stay, check digits are computed anew, a date stays a date of the same notation. A round
adds to each symbol of one half, modulo its alphabet, a number drawn from a keyed digest of the
other half, so different values stay different and equal values get the same pseudonym in every
document, which keeps them linked. All of it is Spark expressions, row by row, without a shuffle.

Whoever has the key can undo the mapping, so there is no built-in one: it is a parameter, else the
session's option ``veritab.pii.key``, else a random one that is made for the session and lost with
it (pseudonyms of two such sessions differ). Defined cases: null text stays null
and has no findings; numbers that fail their check and dates outside the 73,170 days from
1900-01-01 stay as they are; empty texts and tables pass; extra columns pass through.
"""

from __future__ import annotations

import re
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_OPTION = "veritab.pii.key"
ROUNDS = 8
FIRST_DAY, DAYS_HIGH, DAYS_LOW = "1900-01-01", 271, 270

# the name may end a longer identifier, as in DB_PASSWORD
_NAMED = r"""[A-Za-z0-9_.-]{0,40}(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key|secret[_-]?key)["']?\s{0,3}[=:]\s{0,3}["']?"""
#: Month names by language, full and short.
MONTHS = [x.split() for x in (
    "january february march april may june july august september october november december",
    "jan feb mar apr may jun jul aug sep oct nov dec",
    "januar februar märz april mai juni juli august september oktober november dezember",
    "jan feb mär apr mai jun jul aug sep okt nov dez",
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre",
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre",
)]
_MONTH = "(?iu:" + "|".join(sorted({m for names in MONTHS for m in names}, key=lambda m: (-len(m), m))) + ")"
_DAY, _YEAR = "[0-3]?[0-9]", "[12][0-9]{3}"
#: Dates with a month name, their parts as groups: day, ending, gap, name, gap, year; or name, gap, day, ending, gap, year.
_DAY_FIRST = rf"({_DAY})(st|nd|rd|th|er|\.)?( {{1,2}}(?:of |de )?|[-/.]|)({_MONTH})(\.?,? {{1,2}}(?:del? )?|[-/.])({_YEAR})"
_NAME_FIRST = rf"({_MONTH})(\.? {{1,2}}|[-/.])({_DAY})(st|nd|rd|th)?(,? {{1,2}}|, ?|[-/.])({_YEAR})"
_plain = lambda pattern: re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern)  # noqa: E731  without groups
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: Kinds in the order in which they are tried, each with the pattern of a whole candidate.
KINDS = {
    "secret": rf"{_NAMED}[A-Za-z0-9_+/.=-]{{7,}}[A-Za-z0-9_+/=-]",
    "key": r"(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9-]{20,}+|[0-9a-f]{32,128})(?![A-Za-z0-9])",
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?: [A-Z0-9]{4}){2,7}+(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "card": r"(?:[0-9]{13,19}+|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "date": rf"(?:{_YEAR}([-/.])[01]?[0-9]\1{_DAY}|{_DAY}([-/.]){_DAY}\2{_YEAR})(?![0-9])",
    "date_named": rf"(?:{_plain(_DAY_FIRST)}|{_plain(_NAME_FIRST)})(?![0-9])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?|1[ .-])?(?:\([0-9]{2,4}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    "phone_international": r"(?:\+[0-9]{1,3}(?: ?\(0\) ?)?(?:[ .-]?[0-9]{2,4}){2,5}|00[1-9][0-9]{0,2}(?:[ .-][0-9]{2,4}){2,5})(?![0-9])",
    # pairs; three groups; area code and number; area code and short groups
    "phone_national": r"(?:0[0-9](?:[ .-][0-9]{2}){4}|(?:\(0[0-9]{1,4}\) ?|0[0-9]{1,4}[ ./-])(?:[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{2,3}(?:[ .-][0-9]{2,3}){2,3}|[0-9]{6,8}))(?![0-9])",
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
}


def _candidate() -> str:
    parts, groups = [], 0
    for pattern in KINDS.values():
        n = 2 if r"\1" in pattern else 0
        parts.append(pattern.replace(r"\2", f"\\{groups + 2}").replace(r"\1", f"\\{groups + 1}") if n else pattern)
        groups += n
    # a candidate starts where no word, number or address is under way; a full stop that no digit precedes ends a word before figures
    return r"(?<![A-Za-z0-9_%+@-])(?:(?<!\.)|(?<![0-9]\.)(?=[0-9+(]))(?:" + "|".join(parts) + ")"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _feistel(values: Column, sizes: Column, key: str) -> Column:
    """A keyed permutation of tuples whose i-th number is below ``sizes[i]``."""

    def network(v: Column) -> Column:
        half = F.floor(F.size(v) / 2).cast("int")
        one = lambda a, frm, n: F.slice(a, frm, n)
        start = F.struct(one(v, F.lit(1), half).alias("a"), one(v, half + 1, F.size(v) - half).alias("b"))

        def step(s: Column, r: Column) -> Column:
            # odd rounds change the first half, even rounds the second
            odd = r % 2 == 1
            digest = F.sha2(F.concat_ws("|", F.lit(key), r.cast("string"), F.size(v).cast("string"), F.concat_ws(",", F.transform(F.when(odd, s["b"]).otherwise(s["a"]), lambda x: x.cast("string")))), 256)
            shift = lambda side, offset: _let(digest, lambda d: F.transform(side, lambda x, i: F.pmod(x + F.pmod(F.xxhash64(d, i), F.get(sizes, i + offset).cast("long")), F.get(sizes, i + offset).cast("long")).cast("int")))
            return F.struct(
                F.when(odd, shift(s["a"], F.lit(0))).otherwise(s["a"]).alias("a"),
                F.when(odd, s["b"]).otherwise(shift(s["b"], half)).alias("b"),
            )

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["a"], s["b"]))

    return _let(values, network)


def _symbols(text: Column, first: Column, last: Column, key: str) -> Column:
    """``text`` with its digits and letters from ``first`` up to before ``last`` (counted from 0) permuted."""

    def of(chars: Column) -> Column:
        def symbol(c: Column, i: Column) -> Column:
            free = (i >= first) & (i < last)
            base = F.when(free & c.rlike("[0-9]"), 48).when(free & c.rlike("[a-z]"), 97).when(free & c.rlike("[A-Z]"), 65)
            return F.struct(c.alias("c"), base.alias("base"), F.when(base == 48, 10).otherwise(26).alias("size"))

        def rebuilt(all_: Column) -> Column:
            free = F.filter(all_, lambda x: x["base"].isNotNull())
            values = F.transform(free, lambda x: F.ascii(x["c"]) - x["base"])
            new = _feistel(values, F.transform(free, lambda x: x["size"]), key)

            def put(n: Column) -> Column:
                step = lambda s, x: F.struct(
                    F.concat(s["out"], F.when(x["base"].isNull(), x["c"]).otherwise(F.char(F.get(n, s["k"]) + x["base"]))).alias("out"),
                    F.when(x["base"].isNull(), s["k"]).otherwise(s["k"] + 1).alias("k"),
                )
                return F.aggregate(all_, F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step, lambda s: s["out"])

            return _let(new, put)

        return _let(F.transform(chars, symbol), rebuilt)

    return _let(F.split(text, ""), of)


def _luhn(digits: Column) -> Column:
    """Sum of a digit string in which the last digit counts once, the one before twice, and so on."""
    return F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + F.when(c.cast("int") > 4, 1).otherwise(0))),
        F.lit(0), lambda s, x: s + x,
    )


def _mod97(account: Column) -> Column:
    """Remainder of an account number: the first four signs go to the end, a letter counts 10 to 35."""
    moved = F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(moved, ""), value), F.lit(0), lambda s, x: (s * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _card(hit: Column, key: str) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")

    def renewed(s: Column) -> Column:
        rest = F.substring(s, F.lit(1), F.length(s) - 1)
        check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(F.regexp_replace(rest, "[^0-9]", ""), F.lit("0"))), F.lit(10)), F.lit(10))
        return F.concat(rest, check.cast("string"))

    return F.when(F.pmod(_luhn(digits), F.lit(10)) == 0, _let(_symbols(hit, F.lit(0), F.length(hit) - 1, key), renewed))


def _iban(hit: Column, key: str) -> Column:
    plain = lambda s: F.replace(s, F.lit(" "), F.lit(""))

    def renewed(s: Column) -> Column:
        zero = F.concat(F.substring(s, 1, 2), F.lit("00"), F.substring(s, 5, 60))
        return F.concat(F.substring(s, 1, 2), F.lpad((F.lit(98) - _mod97(plain(zero))).cast("string"), 2, "0"), F.substring(s, 5, 60))

    return F.when(_mod97(plain(hit)) == 1, _let(_symbols(hit, F.lit(4), F.length(hit), key), renewed))


def _ip(hit: Column, key: str) -> Column:
    octets = F.transform(F.split(hit, r"\."), lambda x: x.cast("int"))
    return F.array_join(F.transform(_feistel(octets, F.array(*[F.lit(256)] * 4), key), lambda x: x.cast("string")), ".")


def _moved(date: Column, key: str) -> Column:
    """The day that takes the place of ``date``; null outside the days that are permuted."""

    def of(days: Column) -> Column:
        pair = F.array(F.floor(days / DAYS_LOW).cast("int"), F.pmod(days, F.lit(DAYS_LOW)))
        new = F.aggregate(_feistel(pair, F.array(F.lit(DAYS_HIGH), F.lit(DAYS_LOW)), key), F.lit(0), lambda s, x: s * DAYS_LOW + x)
        return F.when((days >= 0) & (days < DAYS_HIGH * DAYS_LOW), F.date_add(F.lit(FIRST_DAY).cast("date"), new))

    return _let(F.date_diff(date, F.lit(FIRST_DAY).cast("date")), of)


def _date(hit: Column, key: str) -> Column:
    """Year first, or day first, or where that is no date month first; the separator stays, and zeros before figures where both have two."""
    read = F.lit(None).cast("struct<date:date,form:string>")
    for order in ("M?d?yyyy", "d?M?yyyy", "yyyy?M?d", "MM?dd?yyyy", "dd?MM?yyyy", "yyyy?MM?dd"):  # the last that holds counts
        for sign in "-/.":
            form = order.replace("?", sign)
            date = F.try_to_date(hit, form)
            read = F.when(date.isNotNull(), F.struct(date.alias("date"), F.lit(form).alias("form"))).otherwise(read)
    return _let(read, lambda r: F.call_function("date_format", _moved(r["date"], key), r["form"]))


def _date_named(hit: Column, key: str) -> Column:
    """Day, name of the month and year are replaced; language, capitals, signs and the place of the day stay."""

    def parts(first: Column) -> Column:
        def part(day_first: int, name_first: int) -> Column:
            return F.when(first, F.regexp_extract(hit, f"^{_DAY_FIRST}$", day_first)).otherwise(F.regexp_extract(hit, f"^{_NAME_FIRST}$", name_first))

        return F.struct(part(1, 3).alias("day"), part(2, 4).alias("ending"), part(3, 2).alias("gap"), part(4, 1).alias("name"), part(5, 5).alias("gap2"), part(6, 6).alias("year"), first.alias("first"))

    def renewed(p: Column) -> Column:
        lists = [F.array(*map(F.lit, names)) for names in MONTHS]
        # names that languages share: German where a full stop follows the day
        german = F.sort_array(F.array(*[F.struct(F.when((p["ending"] == ".") & F.lit(k in (2, 3)), 0).otherwise(1).alias("later"), F.lit(k).alias("k"), x.alias("names")) for k, x in enumerate(lists)]))
        known = F.get(F.filter(german, lambda x: F.array_contains(x["names"], F.lower(p["name"]))), F.lit(0))["names"]

        def put(names: Column) -> Column:
            month = F.array_position(names, F.lower(p["name"])).cast("string")
            date = F.try_to_date(F.concat_ws("-", p["year"], month, p["day"].cast("int").cast("string")), "yyyy-M-d")

            def text(new: Column) -> Column:
                n = F.day(new)
                name = F.get(names, F.month(new) - 1)
                name = F.when(p["name"] == F.upper(p["name"]), F.upper(name)).when(p["name"] == F.lower(p["name"]), name).otherwise(F.initcap(name))
                day = F.when(p["day"].startswith("0"), F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))
                usual = F.when(n.isin(11, 12, 13), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th")
                ending = F.when(p["ending"].isin("", "."), p["ending"]).when(p["ending"] == "er", F.when(n == 1, "er").otherwise("")).otherwise(usual)
                day = F.concat(day, ending)
                return F.when(p["first"], F.concat(day, p["gap"], name, p["gap2"], F.year(new).cast("string"))).otherwise(F.concat(name, p["gap"], day, p["gap2"], F.year(new).cast("string")))

            return _let(_moved(date, key), text)

        return _let(known, put)

    return _let(parts(hit.rlike("^[0-9]")), renewed)


def pseudonym(hit: Column, kind: Column, key: str) -> Column:
    """The replacement of a candidate; null where it fails its check."""
    length = F.length(hit)
    name = F.length(F.regexp_extract(hit, rf"^{_NAMED}", 0))
    prefix = F.length(F.regexp_extract(hit, r"^(?:AKIA|gh[pousr]_|sk-)", 0))
    country = F.length(F.regexp_extract(hit, r"^(?:(?:\+|00)[0-9]{1,3}(?: ?\(0\))?(?=[ .(-]|(?<=\)))|1(?=[ .-])|\(?0)", 0))
    top = length - F.length(F.regexp_extract(hit, r"[A-Za-z]+$", 0))
    return (
        F.when(kind == "secret", _symbols(hit, name, length, key))
        .when(kind == "key", _symbols(hit, prefix, length, key))
        .when(kind == "email", _symbols(hit, F.lit(0), top, key))
        .when(kind == "iban", _iban(hit, key))
        .when(kind == "card", _card(hit, key))
        .when(kind == "ssn", _symbols(hit, F.lit(0), length, key))
        .when(kind == "date", _date(hit, key))
        .when(kind == "date_named", _date_named(hit, key))
        .when(kind.isin("phone", "phone_international", "phone_national"), _symbols(hit, country, length, key))
        .when(kind == "ip", _ip(hit, key))
    )


def _kind(hit: Column) -> Column:
    out = None
    for kind, pattern in KINDS.items():
        found = hit.rlike(f"^(?:{pattern})$")
        out = F.when(found, kind) if out is None else out.when(found, kind)
    return out


def session_key(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_OPTION, "")
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY_OPTION, key)
    return key


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with the text replaced, and ``__found``: kind, value and pseudonym of each finding."""
    key = session_key(docs.sparkSession) if key is None else key
    if key in ("", "set a secret key here"):  # the latter is public: it was once the default
        raise ValueError("set a secret key")
    pattern = _candidate()
    text = F.col(text_col)

    def finding(hit: Column) -> Column:
        return _let(_kind(hit), lambda kind: F.struct(kind.alias("kind"), hit.alias("value"), pseudonym(hit, kind, key).alias("pseudonym")))

    hits = docs.withColumn("__hits", F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), finding))
    rebuilt = F.concat_ws("", F.transform(
        F.split(text, pattern), lambda part, i: F.concat(part, F.coalesce(F.get(F.col("__hits"), i)["pseudonym"], F.get(F.col("__hits"), i)["value"], F.lit("")))
    ))
    some = F.size("__hits") > 0
    return hits.withColumns({
        text_col: F.when(some, rebuilt).otherwise(text),
        "__found": F.coalesce(F.filter("__hits", lambda x: x["pseudonym"].isNotNull()), F.array()),
    }).drop("__hits")
