"""Reading the calculation cell of a rule."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from veritab.functions.text import NONE_MARKERS, blank_to_empty, strip

# Calculation kinds in the order in which they are looked for.
KINDS = ["날짜", "수", "이름개수", "기간", "값", "ISBN유효", "ISBN같음", "학기"]
# Kinds that never look at evidence, so they need no linked file.
CLAIM_ONLY_KINDS = ["기간", "이름개수", "ISBN유효"]


def calc_kind(c: Column) -> Column:
    dense = F.replace(c, F.lit(" "), F.lit(""))
    return F.coalesce(
        *[F.when(dense.startswith(k) | dense.contains("·" + k), F.lit(k)) for k in KINDS]
    )


def calc_method(c: Column) -> Column:
    """``기간 ≥ 3개월`` and friends as a struct; null for an empty cell."""
    s = blank_to_empty(c)
    limit = "(?U)[≥>=]+\\s*(\\d+(?:\\.\\d+)?)\\s*([^\\s·]*)"
    number = F.regexp_extract(s, limit, 1)
    before = F.regexp_extract(s, "(?U)앞선\\s*#?(\\d+)", 1)
    column = F.regexp_extract(s, "(?U)이름칸\\s*=\\s*([^·]+)", 1)
    return F.when(
        ~s.isin(NONE_MARKERS),
        F.struct(
            calc_kind(s).alias("kind"),
            number.try_cast("double").alias("threshold"),
            F.when(number != "", F.regexp_extract(s, limit, 2)).alias("unit"),
            before.try_cast("int").alias("predecessor"),
            F.when(column != "", strip(column)).alias("name_col"),
            s.alias("text"),
        ),
    )
