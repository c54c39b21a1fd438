"""Answers of the linking model: JSON text to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Field names of an answer.
ROWS, ROW, LINKS, LINK_REASON, CONFIDENCE, VALUES, MEMO = "줄", "행", "맺은파일", "맺은근거", "확신", "값", "메모"
ROSTER, ROSTER_STATUS, ROSTER_NAMES = "참여명단", "상태", "이름"
VERDICT, PROVENANCE, RATIONALE, REMARK = "판정", "출처", "근거", "비고"

_TEXT_MAP = "map<string,string>"
# Row and item numbers are written without leading zeros; anything else is another key.
ROW_KEY, ITEM_KEY = "^r(0|[1-9][0-9]*)$", "^v(0|[1-9][0-9]*)$"


def scan_answers(raw: DataFrame, body: str = "body") -> DataFrame:
    """One row per answered sheet row. The row number is the key ``rN``; only the older
    array form carries it inside. Each JSON level is parsed once, nested parts stay text."""
    rows = F.get_json_object(body, f"$.{ROWS}")
    keyed = F.from_json(rows, "map<string,map<string,string>>")
    listed = F.from_json(rows, "array<map<string,string>>")
    is_list = rows.startswith("[")
    entries = F.when(
        is_list, F.transform(listed, lambda m: F.struct(F.try_element_at(m, F.lit(ROW)).alias("key"), m.alias("value")))
    ).otherwise(
        F.transform(F.map_entries(keyed), lambda e: F.struct(F.regexp_extract(e["key"], ROW_KEY, 1).alias("key"), e["value"].alias("value")))
    )
    rest = [c for c in raw.columns if c != body]
    one = raw.select(*rest, F.explode(entries).alias("e")).select(
        *rest, F.col("e.key").try_cast("bigint").alias("row"), F.col("e.value").alias("a")
    )
    text = lambda k: F.coalesce(F.try_element_at("a", F.lit(k)), F.lit(""))
    # an older form nests the items one level deeper
    nested = F.coalesce(F.from_json(text(VERDICT), _TEXT_MAP), F.create_map().cast(_TEXT_MAP))
    typed = one.filter(F.col("row").isNotNull()).withColumns({
        "tags": F.coalesce(F.from_json(text(LINKS), "array<string>"), F.array().cast("array<string>")),
        "link_reason": text(LINK_REASON),
        "confidence": F.coalesce(F.nullif(text(CONFIDENCE), F.lit("")), F.lit("못맺음")),
        "memo": text(MEMO),
        "ext": F.coalesce(F.from_json(text(VALUES), _TEXT_MAP), F.create_map().cast(_TEXT_MAP)),
        "said": F.map_filter(F.map_zip_with("a", nested, lambda k, x, y: F.coalesce(x, y)), lambda k, v: k.rlike(ITEM_KEY)),
    })
    return typed.withColumn("roster", roster(F.try_element_at("ext", F.lit(ROSTER)))).drop("a")


def rejected_answers(raw: DataFrame, body: str = "body") -> DataFrame:
    """What ``scan_answers`` cannot use, with a reason: a body without readable rows, and row keys that name no row."""
    rows = F.get_json_object(body, f"$.{ROWS}")
    keyed, listed = F.from_json(rows, "map<string,string>"), F.from_json(rows, "array<map<string,string>>")
    rest = [c for c in raw.columns if c != body]
    broken = raw.filter(rows.isNull() | F.coalesce(F.when(rows.startswith("["), listed.isNull()).otherwise(keyed.isNull()), F.lit(True)))
    odd = raw.filter(rows.startswith("{")).select(*rest, F.explode(F.map_keys(keyed)).alias("key")).filter(~F.col("key").rlike(ROW_KEY))
    unnumbered = raw.filter(rows.startswith("[")).select(*rest, F.explode(listed).alias("m"))
    unnumbered = unnumbered.filter(F.try_element_at("m", F.lit(ROW)).try_cast("bigint").isNull())
    return (
        broken.select(*rest, F.lit("").alias("key"), F.lit("no readable rows").alias("reason"))
        .unionByName(odd.select(*rest, "key", F.lit("no row number").alias("reason")))
        .unionByName(unnumbered.select(*rest, F.coalesce(F.try_element_at("m", F.lit(ROW)), F.lit("")).alias("key"), F.lit("no row number").alias("reason")))
    )


def roster(text: Column) -> Column:
    """The one object-valued field: null unless it is an object."""
    return F.when(
        text.startswith("{"),
        F.struct(
            F.coalesce(F.get_json_object(text, f"$.{ROSTER_STATUS}"), F.lit("")).alias("status"),
            F.from_json(F.get_json_object(text, f"$.{ROSTER_NAMES}"), "array<string>").alias("names"),
        ),
    )


def unfold_judgements(answers: DataFrame) -> DataFrame:
    """Long table of what the model said per item, texts untouched."""
    keys = [c for c in answers.columns if c in ("wb", "sheet", "ord", "row", "batch")]
    schema = ", ".join(f"`{n}` string" for n in (VERDICT, PROVENANCE, RATIONALE, REMARK))
    each = answers.select(*keys, F.explode("said").alias("v", "text")).select(
        *keys, F.substr("v", F.lit(2)).try_cast("int").alias("item_no"), F.from_json("text", schema).alias("j")
    )
    field = lambda n: F.coalesce(F.col(f"j.{n}"), F.lit(""))
    return each.select(
        *keys, "item_no", field(VERDICT).alias("said"), field(PROVENANCE).alias("provenance"),
        field(RATIONALE).alias("rationale"), field(REMARK).alias("remark"),
    )
