"""Operator 6, exact dedup by content sort.

1. *Sampled splitters.* A bounded sample of sort keys gives the borders of ``parts`` ranges. A
   key is the first ``PREFIX`` characters of the normalised text, the text's 64-bit hash and a
   hash of the row's id; only such short keys reach the driver, ``SAMPLES`` for each range.
2. *Range partition.* Every row goes to the range its key lies in. Equal texts share prefix and
   hash, so they are neighbours; a group large enough to contain borders is split over several
   ranges by the third part of the key, so a hot group never meets in one task.
3. *External sort and neighbouring comparison.* Inside a range Spark's spilling sort orders rows
   by the whole normalised text and id; rows are compared in full with the one before, and the
   first row of a run of equal texts has the run's smallest id.
4. *Texts cut by a border.* Only texts with the prefix and hash of a border can lie in several
   ranges, at most one text for each border. They are combined before and after a shuffle by
   their whole text, and get the smallest id and the joint size.

Normalising replaces each run of ``[\\x20\\x09-\\x0D]`` by one space. Defined cases: a null text
counts as empty, and empty texts are equal to each other; null ids come after all others, so
one is kept only where the whole group has no other; of rows that repeat the smallest id the one
whose raw text comes first stays; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.common import WHITE, whole

PREFIX = 24
SAMPLES = 60
MOST_PARTS = 16_384


def normalised(text: Column | str) -> Column:
    return F.regexp_replace(whole(text), WHITE, " ")


def _fixed(number: Column) -> Column:
    return F.lpad(F.hex(number), 16, "0")


def _start(norm: Column) -> Column:
    """Short and equal for equal texts; the hash stands in fixed width behind the prefix."""
    return F.concat(F.rpad(F.substring(norm, 1, PREFIX), PREFIX, "\0"), _fixed(F.xxhash64(norm)))


def _borders(docs: DataFrame, key, parts: int) -> list[str]:
    n, want = docs.count(), SAMPLES * parts
    rows = docs if n <= want else docs.sample(want / n, seed=6)
    found = sorted(r[0] for r in rows.select(key).limit(2 * want).collect())
    return sorted({found[i * len(found) // parts] for i in range(1, parts)}) if found else []


def _range_of(key: Column, borders: list[str]) -> Column:
    """How many borders are at or below the key, found in two steps of about the square root of their number."""
    if not borders:
        return F.lit(0)
    step = max(1, int(len(borders) ** 0.5))
    rows = [borders[i:i + step] for i in range(0, len(borders), step)]
    heads = F.array(*[F.lit(r[0]) for r in rows])
    blocks = F.array(*[F.array(*[F.lit(x) for x in r]) for r in rows])
    block = F.size(F.filter(heads, lambda x: x <= key))
    inner = F.size(F.filter(F.get(blocks, block - 1), lambda x: x <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inner)


def mark(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """``docs`` with ``__keep_id``, ``__group_size``, ``__kept`` and ``__norm``, the normalised text."""
    parts = min(parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_PARTS)
    start = _start(normalised(text_col))
    borders = _borders(docs, F.concat(start, _fixed(F.xxhash64(id_col))), parts)
    keyed = docs.withColumn("__norm", normalised(text_col)).withColumn("__start", _start(F.col("__norm"))).drop("__norm")
    part = _range_of(F.concat("__start", _fixed(F.xxhash64(id_col))), borders)
    rows = keyed.withColumn("__part", part).repartitionById(parts, "__part")
    rows = rows.withColumn("__norm", normalised(text_col))
    run = Window.partitionBy("__part", "__norm")
    rows = rows.withColumns({
        "__nth": F.row_number().over(run.orderBy(F.col(id_col).asc_nulls_last(), F.col(text_col).asc_nulls_first())),
        "__keep_id": F.min(id_col).over(run),
        "__group_size": F.count(F.lit(1)).over(run),
    })
    kept = F.col("__nth") == 1
    if not borders:
        return rows.withColumn("__kept", kept).drop("__start", "__part", "__nth")
    at_border = F.col("__start").isin(sorted({b[:-16] for b in borders}))
    joint = keyed.filter(at_border).select(F.col(id_col).alias("__id"), normalised(text_col).alias("__text"), "__start")
    joint = joint.groupBy("__start", "__text").agg(F.min("__id").alias("__least"), F.count("*").alias("__all"))
    # one row for each text at a border: bounded by the number of borders
    joint = joint.select(F.col("__start").alias("__at"), F.sha2("__text", 256).alias("__sha"), "__least", "__all")
    rows = rows.join(F.broadcast(joint), (rows["__start"] == joint["__at"]) & (F.sha2(rows["__norm"], 256) == joint["__sha"]), "left")
    found = F.col("__all").isNotNull()
    return rows.withColumns({
        "__kept": kept & (~found | F.col(id_col).eqNullSafe(F.col("__least"))),
        "__keep_id": F.when(found, F.col("__least")).otherwise(F.col("__keep_id")),
        "__group_size": F.when(found, F.col("__all")).otherwise(F.col("__group_size")),
    }).drop("__start", "__part", "__nth", "__at", "__sha", "__least", "__all")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their own columns."""
    return mark(docs, id_col, text_col).filter("__kept").select(*docs.columns)
