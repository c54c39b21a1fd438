"""First-wins rules and row positions that survive a hot key.

A window over a key puts all rows of that key into one task. Here the first record is
found with an aggregate, which combines before the shuffle. Positions are counted by a
window where no key has more than ``BUCKET`` rows. A key that has more is cut into buckets
at quantiles of its own ordinals, so buckets are even however the ordinals are spread.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritab.session import materialize

c = F.col
BUCKET = 1 << 18  # rows of one key that one window task sorts
MOST_BUCKETS = 4096  # of one key


def keep_first(df: DataFrame, by: list[str], order: list[str | Column]) -> DataFrame:
    """One record per ``by``: the one with the smallest order."""
    cols = df.columns
    rest = [c for c in cols if c not in by]
    return (
        df.groupBy(*by)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])
        .select(*cols)
    )


def mark_first(df: DataFrame, by: list[str], order: list[str | Column], flag: str = "is_first") -> DataFrame:
    """Add a flag that is true for the first record per ``by``. Order values are unique."""
    firsts = df.groupBy(*by).agg(F.min(F.struct(*order)).alias("_first"))
    return _joined(df, firsts, by).withColumn(flag, F.struct(*order).eqNullSafe(F.col("_first"))).drop("_first")


def _joined(df: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Each row with the one of ``found`` that has its key, null keys included."""
    named = found.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(by)})
    same = [df[k].eqNullSafe(named[f"_key_{i}"]) for i, k in enumerate(by)]
    return df.join(named, same).drop(*[f"_key_{i}" for i in range(len(by))])


def _hot_keys(df: DataFrame, keys: list[str], width: int) -> tuple[DataFrame, int]:
    """Keys of more than ``width`` rows, few by their nature, and the most rows one has (0: no such key)."""
    hot = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(c("_rows") > width))
    return hot, hot.agg(F.max("_rows")).first()[0] or 0


def _bucket_of(value: Column, step: int) -> Column:
    """How many of a key's sorted splitters (``_blocks``, each of ``step``; ``_heads``: the first of each) are at or below ``value``."""
    block = F.size(F.filter("_heads", lambda x: x <= value))
    inner = F.size(F.filter(F.get("_blocks", block - 1), lambda x: x <= value))
    return F.when(block == 0, 0).otherwise((block - 1) * step + inner)


def _in_buckets(df: DataFrame, keys: list[str], ord_col: str, hot: DataFrame, most: int, width: int) -> DataFrame:
    """The rows of hot keys with the number of their bucket ``_b``, at most about ``width`` rows each.

    Splitters are quantiles of a key's ordinals from a mergeable sketch; rows are compared with them as
    whole numbers. Beyond ``MOST_BUCKETS`` buckets of a key they get longer. Rows without an ordinal are a last bucket.
    """
    parts = min(MOST_BUCKETS, 2 * -(-most // width))
    step = max(1, int(parts ** 0.5))
    rows = _joined(df, hot.drop("_rows"), keys)
    at = F.array(*[F.lit(k / parts) for k in range(1, parts)])
    found = rows.filter(c(ord_col).isNotNull()).groupBy(*keys).agg(F.array_distinct(F.percentile_approx(c(ord_col).cast("long"), at, F.lit(20 * parts))).alias("_at"))
    starts = F.sequence(F.lit(1), F.size("_at"), F.lit(step))
    blocks = F.transform(starts, lambda i: F.slice("_at", i, step))
    found = found.select(*keys, blocks.alias("_blocks"), F.transform(starts, lambda i: F.get("_at", i - 1)).alias("_heads"))
    same = reduce(lambda x, y: x & y, [rows[k].eqNullSafe(c(f"_key_{i}")) for i, k in enumerate(keys)])
    named = found.withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    bucket = F.coalesce(F.when(c(ord_col).isNotNull(), _bucket_of(c(ord_col), step)), F.lit(1 << 30))
    return rows.join(named, same, "left").withColumn("_b", bucket).drop("_blocks", "_heads", *[f"_key_{i}" for i in range(len(keys))])


def _not_hot(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    named = hot.drop("_rows").withColumnsRenamed({k: f"_key_{i}" for i, k in enumerate(keys)})
    return df.join(named, reduce(lambda x, y: x & y, [df[k].eqNullSafe(named[f"_key_{i}"]) for i, k in enumerate(keys)]), "left_anti")


def with_position(df: DataFrame, keys: list[str], ord_col: str, name: str = "pos", width: int = BUCKET) -> DataFrame:
    """1-based position of each row within its key, by a whole-number ordinal; rows without one come last.

    For a hot key one window counts inside each bucket, a second one over one row for each
    bucket. Null keys are a key; no row is lost. Looking for hot keys runs a job.
    """
    order = F.col(ord_col).asc_nulls_last()
    counted = lambda rows: rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order)).cast("long"))
    hot, most = _hot_keys(df, keys, width)
    if not most:
        return counted(df)
    placed = _in_buckets(df, keys, ord_col, hot, most, width)
    starts = (
        placed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)))
        .select(*keys, "_b", F.coalesce("_before", F.lit(0)).alias("_before"))
    )
    inside = placed.withColumn("_i", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order)))
    placed = _joined(inside, starts, [*keys, "_b"]).withColumn(name, F.col("_before") + F.col("_i")).drop("_b", "_i", "_before")
    return counted(_not_hot(df, keys, hot)).unionByName(placed)


def previous_value(df: DataFrame, keys: list[str], ord_col: str, name: str, width: int = BUCKET) -> DataFrame:
    """The preceding ordinal of the same key, null for the first; bucketed as above."""
    order = F.col(ord_col).asc_nulls_last()
    before = lambda rows: rows.withColumn(name, F.lag(ord_col).over(Window.partitionBy(*keys).orderBy(order)))
    hot, most = _hot_keys(df, keys, width)
    if not most:
        return before(df)
    placed = _in_buckets(df, keys, ord_col, hot, most, width)
    edges = (
        placed.groupBy(*keys, "_b").agg(F.max(ord_col).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")))
        .select(*keys, "_b", "_carry")
    )
    inside = placed.withColumn("_p", F.lag(ord_col).over(Window.partitionBy(*keys, "_b").orderBy(order)))
    placed = _joined(inside, edges, [*keys, "_b"]).withColumn(name, F.coalesce("_p", "_carry")).drop("_b", "_p", "_carry")
    return before(_not_hot(df, keys, hot)).unionByName(placed)


def distinct_by_key(items: Column, key) -> Column:
    """Order-keeping distinct of an array by a derived key."""
    keys = F.transform(items, key)
    pairs = F.arrays_zip(items.alias("item"), keys.alias("key"))
    kept = F.filter(
        F.transform(pairs, lambda p, i: F.struct(p["item"].alias("item"), (F.array_position(keys, p["key"]) == i + 1).alias("first"))),
        lambda p: p["first"],
    )
    return F.transform(kept, lambda p: p["item"])
