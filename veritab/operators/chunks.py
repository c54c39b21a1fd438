"""Ordered text that is too long for one row: chunks in order, and a view as one string with a bound."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veritab.operators.first import with_position

PIECES = 64  # pieces of one chunk
MOST_CHARS = 1 << 20  # characters of one row
ONE_STRING = 1 << 26  # characters that may become one string

c = F.col


def in_chunks(pieces: DataFrame, keys: list[str], ord_col: str, text_col: str, sep: str = "", per_chunk: int = PIECES, most: int = MOST_CHARS) -> DataFrame:
    """``(keys, chunk, slice, text)``: read in order of chunk and slice it is all pieces in order of ``ord_col``.

    Positions come first, so a key with most of all pieces is dealt over as many chunks; a
    chunk longer than ``most`` characters lies in several slices. A null text is empty.
    """
    placed = with_position(pieces, keys, ord_col, "_pos").withColumn("chunk", F.floor((c("_pos") - 1) / per_chunk))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce(text_col, F.lit("")).alias("t")))), lambda p: p["t"]), sep)
    chunks = placed.groupBy(*keys, "chunk").agg(joined.alias("text"))
    if sep:
        chunks = chunks.withColumn("text", F.concat(F.when(c("chunk") > 0, F.lit(sep)).otherwise(""), c("text")))
    slices = F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / most))
    return chunks.withColumn("slice", F.explode(slices)).select(
        *keys, "chunk", "slice", F.substring(c("text"), (c("slice") * most + 1).cast("int"), F.lit(most)).alias("text")
    )


def one_string(chunks: DataFrame, keys: list[str], most: int = ONE_STRING) -> DataFrame:
    """``(keys, chars, text)`` of each key; the text is null where it has more than ``most`` characters."""
    sizes = chunks.groupBy(*keys).agg(F.sum(F.length("text")).alias("chars"))
    named = sizes.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [c(k).eqNullSafe(c(f"_{k}")) for k in keys]
    short = chunks.join(named.filter(c("chars") <= most).drop("chars"), same, "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("chunk", "slice", "text")))  # at most ``most`` characters
    texts = short.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"))
    return named.join(texts, same, "left").select(*[c(f"_{k}").alias(k) for k in keys], "chars", "text")
