"""Operator 8, token ids in training order: a keyed permutation gives every sequence its slot.

A document's ids and a closing id 0 are cut into sequences of ``length`` ids; each is one record
of fixed stride, ids as little-endian unsigned 16-bit integers, padded with id 0. Sequences are
numbered densely (a prefix sum over the partitions' totals plus the place inside a partition),
and a Feistel network over the next even power of two, walked again while its result is too
large, permutes the numbers among themselves. The slot alone says where a record lies: shard
``slot div per_shard``, byte ``slot mod per_shard * 2 * length`` of its record column.
``write_shards`` deals ranges of whole shards and writes each shard as one file of a folder of its
own, records in slot order; Spark commits the files, so a repeated task leaves none twice.
``read_shards`` takes shard and offset from where a record lies and goes on from any such place.

The key is a parameter: the same key and input give the same order. Defined cases: null and
empty texts are one record with only the closing id; rows that repeat an id get records of their
own; an empty table gives no rows; ids of 65,536 and more are refused; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm.common import bounded, cut, whole
from veritab.llm.shingles import U, mix
from veritab.llm.tokens import codec

LENGTH = 1024
PER_SHARD = 4096
ROUNDS = 6
KEY = 20


def permute(index: np.ndarray, n: int, key: int = KEY) -> np.ndarray:
    """A permutation of the numbers below ``n``."""
    half = U(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    mask = (U(1) << half) - U(1)
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + U(key) * U(ROUNDS + 1))
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (mix(right + k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def records(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
            per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """One row a sequence: ``id, start, n_tokens, record, slot, shard, offset`` (bytes in the shard)."""
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.BinaryType())])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        if len(c.n_bytes) > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        for b in bounded(batches, "text"):
            ids = [np.append(c.encode(t.as_py()), np.uint32(0)).astype("<u2").tobytes() for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(ids, pa.binary())], schema.names)

    tokens = cut(docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(encoded, schema))
    n_records = F.ceil(F.octet_length("ids") / (2 * length)).cast("int")
    part = F.spark_partition_id()
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    totals = tokens.groupBy(part.alias("part")).agg(F.sum(n_records).alias("n"))
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.sum("n").over(Window.partitionBy()).alias("all"))
    # the number of a row within its partition is the lower part of the generated id
    cuts = tokens.select("id", "ids", F.explode(F.sequence(F.lit(0), n_records - 1)).alias("nth"))
    cuts = cuts.withColumns({"part": part, "place": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    numbered = cuts.join(F.broadcast(totals), "part").withColumn("index", F.col("first") + F.col("place"))

    @F.pandas_udf(T.LongType())
    def slot(index: pd.Series, n: pd.Series) -> pd.Series:
        with np.errstate(over="ignore"):
            return pd.Series(permute(index.to_numpy(), int(n.iloc[0]), key)) if len(index) else index

    record = F.expr(f"substring(ids, nth * {2 * length} + 1, {2 * length})")
    out = numbered.select("id", (F.col("nth").cast("long") * length).alias("start"), record.alias("record"), slot("index", "all").alias("slot"))
    return out.select(
        "id", "start", (F.octet_length("record") / 2).cast("long").alias("n_tokens"),
        F.expr(f"rpad(record, {2 * length}, X'00')").alias("record"), "slot",
        F.expr(f"slot div {per_shard}").alias("shard"), (F.col("slot") % per_shard * 2 * length).alias("offset"),
    )


def in_order(made: DataFrame) -> DataFrame:
    """Records dealt by ranges of slots and sorted within them."""
    return made.repartitionByRange("slot").sortWithinPartitions("slot")


def write_shards(made: DataFrame, folder: str) -> None:
    """A folder ``shard=k`` with one Parquet file for each shard.

    Ranges of shards keep a shard in one task; the sort is the one the writer asks for, so it adds none.
    """
    dealt = made.repartitionByRange("shard").sortWithinPartitions("shard", "slot")
    dealt.write.option("maxRecordsPerFile", 0).option("compression", "zstd").partitionBy("shard").parquet(folder)


def read_shards(spark: SparkSession, folder: str, shard: int = 0, offset: int = 0, id_type: T.DataType | None = None) -> DataFrame:
    """The records from byte ``offset`` of ``shard`` on, shards before it unread; ``shard`` is the folder
    and ``offset`` the place in the file that a record was read from. ``id_type``: long where not given."""
    fields = {"id": id_type or T.LongType(), "start": T.LongType(), "n_tokens": T.LongType(), "record": T.BinaryType(), "slot": T.LongType(), "shard": T.LongType()}
    schema = T.StructType([T.StructField(k, t) for k, t in fields.items()])  # a set without records has no file to take it from
    found = spark.read.schema(schema).parquet(folder).withColumn("offset", F.col("_metadata.row_index") * F.octet_length("record"))
    return found.filter((F.col("shard") >= shard) & ((F.col("shard") > shard) | (F.col("offset") >= offset)))
