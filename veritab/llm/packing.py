"""Operator 3, packing by power-of-two decomposition.

A document's ids and a closing id 0 are cut, from the start, into as many pieces of ``length``
ids as fit and then into the binary digits of the rest, longest first. Every piece is a power of
two and makes a sequence of its own, so no sequence crosses documents and none needs padding;
``bucket`` is the exponent, and ``write_buckets`` lays equal lengths together for batching.
Work is row by row in the scan that reads the texts; nothing is shuffled.

Defined cases: a null or empty text is the single id 0, one piece of length 1; rows that repeat
an id are packed each for itself and get sequences of their own; a text of any length gives as
many pieces as it needs; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm.common import bounded, whole
from veritab.llm.tokens import codec

LENGTH = 1024
PIECES = [("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType())]


def pieces(n: int, length: int = LENGTH) -> list[int]:
    """Lengths that add up to ``n``: full sequences, then the binary digits of the rest."""
    return [length] * (n // length) + [1 << k for k in range(length.bit_length() - 2, -1, -1) if n % length >> k & 1]


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row for each piece: ``id, start, length, ids, doc_tokens, sequence_id, offset, bucket``."""
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(n, t) for n, t in PIECES]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in bounded(batches, "text"):
            row, start, size, ids, total = [], [], [], [], []
            for i, text in enumerate(b["text"].to_pylist()):
                all_ids = np.append(c.encode(text), np.uint32(0)).astype("<u4")
                at = 0
                for n in pieces(len(all_ids), length):
                    row.append(i)
                    start.append(at)
                    size.append(n)
                    ids.append(all_ids[at:at + n].tobytes())
                    total.append(len(all_ids))
                    at += n
            yield pa.RecordBatch.from_arrays(
                [b["id"].take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(total, pa.int64())],
                schema.names,
            )

    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text")).mapInArrow(cut, schema)
    return rows.withColumns({
        "sequence_id": F.monotonically_increasing_id(),
        "offset": F.lit(0).cast("long"),
        "bucket": F.log2("length").cast("int"),
    })


def write_buckets(packed: DataFrame, folder: str) -> None:
    """Parquet with one folder for each sequence length; a length that most have is dealt over several tasks."""
    packed.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)


def read_bucket(spark: SparkSession, folder: str, bucket: int) -> DataFrame:
    """The sequences of one length, ``2 ** bucket`` ids each, without reading the others."""
    return spark.read.parquet(folder).filter(F.col("bucket") == bucket)
