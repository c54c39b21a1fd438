"""Operator 1, BPE encoding and decoding by tree concatenation.

A text of at most ``leaf`` characters is encoded where it lies. A longer one is cut into leaves
of ``leaf`` characters, anywhere but inside a special token's string, and the leaves are dealt
over the cluster and encoded in parallel. Neighbours are then joined pairwise, level by level:
the last tokens of the left and the first of the right side are decoded and encoded again as
one window, which doubles until ``AGREE`` tokens in a row agree exactly with the left side and
as many with the right side. Whether a BPE sequence is the right one depends only on each pair
of neighbouring tokens, so from there on either side stands as it is; a window that reaches the
end of a side needs no agreement there.

Ids travel as little-endian unsigned 32-bit integers in one binary value for each document. Texts
are taken in slices of about a megabyte, and decoded where they were encoded.
Defined cases: null and empty texts have no ids and decode to the empty text; rows that repeat
an id are encoded each for itself; an id without a token decodes to nothing, bytes that are no
UTF-8 to U+FFFD; an empty table gives no rows; columns other than id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm.common import bounded, whole
from veritab.llm.tokens import Codec, codec

LEAF = 65_536
AGREE = 4
WINDOW = 16


def _cuts(text: str, leaf: int, special: list[str]) -> list[int]:
    cuts = [0]
    while cuts[-1] + leaf < len(text):
        cut = cuts[-1] + leaf
        for s in special:
            at = text.find(s, max(cuts[-1], cut - len(s) + 1), cut + len(s) - 1)
            if cuts[-1] < at < cut:
                cut = at
        cuts.append(cut)
    return [*cuts, len(text)]


def _plain_run(ids: np.ndarray, special: np.ndarray, at_end: bool) -> np.ndarray:
    """The ids after the last (before the first) special one: no window reaches across it."""
    hit = np.flatnonzero(np.isin(ids, special))
    return ids if not len(hit) else ids[hit[-1] + 1:] if at_end else ids[:hit[0]]


def _match(side: np.ndarray, side_at: np.ndarray, mid: np.ndarray, mid_at: np.ndarray) -> tuple[int, int] | None:
    """First places in ``side`` and ``mid`` from which ``AGREE`` tokens are the same at the same bytes."""
    where = {int(b): k for k, b in enumerate(mid_at)}
    for i in range(len(side) - AGREE + 1):
        k = where.get(int(side_at[i]))
        if k is not None and k + AGREE <= len(mid) and np.array_equal(side[i:i + AGREE], mid[k:k + AGREE]):
            return i, k
    return None


def join(c: Codec, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Ids of two neighbouring texts, given the ids of each."""
    if not len(left) or not len(right):
        return np.concatenate((left, right))
    special = np.array(list(c.special.values()), np.uint32)
    tail, head = _plain_run(left, special, True), _plain_run(right, special, False)
    if not len(tail) or not len(head):
        return np.concatenate((left, right))
    window = WINDOW
    while True:
        a, b = tail[-window:], head[:window]
        raw_a, raw_b = c.raw(a), c.raw(b)
        skip = 0
        while skip < len(raw_a) and raw_a[skip] & 0xC0 == 0x80:
            skip += 1
        text = (raw_a[skip:] + raw_b).decode("utf-8", "ignore")  # the last character may be incomplete
        mid = c.encode(text)
        mid_n = c.n_bytes[mid.astype(np.int64)]
        mid_at = skip + np.cumsum(mid_n) - mid_n
        a_n, b_n = c.n_bytes[a.astype(np.int64)], c.n_bytes[b.astype(np.int64)]
        a_at, b_at = np.cumsum(a_n) - a_n, len(raw_a) + np.cumsum(b_n) - b_n
        first = (0, 0) if len(a) == len(tail) else _match(a, a_at, mid, mid_at)
        if len(b) == len(head):
            last: tuple[int, int] | None = (len(b), len(mid))
        else:  # the same from the end, over the places where tokens end
            found = _match(b[::-1], (b_at + b_n)[::-1], mid[::-1], (mid_at + mid_n)[::-1])
            last = None if found is None else (len(b) - found[0], len(mid) - found[1])
        if first is not None and last is not None and first[1] <= last[1]:
            return np.concatenate((left[:len(left) - len(a) + first[0]], mid[first[1]:last[1]], right[last[0]:]))
        window *= 2


def join_all(c: Codec, leaves: list[np.ndarray]) -> np.ndarray:
    """A binary tree of joins."""
    while len(leaves) > 1:
        leaves = [join(c, *leaves[i:i + 2]) if i + 1 < len(leaves) else leaves[i] for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else np.zeros(0, np.uint32)


def _packed(ids: list[np.ndarray]) -> pa.Array:
    return pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, decoded: str | None = None) -> DataFrame:
    """``(id, ids)`` for each row of ``docs``, and in a column ``decoded`` the text that its ids give."""
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    long = F.length("text") > leaf
    schema = T.StructType().add("id", kind).add("ids", "binary")
    if decoded:
        schema = schema.add(decoded, "string")

    def columns(c: Codec, names: pa.Array, ids: list[np.ndarray]) -> list[pa.Array]:
        texts = [pa.array([c.decode(x) for x in ids], pa.string())] if decoded else []
        return [names, _packed(ids), *texts]

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in bounded(batches, "text"):
            yield pa.RecordBatch.from_arrays(columns(c, b["id"], [c.encode(t.as_py()) for t in b["text"]]), schema.names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = list(codec(path).special)
        for b in bounded(batches, "text"):
            for i in range(b.num_rows):
                t = b["text"][i].as_py()
                at = _cuts(t, leaf, special)
                n = len(at) - 1
                same = pa.array([i] * n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b["name"].take(same), b["id"].take(same), pa.array(range(n), pa.int32()), pa.array([t[x:y] for x, y in zip(at, at[1:])], pa.string())],
                    ["name", "id", "nth", "text"],
                )

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in bounded(batches, "text"):
            yield pa.RecordBatch.from_arrays([b["name"], b["id"], b["nth"], _packed([c.encode(t.as_py()) for t in b["text"]])], ["name", "id", "nth", "ids"])

    def joined(part: pa.Table) -> pa.Table:
        c, found = codec(path), {}
        copies = 0
        for nth, ids in zip(part["nth"], part["ids"], strict=True):
            copies += nth.as_py() == 0
            found.setdefault(nth.as_py(), ids)
        ids = join_all(c, [np.frombuffer(found[k].as_py(), "<u4") for k in sorted(found)])
        one = pa.Table.from_arrays(columns(c, part["id"].slice(0, 1), [ids]), schema.names)
        return pa.concat_tables([one] * copies)

    # A row is named by what it holds, so a repeated task gives the same names; equal rows are copies of one name.
    name = F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit("\n"), "text"), 256)
    named = T.StructType().add("name", "string").add("id", kind).add("nth", "integer")
    parts = rows.filter(long).select(name.alias("name"), "id", "text").mapInArrow(cut, T.StructType([*named.fields]).add("text", "string"))
    ids = parts.repartition("name", "nth").mapInArrow(leaves, T.StructType([*named.fields]).add("ids", "binary"))
    return rows.filter(~long).mapInArrow(here, schema).unionByName(ids.groupBy("name").applyInArrow(joined, schema))


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids, special tokens included; null ids give the empty text."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in bounded(batches, ids_col):
            text = [c.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in b[ids_col]]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], [*b.schema.names, out])

    return encoded.mapInArrow(texts, T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())]))
