"""Operator 11, ranked lexical search by NRA over impact-sorted lists.

1. One scan counts each document's terms and keeps, of its words, those that some query holds.
   Sums over all documents give ``N``, ``L`` and each term's document frequency.
2. Documents are taken in segments of at most ``SEGMENT`` documents. A segment's posting lists are
   sorted by impact, the part of the score that a posting adds. For each query they are read in
   order, twice as deep in each round. A document's lower bound is what was read of it; its upper bound adds,
   for each list in which it has not been met, the impact the list was last read at. Reading goes
   on until every document whose upper bound reaches the tenth best lower bound has equal bounds:
   then membership, ties and scores are settled. The tenth best score of the segments a task
   has read before is a bound for its next one, so it mostly ends after few postings.
3. Each task gives the ranks it found; the best of all of them are the result.

Nothing of the corpus is gathered: a task holds one segment. Queries are a stated set, taken in
blocks of at most ``BLOCK_ROWS`` queries and about ``BLOCK_BYTES`` of text, each block against all documents.

Terms are the maximal runs of ASCII letters, digits and characters above U+007F, A-Z lower-cased.
Defined cases: a null or empty text has no terms and is never found; a query without terms has
no rows; documents that repeat an id are documents of their own and equal scores of one id are
both listed; null ids come after all others among equals; queries that repeat an id are ranked
each for itself; empty tables give no rows; other columns are left out.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm.common import cut, whole

TOP = 10
SEGMENT = 8192
POSTINGS = 1 << 21  # of a segment, about
FIRST_DEPTH = 64
BLOCK_ROWS = 4096
BLOCK_BYTES = 1 << 23
SCALE, TF, B = 1_000_000_000, 1000, 90

_DELIMITERS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b for b in _DELIMITERS)


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TERMS).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _postings(docs: DataFrame, id_col: str, text_col: str, held) -> DataFrame:
    """``(id, n, terms, tfs)``: a document's number of terms, and how often it has each term of the queries."""
    kind = docs.schema[id_col].dataType

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, 256):
                b = whole_batch.slice(at, 256)
                n, found, tfs = [], [], []
                for text in b["text"]:
                    words = terms(text.as_py())
                    count = Counter(known[x] for x in words if x in known)
                    n.append(len(words))
                    found.append(np.fromiter(count.keys(), np.int32, len(count)))
                    tfs.append(np.fromiter(count.values(), np.int64, len(count)))
                yield pa.RecordBatch.from_arrays(
                    [b["id"], pa.array(n, pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["id", "n", "terms", "tfs"]
                )

    fields = [("n", T.LongType()), ("terms", T.ArrayType(T.IntegerType())), ("tfs", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField("id", kind), *[T.StructField(a, t) for a, t in fields]])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(made, schema)


class _Segment:
    """The impact-sorted lists of some documents."""

    def __init__(self, n: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weights: np.ndarray, docs: int, words: int):
        m = 100 - B + (B * n * docs) // words
        impact = weights[term] * ((SCALE * tf) // (TF * tf + 8 * m[doc]))
        order = np.lexsort((doc, -impact, term))
        self.size, self.doc, self.impact = len(n), doc[order], impact[order]
        self.edge = np.searchsorted(term[order], np.arange(len(weights) + 1))

    def search(self, query: np.ndarray, least: int, top: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the segment that may be among the ``top`` best, with their whole scores.

        ``least`` is a score that a document must reach to be of interest.
        """
        begin, end = self.edge[query], self.edge[query + 1]
        query, begin, end = query[end > begin], begin[end > begin], end[end > begin]
        lower = np.zeros(self.size, np.int64)
        unseen = np.ones((len(query), self.size), bool)
        frontier = self.impact[begin]  # no posting that is not read yet adds more
        alive, at, depth = np.arange(self.size), begin.copy(), FIRST_DEPTH
        while len(alive):
            upper = lower[alive] + frontier @ unseen[:, alive]
            best = lower[alive]
            bound = max(least, np.partition(best, -top)[-top]) if len(best) >= top else least
            alive, upper = alive[upper >= bound], upper[upper >= bound]
            if (lower[alive] == upper).all():
                break
            for k in range(len(query)):
                to = min(begin[k] + depth, end[k])
                read = slice(at[k], to)
                lower[self.doc[read]] += self.impact[read]
                unseen[k, self.doc[read]] = False
                at[k] = to
                frontier[k] = self.impact[to] if to < end[k] else 0
            depth *= 2
        return alive, lower[alive]


def _ranked(batches: Iterator[pa.RecordBatch], queries: list[np.ndarray], weights: np.ndarray, docs: int, words: int, top: int, segment: int) -> Iterator[pa.RecordBatch]:
    best: list[list[tuple]] = [[] for _ in queries]  # (score, id order, id), best first

    def ordered(found: list[tuple]) -> list[tuple]:
        return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))[:top]

    def search(parts: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(parts).combine_chunks()
        sizes = t["terms"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False)
        flat = lambda c: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        lists = _Segment(t["n"].to_numpy(), np.repeat(np.arange(t.num_rows), sizes), flat("terms"), flat("tfs"), weights, docs, words)
        for k, q in enumerate(queries):
            if len(q):
                alive, scores = lists.search(q, max(1, best[k][top - 1][0] if len(best[k]) >= top else 1), top)
                ids = t["id"].take(pa.array(alive, pa.int64())).to_pylist()
                best[k] = ordered(best[k] + [(s, i) for s, i in zip(scores.tolist(), ids, strict=True) if s > 0])

    def parts() -> Iterator[list[pa.RecordBatch]]:
        now, n, postings, step = [], 0, 0, min(256, segment)
        for b in batches:
            for at in range(0, b.num_rows, step):
                piece = b.slice(at, step)
                more = len(piece["terms"].flatten())
                if now and (n + piece.num_rows > segment or postings + more > POSTINGS):
                    yield now
                    now, n, postings = [], 0, 0
                now.append(piece)
                n, postings = n + piece.num_rows, postings + more
        if now:
            yield now

    kind = None
    for p in parts():
        kind = p[0].schema.field("id").type
        search(p)
    rows = [(k, *x) for k, found in enumerate(best) for x in found]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind)], ["query", "score", "id"])


def _block(docs: DataFrame, texts: list[str | None], id_col: str, text_col: str, top: int, segment: int) -> DataFrame:
    """``(query, score, id)``: the best of every task for each text."""
    spark = docs.sparkSession
    found = [sorted(set(terms(t))) for t in texts]
    known = {t: k for k, t in enumerate(sorted({t for f in found for t in f}))}
    held = spark.sparkContext.broadcast(known)  # at most the bytes of a block of queries
    lists = cut(_postings(docs, id_col, text_col, held))
    totals = lists.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("words")).first()
    # one row for each term of the block
    df = {r["term"]: r["n"] for r in lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}
    weights = np.array([weight(totals["docs"], df.get(k, 0)) for k in range(len(known))], np.int64)
    queries = [np.array([known[t] for t in f], np.int64) for f in found]
    n, words = totals["docs"], max(1, totals["words"])
    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("score", T.LongType()), T.StructField("id", docs.schema[id_col].dataType)])
    return lists.mapInArrow(lambda batches: _ranked(batches, queries, weights, n, words, top, segment), schema)


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", top: int = TOP,
           segment: int = SEGMENT) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` best documents of each query, equal scores by ascending id."""
    asked = cut(queries.select(F.monotonically_increasing_id().alias("row"), F.col(query_id).alias("item_id"), F.col(query_text).alias("text")))
    total = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(whole("text"))), F.lit(0)).alias("size")).first()
    blocks = max(1, -(-total["n"] // BLOCK_ROWS), -(-total["size"] // BLOCK_BYTES))
    best = None
    for k in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k).orderBy("row").collect()
        if not rows and k + 1 < blocks:
            continue
        named = docs.sparkSession.createDataFrame([(n, r["row"]) for n, r in enumerate(rows)], "query long, row long")
        found = _block(docs, [r["text"] for r in rows], id_col, text_col, top, segment).join(F.broadcast(named), "query").select("row", "score", "id")
        best = found if best is None else best.union(found)
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.join(asked.drop("text"), "row").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")
