"""Operator 7, n-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Equal sets are one class first (same size and two 64-bit sums over the set), so copies never
meet. Then, for a similarity of ``percent`` in 100:

*Light sets* (at most ``boundary()`` shingles). Two sets of ``n`` and ``m`` shingles link exactly
if they share a subset of ``need(n, m)`` shingles. A light set announces all subsets of each size
that a partner may need; whoever announces the same subset is linked, without a comparison, and
a star from each subset's smallest class keeps everything connected.

*Heavy sets.* Linked sets differ in at most ``D`` shingles, so if the hash space is cut into more
than ``D`` parts some part is the same in both. Inverted lists are kept on such parts (a part is
far more telling than one shingle, so common passages do not fill lists). Part counts go by size
class; a set enters its own class's lists and, where a smaller partner may be in the class below,
that one's. There are ``spare`` parts more than ``D + 1``, so linked sets share at least ``spare + 1``
of them, and each set may leave its ``spare`` longest lists: with lists in one order, by length and
key, the first that two linked sets share has ``spare`` shared ones after it and is left by neither.
Empty parts come last in that order. Entries are shuffled once, by key, and stream through their
task in order; only lists of two sets or more, a few in a hundred, leave it.
Lists are scanned in two steps instead of pairing their members:

1. every member is compared with one hub, the member that meets most others, and keeps its
   difference from the hub;
2. two members that are not both linked to the hub may still be linked with each other. Where a
   hub's members lie in several components, their differences from the hub are compared: in one
   task for each pair of blocks of at most ``SIDE`` members, by counting shared shingles with numpy. No pair
   leaves the task, only a forest of the links that join components.

The boundary is the largest size up to which announcing subsets costs less than entering lists
and comparing (``light_cost`` against ``heavy_cost``). No list is capped and nothing is dropped.

Defined cases: texts without words (null, empty, white space) have no shingles and link with
nothing; fewer words than a shingle has (``words``) are one shingle; rows that repeat an id are rows of their own;
null ids never name a component unless it has no other; an empty table gives no rows; columns
other than id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm import shingles
from veritab.llm.common import cut
from veritab.llm.graph import components, forest
from veritab.llm.shingles import U, mix

PERCENT = 90
WORDS = 3
CLASS_RATIO = 1.37
SPARE = 2
VERIFY = 2
BITS_A_SET = 16
SEEN = 1 << 20
SIDE = 1024
FEW = 24
COLUMNS = 4096


def need(n: int, m: int, percent: int = PERCENT) -> int:
    """Shared shingles that two sets of these sizes must have to link."""
    return -(-percent * (n + m) // (100 + percent))


def partners(n: int, percent: int = PERCENT) -> range:
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def light_cost(n: int, percent: int = PERCENT) -> int:
    """Subsets that a set of ``n`` announces."""
    return sum(comb(n, need(n, m, percent)) for m in partners(n, percent) if not n == m == need(n, m, percent))


def spare(most: int) -> int:
    """Parts beyond those that two sets with ``most`` differences need."""
    return SPARE + most // 10


def heavy_cost(n: int, percent: int = PERCENT) -> int:
    """Lists that a set of ``n`` enters, and the shingles moved to compare it once."""
    most = 2 * n * (100 - percent) // (100 + percent)
    return most + 1 + spare(most) + VERIFY * n


@lru_cache
def boundary(percent: int = PERCENT) -> int:
    n = 1
    while light_cost(n + 1, percent) <= heavy_cost(n + 1, percent):
        n += 1
    return n


@lru_cache
def classes(percent: int = PERCENT) -> np.ndarray:
    """Smallest sizes of the heavy classes; a partner is never more than one class away."""
    edges = [boundary(percent) + 1]
    while edges[-1] < 1 << 40:
        edges.append(int(edges[-1] * max(CLASS_RATIO, 100 / percent + 0.01)) + 1)
    return np.array(edges)


def differences(c: int, percent: int = PERCENT) -> int:
    """Shingles that linked sets can differ in, the smaller one being in class ``c``."""
    most = int(classes(percent)[c + 1]) - 1
    return (most + 100 * most // percent) * (100 - percent) // (100 + percent)


def parts_of(c: int, percent: int = PERCENT) -> int:
    """Parts for pairs whose smaller set is in class ``c``."""
    return differences(c, percent) + 1 + spare(differences(c, percent))


def _light_keys(s: np.ndarray, percent: int) -> np.ndarray:
    n, x, out = len(s), boundary(percent), []
    values = mix(s)
    for m in partners(n, percent):
        o = need(n, m, percent)
        if min(n, m) > x or o > min(n, m) or (o == n == m):
            continue
        tag = mix(np.array([min(n, m) * 4096 + max(n, m)], np.uint64))[0]
        gone = n - o
        sums = [values.sum(dtype=np.uint64) - values[list(c)].sum(dtype=np.uint64) for c in combinations(range(n), gone)] if gone else [values.sum(dtype=np.uint64)]
        out.append(mix(np.array(sums, np.uint64) ^ tag) & ~U(1) | U(n != m))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _heavy_keys(s: np.ndarray, percent: int) -> tuple[np.ndarray, list[int]]:
    """The lists of a set, and how many it may leave in its even and its odd class, which a key's last bit tells."""
    n, out, leave, edges = len(s), [], [0, 0], classes(percent)
    if n < edges[0]:
        return np.zeros(0, np.uint64), leave
    own = int(np.searchsorted(edges, n, "right")) - 1
    values = mix(s)
    for c in [own, own - 1] if own and n <= 100 * (int(edges[own]) - 1) // percent else [own]:
        k, free = parts_of(c, percent), spare(differences(c, percent))
        part = ((s >> U(32)) * U(k)) >> U(32)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        name = mix(part[first] * U(64) + U(c))
        keys = [mix(np.add.reduceat(values, first) + name)]
        if k - len(first) > free:  # two such sets might share nothing but empty parts
            empty = np.setdiff1d(np.arange(k, dtype=np.uint64), part[first])
            keys.append(mix(mix(empty * U(64) + U(c)) ^ U(0x5DEECE66D)))
        else:
            leave[c % 2] = free - (k - len(first))
        out += [x & ~U(1) | U(c % 2) for x in keys]
    return np.concatenate(out), leave


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    flat = _signed(np.concatenate(arrays)) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _sums(s: np.ndarray) -> tuple[int, int]:
    """Two numbers that, with the size, name the set."""
    return int(_signed(mix(s ^ U(0x1234567)).sum(dtype=np.uint64, keepdims=True))[0]), int(_signed(mix(s + U(0x89ABCDEF)).sum(dtype=np.uint64, keepdims=True))[0])


def _chunks(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def sketch(docs: DataFrame, id_col: str, text_col: str, percent: int, words: int) -> DataFrame:
    """``(row, id, n, s1, s2, light, heavy, leave)`` of each row.

    A set that the same task has met before has its ``heavy`` keys there and none here.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        with np.errstate(over="ignore"):
            for b in _chunks(batches):
                found = list(shingles.sets(b["text"].to_pylist(), words))
                sums = [_sums(s) for s in found]
                lists = [_heavy_keys(s, percent) for s in found]
                for k, name in enumerate(sums):
                    if name in seen:
                        lists[k] = lists[k][0][:0], lists[k][1]
                    seen.add(name)
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays(
                    [b["row"], b["id"], pa.array([len(s) for s in found], pa.int64()), pa.array([x for x, _ in sums], pa.int64()), pa.array([y for _, y in sums], pa.int64()),
                     _lists([_light_keys(s, percent) if len(s) <= 100 * boundary(percent) // percent else np.zeros(0, np.uint64) for s in found]),
                     _lists([x for x, _ in lists]), pa.array([x for _, x in lists], pa.list_(pa.int32()))],
                    ["row", "id", "n", "s1", "s2", "light", "heavy", "leave"],
                )

    kinds = {"n": T.LongType(), "s1": T.LongType(), "s2": T.LongType(), "light": T.ArrayType(T.LongType()), "heavy": T.ArrayType(T.LongType()), "leave": T.ArrayType(T.IntegerType())}
    schema = T.StructType([rows.schema["row"], rows.schema["id"], *[T.StructField(k, v) for k, v in kinds.items()]])
    return rows.mapInArrow(made, schema)


def _sets_of(docs: DataFrame, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """``(n, s1, s2, tokens)`` of the classes in ``wanted (n, s1, s2)``, and perhaps of some more.

    A bit map tells the scan which sets to give out; a join settles the rest. It has ``BITS_A_SET``
    bits for each wanted set, and between 128 KB and 8 MB.
    """
    size = 1 << min(26, max(20, (BITS_A_SET * wanted.count()).bit_length()))
    bits = wanted.selectExpr(f"cast(pmod(s1, {size}) div 32 as int) AS w", "shiftleft(cast(1 as bigint), cast(pmod(s1, 32) as int)) AS bit")
    rows = bits.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most size / 32 rows
    found = np.zeros(size // 32, np.uint32)
    found[rows["w"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    held = docs.sparkSession.sparkContext.broadcast(found)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in _chunks(batches):
                out = []
                for s in shingles.sets(b["text"].to_pylist(), words):
                    if len(s):
                        s1, s2 = _sums(s)
                        if int(held.value[s1 % size // 32]) >> (s1 % 32) & 1:
                            out.append((len(s), s1, s2, s))
                yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in out], pa.int64()) for k in range(3)), _lists([x[3] for x in out])], ["n", "s1", "s2", "tokens"])

    sets = docs.select(F.col(text_col).alias("text")).mapInArrow(made, "n long, s1 long, s2 long, tokens array<bigint>")
    return sets.groupBy("n", "s1", "s2").agg(F.first("tokens").alias("tokens"))


def _stars(entries: DataFrame) -> DataFrame:
    """``(a, b)``: each entry of ``(key, node, n)`` with the smallest node of its key.

    An odd key is a subset for two sizes: it links each set of one with each of the other, so it
    connects all of them if both sizes are there, and none if only one is.
    """
    hubs = entries.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("c"), F.min("n").alias("x"), F.max("n").alias("y"))
    hubs = hubs.filter("c > 1 AND (x < y OR pmod(key, 2) = 0)").select("key", "b")
    return entries.join(hubs, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted ``(key, s1)`` each different row once, where a key has several."""
    last: tuple[int, int] | None = None  # the row before
    shared = False  # whether its key has several, so that it is given out
    for b in batches:
        key, s1 = b["key"].to_numpy(), b["s1"].to_numpy()
        if last is not None:
            key, s1 = np.concatenate(([last[0]], key)), np.concatenate(([last[1]], s1))
        if not len(key):
            continue
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (s1[1:] != s1[:-1])))
        key, s1 = key[new], s1[new]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        several = size > 1
        several[0] |= shared
        out = np.repeat(several, size)
        if shared:
            out[0] = False  # given out with the batch before
        last, shared = (key[-1], s1[-1]), bool(several[-1])
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(s1[out])], ["key", "s1"])


def _hub_pairs(entries: DataFrame) -> DataFrame:
    """``(node, hub)``: each member of a list with the member that stays in most shared lists.

    Of ``entries (key, node, leave)`` each node leaves its ``leave`` longest lists of either class.
    """
    shared = entries.join(entries.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1"), "key").repartition("node")
    longest = Window.partitionBy("node", F.pmod("key", F.lit(2))).orderBy(F.col("c").desc(), F.col("key").desc())
    stay = shared.withColumn("nth", F.row_number().over(longest)).filter("nth > leave")
    stay = cut(stay.select("key", "node", F.count("*").over(Window.partitionBy("node")).alias("degree")))
    rank = F.struct("degree", (-F.col("node")).alias("minus"))
    hubs = stay.groupBy("key").agg((-F.max(rank)["minus"]).alias("hub"))
    return stay.join(hubs, "key").filter("node <> hub").select("node", "hub").distinct()


def links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """Rows ``(row, id, n, node)`` with the class each belongs to (null: none), and edges ``(a, b)`` between classes.

    The edges connect exactly the classes that links connect.
    """
    rows = cut(sketch(docs, id_col, text_col, percent, words))
    named = rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min("row").alias("node"), F.min("leave").alias("leave"))  # equal sets leave alike
    named = cut(named)
    leaders = rows.filter(F.size("light") > 0).select("row", "n", "light").join(named.select("node"), F.col("row") == F.col("node"))
    light = _stars(leaders.select(F.explode("light").alias("key"), "node", "n"))
    entries = rows.select(F.explode("heavy").alias("key"), "s1").repartition("key").sortWithinPartitions("key", "s1")
    entries = entries.mapInArrow(_shared, "key long, s1 long").join(named.select("s1", "node", "leave"), "s1")
    entries = cut(entries.selectExpr("key", "node", "leave[pmod(key, 2)] AS leave"))
    pairs = cut(_hub_pairs(entries))
    named = named.drop("leave")

    wanted = pairs.select("node").union(pairs.select("hub")).distinct().join(named, "node")
    wanted = cut(wanted)
    sets = cut(_sets_of(docs, text_col, wanted, words).join(wanted, ["n", "s1", "s2"]).select("node", "n", "tokens"))
    hubs = sets.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("tokens").alias("hub_tokens"))
    apart = F.concat(F.array_except("tokens", "hub_tokens"), F.array_except("hub_tokens", "tokens"))
    far = pairs.join(sets, "node").join(hubs, "hub").select("hub", "node", "n", "hub_n", apart.alias("delta"))
    a, b = 100 + percent, 100 - percent
    far = far.withColumn("d", F.size("delta").cast("long"))
    far = cut(far.withColumn("linked", a * F.col("d") <= b * (F.col("n") + F.col("hub_n"))).drop("hub_n"))
    edges = cut(light.union(far.filter("linked").select(F.col("node").alias("a"), F.col("hub").alias("b"))).distinct())
    more = _around_hubs(far, components(edges), percent)
    row_class = rows.select("row", "id", "n", "s1", "s2").join(named, ["n", "s1", "s2"], "left")
    return row_class.select("row", "id", "n", "node"), edges.union(more)


def _overlaps(tokens: list[np.ndarray], mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """How many tokens each of the sets ``mine`` (places in ``tokens``) shares with each of ``theirs``.

    Tokens of one set do not matter. Of those of a few sets the pairs are counted, the
    others are multiplied as matrices, some thousand tokens at a time.
    """
    row = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    flat = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
    x, y = np.full(len(tokens), -1), np.full(len(tokens), -1)
    x[mine], y[theirs] = np.arange(len(mine)), np.arange(len(theirs))
    out = np.zeros((len(mine), len(theirs)), np.float32)
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    begin = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1]))) if len(flat) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(flat)))
    few = np.repeat(size <= FEW, size)
    token, member = flat[few], row[few]
    for step in range(1, min(FEW, len(token))):
        same = token[step:] == token[:-step]
        if not same.any():
            break
        p, q = member[:-step][same], member[step:][same]
        for u, v in ((p, q), (q, p)):
            fits = (x[u] >= 0) & (y[v] >= 0)
            np.add.at(out, (x[u[fits]], y[v[fits]]), 1)
    place = np.repeat(np.cumsum(size > FEW) - 1, size)[~few]
    member = row[~few]
    for at in range(0, int((size > FEW).sum()), COLUMNS):
        here = (place >= at) & (place < at + COLUMNS)
        held = np.zeros((len(tokens), min(COLUMNS, int((size > FEW).sum()) - at)), np.float32)
        held[member[here], place[here] - at] = 1
        out += held[mine] @ held[theirs].T
    return out


def _linked(name: tuple, part: pa.Table, percent: int) -> pa.Table:
    """``(a, b)``: a forest of the links between members of different components in a pair of blocks of one hub."""
    a, b = 100 + percent, 100 - percent
    i, j = name[1].as_py(), name[2].as_py()
    side = part["side"].to_numpy()
    node, n, d, root = (part[c].to_numpy() for c in ("node", "n", "d", "root"))
    near = part["linked"].to_numpy()
    tokens = [x.values.to_numpy() for x in part["delta"]]
    mine, theirs = np.flatnonzero(side == i), np.flatnonzero(side == j)
    none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    if not len(mine) or not len(theirs):
        return none
    shared = _overlaps(tokens, mine, theirs)
    apart = d[mine][:, None] + d[theirs][None, :] - 2 * shared
    hit = (a * apart <= b * (n[mine][:, None] + n[theirs][None, :])) & (root[mine][:, None] != root[theirs][None, :]) & ~(near[mine][:, None] & near[theirs][None, :])
    x, y = np.nonzero(hit)
    if not len(x):
        return none
    ends, least = forest(node[mine][x], node[theirs][y])
    return pa.table({"a": pa.array(ends), "b": pa.array(least)})


def _around_hubs(far: DataFrame, roots: DataFrame, percent: int, side: int = SIDE) -> DataFrame:
    """Links ``(a, b)`` between members of one hub that are in different components so far.

    Members are compared by their differences from the hub. A hub of more than ``side`` open
    members has them in blocks, and the pairs of its blocks are dealt over tasks; pairs of members stay there.
    """
    named = roots.withColumnsRenamed({"node": "node_", "root": "root_"})
    slim = far.select("hub", "node").join(named, F.col("node") == F.col("node_"), "left").select("hub", "node", F.coalesce("root_", "node").alias("root"))
    slim = cut(slim)
    open_ = slim.groupBy("hub").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / side).cast("int").alias("blocks")).filter("x < y").select("hub", "blocks")
    members = slim.join(open_, "hub").withColumn("side", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("hub", "node", "root", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    members = members.join(far.filter("d > 0"), ["hub", "node"]).select("hub", "i", "j", "side", "node", "n", "d", "root", "linked", "delta")
    return members.groupBy("hub", "i", "j").applyInArrow(lambda name, part: _linked(name, part, percent), "a long, b long").filter("a <> b").distinct()


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, words: int = WORDS) -> DataFrame:
    """``(row, id, n_shingles, component_id)`` of each row: the smallest id that its links reach."""
    rows, edges = links(docs, id_col, text_col, percent, words)
    roots = components(edges).withColumnsRenamed({"node": "node_"})
    rows = cut(rows.join(roots, F.col("node") == F.col("node_"), "left").select("row", "id", "n", F.coalesce("root", "node").alias("group")))
    least = rows.filter("group is not null").groupBy("group").agg(F.min("id").alias("least"))
    return rows.join(least, "group", "left").select(
        "row", "id", F.col("n").alias("n_shingles"), F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id")
    )
