"""Operator 13, embedding near-dedup by lattice hashing.

1. *Classes.* Rows with equal vectors are one class with a number of copies, so copies never meet.
2. *Cells.* A table is a random projection to ``depth`` times eight dimensions, divided by ``width``
   and decoded to points of the lattice E8. A class enters the cell of its point and those of the
   ``PROBES`` lattice neighbours nearest to its projection, in each of ``tables`` tables. ``plan``
   takes depth and width by cost for the number of classes, and as many tables as give a pair at
   the threshold the chance ``RECALL`` to share a cell; pairs above it have a higher one. The chance is measured on
   pairs of exactly that cosine, and is the same for any data, as projections are isotropic.
3. *Sketches.* Only a 128-bit sign sketch travels with a class into its cells. Classes that are near no
   other in a cell, by sketches that differ in at most ``link_bits`` signs, leave it; a pair at
   the threshold differs in more with a chance of about one in a million. Cells of more than ``STREAM`` members pass by
   without holding them and keep all. The few cells that may hold a large share of all rows, at most
   ``HOT_CELLS``, are found by a count and dealt over all tasks.
4. *Balls.* In every cell one member is the hub, by a hash. A class joins the ball of the first hub
   that its sketch is close to, if it lies within half the threshold's angle. Two members of a ball are
   within the whole angle, so they link without being compared: a family of any size costs one comparison a member.
5. *Verification.* Cells whose members are all of one ball are done. In the others members of
   different balls are compared in double precision, as products of matrices of at most ``SIDE``
   rows; a larger cell is cut into blocks and its pairs of blocks are dealt over tasks. A pair
   counts in the least cell that it shares, so it counts once. Pairs never leave a task: it gives
   each class's number of links and a spanning forest of the links.

No cell is capped, nothing is sampled. Cosines below the threshold never link.

Defined cases: vectors that are null, empty, zero or hold a null or non-finite component link with nothing and
keep their own id; vectors of different lengths never link; rows that repeat an id are rows of their
own; a null id names a component only if it has no other; an empty table gives no rows; other
columns are left out.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm.common import cut
from veritab.llm.graph import components, forest
from veritab.llm.shingles import U, mix

COSINE = 0.9
RECALL = 0.93
PROBES = 5
SIDE = 512
STREAM = 2048
HOT_CELLS = 10_000
SIGNS = 128
TRIALS = 6000
WIDTHS = (0.7, 0.8, 0.9, 1.0)
EDGE = 1e-9  # a ball is that much smaller than it could be, for rounding


@lru_cache
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    two = [(i, a, j, b) for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    whole = np.zeros((len(two), 8))
    for row, (i, a, j, b) in zip(whole, two, strict=True):
        row[i], row[j] = a, b
    half = np.array([s for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0])
    return np.concatenate((whole, half))


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(1) % 2)
    off = x[odd] - near[odd]
    worst = np.abs(off).argmax(1)
    near[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8: even whole coordinates, or those moved by one half each."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def _projection(table: int, block: int, dim: int) -> np.ndarray:
    return np.random.default_rng([table, block, dim]).standard_normal((dim, 8))


def _name(points: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit name of each lattice point, through its doubled coordinates."""
    doubled = np.rint(2 * points).astype(np.int64).view(np.uint64)
    out = np.full(len(points), salt, np.uint64)
    for k in range(8):
        out = mix(out * U(0x9E3779B97F4A7C15) + doubled[:, k])
    return out


def cells(unit: np.ndarray, tables: int, depth: int, width: float, probes: int = PROBES) -> np.ndarray:
    """Names of the cells of each vector, ``1 + depth * probes`` for each table, those of a table side by side."""
    out = []
    dim = unit.shape[1]
    with np.errstate(over="ignore"):
        for t in range(tables):
            own, near = [], []
            for d in range(depth):
                x = unit @ _projection(t, d, dim) / width
                point = decode(x)
                own.append(_name(point, t * 64 + d))
                close = np.argpartition(-(x - point) @ neighbours().T, probes, axis=1)[:, :probes]
                near.append([_name(point + neighbours()[close[:, p]], t * 64 + d) for p in range(probes)])
            join = lambda parts: mix(sum((mix(p + U(k)) for k, p in enumerate(parts)), np.zeros(len(unit), np.uint64)) + U(dim))
            out.append(join(own))
            out += [join([*own[:d], other, *own[d + 1:]]) for d in range(depth) for other in near[d]]
    return np.stack(out, 1).view(np.int64)


def _meet(cosine: float, depth: int, width: float, trials: int = TRIALS) -> float:
    """The chance that vectors of this cosine share a cell of one table, over several tables."""
    rng, dim, found = np.random.default_rng(13), 64, []
    for t in range(6):
        u, v = rng.standard_normal((2, trials // 6, dim))
        u /= np.linalg.norm(u, axis=1)[:, None]
        v -= (u * v).sum(1)[:, None] * u
        v = cosine * u + np.sqrt(1 - cosine * cosine) * v / np.linalg.norm(v, axis=1)[:, None]
        a, b = (cells(np.concatenate((u, v)), t + 1, depth, width)[:, -(1 + depth * PROBES):].reshape(2, len(u), -1))
        found.append((a[:, :, None] == b[:, None, :]).any((1, 2)).mean())
    return float(np.mean(found))


@lru_cache
def _chances(cosine: float) -> list[tuple[int, float, int, float]]:
    """``(depth, width, tables, chance that unlike vectors share a cell)`` of each setting."""
    out = []
    for depth, width in itertools.product((1, 2), WIDTHS):
        meet = _meet(cosine, depth, width)
        if meet > 0.02:
            tables = int(np.ceil(np.log(1 - RECALL) / np.log(1 - meet)))
            # unlike: a cosine of 0.2; of depth 2 both halves agree, which is too rare to be counted
            out.append((depth, width, tables, max(_meet(0.2, 1, width, 24_000), 1e-6) ** depth))
    return out


def plan(classes: int, cosine: float = COSINE) -> tuple[int, int, float]:
    """``(tables, depth, width)`` that cost least for so many classes: cells entered, and unlike pairs compared."""
    cost = lambda s: s[2] * (1 + s[0] * PROBES + classes * s[3] / 8)
    depth, width, tables, _ = min(_chances(cosine), key=cost)
    return tables, depth, width


def _usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _unit(x: np.ndarray) -> np.ndarray:
    """The vectors at length 1, in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1)[:, None]
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(lists: pa.Array) -> np.ndarray:
    return _unit(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1))


def _same_length(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = b[column].value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(sizes):
        yield b if len(b) == (sizes == n).sum() else b.filter(pa.array(sizes == n))


def _signs(unit: np.ndarray) -> np.ndarray:
    """Sides of ``SIGNS`` random planes, as two 64-bit numbers a vector."""
    planes = np.random.default_rng([64, unit.shape[1]]).standard_normal((unit.shape[1], SIGNS))
    return np.packbits(unit @ planes > 0, axis=1).view(np.int64)


def link_bits(cosine: float) -> int:
    """Signs that a pair at the threshold differs in, and five standard deviations more."""
    share = np.arccos(cosine) / np.pi
    return int(SIGNS * share + 5 * np.sqrt(SIGNS * share * (1 - share)))


def ball_bits(cosine: float) -> int:
    """Signs that a pair of half the threshold's angle differs in, and one standard deviation more."""
    share = np.arccos(cosine) / 2 / np.pi
    return int(SIGNS * share + np.sqrt(SIGNS * share * (1 - share)))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a[:, None, :] ^ b[None, :, :]).view(np.uint64)).sum(2)  # of signed numbers it counts the absolute value


def _fixed_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def entries(classes: DataFrame, setting: tuple[int, int, float]) -> DataFrame:
    """``(node, vector, keys, sign_a, sign_b)`` of ``classes (node, vector)``: the cells they enter, and their sketch."""
    tables, depth, width = setting

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                for b in _same_length(whole.slice(at, 1000), "vector"):
                    unit = _matrix(b["vector"])
                    signs = _signs(unit)
                    columns = [b["node"], b["vector"], _fixed_lists(cells(unit, tables, depth, width)), pa.array(signs[:, 0]), pa.array(signs[:, 1])]
                    yield pa.RecordBatch.from_arrays(columns, ["node", "vector", "keys", "sign_a", "sign_b"])

    rows = classes.select("node", "vector")
    longs = [T.StructField(x, T.LongType()) for x in ("sign_a", "sign_b")]
    return rows.mapInArrow(made, T.StructType([*rows.schema.fields, T.StructField("keys", T.ArrayType(T.LongType())), *longs]))


def _met(sorted_cells: Iterator[pa.RecordBatch], link: int, ball: int) -> Iterator[pa.RecordBatch]:
    """``(key, node, hub)`` of the members of each cell that are near another one; the hub is the cell's first."""
    key, hub, held = None, None, []  # held: pieces (node, signs) of the cell while it is small
    size = 0

    def rows(at, node, signs, near) -> pa.RecordBatch:
        close = _apart(signs, hub[1])[:, 0] <= ball
        hubs = pa.array(np.full(len(node), hub[0][0]), mask=~close | (node == hub[0][0]))
        made = pa.RecordBatch.from_arrays([pa.array(np.full(len(node), at)), pa.array(node), hubs], ["key", "node", "hub"])
        return made if near is None else made.filter(pa.array(near))

    def close_cell() -> Iterator[pa.RecordBatch]:
        if held and size > 1:
            node, signs = (np.concatenate([h[k] for h in held]) for k in (0, 1))
            near = _apart(signs, signs) <= link
            np.fill_diagonal(near, False)
            if near.any():
                yield rows(key, node, signs, near.any(1))

    for b in sorted_cells:
        keys, nodes = b["key"].to_numpy(), b["node"].to_numpy()
        signs = np.stack((b["sign_a"].to_numpy(), b["sign_b"].to_numpy()), 1)
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if keys[x] != key:
                yield from close_cell()
                key, held, size = keys[x], [], 0
                hub = nodes[x:x + 1], signs[x:x + 1]
            size += y - x
            if size <= STREAM:
                held.append((nodes[x:y], signs[x:y]))
                continue
            for node, sign in [*held, (nodes[x:y], signs[x:y])]:
                yield rows(key, node, sign, None)
            held = []
    yield from close_cell()


def _neighbours(entered: DataFrame, n: int, cosine: float) -> DataFrame:
    """``(key, node, hub)``: members of cells that may link within them, and their cell's hub where they are close to it."""
    keys = entered.select("node", "sign_a", "sign_b", F.explode(F.array_distinct("keys")).alias("key"))
    hot = max(STREAM, n // HOT_CELLS)  # so at most HOT_CELLS cells hold more entries
    found = [r["key"] for r in keys.groupBy("key").count().filter(F.col("count") > hot).select("key").collect()]
    kind = "key long, node long, hub long"
    link, ball = link_bits(cosine), ball_bits(cosine)
    cold = keys
    if found:
        large = F.broadcast(entered.sparkSession.createDataFrame([(k,) for k in found], "key long"))
        cold = keys.join(large, "key", "left_anti")
    cold = cold.select("key", "node", "sign_a", "sign_b").repartition("key").sortWithinPartitions("key", F.xxhash64("node"), "node")
    out = cold.mapInArrow(lambda batches: _met(batches, link, ball), kind)
    if found:
        held = keys.join(large, "key")
        rank = F.struct(F.xxhash64("node").alias("hash"), "node", "sign_a", "sign_b")
        hubs = held.groupBy("key").agg(F.min(rank).alias("first"))  # one row for each of the few cells
        apart = F.bit_count(F.col("sign_a").bitwiseXOR(F.col("first.sign_a"))) + F.bit_count(F.col("sign_b").bitwiseXOR(F.col("first.sign_b")))
        hub = F.when((apart <= ball) & (F.col("node") != F.col("first.node")), F.col("first.node"))
        out = out.union(held.join(F.broadcast(hubs), "key").select("key", "node", hub.alias("hub")))
    return out


def _balls(near: DataFrame, entered: DataFrame, cosine: float) -> DataFrame:
    """``(node, ball)`` of the classes that lie in another one's ball."""
    least = F.min(F.struct(F.xxhash64("hub").alias("hash"), "hub"))
    pairs = near.filter("hub IS NOT NULL").groupBy("node").agg(least.alias("x")).select("node", "x.hub", "x.hash").filter(F.col("hash") < F.xxhash64("node"))
    mine, theirs = entered.select("node", "vector"), entered.select(F.col("node").alias("hub"), F.col("vector").alias("hub_vector"))
    double = lambda x: x.cast("double")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: double(x) * double(y)), F.lit(0.0), lambda s, x: s + x)
    cos = dot("vector", "hub_vector") / F.sqrt(dot("vector", "vector") * dot("hub_vector", "hub_vector"))
    inside = float(np.sqrt((1 + cosine) / 2) + EDGE)  # the cosine of half the angle
    return pairs.join(mine, "node").join(theirs, "hub").filter((F.size("vector") == F.size("hub_vector")) & (cos >= inside)).select("node", F.col("hub").alias("ball"))


def _once(a_keys: np.ndarray, b_keys: np.ndarray, key: int, per_table: int) -> np.ndarray:
    """Whether ``key`` is the least cell that each pair of rows shares."""
    tables = a_keys.shape[1] // per_table
    a, b = a_keys.reshape(-1, tables, per_table, 1), b_keys.reshape(-1, tables, 1, per_table)
    shared = np.where(a == b, a, np.iinfo(np.int64).max)
    return shared.min((1, 2, 3)) == key


def _compared(part: pa.RecordBatch, name: tuple[int, int, int], cosine: float, per_table: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(nodes, links, roots)`` of the members of one pair of blocks that link across balls, for each length of vectors."""
    key, i, j = name
    out = []
    for same in _same_length(part, "vector"):
        unit, side = _matrix(same["vector"]), same["side"].to_numpy()
        node, ball, copies = (same[c].to_numpy() for c in ("node", "ball", "copies"))
        mine, theirs = np.flatnonzero(side == i), np.flatnonzero(side == j)
        hit = (unit[mine] @ unit[theirs].T >= cosine) & (ball[mine][:, None] != ball[theirs][None, :])
        x, y = np.nonzero(np.triu(hit, 1) if i == j else hit)
        x, y = mine[x], theirs[y]
        if len(x):
            keys = same["keys"].flatten().to_numpy().reshape(len(same), -1)
            first = np.concatenate([_once(keys[x[k:k + 4096]], keys[y[k:k + 4096]], key, per_table) for k in range(0, len(x), 4096)])
            x, y = x[first], y[first]
        if len(x):
            nodes, roots = forest(node[x], node[y])
            links = np.zeros(len(nodes), np.int64)
            np.add.at(links, np.searchsorted(nodes, node[x]), copies[y])
            np.add.at(links, np.searchsorted(nodes, node[y]), copies[x])
            out.append((nodes, links, roots))
    return out


def _verify(members: DataFrame, cosine: float, per_table: int) -> DataFrame:
    """``(node, links, root)`` from ``members (key, i, j, side, node, ball, copies, vector, keys)``, one group for a pair of blocks.

    Groups stream through their task in order; at most two blocks are held.
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, done, size = None, [], [], 0

        def close() -> None:
            nonlocal size
            if held:
                part = held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                if part.num_rows > 1:
                    found = _compared(part, now, cosine, per_table)
                    done.extend(found)
                    size += sum(len(f[0]) for f in found)

        def ready() -> pa.RecordBatch:
            columns = [pa.array(np.concatenate([d[k] for d in done])) for k in range(3)]
            return pa.RecordBatch.from_arrays(columns, ["node", "links", "root"])

        for b in batches:
            key, i, j = (b[c].to_numpy() for c in ("key", "i", "j"))
            if not len(key):
                continue
            cuts = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]), [True])))
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                name = int(key[x]), int(i[x]), int(j[x])
                if name != now:
                    close()
                    now, held = name, []
                held.append(b.slice(x, y - x))
            if size > 10_000:
                yield ready()
                done, size = [], 0
        close()
        if done:
            yield ready()

    group = ["key", "i", "j"]
    return members.repartition(*group).sortWithinPartitions(*group).mapInArrow(made, "node long, links long, root long")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, side: int = SIDE) -> DataFrame:
    """``(row, id, n_links, component_id, kept)`` of each row."""
    v = F.col(vector_col)
    named = cut(rows.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.when(_usable(v), v).alias("vector")))
    classes = cut(named.filter("vector IS NOT NULL").groupBy("vector").agg(F.min("row").alias("node"), F.count("*").alias("copies")))
    setting = plan(classes.count(), cosine)
    per_table = 1 + setting[1] * PROBES
    entered = cut(entries(classes, setting))
    near = cut(_neighbours(entered, classes.count() * per_table * setting[0], cosine))
    named_ = lambda df: df.withColumnRenamed("node", "node_")
    placed = classes.select("node", "copies").join(named_(_balls(near, entered, cosine)), F.col("node") == F.col("node_"), "left")
    placed = cut(placed.select("node", F.coalesce("ball", "node").alias("ball"), "copies"))

    at = near.select("key", "node").join(placed, "node")
    mixed = at.groupBy("key").agg(F.min("ball").alias("x"), F.max("ball").alias("y"), F.count("*").alias("n")).filter("x < y")
    mixed = mixed.select("key", F.ceil(F.col("n") / side).cast("int").alias("blocks"))
    members = at.join(mixed, "key").withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("key", "node", "ball", "copies", "side", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"))
    members = members.join(entered.select("node", "vector", "keys"), "node")
    found = cut(_verify(members, cosine, per_table))

    edges = placed.filter("node <> ball").select(F.col("node").alias("a"), F.col("ball").alias("b")).union(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    in_ball = placed.groupBy("ball").agg(F.sum("copies").alias("in_ball"))
    more = found.groupBy("node").agg(F.sum("links").alias("more"))
    links = placed.join(in_ball, "ball").join(named_(more), F.col("node") == F.col("node_"), "left")
    roots = named_(components(edges))
    links = links.select("node", (F.col("in_ball") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    links = cut(links.join(roots, F.col("node") == F.col("node_"), "left").select("node", "n_links", F.coalesce("root", "node").alias("root")))

    of_class = classes.select("vector", F.col("node").alias("class_node"))
    joined = named.join(of_class, "vector", "left").join(links, F.col("class_node") == F.col("node"), "left").select("row", "id", "n_links", "root")
    joined = cut(joined)
    least = joined.filter("root IS NOT NULL").groupBy("root").agg(F.min("id").alias("least"))
    component = F.when(F.col("root").isNull(), F.col("id")).otherwise(F.col("least"))
    return joined.join(least, "root", "left").select(
        "row", "id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept")
    )
