import inspect
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from veritab.llm import common, ngramjoin, shingles
from veritab.llm.graph import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def set_of(text, words=3):
    w = (text or "").encode().translate(_LOWER).split()
    return frozenset(zip(*(w[k:] for k in range(words)))) if len(w) >= words else frozenset([tuple(w)] if w else [])


def brute(rows, percent=90, words=3):
    sets = [set_of(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for x in range(len(rows)):
        groups[root(x)].append(rows[x][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return sorted((str(rows[x][0]), len(sets[x]), str(least[root(x)])) for x in range(len(rows)))


def word(r):
    return "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        k = r.randrange(len(words))
        words[k:k + 1] = r.choice([[word(r)], [], [words[k], word(r)]])
    return words


@pytest.mark.parametrize(("percent", "words"), [(90, 3), (80, 5)])
def test_equals_brute_force_on_dense_near_copies(spark, percent, words):
    r = random.Random(7)
    rows = []
    for size in (4, 9, 11, 18, 20, 21, 23, 24, 30, 60, 150, 400):
        base = [word(r) for _ in range(size)]
        for k in range(24):
            rows.append((len(rows), " ".join(edited(r, base, k % 6))))
        rows.append((len(rows), " ".join(base).upper()))
        rows.append((len(rows), "\n".join(base)))
    # no original here: a second centre that most variants are near to, away from the first
    centre = [word(r) for _ in range(200)]
    for k in range(40):
        rows.append((len(rows), " ".join(edited(r, centre, 2 + k % 4))))
    rows += [(None, rows[5][1]), (None, "nothing like it at all"), (3, None), (8, ""), (8, " \n "), (9, "one"), (900, "ONE"), (10, "two words"), (11, "two  words"), (12, "x" * 4000)]
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, node long").repartition(4)
    got = ngramjoin.join(df, percent=percent, words=words).collect()
    assert sorted((str(g["id"]), g["n_shingles"], str(g["component_id"])) for g in got) == brute(rows, percent, words)


def test_a_far_member_meets_one_that_the_hub_links(spark):
    """Of the far member's 12 differences only 2 are shared, and both are more frequent than the rest."""
    near, far_off = [1, 2], [1, 2, *range(10, 20)]
    rows = [(0, 1, 100, near, 2, True), (0, 2, 100, far_off, 12, False)]
    far = spark.createDataFrame(rows, "hub long, node long, n long, delta array<long>, d long, linked boolean")
    roots = spark.createDataFrame([(0, 0), (1, 0)], "node long, root long")
    assert [tuple(r) for r in ngramjoin._around_hubs(far, roots, 90).collect()] in ([(1, 2)], [(2, 1)])


@pytest.mark.parametrize("p", [90, 80])
def test_costs_choose_the_boundary(p):
    x = ngramjoin.boundary(p)
    assert ngramjoin.light_cost(x, p) <= ngramjoin.heavy_cost(x, p) and ngramjoin.light_cost(x + 1, p) > ngramjoin.heavy_cost(x + 1, p)
    edges = ngramjoin.classes(p)
    for n in (x + 1, 57, 999):  # a partner is in the same or the next class, and differs in fewer parts than there are
        for m in (m for m in ngramjoin.partners(n, p) if m >= n):
            a, b = (int(np.searchsorted(edges, v, "right")) - 1 for v in (n, m))
            assert b - a <= 1 and n + m - 2 * ngramjoin.need(n, m, p) <= ngramjoin.differences(a, p) < ngramjoin.parts_of(a, p)


@pytest.mark.parametrize("side", [2, 7, 1024])
def test_members_around_a_hub_are_compared_in_blocks(spark, side, monkeypatch):
    r = random.Random(side)
    hub = set(range(1000, 1100))
    sets = {}
    for k in range(40):  # three families around one hub, far from it, and loners
        own = hub - set(r.sample(sorted(hub), 30)) if k < 3 else set(sets[k % 3]) if k < 34 else set(range(5000 + 100 * k, 5100 + 100 * k))
        sets[k] = own ^ set(r.sample(range(2000, 2040), r.randrange(6)))
    rows = [(0, k, len(s), sorted(s ^ hub), len(s ^ hub), 190 * len(s ^ hub) <= 10 * (len(s) + 100)) for k, s in sets.items()]
    far = spark.createDataFrame(rows, "hub long, node long, n long, delta array<long>, d long, linked boolean")
    got = ngramjoin._around_hubs(far, spark.createDataFrame([], "node long, root long"), 90, side)
    want = [(x, y) for x in sets for y in range(x) if 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y])]
    both = [sorted(map(tuple, components(spark.createDataFrame(e, "a long, b long")).collect())) for e in ([tuple(e) for e in got.collect()], want)]
    assert both[0] == both[1]


def test_overlaps_count_shared_tokens(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(ngramjoin, "FEW", 3)
    monkeypatch.setattr(ngramjoin, "COLUMNS", 4)
    tokens = [np.unique(rng.integers(0, 60, rng.integers(0, 30))) for _ in range(25)]
    for mine, theirs in ((np.arange(25), np.arange(25)), (np.arange(0, 25, 2), np.arange(1, 25, 2))):
        want = [[len(np.intersect1d(tokens[x], tokens[y])) if x != y else got for y, got in zip(theirs, line)] for x, line in zip(mine, ngramjoin._overlaps(tokens, mine, theirs))]
        assert (np.array(want) == ngramjoin._overlaps(tokens, mine, theirs)).all()


def test_only_lists_of_several_sets_leave_the_shuffle():
    r = random.Random(4)
    rows = sorted((r.randrange(40), r.randrange(3)) for _ in range(90))
    want = sorted({x for x in rows if len({y for k, y in rows if k == x[0]}) > 1})
    for size in (1, 2, 7, 90):
        cut = [pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows[i:i + size]], pa.int64()) for k in (0, 1)], ["key", "s1"]) for i in range(0, 90, size)]
        assert [tuple(x.values()) for b in ngramjoin._shared(iter(cut)) for x in b.to_pylist()] == want


def test_long_texts_are_cut_between_words(monkeypatch):
    r = random.Random(1)
    texts = [" ".join(word(r) for _ in range(n)) for n in (3, 400, 900)] + ["y" * 3000 + " a b c", None]
    whole = [s.tolist() for s in shingles.sets(texts)]
    monkeypatch.setattr(shingles, "BLOCK", 500)
    assert [s.tolist() for s in shingles.sets(texts)] == whole and [len(s) for s in whole] == [len(set_of(t)) for t in texts]


def test_empty_table(spark):
    assert ngramjoin.join(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 140)] + [(7, k) for k in range(8, 30)] + [(50, 50), (60, 61), (61, 60)]
    got = {(r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(k, 100) for k in range(100, 141)} | {(k, 7) for k in range(7, 30)} | {(60, 60), (61, 60)}


def test_the_join_leaves_the_garbage_collector_alone():
    for module in (common, ngramjoin):
        source = inspect.getsource(module)
        assert "_jvm" not in source and "gc.collect" not in source


def test_star_rounds_over_few_edges_run_in_few_tasks(spark):
    """Each task of each shuffle writes files of its own, however few rows it has."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "64")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        path = spark.range(40, numPartitions=64).selectExpr("id AS a", "id + 1 AS b")
        found = components(path.union(path.selectExpr("a + 100 AS a", "b + 100 AS b")))
        assert found.rdd.getNumPartitions() <= 4
        assert {(r.node, r.root) for r in found.collect()} == {(n + s, s) for n in range(41) for s in (0, 100)}
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
