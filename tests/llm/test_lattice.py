import itertools

import numpy as np
import pytest

from veritab.llm import lattice

SCHEMA = "vec_id long, embedding array<float>, row string, node string"


def brute(rows, cosine=0.9):
    """Links, components and their rows by comparing all pairs."""
    def fine(v):
        return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    link = [[False] * n for _ in range(n)]
    for a, b in itertools.combinations(range(n), 2):
        u, v = rows[a][1], rows[b][1]
        if fine(u) and fine(v) and len(u) == len(v):
            u, v = np.array(u, np.float32).astype(float), np.array(v, np.float32).astype(float)
            link[a][b] = link[b][a] = u @ v / np.sqrt((u @ u) * (v @ v)) >= cosine
    root = list(range(n))
    for _ in range(n):
        for a in range(n):
            root[a] = min([root[a], *(root[b] for b in range(n) if link[a][b])])
    ids = {r: min((rows[a][0] for a in range(n) if root[a] == r and rows[a][0] is not None), default=None) for r in set(root)}
    return sorted(str((rows[a][0], int(sum(link[a])), ids[root[a]], rows[a][0] == ids[root[a]])) for a in range(n))


def got(df):
    return sorted(str((r["id"], r["n_links"], r["component_id"], r["kept"])) for r in df.collect())


def family(rng, n, noise, dim=16):
    base = rng.standard_normal(dim)
    base /= np.linalg.norm(base)
    return [base + noise * rng.standard_normal(dim) / np.sqrt(dim) for _ in range(n)]


def test_decoding_gives_the_nearest_lattice_point():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 8)) * 2
    p = lattice.decode(x)
    doubled = np.rint(2 * p)
    assert np.allclose(doubled, 2 * p) and ((doubled % 2 == 0).all(1) | (doubled % 2 == 1).all(1)).all() and (p.sum(1) % 2 == 0).all()
    near = lattice.neighbours()
    assert near.shape == (240, 8) and np.allclose((near ** 2).sum(1), 2)
    # a point is nearest if none of its neighbours is nearer
    d = ((x - p) ** 2).sum(1)
    assert (((x[:, None] - p[:, None] - near[None]) ** 2).sum(2) >= d[:, None] - 1e-9).all()


def test_signs_and_setting():
    rng = np.random.default_rng(1)
    u = rng.standard_normal((2000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    v = rng.standard_normal((2000, 64))
    v -= (u * v).sum(1)[:, None] * u
    v = 0.9 * u + np.sqrt(1 - 0.81) * v / np.linalg.norm(v, axis=1)[:, None]
    tables, depth, width = lattice.plan(50_000)
    a, b = lattice.cells(u, tables, depth, width), lattice.cells(v, tables, depth, width)
    shared = (a[:, :, None] == b[:, None, :]).any((1, 2))
    assert shared.mean() >= 0.9  # recall at the threshold itself
    apart = np.array([lattice._apart(x, y)[0, 0] for x, y in zip(lattice._signs(u)[:, None], lattice._signs(v)[:, None])])
    assert (apart <= lattice.link_bits(0.9)).all() and abs(apart.mean() - 18.4) < 0.5


def test_recall_and_precision_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [v for n, noise in ((40, 0.1), (30, 0.25), (30, 0.4), (20, 0.6), (2, 0.3), (2, 0.45)) for v in family(rng, n, noise, 32)]
    vectors += list(rng.standard_normal((150, 32)))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    found = {r["id"]: r for r in lattice.near_duplicates(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA), side=7).collect()}
    x = np.array([v for _, v in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    exact = link.sum(1)
    mine = np.array([found[k]["n_links"] for k in range(len(rows))])
    assert (mine <= exact).all() and mine.sum() >= 0.9 * exact.sum() and len(found) == len(rows)
    # components join nothing that links do not connect
    reach = np.linalg.matrix_power((link | np.eye(len(x), dtype=bool)).astype(float), 64) > 0
    assert all(reach[k, found[k]["component_id"]] for k in range(len(rows)))


def test_cases(spark):
    rng = np.random.default_rng(2)
    f = lambda v: [float(x) for x in v]
    a, b = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(10, f(a)), (3, f(a)), (None, f(a)), (3, f(a)), (7, f(2 * a)), (8, f(-a)), (20, f(b)), (21, f(b * 1e-20)), (22, None), (23, []), (24, [0.0] * 16), (25, [None, 1.0]),
            (26, [float("nan"), 1.0]), (27, [float("inf"), 1.0]), (None, None), (30, [1.0, 0.0]), (31, [1.0, 0.1]), (32, [1.0])]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    result = lattice.near_duplicates(df)
    assert got(result) == brute(rows)
    assert result.columns == ["row", "id", "n_links", "component_id", "kept"]
    assert lattice.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("stream", [4, 2048])
def test_large_cells_keep_all_members(stream, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(lattice, "STREAM", stream)
    rng = np.random.default_rng(3)
    signs = np.repeat(rng.integers(0, 1 << 62, (3, 2)), [6, 1, 1], axis=0)
    keys = np.array([1] * 8 + [2])
    signs = np.concatenate((signs, signs[:1]))
    made = [pa.RecordBatch.from_arrays([pa.array(keys[x:y]), pa.array(np.arange(x, y)), pa.array(signs[x:y, 0]), pa.array(signs[x:y, 1])], ["key", "node", "sign_a", "sign_b"]) for x, y in ((0, 3), (3, 9))]
    out = [r for b in lattice._met(iter(made), 10, 5) for r in b.to_pylist()]
    assert {r["node"] for r in out} == (set(range(8)) if stream == 4 else set(range(6)))
    assert all(r["hub"] == (0 if 0 < r["node"] < 6 else None) for r in out)


def test_hot_cells_are_dealt(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate([*family(rng, 60, 0.2), *family(rng, 25, 0.5), *rng.standard_normal((20, 16))])]
    df = spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)
    want = got(lattice.near_duplicates(df))
    monkeypatch.setattr(lattice, "STREAM", 5)
    assert got(lattice.near_duplicates(df, side=9)) == want
