"""Positions, fair shares and borrowed rows against plain definitions."""

import random

import pytest

from pyspark.sql import functions as F

from veritab.operators import first as O, guards as G, pack as P


def test_positions_with_a_hot_key_sparse_ordinals_and_nulls(spark):
    rng = random.Random(1)
    rows = [(k, o) for k in ("a", "b", None) for o in rng.sample(range(500), 90)] + [("hot", rng.randrange(1 << 60)) for _ in range(1500)] + [("a", None), (None, None)]
    df = spark.createDataFrame(rows, "k string, ord long")
    placed = O.previous_value(O.with_position(df, ["k"], "ord", width=16), ["k"], "ord", "before", width=7).collect()
    got = {(r.k, r.ord): (r.pos, r.before) for r in placed}
    assert len(placed) == len(rows)
    for k in ("a", "b", None, "hot"):
        ords = sorted(o for kk, o in rows if kk == k and o is not None)
        for i, o in enumerate(ords):
            assert got[k, o] == (i + 1, ords[i - 1] if i else None)
    assert got["a", None][0] == 91 and got[None, None][0] == 91
    firsts = O.mark_first(df, ["k"], ["ord"]).filter("is_first").collect()
    assert len(firsts) == 4


def test_buckets_are_even_however_ordinals_are_spread(spark):
    """Most ids from 0 on, some a billion further, some beyond 2^53: no bucket gets long and none merge."""
    rows = [("hot", k) for k in range(6000)] + [("hot", 10**9 + k) for k in range(600)] + [("hot", 2**60 + k) for k in range(64)] + [("cold", k) for k in range(50)] + [("hot", None)] * 3
    df = spark.createDataFrame(rows, "k string, ord long").repartition(5)
    hot, most = O._hot_keys(df, ["k"], 100)
    assert [r.k for r in hot.collect()] == ["hot"] and most == 6667
    sizes = [r["count"] for r in O._in_buckets(df, ["k"], "ord", hot, most, 100).groupBy("_b").count().collect()]
    assert sum(sizes) == 6667 and max(sizes) <= 200
    got = O.with_position(df, ["k"], "ord", width=100).collect()
    ords = sorted(o for k, o in rows if k == "hot" and o is not None)
    assert {r.ord: r.pos for r in got if r.k == "hot" and r.ord is not None} == {o: i + 1 for i, o in enumerate(ords)}
    assert sorted(r.pos for r in got if r.k == "hot" and r.ord is None) == [6665, 6666, 6667]
    before = {r.ord: r.before for r in O.previous_value(df.filter("ord is not null"), ["k"], "ord", "before", width=100).filter("k = 'hot'").collect()}
    assert before == {o: ords[i - 1] if i else None for i, o in enumerate(ords)}


def fill(lengths, total, per_file):
    """Fair shares, one file at a time."""
    n = len(lengths)
    caps = [min(x, max(per_file, total // n)) for x in lengths]
    if sum(caps) <= total:
        return caps
    out, left = [0] * n, total
    for done, i in enumerate(sorted(range(n), key=lambda i: caps[i])):
        out[i] = min(caps[i], left // (n - done))
        left -= out[i]
    return out


def test_fair_shares_match_sequential_definition(spark):
    rng = random.Random(7)
    files, budgets, want = [], [], {}
    for g in range(120):
        n = rng.choice([1, 2, 3, 8, 40])
        lengths = [rng.choice([0, 5, 100, rng.randrange(400), 400]) for _ in range(n)]
        total, per = rng.choice([0, 7, 500, 3000]), rng.choice([10, 100, 300])
        budgets.append((g, total, per))
        files += [(g, i, x) for i, x in enumerate(lengths)]
        want.update({(g, i): s for i, s in enumerate(fill(lengths, total, per))})
    got = P.shares(spark.createDataFrame(files, "g int, ord long, len long"), ["g"], spark.createDataFrame(budgets, "g int, total long, per_file long"))
    assert {(r.g, r.ord): r.share for r in got.collect()} == want


def test_uneven_files_all_get_something(spark):
    lengths = [92400, 61000, 48000, 800, 33000, 27000, 21000, 19000, 18000, 17000, 16000, 15000, 14000, 13000, 12000, 11000, 10000, 9000]
    files = spark.createDataFrame([("s", i, x) for i, x in enumerate(lengths)], "g string, ord long, len long")
    shares = {r.ord: r.share for r in P.shares(files, ["g"], spark.createDataFrame([("s", 360000, 60000)], "g string, total long, per_file long")).collect()}
    assert min(shares.values()) > 0 and sum(shares.values()) == 360000 and shares[3] == 800


def test_head_and_tail(spark):
    text = "표제와 저자" + "본" * 30000 + "Acknowledgements 이 연구는 …"
    rows = [(text, 12820), ("가" * 8000, 10000), ("나" * 5000, 1000)]
    long, whole, small = [r.out for r in spark.createDataFrame(rows, "t string, n int").select(P.head_and_tail(F.col("t"), F.col("n")).alias("out")).collect()]
    assert long.startswith("표제와 저자") and long.endswith("이 연구는 …") and "가운데" in long and len(long) <= 12820 + 40
    assert whole == "가" * 8000 and small == "나" * 1000


def test_budget_fits_target(spark):
    files = spark.createDataFrame([("s", i, 30000) for i in range(40)], "g string, ord long, len long")
    other = spark.createDataFrame([("s", 120000)], "g string, chars long")
    fitted = P.fit_budgets(files, ["g"], other, lambda df: df).collect()[0]
    target = min(235000, int(272000 * 0.86)) - int((6000 + 160 * 40) * 0.65)
    assert int((fitted.total + 120000) * 0.65) <= target and fitted.total > 150000


@pytest.mark.parametrize("few", [0, 3, 64])
def test_borrowed_rows_match_pairwise_definition(spark, few):
    """With ``few`` 0 every record walks the prefix tree, with 64 hardly one does."""
    rng = random.Random(3)
    rows, links = [], []
    for sheet in ("s1", "s2"):
        for r in range(60):
            vals = {k: rng.choice(["", "", "1", "2"]) for k in ("a", "b", "c", "d")}
            rows.append(("w", sheet, r, vals))
            links += [("w", sheet, r, f, 0) for f in {rng.choice(["hot", "hot", "x", "y"]) for _ in range(rng.randrange(3))}]
    got = G.borrowed_rows(
        spark.createDataFrame(links, "wb string, sheet string, row int, name string, place int"),
        spark.createDataFrame(rows, "wb string, sheet string, row int, vals map<string,string>"), few,
    )
    filled = {(s, r): {k: v for k, v in vals.items() if v} for _, s, r, vals in rows}
    uses = {}
    for _, s, r, f, _p in links:
        uses.setdefault((s, f), set()).add(r)
    want = {}
    for (s, f), rs in uses.items():
        for a in rs:
            for b in rs:
                if a != b and len(filled[s, a]) < len(filled[s, b]) and filled[s, a].items() <= filled[s, b].items():
                    want[s, a] = min(b, want.get((s, a), b))
    assert {(r.sheet, r.row): r.larger_row for r in got.collect()} == want
