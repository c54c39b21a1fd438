import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from check_oracles import database
from veritab.llm import lexical
from veritab.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=10):
    words = [terms(t) for _, t in docs]
    n_docs, total = sum(bool(w) for w in words), sum(map(len, words))
    tfs = [Counter(w) for w in words]
    df = Counter(t for c in tfs for t in c)
    out = []
    for item, text in items:
        scores = []
        for (doc, _), w, tf in zip(docs, words, tfs):
            if w:
                m = 10 + (90 * len(w) * n_docs) // total
                s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in set(terms(text)) if tf[t])
                if s > 0:
                    scores.append((-s, doc is None, doc or 0, doc))
        out += [(item, k, x[3], -x[0]) for k, x in enumerate(sorted(scores)[:top], 1)]
    return out


def found(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


@pytest.mark.parametrize("segment", [3, 8192])
def test_equals_brute_force(spark, segment):
    r = random.Random(segment)
    word = lambda: "".join(r.choice("abcÉ") for _ in range(r.choice([1, 1, 2])))
    docs = [(k, r.choice([" ", "-", "_", "\n"]).join(word().upper() if r.random() < 0.1 else word() for _ in range(r.randint(1, 60)))) for k in range(300)]
    docs += [(5, docs[5][1]), (None, docs[6][1]), (400, docs[6][1]), (401, None), (402, ""), (403, "--- !!"), (404, "a " * 30_000 + "zz")]
    items = [(k, " ".join(word() for _ in range(r.randint(1, 8)))) for k in range(20)]
    items += [(20, None), (21, "?!"), (21, "zz zz qq"), (None, "zz"), (3, "nowhere9")]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, rank int, score int").repartition(5)
    q = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, row int")
    got = lexical.search(d, q, segment=segment)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert found(got.collect()) == found(brute(docs, items))


def test_small_blocks_of_queries_and_empty_tables(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ROWS", 3)
    docs, items = [(1, "a b c"), (2, "b c d"), (3, "c")], [(k, t) for k, t in enumerate(["a", "b", "c", "d", "a d", "x", "b b"])]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(lexical.search(d, q).collect()) == found(brute(docs, items))
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0
    assert found(lexical.search(d, q, top=1).collect()) == found(brute(docs, items, 1))


def test_segment_search_settles_every_score():
    rng = np.random.default_rng(1)
    for _ in range(60):
        size, n_terms = 200, 6
        n = rng.integers(1, 50, size)
        doc, term = np.nonzero(rng.random((size, n_terms)) < 0.4)
        s = lexical._Segment(n, doc, term, rng.integers(1, 4, len(doc)), rng.integers(1, 9000, n_terms), size, int(n.sum()))
        exact = np.zeros(size, np.int64)
        np.add.at(exact, s.doc, s.impact)
        alive, scores = s.search(np.arange(n_terms), 1, 5)
        assert (exact[alive] == scores).all()
        bound = np.sort(exact)[-5]
        assert set(np.flatnonzero((exact >= bound) & (exact > 0))) <= set(alive)


def test_query_matches_duckdb(spark):
    con = database(SF)
    rows = QUERIES["op11_lexical"](spark, SF)
    assert found(rows.collect()) == found(con.execute(f"SELECT {', '.join(rows.columns)} FROM ({ORACLES['op11_lexical']})").fetchall())
