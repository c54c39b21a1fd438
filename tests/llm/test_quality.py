import math
import re
from collections import Counter

from pyspark.sql import functions as F

from veritab.llm import quality


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = list(zip(w, w[1:], w[2:]))
    n = Counter(windows)
    again = {k + j for k, x in enumerate(windows) if n[x] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_base_counts(spark):
    texts = ["a b c a b c a", "x x x x x", "one\n\none\n \ntwo\ntwo", None, "", " \t\n", "é ## <b>|", "a b", "a b c d a b c", "w " * 3000, "q" * 9000, "x\x0by\x0cz\x1cw", "a\n" * 40]
    df = spark.createDataFrame([(k, t, 7) for k, t in enumerate(texts)], "doc_id long, text string, n_words int")
    rows = {r["doc_id"]: r for r in quality.statistics(df).collect()}
    for k, t in enumerate(texts):
        s = rows[k]["__stats"]
        assert tuple(s[c] for c in quality.BASE) == brute(t), t
        assert rows[k]["n_words"] == 7


def fixture(spark):
    body = [" ".join(f"w{(k * 7 + j * j) % 997}" for j in range(80)) for k in range(120)]
    rows = [(k, t if k % 4 else t.replace(" ", " | ")) for k, t in enumerate(body)] + [(500 + k, t.upper() if k % 3 == 0 else t) for k, t in enumerate(body)]
    labels = [(k, int(k % 4 != 0)) for k in range(120)] + [(500 + k, int(k % 3 != 0)) for k in range(120)]
    return rows, labels


def test_rules_are_learned_ordered_and_precise(spark):
    rows, labels = fixture(spark)
    odd = [(None, 0), (1, None), (2, 0), (2, 1), (99_999, 0)]
    docs = spark.createDataFrame([*rows, (None, None), (7, "again a copy of an id " * 20)], "doc_id long, text string")
    figures = quality.figures(docs)
    rules = quality.learn(quality.labelled(figures, spark.createDataFrame(labels + odd, "doc_id long, quality int")))
    assert 2 <= len(rules) <= quality.MOST_RULES and any(x.figure == "upper_share" for r in rules for x in r)
    want = dict(labels)
    for r in quality.decide(figures, rules).collect():
        if r["doc_id"] in want and r["doc_id"] not in (2, 7) and not r["__base_failed"]:
            assert r["__kept"] == bool(want[r["doc_id"]])
        if r["doc_id"] is None:
            assert r["__base_failed"] and not r["__kept"]


def test_rules_do_not_depend_on_the_order_of_rows(spark):
    rows, labels = fixture(spark)
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [quality.learn(quality.labelled(quality.figures(d), marks)) for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("doc_id")).repartition(3, "text"))]
    assert found[0] and found[0] == found[1] == found[2]


def learned(rows):
    """The list that sequential covering gives, by plain loops over ``(figures, bad, grow)``."""
    figures, rules = quality.FIGURES, []
    digits = lambda x: x if x == 0 else float(f"{x:.2e}")
    cuts = {}
    for f in figures:
        cuts[f] = set()
        for side in (True, False):
            values = sorted(digits(s[f]) for s, bad, _ in rows if bad == side)
            k = 0
            for n, v in enumerate(values, 1):
                if n == len(values) or values[n] != v:
                    if n * quality.BINS >= k * len(values):
                        cuts[f].add(v)
                        k = n * quality.BINS // len(values) + 1
    holds = lambda rule, s: all((s[f] > c) == above for f, above, c in rule)
    while len(rules) < quality.MOST_RULES:
        rule = []
        while len(rule) < quality.MOST_LITERALS:
            held = [x for x in rows if holds(rule, x[0])]
            grow = [x for x in held if x[2]]
            p0, n0 = sum(x[1] for x in grow), sum(not x[1] for x in grow)
            best, most = None, 0.0
            for f in figures if p0 and n0 else []:
                for c in sorted(cuts[f]):
                    for above in (True, False):
                        hit = [x for x in grow if (x[0][f] > c) == above]
                        p = sum(x[1] for x in hit)
                        gain = p * (math.log2(p / len(hit)) - math.log2(p0 / (p0 + n0))) if p else 0.0
                        if gain > most + 1e-9:
                            best, most = (f, above, c, len(hit) - p), gain
            if best is None:
                break
            f, above, c, n = best
            good = [x[0][f] for x in held if not x[1] and (x[0][f] > c) != above]
            if good:
                g = max(good) if above else min(good)
                near = [x[0][f] for x in held if x[1] and (x[0][f] > g if above else x[0][f] < g)]
                if near:
                    c = (g + (min(near) if above else max(near))) / 2
            rule.append((f, above, c))
            if not n:
                break
        if not rule:
            break

        def balance(k, rule=rule):
            hit = [x for x in rows if not x[2] and holds(rule[:k], x[0])]
            p = sum(x[1] for x in hit)
            return (2 * p - len(hit)) / max(1, len(hit)), -k

        k = max(range(1, len(rule) + 1), key=balance)
        hit = [x for x in rows if holds(rule[:k], x[0])]
        p = sum(x[1] for x in hit)
        if p < quality.LEAST_COVERED or p < quality.PRECISION * len(hit):
            break
        rules.append(rule[:k])
        rows = [x for x in rows if not holds(rule[:k], x[0])]
    return rules


def test_rules_are_those_of_a_plain_learner(spark):
    rows, labels = fixture(spark)
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    seen = quality.labelled(quality.figures(docs), marks)
    plain = learned([(r["stats"].asDict(), r["bad"], r["grow"]) for r in seen.collect()])
    mine = [[(x.figure, x.above, x.cut) for x in rule] for rule in quality.learn(seen)]
    flat = lambda rules: [x for rule in rules for x in rule]
    assert [len(r) for r in mine] == [len(r) for r in plain] and [x[:2] for x in flat(mine)] == [x[:2] for x in flat(plain)]
    assert all(abs(a[2] - b[2]) < 1e-9 * max(1, abs(b[2])) for a, b in zip(flat(mine), flat(plain)))


def test_without_labels_the_base_checks_decide(spark):
    rows, _ = fixture(spark)
    docs = spark.createDataFrame(rows[:20], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.apply(docs, none).filter("__kept").count() == 20 and quality.apply(docs.limit(0), none).count() == 0
