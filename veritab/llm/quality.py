"""Operator 10, quality rules as a learned decision list.

``statistics`` computes a text's figures with Spark expressions. ``learn`` fits an ordered list of
rejecting rules to labelled documents (quality 0 or 1) by sequential covering: a rule grows by
the threshold with the highest information gain on two thirds of the labelled rows, is pruned to
the prefix with the best balance on the other third, and is taken while it is precise enough;
the rows it covers leave, and the next rule starts. Each step is one aggregation of all labelled
rows into counts for each figure and bin, so what reaches the driver is bounded by figures times
bins, whatever the input. ``verdict`` turns the list into one ordered CASE expression.

Base checks reject texts of fewer than ``MIN_WORDS`` words and those where words in repeated
3-word windows are more than half. Defined cases: a null text has no words; empty texts fail the
base checks; labels that are null, contradict each other or name no document are left out; of
documents that repeat an id each takes the label; of equally good thresholds the one of the first
figure in ``FIGURES`` and of the least cut is taken, so rules do not depend on the order of rows;
without usable labels the list is empty and the base checks decide; extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import WHITE, cut, whole

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIGURES = ["words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_share"]
MIN_WORDS = 50
BINS = 48
MOST_RULES = 8
MOST_LITERALS = 3
PRECISION = 0.95
LEAST_COVERED = 5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more."""

    def windows(w: Column) -> Column:
        at = lambda i: F.get(w, i)
        return F.when(F.size(w) < 3, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))
        )

    def covered(places: Column) -> Column:
        grown = F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda s, i: F.struct((s["n"] + F.least(F.lit(3), i - s["last"])).alias("n"), i.alias("last")),
        )
        return grown["n"].cast("long")

    def twice(ordered: Column) -> Column:
        same = lambda j, x: F.coalesce(F.get(ordered, j)["k"] == x["k"], F.lit(False))
        hits = F.transform(F.filter(ordered, lambda x, j: same(j - 1, x) | same(j + 1, x)), lambda x: x["i"])
        return covered(F.array_sort(hits))

    def count(keys: Column) -> Column:
        ordered = F.sort_array(F.transform(keys, lambda k, i: F.struct(k.alias("k"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(_let(ordered, twice))

    return _let(windows(words), count)


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__stats``: the base counts and the figures rules are learned on."""
    text = whole(text_col)
    chars = F.length(text)
    kept = lambda pattern: F.length(F.regexp_replace(text, pattern, "")).cast("long")

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            _repeated(words).alias("n_repeat_words"),
            F.size(F.array_distinct(words)).alias("distinct"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    split = lambda pattern: F.split(text, pattern)
    parts = docs.withColumns({
        "__w": _let(F.filter(split(WHITE), lambda w: w != ""), of_words),
        "__l": _let(F.filter(split("\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), of_lines),
        "__symbols": kept(r"[^#*$%&|<>]+"),
        "__upper": kept(r"\P{Lu}+"),
        "__chars": chars,
    })
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    w, lines = F.col("__w"), F.col("__l")
    stats = F.struct(
        w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), F.col("__symbols").alias("n_symbols"),
        lines["n_dup_lines"].alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words"),
        w["n_words"].cast("double").alias("words"),
        share(w["word_chars"], w["n_words"]).alias("word_length"),
        share(F.col("__symbols"), F.col("__chars")).alias("symbol_share"),
        share(lines["n_dup_lines"], lines["n_lines"]).alias("dup_line_share"),
        share(w["n_repeat_words"], w["n_words"]).alias("repeat_share"),
        share(F.col("__upper"), F.col("__chars")).alias("upper_share"),
        share(w["distinct"], w["n_words"]).alias("distinct_share"),
    )
    return parts.withColumn("__stats", stats).drop("__w", "__l", "__symbols", "__upper", "__chars")


def base_failed(stats: Column | str = "__stats") -> Column:
    s = F.col(stats) if isinstance(stats, str) else stats
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


@dataclass(frozen=True)
class Literal:
    figure: str
    above: bool
    cut: float

    def holds(self, stats: Column) -> Column:
        return stats[self.figure] > self.cut if self.above else stats[self.figure] <= self.cut


def _all(rule: list[Literal], stats: Column) -> Column:
    out = F.lit(True)
    for x in rule:
        out = out & x.holds(stats)
    return out


def labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(stats, bad, grow)`` of the documents with exactly one label that pass the base checks."""
    clear = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__label_id"))
    clear = clear.agg(F.min(label_col).alias("__low"), F.max(label_col).alias("__high")).filter("__low = __high")
    rows = docs.select(F.col(id_col).alias("__id"), F.col("__stats").alias("stats")).join(clear, F.col("__id") == F.col("__label_id"))
    return rows.filter(~base_failed("stats")).select(
        "stats", (F.col("__low") == 0).alias("bad"), (F.pmod(F.xxhash64("__id"), F.lit(3)) != 0).alias("grow")
    )


def _rounded(x: Column) -> Column:
    """Three significant digits, so that a figure has a bounded number of values."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(x)) - 2)
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x / unit) * unit)


def _cuts(rows: DataFrame) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each class, at most ``BINS`` a class and figure, the same for any order of rows."""
    values = F.array(*[F.struct(F.lit(f).alias("figure"), _rounded(F.col("stats")[f]).alias("value")) for f in FIGURES])
    counts = rows.select("bad", F.explode(values).alias("v")).groupBy("v.figure", "bad", "v.value").agg(F.count("*").alias("n"))
    found: dict[tuple[str, bool], list[tuple[float, int]]] = {}
    for r in counts.collect():  # at most 900 values a figure, class and power of ten
        found.setdefault((r["figure"], r["bad"]), []).append((r["value"], r["n"]))
    out: dict[str, set[float]] = {f: set() for f in FIGURES}
    for (f, _), pairs in found.items():
        pairs.sort()
        total, upto, k = sum(n for _, n in pairs), 0, 0
        for value, n in pairs:
            upto += n
            if upto * BINS >= k * total:
                out[f].add(value)
                k = upto * BINS // total + 1
    return {f: sorted(v) for f, v in out.items()}


def _histogram(rows: DataFrame, cuts: dict[str, list[float]]) -> dict[str, dict[int, tuple[int, int]]]:
    """Bad and good rows by figure and number of cuts below the value."""

    def below(f: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[f]]), lambda c: c < F.col("stats")[f]))

    bins = F.array(*[F.struct(F.lit(f).alias("figure"), below(f).alias("bin")) for f in FIGURES if cuts[f]])
    counts = rows.select(F.explode(bins).alias("b"), "bad").groupBy("b.figure", "b.bin").agg(
        F.sum(F.col("bad").cast("long")).alias("p"), F.sum((~F.col("bad")).cast("long")).alias("n")
    )
    out: dict[str, dict[int, tuple[int, int]]] = {}
    for r in counts.collect():
        out.setdefault(r["figure"], {})[r["bin"]] = (r["p"], r["n"])
    return out


def _best(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[Literal, int, int] | None:
    """The threshold that gains most information about bad rows, with the rows it covers."""
    best, most = None, 0.0
    found = _histogram(rows, cuts)
    for f, bins in ((f, found[f]) for f in FIGURES if f in found):  # of equal gains the first figure and least cut
        p_all, n_all = (sum(x[i] for x in bins.values()) for i in (0, 1))
        if not p_all or not n_all:
            return None
        prior, p_below, n_below = log2(p_all / (p_all + n_all)), 0, 0
        for k, c in enumerate(cuts[f]):
            p, n = bins.get(k, (0, 0))  # bin k: values above the first k cuts, at most cut k
            p_below, n_below = p_below + p, n_below + n
            for above, p, n in ((True, p_all - p_below, n_all - n_below), (False, p_below, n_below)):
                gain = p * (log2(p / (p + n)) - prior) if p else 0.0
                if gain > most + 1e-9:
                    best, most = (Literal(f, above, c), p, n), gain
    return best


def _between(rows: DataFrame, x: Literal) -> Literal:
    """The same literal with its cut halfway between the nearest good row that it leaves and the bad row next to that."""
    value, bad = F.col("stats")[x.figure], F.col("bad")
    left = F.max(F.when(~bad & (value <= x.cut), value)) if x.above else F.min(F.when(~bad & (value > x.cut), value))
    good = rows.agg(left).first()[0]
    if good is None:
        return x
    near = rows.agg(F.min(F.when(bad & (value > good), value)) if x.above else F.max(F.when(bad & (value < good), value))).first()[0]
    if near is None:
        return x
    middle = (good + near) / 2
    return Literal(x.figure, x.above, middle if x.above or middle < good else near)


def learn(rows: DataFrame) -> list[list[Literal]]:
    """Ordered rules, each a conjunction, from the rows of ``labelled``."""
    rows = cut(rows)
    rules: list[list[Literal]] = []
    if rows.isEmpty():
        return rules
    cuts = _cuts(rows)
    stats = F.col("stats")
    while len(rules) < MOST_RULES:
        rule: list[Literal] = []
        while len(rule) < MOST_LITERALS:
            held = rows.filter(_all(rule, stats))
            found = _best(held.filter("grow"), cuts)
            if found is None:
                break
            rule.append(_between(held, found[0]))
            if found[2] == 0:
                break
        if not rule:
            break
        # prune: the prefix with the best balance of bad over good on rows it was not grown on
        hit = lambda k: _all(rule[:k], stats)  # noqa: E731, B023
        sums = rows.agg(*[
            F.coalesce(F.sum((hit(k) & side & what).cast("long")), F.lit(0)).alias(f"{name}{k}")
            for k in range(1, len(rule) + 1)
            for name, side, what in (("a", ~F.col("grow"), F.col("bad")), ("b", ~F.col("grow"), ~F.col("bad")), ("p", F.lit(True), F.col("bad")), ("n", F.lit(True), ~F.col("bad")))
        ]).first()
        balance = lambda k: ((sums[f"a{k}"] - sums[f"b{k}"]) / max(1, sums[f"a{k}"] + sums[f"b{k}"]), -k)  # noqa: E731, B023
        k = max(range(1, len(rule) + 1), key=balance)
        p, n = sums[f"p{k}"], sums[f"n{k}"]
        if p < LEAST_COVERED or p < PRECISION * (p + n):
            break
        rules.append(rule[:k])
        rows = rows.filter(~hit(k))
    return rules


def verdict(rules: list[list[Literal]], stats: Column | str = "__stats") -> Column:
    """Number of the first rule that holds, counted from 1; null where none does."""
    s = F.col(stats) if isinstance(stats, str) else stats
    out = None
    for k, rule in enumerate(rules, 1):
        out = F.when(_all(rule, s), F.lit(k)) if out is None else out.when(_all(rule, s), F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def decide(rated: DataFrame, rules: list[list[Literal]]) -> DataFrame:
    """``rated`` (with ``__stats``) with ``__base_failed``, ``__rule`` and ``__kept``."""
    return rated.withColumns({"__base_failed": base_failed(), "__rule": verdict(rules)}).withColumn(
        "__kept", ~F.col("__base_failed") & F.col("__rule").isNull()
    )


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id and ``__stats`` of each row, computed once: learning and deciding need no texts."""
    return cut(statistics(docs.select(id_col, text_col), text_col).drop(text_col))


def apply(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, whole rows, with the columns of ``decide``."""
    rules = learn(labelled(figures(docs, id_col, text_col), labels, id_col))
    return decide(statistics(docs, text_col), rules)
