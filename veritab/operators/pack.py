"""Fitting evidence text into a size budget: fair shares, cuts, and what was cut.

A share depends on every file of its group, yet no group is ever sorted as a whole:
shares follow from how many files have which length, and lengths above the per-file cap
count as the cap, so a group has at most ``per_file`` + 1 distinct lengths to look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritab.operators.chunks import MOST_CHARS, ONE_STRING, in_chunks, one_string
from veritab.operators.first import with_position

TOKENS_PER_CHAR = 0.65
TAIL_SHARE, TAIL_MIN = 0.4, 2000
INPUT_LIMIT, LIMIT_FLOOR, FILL_TARGET = 272000, 50000, 235000
FILL_SHARE, SAFE_SHARE = 0.86, 0.93
RESERVE, RESERVE_PER_FILE = 6000, 160
PER_FILE = 60000
NO_TEXT = "(글자를 하나도 뽑지 못한 파일이다)"  # fixed value: stands for an empty file

c = F.col


def token_estimate(chars: Column) -> Column:
    return F.floor(chars * TOKENS_PER_CHAR)


def lengths_of(files: DataFrame, keys: list[str]) -> DataFrame:
    """How many files of a group have which length."""
    return files.groupBy(*keys, "len").agg(F.count(F.lit(1)).alias("m"))


def levels(files: DataFrame, keys: list[str], budgets: DataFrame) -> DataFrame:
    """Distinct capped lengths per group with how full each gets.

    ``files``: keys, ord, len. ``budgets``: keys, total, per_file. Result per (keys, cap):
    count, the group's split, and how many files of the level get one character more.
    """
    return levels_of(lengths_of(files, keys), keys, budgets)


def levels_of(hist: DataFrame, keys: list[str], budgets: DataFrame) -> DataFrame:
    """The same from the length counts ``(keys, len, m)``."""
    sizes = hist.groupBy(*keys).agg(F.sum("m").alias("n"))
    facts = sizes.join(budgets, keys).withColumn("most", F.greatest("per_file", F.expr("total div n")))
    caps = (
        hist.join(facts, keys).withColumn("cap", F.least("len", "most"))
        .groupBy(*keys, "cap", "n", "total").agg(F.sum("m").alias("m"))
    )
    before = Window.partitionBy(*keys).orderBy("cap").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    placed = caps.withColumns({
        "rank0": F.coalesce(F.sum("m").over(before), F.lit(0)),
        "spent": F.coalesce(F.sum(c("m") * c("cap")).over(before), F.lit(0)),
        "want": F.sum(c("m") * c("cap")).over(whole),
    }).withColumn("full", (c("want") > c("total")) & (c("cap") > F.expr("(total - spent) div (n - rank0)")))
    split = placed.withColumn("brim", F.min(F.when(c("full"), F.struct("cap", "rank0", "spent"))).over(whole))
    shared = split.withColumns({
        "above": c("brim").isNotNull() & (c("cap") >= c("brim.cap")),
        "left": c("total") - c("brim.spent"), "sharers": c("n") - c("brim.rank0"),
        "after": c("n") - c("rank0") - c("m"),
    })
    return shared.select(
        *keys, "cap", "m", "total",
        F.when(c("above"), F.expr("left div sharers")).otherwise(c("cap")).alias("base"),
        F.when(c("above"), F.least("m", F.greatest(F.lit(0), F.expr("left % sharers") - c("after")))).otherwise(0).alias("plus"),
    )


def shares(files: DataFrame, keys: list[str], budgets: DataFrame) -> DataFrame:
    """Characters each file may fill: (keys, ord, len, share).

    Within one length the last files in order take the odd characters, so only levels
    where that splits the level need positions.
    """
    table = levels(files, keys, budgets).select(*keys, "cap", "m", "base", "plus")
    sizes = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    most = sizes.join(budgets, keys).select(*keys, F.greatest("per_file", F.expr("total div n")).alias("most"))
    placed = files.select(*keys, "ord", "len").join(most, keys).withColumn("cap", F.least("len", "most")).join(table, [*keys, "cap"])
    split = (c("plus") > 0) & (c("plus") < c("m"))
    cols = [*keys, "ord", "len", "share"]
    even = placed.filter(~split).withColumn("share", c("base") + F.when(c("plus") > 0, 1).otherwise(0)).select(*cols)
    odd = with_position(placed.filter(split), [*keys, "cap"], "ord")
    return even.unionByName(odd.withColumn("share", c("base") + F.when(c("pos") > c("m") - c("plus"), 1).otherwise(0)).select(*cols))


def cut_size(length: Column, share: Column) -> Column:
    return F.greatest(length - share, F.lit(0))


def head_and_tail(text: Column, share: Column) -> Column:
    """The text within its share: whole, only its head, or head and tail with a mark."""
    tail = F.floor(share * TAIL_SHARE).cast("int")
    mark = F.concat(F.lit("\n\n…가운데 "), F.format_number(F.length(text) - share, 0), F.lit("자 잘림…\n\n"))  # fixed value
    both = F.concat(F.substring(text, F.lit(1), share.cast("int") - tail), mark, F.right(text, tail))
    return (
        F.when(F.length(text) <= share, text)
        .when(share < TAIL_MIN, F.substring(text, F.lit(1), share.cast("int")))
        .otherwise(both)
    )


def cut_log(shared: DataFrame) -> DataFrame:
    """Files that were cut: full length and what was kept."""
    return shared.filter(c("len") > c("share")).withColumnsRenamed({"len": "total_chars", "share": "kept_chars"})


def segments(docs: DataFrame, shared: DataFrame, keys: list[str]) -> DataFrame:
    """The packed text file by file, in order: heading, notice of a cut, text.

    Rows in order rather than one string per group, so a group may hold any number of
    files; ``docs`` has keys, ord, tag, name, text.
    """
    cut = cut_size(F.length("text"), c("share"))
    head = F.concat(F.lit("\n【"), c("tag"), F.lit("】 "), c("name"))
    notice = F.when(cut > 0, F.concat(F.lit("  ※ cut in the middle: "), F.format_number(cut, 0), F.lit(" characters")))
    body = F.coalesce(F.nullif(head_and_tail(c("text"), c("share")), F.lit("")), F.lit(NO_TEXT))
    return docs.join(shared.select(*keys, "ord", "share"), [*keys, "ord"]).select(
        *keys, "ord", "tag", F.concat_ws("\n", head, notice, body).alias("segment")
    )


def input_limit(limit: int | None = None) -> int:
    return max(LIMIT_FLOOR, limit or INPUT_LIMIT)


def fit_budgets(files: DataFrame, keys: list[str], other_chars: DataFrame, keep, limit: int | None = None,
                per_file: int = PER_FILE, rounds: int = 6) -> DataFrame:
    """Largest total per group whose estimated tokens stay below the target.

    ``other_chars``: keys, chars of everything besides the files. Each round looks only
    at the length counts; ``keep`` writes a round's small result. Independent of batches.
    The result says what the total is estimated at and whether it ``fits``: after the last
    round, or where no smaller total is allowed, a group may still be over its target.
    """
    limit = input_limit(limit)
    sizes = files.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files"))
    reserve = F.floor((RESERVE + RESERVE_PER_FILE * c("n_files")) * TOKENS_PER_CHAR)
    target = F.least(F.lit(FILL_TARGET), F.lit(int(limit * FILL_SHARE))) - reserve
    state = sizes.join(other_chars, keys).select(
        *keys, "chars", target.alias("target"), F.greatest(F.lit(0), F.floor(target / TOKENS_PER_CHAR)).alias("total"), F.lit(per_file).alias("per_file"), F.lit(True).alias("open")
    )

    def estimated(state: DataFrame) -> DataFrame:
        filled = levels(files, keys, state.select(*keys, "total", "per_file")).groupBy(*keys).agg(
            F.sum(c("m") * c("base") + c("plus")).alias("kept")
        )
        return state.join(filled, keys).withColumn("tokens", token_estimate(c("kept") + c("chars")))

    for _ in range(rounds):
        smaller = F.floor(c("total") * c("target") / F.greatest(c("tokens"), F.lit(1))) - 2000
        go = c("open") & (c("tokens") > c("target")) & (smaller < c("total")) & (smaller >= 20000)
        state = keep(estimated(state).withColumn("go", go).select(
            *keys, "chars", "target", F.when(c("go"), smaller).otherwise(c("total")).alias("total"), "per_file", c("go").alias("open")
        ))
    return estimated(state).select(*keys, "total", "per_file", "tokens", (c("tokens") <= c("target")).alias("fits"))


def safe_total(total: Column, tokens: Column, limit: int | None = None) -> Column:
    """One step of the guard that a batch takes when its own text is longer than was reserved:
    the total to try next, the same one where the tokens are safe, null where none is left."""
    most = int(input_limit(limit) * SAFE_SHARE)
    smaller = F.floor(total * most / F.greatest(tokens, F.lit(1))) - 4000
    return F.when(tokens <= most, total).when(smaller >= 20000, smaller)


def fit_batches(files: DataFrame, keys: list[str], batches: DataFrame, keep, limit: int | None = None, rounds: int = 4) -> DataFrame:
    """The total that each batch really uses: its group's, made smaller while its own text does not fit.

    ``batches``: keys, batch, chars (of everything besides the files in this batch), total, per_file. A round
    measures every batch that is still open from the length counts of its group, and closes those that are safe
    or have no smaller total left; ``keep`` writes a round's small result. Returns keys, batch, total, tokens,
    rounds (how often it was made smaller) and ``fits``.
    """
    most = int(input_limit(limit) * SAFE_SHARE)
    at = [*keys, "batch"]
    hist = keep(lengths_of(files, keys))
    # a batch of a group without files keeps its own text only
    state = batches.select(*at, "chars", "total", "per_file", F.lit(0).alias("rounds"), F.lit(True).alias("open"), F.lit(None).cast("bigint").alias("tokens"))

    def measured(state: DataFrame) -> DataFrame:
        todo = state.filter("open")
        own = hist.join(todo.select(*at), keys)
        kept = levels_of(own, at, todo.select(*at, "total", "per_file")).groupBy(*at).agg(F.sum(c("m") * c("base") + c("plus")).alias("kept"))
        said = token_estimate(F.coalesce("kept", F.lit(0)) + c("chars"))
        return state.join(kept, at, "left").withColumn("tokens", F.when(c("open"), said).otherwise(c("tokens"))).drop("kept")

    for _ in range(rounds):
        now = measured(state).withColumn("next", safe_total(c("total"), c("tokens"), limit))
        go = c("open") & (c("tokens") > most) & c("next").isNotNull()
        state = keep(now.withColumn("go", go).select(
            *at, "chars", F.when(c("go"), c("next")).otherwise(c("total")).alias("total"), "per_file",
            (c("rounds") + F.when(c("go"), 1).otherwise(0)).alias("rounds"), c("go").alias("open"), "tokens",
        ))
    return measured(state).select(*at, "total", "tokens", "rounds", (c("tokens") <= most).alias("fits"))


def claim_line(row: Column, values: Column) -> Column:
    """``row |  k=v  |  k=v`` from an ordered array of (k, v), empty values left out."""
    said = F.array_join(F.transform(F.filter(values, lambda p: F.trim(p["v"]) != ""), lambda p: F.concat(p["k"], F.lit("="), p["v"])), "  |  ")
    body = F.when(said == "", F.lit("(빈 줄)")).otherwise(said)  # fixed value
    number = F.when(F.length(row.cast("string")) < 4, F.lpad(row.cast("string"), 4, " ")).otherwise(row.cast("string"))
    return F.concat(number, F.lit(" |  "), body)


def roster_chunks(people: DataFrame, keys: list[str], per_chunk: int = 1024, most: int = MOST_CHARS) -> DataFrame:
    """``name(category) · …`` of each roster in ``(keys, chunk, slice, text)``, whatever its size."""
    one = F.when(c("category") != "", F.concat(c("name"), F.lit("("), c("category"), F.lit(")"))).otherwise(c("name"))
    return in_chunks(people.select(*keys, "row", one.alias("said")), keys, "row", "said", " · ", per_chunk, most)


def roster_line(people: DataFrame, keys: list[str], most: int = ONE_STRING) -> DataFrame:
    """``(keys, people, line)``: the roster as one line, null where it has more than ``most`` characters."""
    counts = people.groupBy(*keys).agg(F.count(F.lit(1)).alias("people"))
    return counts.join(one_string(roster_chunks(people, keys), keys, most), keys).select(*keys, "people", c("text").alias("line"))
