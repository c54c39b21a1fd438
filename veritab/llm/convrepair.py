"""Operator 12, conversation structure repair by scalar big-integer weights.

A conversation's rows, in order of turn, are edited at least cost into roles ``(s?(ua)+)?``. The
walk is a DAG: before each row at most one empty turn is inserted (a second one only costs more),
then the row is kept, reroled or deleted; after the last row up to two turns are inserted. A
node's value is one integer, ``cost * 8**width + audit``: the audit's letters are its octal
digits from the most significant place on, D, I, K, R as 1 to 4 and zeros behind its end. Of two
values the smaller integer is the cheaper edit, and among equally cheap ones the ASCII-least
audit, so plain ``min`` decides everything. Equal costs never leave one audit a prefix of another,
as both spend the same rows and only inserts, which cost, could make one longer.

Rows are dealt in blocks of ``BLOCK`` by their place in the conversation. A block's task makes the
matrix of values from each role state before to each one behind it; only states and letters
leave it. The blocks of a conversation are then put together from its end, where the value of
one state is again an integer, and its audit is cut at the blocks. So a conversation of any
length costs no more than its audit in memory; its sorting and its digest, which runs over its
turns in order, stream through one task.

Faults, each row's first one: *blank* (no character but white space), *duplicate* (role and text
seen earlier in the conversation), *truncated* (the last such character is none of ``.!?``).

Defined cases: null roles and texts are one space; a null conversation is a conversation, null
turns come first; rows of one turn are ordered by role and text; roles other than system, user
and assistant count by their first letter; a conversation without rows has zeros, an empty audit
and the digest of nothing; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veritab.llm.common import cut

BLOCK = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = "DIKR"
# States of the pattern: nothing yet, after s, after u, after a. The empty pattern and the end of a pair are accepted.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
TURN = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # where an inserted or reroled turn leads
ROLE = {USER: "user", ASSISTANT: "assistant"}
NOT_WHITE, ENDS = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*$"


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, there)``: rows damaged by a hash of their name; a dropped one stays as not there."""
    space = lambda x: F.coalesce(F.col(x), F.lit(" "))
    name = F.concat(F.coalesce(F.col(conv_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), F.lit(" ")))
    named = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"), (F.crc32(name) % 20).alias("how"))
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    done = named.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "how")
    twice = F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return done.select("conv_id", "turn", "role", "text", (F.col("how") != 0).alias("there"), F.explode(twice).alias("copy")).drop("copy")


def examine(rows: DataFrame) -> DataFrame:
    """``rows (conv_id, turn, role, text, there)`` with ``pos``, ``fault`` and ``before``, the role before; rows not there come last."""
    rows = rows.withColumns({x: F.coalesce(x, F.lit(" ")) for x in ("role", "text")})
    order = [~F.col("there"), F.col("turn").asc_nulls_first(), "role", "text"]
    conv = Window.partitionBy("conv_id").orderBy(*order)
    same = Window.partitionBy("conv_id", "there", "role", "text").orderBy("pos")
    seen = rows.withColumns({
        "pos": F.row_number().over(conv).cast("long") - 1, "before": F.lag("role").over(conv), "turn_before": F.lag("turn").over(conv),
    }).withColumn("nth", F.row_number().over(same))
    fault = F.when(~F.col("text").rlike(NOT_WHITE), "blank").when(F.col("nth") > 1, "duplicate").when(~F.col("text").rlike(ENDS), "truncated")
    return seen.withColumn("fault", F.when(F.col("there"), fault)).drop("nth")


def _symbol() -> Column:
    """What an edit depends on: ``-`` must go; else s, u, a or x for the role, as a capital where the text is truncated."""
    first = F.substring("role", 1, 1)
    plain = F.when(first.isin("s", "u", "a"), first).otherwise("x")
    return F.when(F.col("fault").isin("blank", "duplicate"), "-").when(F.col("fault") == "truncated", F.upper(plain)).otherwise(plain)


class Weights:
    """Integers of ``width`` letters behind a cost."""

    def __init__(self, width: int):
        self.shift = 3 * width
        self.low = (1 << self.shift) - 1

    def add(self, value: int, used: int, cost: int, letter: str) -> tuple[int, int]:
        """A value one letter longer, and how many letters it has."""
        return value + (cost << self.shift) + ((LETTERS.index(letter) + 1) << (self.shift - 3 * (used + 1))), used + 1

    def letters(self, value: int) -> str:
        digits = oct(value & self.low)[2:].rjust(self.shift // 3, "0") if value & self.low else ""
        return "".join(LETTERS[int(d) - 1] for d in digits.rstrip("0"))


def _less(now: dict[int, tuple[int, int]], state: int, found: tuple[int, int]) -> None:
    if state not in now or found[0] < now[state][0]:
        now[state] = found


def block_values(symbols: str, start: int, w: Weights) -> dict[int, tuple[int, int]]:
    """The least value, and its letters, of each state behind a block that begins in ``start``."""
    now = {start: (0, 0)}
    for sign in symbols:
        ready = dict(now)
        for state, (value, used) in now.items():
            _less(ready, TURN[state], w.add(value, used, INSERT, "I"))
        now = {}
        low, more = sign.lower(), TRUNCATED if sign.isupper() else 0
        for state, (value, used) in ready.items():
            _less(now, state, w.add(value, used, DELETE, "D"))
            if sign != "-":
                if (state, low) in NEXT:
                    _less(now, NEXT[state, low], w.add(value, used, KEEP + more, "K"))
                _less(now, TURN[state], w.add(value, used, REROLE + more, "R"))
    return now


def _end(w: Weights) -> dict[int, tuple[int, int]]:
    """The least value from each state to an accepted end, by inserts alone."""
    out = {}
    for state in (EMPTY, SYSTEM, USER, ASSISTANT):
        at, value = state, (0, 0)
        while at not in (EMPTY, ASSISTANT):
            value, at = w.add(*value, INSERT, "I"), TURN[at]
        out[state] = value
    return out


def _bytes(value: int) -> bytes:
    return value.to_bytes((value.bit_length() + 7) // 8, "little")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(conv_id, block, n, values)`` of sorted ``(conv_id, block, pos, symbol)``; values by first and last state."""
    w = Weights(2 * BLOCK)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        out = []
        for conv, block, signs in rows:
            starts = [EMPTY] if block == 0 else [EMPTY, SYSTEM, USER, ASSISTANT]
            out.append((conv, block, len(signs), [(s, e, _bytes(v), n) for s in starts for e, (v, n) in block_values(signs, s, w).items()]))
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("value", pa.binary()), ("n", pa.int32())]))
        values = [[dict(zip(("s", "e", "value", "n"), v, strict=True)) for v in x[3]] for x in out]
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.int64()), pa.array(values, kind)], ["conv_id", "block", "n", "values"])

    now, signs, ready = None, [], []
    for b in batches:
        for conv, block, sign in zip(b["conv_id"].to_pylist(), b["block"].to_pylist(), b["symbol"].to_pylist(), strict=True):
            if now != (conv, block):
                if now:
                    ready.append((*now, "".join(signs)))
                now, signs = (conv, block), []
                if len(ready) >= 2000:
                    yield made(ready)
                    ready = []
            signs.append(sign)
    if now:
        ready.append((*now, "".join(signs)))
    if ready:
        yield made(ready)


def _pieces(audit: str, sizes: list[int]) -> Iterator[str]:
    """The audit cut so that each block has its rows' letters, inserts before a row with it and those at the end with the last."""
    at = 0
    for k, n in enumerate(sizes):
        end = at
        while n:
            n -= audit[end] != "I"
            end += 1
        yield audit[at:end] if k + 1 < len(sizes) else audit[at:]
        at = end


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(conv_id, block, cost, piece)`` of blocks sorted by conversation, last block first; the first block names the cost."""
    block_w = Weights(2 * BLOCK)

    def close(conv, rest: dict[int, int], w: Weights, sizes: list[int]) -> list[tuple]:
        pieces = _pieces(w.letters(rest[EMPTY]), sizes[::-1])
        return [(conv, k, rest[EMPTY] >> w.shift if k == 0 else None, p) for k, p in enumerate(pieces)]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "block", "cost", "piece"])

    now, out = None, []
    w, rest, sizes = Weights(2), {}, []
    for b in batches:
        for conv, block, n, values in zip(*(b[c].to_pylist() for c in ("conv_id", "block", "n", "values")), strict=True):
            if not sizes or conv != now:
                if sizes:
                    out += close(now, rest, w, sizes)
                now, w, sizes = conv, Weights(2), []
                rest = {s: v for s, (v, _) in _end(w).items()}
            wider = Weights(w.shift // 3 + 2 * BLOCK)
            best: dict[int, int] = {}
            for x in values:
                value, behind = int.from_bytes(x["value"], "little"), rest[x["e"]]
                cost = (value >> block_w.shift) + (behind >> w.shift)
                # the block's letters, then those behind it, which move up to where the block's end
                made = (cost << wider.shift) + ((value & block_w.low) << w.shift) + ((behind & w.low) << (block_w.shift - 3 * x["n"]))
                best[x["s"]] = min(made, best.get(x["s"], made))
            w, rest = wider, best
            sizes.append(n)
            if len(out) >= 2000:
                yield batch(out)
                out = []
    if sizes:
        out += close(now, rest, w, sizes)
    if out:
        yield batch(out)


def repair(rows: DataFrame) -> DataFrame:
    """``(conv_id, block, cost, piece, pos, role, text)`` records, in two kinds, from examined rows.

    A record with ``piece`` holds the audit letters of one block (``cost`` in a conversation's first);
    the others are the rows. In the order of ``read_back`` each block's letters precede its rows.
    """
    rows = rows.filter("there").withColumn("block", F.floor(F.col("pos") / BLOCK))
    signs = rows.select("conv_id", "block", "pos", _symbol().alias("symbol")).repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "pos")
    blocks = signs.drop("pos").mapInArrow(_blocks, "conv_id long, block long, n long, values array<struct<s:int,e:int,value:binary,n:int>>")
    last_first = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("block").desc())
    pieces = last_first.mapInArrow(_join_blocks, "conv_id long, block long, cost long, piece string")
    nothing = lambda kind: F.lit(None).cast(kind)
    audit = pieces.select("conv_id", "block", F.lit(-1).cast("long").alias("pos"), "cost", "piece", nothing("string").alias("role"), nothing("string").alias("text"))
    return audit.unionByName(rows.select("conv_id", "block", "pos", nothing("long").alias("cost"), nothing("string").alias("piece"), "role", "text"))


def repaired_turns(records: DataFrame) -> DataFrame:
    """``(conv_id, nth, edit, role, text)``: the turns of each repaired conversation in order; deleted rows have edit D."""

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _edited(batches):
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["conv_id", "nth", "edit", "role", "text"])

    return _in_order(records).mapInArrow(turns, "conv_id long, nth long, edit string, role string, text string")


def _in_order(records: DataFrame) -> DataFrame:
    return records.repartition("conv_id").sortWithinPartitions("conv_id", "block", "pos").select("conv_id", "block", "pos", "cost", "piece", "role", "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """The edits of each batch of sorted records: (conversation, number, letter, role, text)."""
    conv, left, state, nth = None, "", EMPTY, 0
    begun = False

    def insert(rows: list[tuple]) -> None:
        nonlocal left, state, nth
        while left[:1] == "I":
            state = TURN[state]
            rows.append((conv, nth, "I", ROLE[state], ""))
            left, nth = left[1:], nth + 1

    for b in batches:
        rows: list[tuple] = []
        for name, block, pos, piece, role, text in zip(*(b[c].to_pylist() for c in ("conv_id", "block", "pos", "piece", "role", "text")), strict=True):
            if not begun or name != conv or pos < 0 and block == 0:
                begun, conv, left, state, nth = True, name, "", EMPTY, 0
            if pos < 0:
                left += piece
                continue
            insert(rows)
            letter, left = left[0], left[1:]
            if letter == "R":
                state = TURN[state]
                role = ROLE[state]
            elif letter == "K":
                state = NEXT[state, role[0]]
            rows.append((conv, nth, letter, role, text))
            nth += 1
            insert(rows)
        yield b, rows


def digests(records: DataFrame) -> DataFrame:
    """``(conv_id, cost, audit, repaired_sha256)`` of each conversation with rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # conversation, cost, letters, digest, whether a turn was written

        def row() -> pa.RecordBatch:
            values = [(now[0], pa.int64()), (now[1], pa.int64()), ("".join(now[2]), pa.string()), (now[3].hexdigest(), pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in values], ["conv_id", "cost", "audit", "repaired_sha256"])

        costs: dict = {}
        for b, rows in _edited(batches):
            for name, cost in zip(b["conv_id"].to_pylist(), b["cost"].to_pylist(), strict=True):
                if cost is not None:
                    costs[name] = cost
            for conv, _, letter, role, text in rows:
                if not now or conv != now[0]:
                    if now:
                        yield row()
                    now = [conv, costs.pop(conv), [], hashlib.sha256(), False]
                now[2].append(letter)
                if letter != "D":
                    now[3].update((("\n" if now[4] else "") + f"{role}:{text}").encode())
                    now[4] = True
        if now:
            yield row()

    return _in_order(records).mapInArrow(read, "conv_id long, cost long, audit string, repaired_sha256 string")


def counts(examined: DataFrame) -> DataFrame:
    """Per conversation, those without rows too: gaps, faults by kind and illegal neighbours."""
    there = F.col("there")
    number = lambda what: F.count_if(what).alias
    turn = F.when(there, F.col("turn"))
    new = there & F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))
    pair = F.concat(F.substring("before", 1, 1), F.substring("role", 1, 1))
    return examined.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_if(new), F.lit(0)).cast("long").alias("gaps"),
        *[number(F.col("fault") == k)(k) for k in ("blank", "duplicate", "truncated")],
        number(there & F.col("before").isNotNull() & ~pair.isin("su", "ua", "au"))("illegal"),
    )


def report(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows (conv_id, turn, role, text, there)``: counts, cost, audit and digest."""
    seen = cut(examine(rows))
    fixed = digests(repair(seen)).withColumnRenamed("conv_id", "name")
    made = counts(seen).join(fixed, F.col("conv_id").eqNullSafe(F.col("name")), "left").drop("name")
    return made.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
