import hashlib
import random
import re
import zlib

import pytest

from veritab.llm import convrepair

SCHEMA = "conv_id long, turn long, role string, text string, there boolean, pos string, fault string"
GOOD = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Cost, audit and repaired text over every sequence of edits, with up to two inserts at each place."""
    seen, faults = set(), []
    for role, text in rows:
        if not re.search(r"[^\x20\x09-\x0D]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif re.sub(r"[\x20\x09-\x0D]+$", "", text)[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append(None)
        seen.add((role, text))
    found = [(0, "", [])]
    ended = []
    for k in range(len(rows) + 1):
        for _ in range(2):
            found += [(c + 3, a + "I", [*t, (r, "")]) for c, a, t in found for r in ("user", "assistant") if a[-2:] != "II"]
        if k == len(rows):
            ended = found
            break
        role, text = rows[k]
        more = 3 if faults[k] == "truncated" else 0
        step = [(c + 4, a + "D", t) for c, a, t in found]
        if faults[k] in (None, "truncated"):
            step += [(c + more, a + "K", [*t, (role, text)]) for c, a, t in found]
            step += [(c + more + 3, a + "R", [*t, (r, text)]) for c, a, t in found for r in ("user", "assistant")]
        best = {}  # what may follow depends on the initials alone, and only on how far they match
        for c, a, t in step:
            initials = "".join(r[:1] or "-" for r, _ in t)
            if re.fullmatch(r"s?(ua)*u?", initials):
                key = (initials[-1:], len(initials) > 0)
                best[key] = min(best.get(key, (c, a, t)), (c, a, t))
        found = list(best.values())
    cost, audit, turns = min(x for x in ended if GOOD.fullmatch("".join(r[:1] or "-" for r, _ in x[2])))
    return faults, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()


def conversation(r, n):
    said = ["a.", "b!", "c", " ", "", "d?\n", "é. x"]
    return [(r.choice(["user", "assistant", "system", "user", "assistant", "tool", "uncle", ""]), r.choice(said) if r.random() < 0.5 else f"t{r.randrange(99)}.") for _ in range(n)]


def expected(rows):
    faults, cost, audit, digest = brute(rows)
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
    return (*(faults.count(k) for k in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest)


@pytest.mark.parametrize("block", [1, 2, 512])
def test_equals_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(convrepair, "BLOCK", block)
    r = random.Random(block)
    convs = {k: conversation(r, r.randint(1, 7)) for k in range(60 if block < 512 else 200)}
    rows = [(k, 10 * n, *said, True, "x", "y") for k, v in convs.items() for n, said in enumerate(v)]
    r.shuffle(rows)
    # workers load the module with its own block size, so small blocks are put through its functions here
    got = {x["conv_id"]: x for x in convrepair.report(spark.createDataFrame(rows, SCHEMA)).collect()} if block == 512 else local(convs, block)
    for k, v in convs.items():
        x = got[k]
        mine = tuple(x) if isinstance(x, tuple) and block < 512 else (x["blank"], x["duplicate"], x["truncated"], x["illegal"], x["cost"], x["audit"], x["repaired_sha256"])
        assert mine == expected(v), v


def local(convs, block):
    """The Arrow functions by themselves, with small blocks."""
    import pyarrow as pa

    out = {}
    for conv, rows in convs.items():
        faults = brute(rows)[0]
        sign = lambda role, f: "-" if f in ("blank", "duplicate") else (role[:1] if role[:1] in ("s", "u", "a") else "x").upper() if f else role[:1] if role[:1] in ("s", "u", "a") else "x"
        n = len(rows)
        signs = pa.RecordBatch.from_pydict({"conv_id": [conv] * n, "block": [k // block for k in range(n)], "symbol": [sign(x[0], f) for x, f in zip(rows, faults)]})
        made = pa.Table.from_batches(list(convrepair._blocks(iter([signs])))).sort_by([("block", "descending")])
        pieces = pa.Table.from_batches(list(convrepair._join_blocks(iter(made.to_batches())))).to_pylist()
        records = [(conv, p["block"], -1, p["cost"], p["piece"], None, None) for p in pieces] + [(conv, k // block, k, None, None, *x) for k, x in enumerate(rows)]
        records.sort(key=lambda x: (x[1], x[2]))
        batch = pa.RecordBatch.from_pylist([dict(zip(("conv_id", "block", "pos", "cost", "piece", "role", "text"), x)) for x in records])
        turns = [x for _, part in convrepair._edited(iter([batch])) for x in part]
        digest = hashlib.sha256("\n".join(f"{t[3]}:{t[4]}" for t in turns if t[2] != "D").encode()).hexdigest()
        want = expected(rows)
        out[conv] = (*want[:4], next(p["cost"] for p in pieces if p["block"] == 0), "".join(t[2] for t in turns), digest)
    return out


def test_long_conversation_nulls_ties_and_drops(spark):
    r = random.Random(3)
    long = [x for _ in range(500) for x in conversation(r, 4)]
    rows = [(1, k, *said) for k, said in enumerate(long)]
    rows += [(None, 0, "user", "hi."), (None, None, None, None), (2, 5, "user", "a."), (2, 5, "user", "a."), (2, 9, "assistant", "b."), (3, None, "user", "x.")]
    df = spark.createDataFrame([(*x, True, "z", "z") for x in rows] + [(4, 0, "user", "gone.", False, "z", "z")], SCHEMA)
    got = {x["conv_id"]: x for x in convrepair.report(df).collect()}
    assert (got[1]["cost"], got[1]["audit"], got[1]["repaired_sha256"]) == brute(long)[1:]
    assert (got[None]["blank"], got[None]["gaps"], got[None]["audit"], got[None]["cost"]) == (1, 0, "DKI", 7)
    assert (got[2]["duplicate"], got[2]["gaps"], got[2]["audit"], got[2]["cost"]) == (1, 3, "KDK", 4)
    assert got[3]["gaps"] == 0 and got[3]["audit"] == "KI"
    assert tuple(got[4])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert convrepair.report(df.limit(0)).count() == 0


def test_damage(spark):
    rows = [(k, t, "assistant", "A. b!") for k in range(40) for t in range(4)] + [(None, None, None, None)]
    got = convrepair.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    for k, t, role, text in rows:
        how = zlib.crc32(f"{' ' if k is None else k}:{' ' if t is None else t}".encode()) % 20
        mine = [x for x in got if (x["conv_id"], x["turn"]) == (k, t)]
        assert len(mine) == (2 if how == 3 else 1) and mine[0]["there"] == (how != 0)
        want = {1: "", 2: (text or " ").translate({46: None, 33: None, 63: None})}.get(how, text or " ")
        assert all(x["text"] == want and x["role"] == ("user" if how == 4 else role or " ") for x in mine)


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "x."), (1, 1, "user", "y."), (1, 2, "user", " "), (1, 3, "tool", "z.")]
    df = spark.createDataFrame([(*x, True, "", "") for x in rows], SCHEMA)
    turns = convrepair.repaired_turns(convrepair.repair(convrepair.examine(df.drop("pos", "fault")))).orderBy("nth").collect()
    kept = [(t["edit"], t["role"], t["text"]) for t in turns]
    assert [k[0] for k in kept] == list(brute([x[2:] for x in rows])[2])
    assert GOOD.fullmatch("".join(k[1][0] for k in kept if k[0] != "D"))
