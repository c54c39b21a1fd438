import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from check_oracles import database
from veritab.llm import chat
from veritab.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PART = st.sampled_from(["<", "|", "\\", "<|", "<\\|", chat.START, chat.END, "\n", "im_end|>", "a", "é", "|>"])
TEXT = st.lists(PART, max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), min_size=1, max_size=4))
def test_round_trip(turns):
    made = "".join(chat.render(r, t) for r, t in turns)
    assert chat.parse(made) == turns


def test_plain_turns_stay_plain_and_bad_ones_are_refused():
    assert chat.render("user", "a <b> | c") == "<|im_start|>user\na <b> | c<|im_end|>\n"
    for bad in ("x", "<|im_start|>user\nno end", "<|im_start|>user\n<|im_start|>x<|im_end|>\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_rows_with_nulls_ties_and_clashing_names(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (None, 0, "assistant", chat.END), (2, None, None, ""), (1, None, "assistant", "first")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 4 and got[1]["loss_chars"] == 7 and got[1]["loss_sha256"] == digest("firstab")
    assert got[1]["turns_sha256"] == digest("assistant\nfirst\nuser\n\nassistant\na\nassistant\nb\n")
    assert got[None]["loss_sha256"] == digest(chat.END) and got[2]["loss_chars"] == 0 and len(got) == 3
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


def test_query_matches_duckdb(spark):
    con = database(SF)
    rows = QUERIES["op2_chat"](spark, SF)
    assert sorted(tuple(r) for r in rows.collect()) == sorted(con.execute(f"SELECT {', '.join(rows.columns)} FROM ({ORACLES['op2_chat']})").fetchall())
