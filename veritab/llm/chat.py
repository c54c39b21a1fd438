"""Operator 2, chat formatting by a grammar round trip.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. The deterministic parser reads exactly such
turns, refuses a control string inside a role or text, and takes one backslash out of every
``<\\...\\|``. A turn is rendered plainly first, parsed again and compared with its source; where
they differ (control strings or things that look like escaped ones), every ``<``, backslashes,
``|`` of the content gets one backslash more, which the parser undoes, and the turn must then
come back identical. A role is a single line: its line feeds are written ``\\n`` in that second
form, its backslashes doubled.

Rendering is row by row. ``read_back`` streams the rendered turns of each conversation in order
through the parser, one Arrow batch at a time, so even a conversation of a third of all rows is
never held whole. The loss mask covers the texts of role ``assistant``.

Defined cases: null text and null role count as empty; null turns come first and rows that
repeat a turn are ordered by role and text; rows without conversation id form one conversation;
empty texts are turns; an empty table gives no rows; other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.llm.common import whole

START, END = "<|im_start|>", "<|im_end|>"
TRAINED = "assistant"
_GUARD, _GUARDED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def _escape(s: str) -> str:
    return _GUARD.sub(r"<\\\1|", s)


def _escape_role(s: str) -> str:
    return _escape(s.replace("\\", "\\\\").replace("\n", "\\n"))


def _unescape(s: str) -> str:
    return _GUARDED.sub(r"<\1|", s)


def _unescape_role(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], _unescape(s))


def parse(text: str) -> list[tuple[str, str]]:
    """Roles and texts of rendered turns; raises ``ValueError`` where the grammar does not hold."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if m is None or START in m[1] or END in m[1] or START in m[2]:
            raise ValueError(f"no turn at character {at}")
        out.append((_unescape_role(m[1]), _unescape(m[2])))
        at = m.end()
    return out


def render(role: str, text: str) -> str:
    """One turn, escaped only if its plain form does not parse back to the same."""
    for r, t in ((role, text), (_escape_role(role), _escape(text))):
        made = f"{START}{r}\n{t}{END}\n"
        try:
            if parse(made) == [(role, text)]:
                return made
        except ValueError:
            pass
    raise ValueError("a turn does not survive the round trip")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turn, role, text, formatted)``; a conversation's formatted text is that of its turns in order."""
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), whole(role_col).alias("role"), whole(text_col).alias("text"))

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render(r, t) for r, t in zip(b["role"].to_pylist(), b["text"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.string())], [*b.schema.names, "formatted"])

    return rows.mapInArrow(rendered, T.StructType([*rows.schema.fields, T.StructField("formatted", T.StringType())]))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """What a reader finds in each conversation's formatted text: turns, and the text under the loss mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: list = []  # id, turns, digest, loss characters, loss digest, formatted characters

        def row() -> pa.RecordBatch:
            values = [now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in READ.split(", ")])

        for b in batches:
            for conv, text in zip(b["conv_id"].to_pylist(), b["formatted"].to_pylist(), strict=True):
                if not now or now[0] != conv:
                    if now:
                        yield row()
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    now[1] += 1
                    now[2].update(f"{role}\n{said}\n".encode())
                    if role == TRAINED:
                        now[3] += len(said)
                        now[4].update(said.encode())
                now[5] += len(text)
        if now:
            yield row()

    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return formatted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "formatted").mapInArrow(read, READ)
