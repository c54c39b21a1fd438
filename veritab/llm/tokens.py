"""Byte-level BPE of one text: the ids of a ``tokenizers`` JSON vocabulary, computed by ``tiktoken``.

The JSON file writes each byte as one printable character and numbers its tokens in the order of
their merges, which is what ``tiktoken`` needs. Texts that hold a special token's string are
split there first, as the ``tokenizers`` library does.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import tiktoken

# Fixed value: the pattern that byte-level BPE of this vocabulary splits texts with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STEP = 1 << 18


def _byte_of_sign() -> dict[str, int]:
    """A byte's sign is itself where it is printable, else the next free character from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    signs, free = {chr(b): b for b in own}, 256
    for b in range(256):
        if b not in own:
            signs[chr(free)] = b
            free += 1
    return signs


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] is not None or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        sign = _byte_of_sign()
        ranks = {bytes(sign[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        self.bpe = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        known = {v: k for k, v in ranks.items()} | {v: k.encode() for k, v in self.special.items()}
        table = [known.get(i, b"") for i in range(max(known) + 1)]
        self.n_bytes = np.array([len(b) for b in table], np.int64)
        self.starts = np.cumsum(self.n_bytes) - self.n_bytes
        self.bytes = np.frombuffer(b"".join(table), np.uint8)

    def encode(self, text: str | None) -> np.ndarray:
        """Unsigned 32-bit ids; null counts as empty."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.split is None or not any(s in text for s in self.special):
            return self.bpe.encode_to_numpy(text, disallowed_special=())
        parts = [p for p in self.split.split(text) if p]
        return np.concatenate([np.array([self.special[p]], np.uint32) if p in self.special else self.bpe.encode_to_numpy(p, disallowed_special=()) for p in parts])

    def inside(self, raw: bytes) -> np.ndarray:
        """Ids of bytes that lie within one word."""
        return np.array(self.bpe._encode_single_piece(raw), np.uint32)

    def raw(self, ids: np.ndarray) -> bytes:
        """The bytes of ids; an id without a token has none."""
        out = []
        for i in range(0, len(ids), STEP):
            part = ids[i:i + STEP].astype(np.int64)
            part = part[part < len(self.n_bytes)]
            n = self.n_bytes[part]
            upto = np.cumsum(n)
            if len(part):
                out.append(self.bytes[np.repeat(self.starts[part] - (upto - n), n) + np.arange(upto[-1])].tobytes())
        return b"".join(out)

    def decode(self, ids: np.ndarray) -> str:
        return self.raw(ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec for each Python worker and vocabulary."""
    return Codec(path)
