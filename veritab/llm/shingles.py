"""Sets of word shingles as 64-bit hashes, computed for many texts at once with numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became a-z. A word's hash is a sum of random
64-bit values of its bytes times powers of an odd number, a shingle's a mix of those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WHITE = np.isin(np.arange(256), [32, *range(9, 14)])
_STEP = 0xD6E8FEB86659FD93
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * U(0x9E3779B97F4A7C15))


class _Powers:
    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> None:
        if n > len(self.up):
            grow = lambda x: np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, x, np.uint64))))
            self.up, self.down = grow(_STEP), grow(pow(_STEP, -1, 1 << 64))


_POWERS = _Powers()


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where words start, and their hashes."""
    data = np.frombuffer(raw.translate(_LOWER), np.uint8)
    white = np.concatenate(([True], _WHITE[data], [True]))
    begin, end = np.flatnonzero(white[:-2] & ~white[1:-1]), np.flatnonzero(~white[1:-1] & white[2:]) + 1
    _POWERS.to(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWERS.up[:len(data)], out=total[1:])
    return begin, mix((total[end] - total[begin]) * _POWERS.down[begin])


def _parts(raw: bytes) -> Iterator[bytes]:
    """A long text in parts of about ``BLOCK`` bytes that end before white space; a longer word stays whole."""
    at = 0
    while len(raw) - at > BLOCK:
        cut = max(raw.rfind(b, at + 1, at + BLOCK) for b in (b" ", b"\n"))
        if cut < 0:
            later = [p for p in (raw.find(b, at + BLOCK) for b in (b" ", b"\n")) if p > 0]
            if not later:
                break
            cut = min(later)
        yield raw[at:cut]
        at = cut
    yield raw[at:]


def _set(w: np.ndarray, size: int) -> np.ndarray:
    if len(w) >= size:
        n = len(w) - size + 1
        found = np.zeros(n, np.uint64)
        for k in range(size - 1, -1, -1):
            found = mix(w[k:k + n] * U(2 * k + 3) + found)
        return np.unique(found)
    return np.array([mix(np.array([len(w)], np.uint64) + sum((mix(x + U(k)) * U(2 * k + 3) for k, x in enumerate(w)), U(0)))[0]], np.uint64) if len(w) else np.zeros(0, np.uint64)


def sets(texts: list[str | None], words: int = 3) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text; none for null and for texts without words.

    A text of fewer than ``words`` words is one shingle.
    """
    with np.errstate(over="ignore"):
        group: list[bytes] = []

        def flush() -> Iterator[np.ndarray]:
            begin, hashes = _words(b"\n".join(group))
            starts = np.cumsum([0, *[len(g) + 1 for g in group]])
            edges = np.searchsorted(begin, starts)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield _set(hashes[a:b], words)
            group.clear()

        size = 0
        for t in texts:
            raw = (t or "").encode()
            if size + len(raw) > BLOCK and group:
                yield from flush()
                size = 0
            if len(raw) > BLOCK:
                yield _set(np.concatenate([_words(p)[1] for p in _parts(raw)]), words)
            else:
                group.append(raw)
                size += len(raw)
        if group:
            yield from flush()
