"""Tokens of many texts at once, as numpy arrays over their UTF-8 bytes.

A token is a run of letters and digits, where every byte beyond ASCII counts as a letter, or a run of
other visible characters. Its hash is a polynomial in its bytes, taken from prefix sums, so no Python
object is made for a token.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_CLASS = np.array([0 if b <= 32 or b == 127 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64)
_PLAIN = np.arange(256, dtype=np.uint64)


class Tokens(NamedTuple):
    """Byte ranges and hashes of tokens; ``doc`` is the number of the text each is from."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hashes: dict[int, np.ndarray]  # of the first n bytes, 0: of the whole token


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int) -> np.ndarray:
    if base not in _POWERS:
        _POWERS[base] = np.cumprod(np.concatenate(([np.uint64(1)], np.full(CHUNK, base, np.uint64))))
    return _POWERS[base]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _chunk(data: np.ndarray, heads: np.ndarray, prefixes: tuple[int, ...], fold: bool) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """``heads``: places at which a token can't go on because another text begins."""
    kind = _CLASS[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
    edge[heads] = True
    seen = kind != 0
    start = np.flatnonzero(seen & edge[:-1])
    end = np.flatnonzero(seen & edge[1:]) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if fold else _PLAIN)[data] * _powers(_BASE)[: len(data)], out=sums[1:])
    back = _powers(pow(_BASE, -1, 1 << 64))[start]
    hashes = {}
    for n in (0, *prefixes):
        stop = np.minimum(start + n, end) if n else end
        hashes[n] = mix((sums[stop] - sums[start]) * back + (stop - start).astype(np.uint64))
    return start, end, hashes


def tokenize(data: np.ndarray, offsets: np.ndarray, prefixes: tuple[int, ...] = (), fold: bool = True) -> Tokens:
    """Tokens of the texts ``data[offsets[i]:offsets[i + 1]]``.

    Text is worked on in pieces of at most 2 MiB that end at white space, so memory beyond the tokens
    themselves is bounded; only a single token longer than a piece is divided. Empty texts have none.
    """
    parts = []
    at = 0
    while at < len(data):
        stop = min(len(data), at + CHUNK)
        if stop < len(data):
            spaces = np.flatnonzero(_CLASS[data[at:stop]] == 0)
            stop = at + int(spaces[-1]) + 1 if len(spaces) else stop
        inside = offsets[(offsets > at) & (offsets < stop)] - at
        start, end, hashes = _chunk(data[at:stop], inside, prefixes, fold)
        parts.append((start + at, end + at, hashes))
        at = stop
    if not parts:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, none, {n: np.zeros(0, np.uint64) for n in (0, *prefixes)})
    start, end = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    hashes = {n: np.concatenate([p[2][n] for p in parts]) for n in (0, *prefixes)}
    return Tokens(start, end, np.searchsorted(offsets, start, "right") - 1, hashes)
