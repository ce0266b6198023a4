"""Hashed word shingles of whole texts, many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
CHUNK = 1 << 20
_U = np.uint64
LOWER = np.arange(256, dtype=np.uint64)
LOWER[65:91] += _U(32)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_BASE = 0x9E3779B97F4A7C15
_STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], _U)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, a bijection of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _STEPS[0]
    x = (x ^ (x >> _U(27))) * _STEPS[1]
    return x ^ (x >> _U(31))


def powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE | 1, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def buffer_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array without nulls."""
    _, offsets, data = array.buffers()
    wide = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    at = np.frombuffer(offsets, wide)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)), at


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `limit` bytes; a longer text is a range of its own."""
    a = 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b
        a = b


def shingle_sets(array: pa.Array) -> Iterator[np.ndarray]:
    """For every text in turn the sorted distinct hashes of its shingles: WORDS words each, or all words of a shorter text."""
    data, offsets = buffer_of(array)
    for a, b in chunks(offsets):
        yield from _sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _sets(raw: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    n_docs, none = len(offsets) - 1, np.empty(0, _U)
    at = np.flatnonzero(~SPACE[raw])
    if not len(at):
        yield from [none] * n_docs
        return
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1] + 1
    starts = np.searchsorted(at, offsets[:-1])
    first[starts[starts < len(at)]] = True
    first = np.flatnonzero(first)
    lengths = np.diff(np.append(first, len(at)))
    inside = np.arange(len(at)) - np.repeat(first, lengths)
    words = mix(np.add.reduceat((LOWER[raw[at]] + _U(1)) * powers(int(lengths.max()))[inside], first) + lengths.astype(_U))
    edges = np.searchsorted(at[first], offsets)
    grams = none
    if len(words) >= WORDS:
        n = len(words) - WORDS + 1
        grams = mix(sum(words[k : k + n] * _STEPS[k] for k in range(WORDS)))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(grams[a : b - WORDS + 1])
        elif b > a:  # the number of words keeps these apart from whole shingles
            yield mix(np.array([(words[a:b] * _STEPS[: b - a]).sum(dtype=_U) + _U(b - a)], _U))
        else:
            yield none
