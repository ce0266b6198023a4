"""Places of words in many texts laid end to end, by a table of the bytes that words are made of."""

from __future__ import annotations

import numpy as np


def places(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every word, and edges: text k's words are edges[k] to edges[k + 1].

    inside: whether each byte belongs to a word; text k is the bytes offsets[k] to offsets[k + 1], and no word crosses texts.
    """
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    own = offsets[1:] > offsets[:-1]
    before[offsets[:-1][own]] = False
    after[offsets[1:][own] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)
