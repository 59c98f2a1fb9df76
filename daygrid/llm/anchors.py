"""Content-defined anchors of byte strings: minimizers of every window of ``span`` bytes.

A window of ``span`` bytes holds ``span - GRAM + 1`` grams; its anchor is the
gram with the smallest hash, the leftmost of equals.  Equal windows have equal
anchors at equal places, so two places with the same ``span`` bytes meet under
the hash of their common anchor.
"""

from __future__ import annotations

import numpy as np

from daygrid.llm.shingles import mix, powers, running_hash

GRAM = 32
_PLACE = np.uint64((1 << 30) - 1)  # low bits of a key: the place; high bits: the hash


def span_hash(sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Mixed hashes of data[low:high] for many spans, from running sums."""
    with np.errstate(over="ignore"):
        return mix((sums[high] - sums[low]) * powers(len(sums), "down")[low])


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    have = 1
    out = keys
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(data: np.ndarray, offsets: np.ndarray, span: int, gram: int = GRAM):
    """(place, first, last, hash) of the anchors of all rows of a chunk, and its running sums.

    ``place`` is the anchor's offset in the chunk; the windows that begin at
    ``first`` to ``last`` are those it is the anchor of, each window having one.
    """
    gram = min(gram, max(1, span // 2))
    sums = running_hash(data)
    none = np.zeros(0, np.int64)
    if len(data) < span:
        return none, none, none, np.zeros(0, np.uint64), sums
    n = len(data) - gram + 1
    with np.errstate(over="ignore"):
        hashes = mix((sums[gram:] - sums[:n]) * powers(n, "down"))
    keys = (hashes & ~_PLACE) | np.arange(n, dtype=np.uint64)
    least = window_minima(keys, span - gram + 1)  # by the window's first byte
    ends = np.repeat(offsets[1:], np.diff(offsets))[:len(least)]
    begins = np.flatnonzero(np.arange(len(least)) + span <= ends)  # windows inside one row
    chosen = (least[begins] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.diff(chosen, prepend=-1))
    first = begins[new]
    last = begins[np.append(new[1:], len(begins)) - 1] if len(new) else none
    places = chosen[new]
    return places, first, last, hashes[places], sums
