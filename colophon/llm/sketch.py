"""Fast similarity sketching of many sets at once (rounds of hashed bin placement).

A sketch has ``size`` coordinates. In round ``i`` below ``size`` every element of
a set is thrown into one bin by that round's hash; from round ``size`` on, round
``size + j`` throws every element into bin ``j``, so that after at most
``2 * size`` rounds each coordinate of a nonempty set is filled. A bin keeps the
least (round, value) that reached it. Sets whose bins are all filled are done,
so large sets take one or two rounds and the expected work is linear. The share
of equal coordinates estimates the Jaccard similarity, with Chernoff bounds.
"""

from __future__ import annotations

import numpy as np

from colophon.llm.words import mix

_U = np.uint64


def sketches(elements: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """A row of ``size`` values per set; set ``i`` is ``elements[first[i]:first[i + 1]]``.

    The elements of a set are distinct. The row of an empty set is all ones.
    """
    count = len(first) - 1
    empty = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full((count, size), empty, _U)
    rows = np.flatnonzero(np.diff(first))  # sets that are not filled yet
    owner = np.repeat(np.arange(len(rows)), np.diff(first)[rows])
    bins = np.full((len(rows), size), empty, _U)
    for turn in range(2 * size):
        if not len(rows):
            break
        value = mix(elements, turn + 1)
        at = (value % _U(size)).astype(np.int64) if turn < size else turn - size
        ranked = (value >> _U(11)) | _U(turn) << _U(53)  # 53 bits of value below the round
        np.minimum.at(bins.reshape(-1), owner * size + at, ranked)
        full = (bins != empty).all(axis=1)
        if full.any():
            out[rows[full]] = bins[full]
            left = ~full
            kept = left[owner]
            elements, owner = elements[kept], (np.cumsum(left) - 1)[owner[kept]]
            rows, bins = rows[left], bins[left]
    return out


def bands(rows: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` coordinates."""
    count, size = rows.shape
    number = size // width
    out = np.zeros((count, number), _U)
    for j in range(width):
        out = mix(out * _U(0x9E3779B97F4A7C15) + rows[:, j : number * width : width], j)
    return mix(out + np.arange(number, dtype=_U), 99)
