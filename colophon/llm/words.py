"""Words and their hashes for many texts at once, as numpy arrays over UTF-8 bytes.

Texts are handled in slices of whole documents of about ``SLICE_BYTES``, so that
memory is bounded by that or by the longest document, whatever the size of an
Arrow batch; steps that need nothing of a slice but its rows take the smaller
``STREAM_BYTES``. A null text has no bytes and so no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES, STREAM_BYTES = 1 << 21, 1 << 19
_BLOCK = 1 << 18
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_STEP = 0xD1342543DE82EF95


def byte_table(word_bytes, lower: bool = False) -> np.ndarray:
    """256 entries: 0 for a separator, else one more than the byte to hash."""
    table = np.zeros(256, np.uint16)
    for b in word_bytes:
        table[b] = (b + 32 if lower and 65 <= b <= 90 else b) + 1
    return table


SPACES = {0x20, *range(0x09, 0x0E)}
PLAIN = byte_table(b for b in range(256) if b not in SPACES)
LOWER = byte_table((b for b in range(256) if b not in SPACES), lower=True)
# letters and digits of ASCII, and everything beyond ASCII
ALNUM = byte_table(
    (b for b in range(256) if b >= 0x80 or chr(b).isalnum()), lower=True
)


class Words(NamedTuple):
    """One entry per word; ``first`` has the first word of each text, and the end."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.size = base, 0

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 2 * self.size, 1024)
            self.up = self._table(self.base)
            self.down = self._table(pow(self.base, -1, 1 << 64))
        return self.up[:n], self.down[:n]

    def _table(self, base: int) -> np.ndarray:
        table = np.full(self.size, base, _U)
        table[0] = 1
        return np.cumprod(table, dtype=_U)


_BYTE_POWERS, _WORD_POWERS = _Powers(_BASE), _Powers(_STEP)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Spread every input bit over all 64."""
    x = x + _U((seed * _BASE + _STEP) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted, each once: a plain sort is many times faster than ``np.unique`` of numpy 2.3."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, and ``len + 1`` offsets into them."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, places, data = texts.buffers()
    if places is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(places, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches, limit: int = SLICE_BYTES, rows: int = 4096) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Record batches cut into runs of whole rows, with the bytes of column ``text``."""
    for batch in batches:
        data, at = text_bytes(batch.column("text"))
        lo = 0
        while lo < batch.num_rows:
            hi = int(np.searchsorted(at, at[lo] + limit, side="right")) - 1
            hi = min(max(hi, lo + 1), lo + rows, batch.num_rows)
            yield batch.slice(lo, hi - lo), data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
            lo = hi


def split(data: np.ndarray, at: np.ndarray, table: np.ndarray, longest: int = 0) -> Words:
    """All words of all texts. A word never runs over the end of its text.

    With ``longest``, words of more bytes are cut into pieces of that many.
    """
    starts, ends, hashes = [], [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + _BLOCK, n)
        while hi < n:  # end a block at a separator, however far that is
            gap = np.flatnonzero(table[data[hi : hi + _BLOCK]] == 0)
            hi = hi + (int(gap[0]) if len(gap) else min(_BLOCK, n - hi))
            if len(gap):
                break
        code = table[data[lo:hi]]
        on = code != 0
        begins = on.copy()
        begins[1:] &= ~on[:-1]
        new = at[np.searchsorted(at, lo) : np.searchsorted(at, hi)] - lo
        begins[new] = on[new]
        stops = on.copy()
        stops[:-1] &= ~on[1:] | begins[1:]
        s, e = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if longest and len(s) and int((e - s).max()) > longest:
            number = (e - s + longest - 1) // longest
            nth = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
            s, e = np.repeat(s, number) + longest * nth, np.repeat(e, number)
            e = np.minimum(s + longest, e)
        up, down = _BYTE_POWERS(hi - lo)
        total = np.zeros(hi - lo + 1, _U)
        np.cumsum(code * up, out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s]))
        starts.append(s + lo)
        ends.append(e + lo)
        lo = hi
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    start, end, hashed = cat(starts, np.int64), cat(ends, np.int64), cat(hashes, _U)
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(doc, start, end, hashed, first)


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the ``n`` words from each place on, and whether they are of one text."""
    count = len(words.hash)
    if count < n:
        return np.zeros(0, _U), np.zeros(0, bool)
    up, down = _WORD_POWERS(count)
    total = np.zeros(count + 1, _U)
    np.cumsum(words.hash * up, out=total[1:])
    hashed = mix((total[n:] - total[:-n]) * down[: count - n + 1], n)
    return hashed, words.doc[: count - n + 1] == words.doc[n - 1 :]


def window_min(values: np.ndarray, n: int) -> np.ndarray:
    """Place of the least value in each run of ``n``; of equal ones the first."""
    count = len(values) - n + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    best, place = values[:count].copy(), np.arange(count)
    for i in range(1, n):
        less = values[i : i + count] < best
        best[less] = values[i : i + count][less]
        place[less] = np.flatnonzero(less) + i
    return place
