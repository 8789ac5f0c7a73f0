"""Spans found by fixed patterns, joined by those that a trained tagger adds.

What PII and secret scans share: spans of a text are ``(start, end, kind)`` in code
points, end exclusive. Pattern spans always stay; a tagger's span is added where
it overlaps none of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa

from colophon.llm import crf, words

# spans of a slice: (text, start, end, kind) in bytes
Matcher = Callable[[np.ndarray, np.ndarray, bytes], list[tuple[int, int, int, str]]]

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def byte_set(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


def runs(flags: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of set flags that stay in one text."""
    begins, stops = flags.copy(), flags.copy()
    inner = at[(at > 0) & (at < len(flags))]
    begins[1:] &= ~flags[:-1]
    stops[:-1] &= ~flags[1:]
    begins[inner] = flags[inner]
    stops[inner - 1] = flags[inner - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def text_of(at: np.ndarray, places) -> np.ndarray:
    return np.searchsorted(at, places, side="right") - 1


@lru_cache(maxsize=4)
def trained(examples: Callable[[], Sequence[str]], kinds: tuple[str, ...]) -> crf.Model:
    """One fit per table of examples and driver process."""
    return crf.train(examples(), kinds)


def _joined(spans, kinds: Sequence[str]) -> str:
    order = sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def anything(kind: str, span: bytes) -> bool:
    return True


def found(match: Matcher, model: crf.Model, lookup: crf.Lookup, data: np.ndarray, at: np.ndarray, check=anything):
    """Per text with any span ``(pattern spans, added spans)``, in bytes of the slice.

    ``check`` is the exact test that a tagger's span of a kind must pass.
    """
    raw = data.tobytes()
    base: dict[int, list] = {}
    for doc, lo, hi, kind in match(data, at, raw):
        base.setdefault(int(doc), []).append((int(lo), int(hi), kind))
    added: dict[int, list] = {}
    for doc, lo, hi, kind in crf.spans(model, lookup, data, at):
        if check(kind, raw[lo:hi]) and all(hi <= a or lo >= b for a, b, _ in base.get(doc, ())):
            added.setdefault(doc, []).append((lo, hi, kind))
    return base, added


def digest(match: Matcher, model: crf.Model, base_kinds: Sequence[str], kinds: Sequence[str], check=anything):
    """Arrow batches of ``doc_id, text`` to counts, digest and spans per row."""

    def of(batches):
        lookup = crf.Lookup(model.keys)
        for rows, data, at in words.slices(batches):
            base, added = found(match, model, lookup, data, at, check)
            n = rows.num_rows
            counts = np.zeros((len(base_kinds), n), np.int64)
            sha, listed = [EMPTY_SHA] * n, [""] * n
            if base or added:
                # code points before each byte
                points = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=points[1:])
            for doc in base.keys() | added.keys():
                zero = points[at[doc]]
                turn = lambda s: [(int(points[a] - zero), int(points[b] - zero), k) for a, b, k in s]  # noqa: B023, E731
                own, more = turn(base.get(doc, ())), turn(added.get(doc, ()))
                for _, _, kind in own:
                    counts[base_kinds.index(kind), doc] += 1
                sha[doc] = hashlib.sha256(_joined(own, kinds).encode()).hexdigest()
                listed[doc] = _joined(own + more, kinds)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), *[pa.array(c) for c in counts], pa.array(sha), pa.array(listed)],
                ["doc_id", *[f"n_{k}" for k in base_kinds], "base_sha256", "spans"],
            )

    return of


def schema(base_kinds: Sequence[str]) -> str:
    return "doc_id long, " + "".join(f"n_{k} long, " for k in base_kinds) + "base_sha256 string, spans string"
