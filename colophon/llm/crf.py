"""Linear-chain conditional random fields over tokens, in numpy batches.

Tokens are runs without ASCII white space. Features are the shape of a token and
of its neighbours (letters, capitals and digits as classes, runs collapsed), their
form (digits one by one, all signs alike), the signs between letters or
digits, their letters alone, their lower-cased
words, digit counts and lengths, and a feature of the whole text. Training is maximum likelihood by forward-backward over a small labelled
table; decoding is Viterbi.

Decoding is cut exactly: where label O beats all others by more than the
transitions on both sides can give back, every best path has O there, so only
the tokens between such places go through Viterbi, many runs at a time.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np

from colophon.llm import words

_U = np.uint64
_TABLE_BITS = 20
EPOCHS, RATE, DECAY = 50, 0.2, 1e-3

# classes of bytes: letters 1, capitals 2, digits 3, others themselves
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[128:] = 1
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58] = 1, 2, 3
for _b in (32, 9, 10, 11, 12, 13):
    _SHAPE[_b] = 0
_BUCKET = np.array([0, 1, 2, 3, 4, 5, 5, 5, 6, 6, 6, 6, 7, 7, 8, 8, 9, 9, 9, 9] + [10] * 12 + [11] * 33, np.uint64)


class Tokens(NamedTuple):
    """Tokens and the feature keys that they share.

    Most keys depend on a token's kind alone, what it is written like; kinds are few, so
    weights are looked up per kind. A row is added behind the kinds for the ends of a text.
    """

    found: words.Words
    kind: np.ndarray  # per token
    before: np.ndarray  # the kind of the token before, or the last row
    after: np.ndarray
    own: np.ndarray  # (kinds, slots) of a token itself
    left: np.ndarray  # of the token before it
    right: np.ndarray  # of the token after it
    wide: np.ndarray  # (places, 1): digits of three tokens
    wide_at: np.ndarray
    busy: np.ndarray  # (kinds * 4, 1): shape and how busy the text is with signs
    busy_at: np.ndarray

    def groups(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Feature keys and, per token, the row of them."""
        return [
            (self.own, self.kind), (self.left, self.before), (self.right, self.after),
            (self.wide, self.wide_at), (self.busy, self.busy_at),
        ]

    @property
    def keys(self) -> np.ndarray:
        """(tokens, slots)"""
        return np.concatenate([keys[at] for keys, at in self.groups()], axis=1)


def _buckets(counts: np.ndarray) -> np.ndarray:
    return _BUCKET[np.minimum(counts, len(_BUCKET) - 1)]


def _sums(flags: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[end] - total[start]


def _hashed(values: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each token's values; ``values`` lie at ``place``, in order."""
    up, down = words._BYTE_POWERS(len(place) + 1)
    total = np.zeros(len(place) + 1, _U)
    np.cumsum(values * up[: len(place)], out=total[1:])
    s, e = np.searchsorted(place, start), np.searchsorted(place, end)
    return words.mix((total[e] - total[s]) * down[s])


def tokens(data: np.ndarray, at: np.ndarray) -> Tokens:
    """Tokens of all texts with their feature keys."""
    found = words.split(data, at, words.LOWER)
    start, end = found.start, found.end
    count = len(start)
    code = _SHAPE[data]
    change = np.ones(len(code), bool)
    change[1:] = code[1:] != code[:-1]
    change[start] = True
    place = np.flatnonzero((code != 0) & change)
    shape = _hashed(code[place], place, start, end)  # runs of letters, capitals, digits and each sign

    # kinds: equal but for the letters' case, and of equal shape
    mixed = found.hash ^ words.mix(shape, 3)
    _, first, kind = np.unique(mixed, return_index=True, return_inverse=True)
    kinds, s, e = len(first), start[first], end[first]
    word, shape = found.hash[first], shape[first]
    digits, length = _buckets(_sums(code == 3, s, e)), _buckets(e - s)
    # digits one by one, any signs alike
    plain = np.where(code > 3, _U(4), code)
    step = np.ones(len(plain), bool)
    step[1:] = (plain[1:] != plain[:-1]) | (plain[1:] == 3)
    step[start] = True
    place = np.flatnonzero((plain != 0) & step)
    form = _hashed(plain[place], place, s, e)
    # signs between letters or digits, whichever
    rough = np.where((code > 0) & (code <= 3), _U(1), code)
    step = np.ones(len(rough), bool)
    step[1:] = rough[1:] != rough[:-1]
    step[start] = True
    place = np.flatnonzero((rough != 0) & step)
    mask = _hashed(rough[place], place, s, e)
    # letters alone, of any case
    place = np.flatnonzero((code == 1) | (code == 2))
    core = _hashed(words.LOWER[data[place]].astype(_U), place, s, e)

    def slots(number: int, *values: np.ndarray) -> np.ndarray:
        rows = [words.mix(np.append(v, _U(7)), number + i) for i, v in enumerate(values)]
        return np.stack(rows, axis=1)

    head, tail = np.zeros(count, bool), np.zeros(count, bool)
    some = found.first[1:] > found.first[:-1]
    head[found.first[:-1][some]] = True
    tail[found.first[1:][some] - 1] = True
    before, after = np.full(count, kinds), np.full(count, kinds)
    before[1:] = kind[:-1]
    after[:-1] = kind[1:]
    before[head], after[tail] = kinds, kinds

    marks = _sums((code > 3) & (code != 44) & (code != 46), at[:-1], at[1:])
    busy = np.minimum(16 * marks // np.maximum(np.diff(at), 1), 3)[found.doc]
    each = np.repeat(shape, 4) ^ (np.tile(np.arange(4, dtype=_U), kinds) + _U(1)) * _U(0x9E3779B97F4A7C15)
    count_of = np.append(digits, _U(15))
    wide, wide_at = np.unique(
        count_of[before] * _U(256) + count_of[kind] * _U(16) + count_of[after], return_inverse=True
    )
    return Tokens(
        found, kind, before, after,
        slots(50, word, shape, form, core, digits * _U(16) + length, words.mix(shape, 5) ^ digits * _U(32) ^ length, mask),
        slots(60, word, shape, form, core), slots(70, word, shape, form, core),
        words.mix(wide, 80)[:, None], wide_at, words.mix(each, 90)[:, None], kind * 4 + busy,
    )


class Model(NamedTuple):
    """Labels (``O`` first), known feature keys, their weights, and transitions.

    ``longest`` is the most tokens that a labelled span of a kind has: a longer chain
    is outside of what was learned, and is no span.
    """

    labels: tuple[str, ...]
    keys: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    longest: dict[str, int]


class Lookup:
    """Feature keys to rows of the weights; row 0 is for unknown keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.table = np.zeros(1 << _TABLE_BITS, np.int32)
        self.table[(keys[1:] >> _U(64 - _TABLE_BITS)).astype(np.int64)] = np.arange(1, len(keys))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        row = self.table[(keys >> _U(64 - _TABLE_BITS)).astype(np.int64)]
        return np.where(self.keys[row] == keys, row, 0)


_MARK = re.compile(r"<(\w+)>(.*?)</\1>", re.S)


def _read(example: str, labels: Sequence[str]) -> tuple[bytes, list[tuple[int, int, str]]]:
    """A text with ``<kind>...</kind>`` around its spans, to bytes and byte spans."""
    plain, spans, last = "", [], 0
    for m in _MARK.finditer(example):
        plain += example[last : m.start()]
        start = len(plain.encode())
        plain += m[2]
        spans.append((start, len(plain.encode()), m[1]))
        last = m.end()
    return (plain + example[last:]).encode(), spans


def train(examples: Sequence[str], kinds: Sequence[str]) -> Model:
    """Fit on texts whose spans are marked up as ``<kind>...</kind>``."""
    labels = ("O", *[f"{p}-{k}" for k in kinds for p in "BI"])
    texts = [_read(x, labels) for x in examples]
    data = np.frombuffer(b"".join(t for t, _ in texts), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t) for t, _ in texts])])
    read = tokens(data, at)
    found = read.found
    gold = np.zeros(len(found.start), np.int64)
    reach = dict.fromkeys(kinds, 0)
    for i, (_, spans) in enumerate(texts):
        for lo, hi, kind in spans:
            first, last = found.first[i], found.first[i + 1]
            inside = [t for t in range(first, last) if found.start[t] < at[i] + hi and found.end[t] > at[i] + lo]
            reach[kind] = max(reach[kind], len(inside))
            for n, t in enumerate(inside):
                gold[t] = labels.index(f"{'I' if n else 'B'}-{kind}")
    every = read.keys
    seen, n = np.unique(every, return_counts=True)
    seen = seen[n >= 2]
    slot = seen >> _U(64 - _TABLE_BITS)
    seen = seen[np.concatenate([[True], slot[1:] != slot[:-1]])]  # one key per place of the table
    keys = np.concatenate([np.zeros(1, _U), seen])
    rows = Lookup(keys)(every)
    size = np.diff(found.first)
    longest = int(size.max())
    place = found.first[:-1, None] + np.arange(longest)
    real = np.arange(longest) < size[:, None]
    x = np.where(real[:, :, None], rows[np.minimum(place, len(rows) - 1)], 0)
    y = np.where(real, gold[np.minimum(place, len(gold) - 1)], 0)
    weights, moves = _fit(x, y, real, len(keys), len(labels))
    return Model(labels, keys, weights.astype(np.float32), moves.astype(np.float32), reach)


def _sum_exp(v: np.ndarray, axis: int) -> np.ndarray:
    top = v.max(axis=axis, keepdims=True)
    return (np.log(np.exp(v - top).sum(axis=axis, keepdims=True)) + top).squeeze(axis)


def _fit(x, y, real, n_keys: int, n_labels: int):
    """Adam steps on the mean log-likelihood."""
    params = [np.zeros((n_keys, n_labels)), np.zeros((n_labels, n_labels))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    one = np.eye(n_labels)
    both = real[:, :-1] & real[:, 1:]
    for step in range(1, EPOCHS + 1):
        weights, moves = params
        grad = _gradient(weights[x].sum(axis=2), moves, y, real, both, one)
        flat = x.reshape(-1, x.shape[2])
        dw = np.stack([
            np.bincount(flat.ravel(), np.repeat(grad[0][..., c].ravel(), flat.shape[1]), n_keys) for c in range(n_labels)
        ], axis=1)
        dw[0] = 0
        for i, g in enumerate((dw, grad[1])):
            g = g / len(x) + DECAY * params[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] = params[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)
        params[0][0] = 0
    return params


def _gradient(emit, moves, y, real, both, one):
    """Expected less observed counts, for emissions and transitions."""
    rows, longest, n = emit.shape
    ahead = np.zeros_like(emit)
    ahead[:, 0] = emit[:, 0]
    for t in range(1, longest):
        new = _sum_exp(ahead[:, t - 1, :, None] + moves, 1) + emit[:, t]
        ahead[:, t] = np.where(real[:, t, None], new, ahead[:, t - 1])
    norm = _sum_exp(ahead[:, -1], 1)
    behind = np.zeros_like(emit)
    for t in range(longest - 2, -1, -1):
        new = _sum_exp(moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        behind[:, t] = np.where(real[:, t + 1, None], new, 0)
    node = np.exp(np.minimum(ahead + behind - norm[:, None, None], 0)) * real[..., None]
    pair = ahead[:, :-1, :, None] + moves + (emit + behind)[:, 1:, None, :] - norm[:, None, None, None]
    pair = (np.exp(np.minimum(pair, 0)) * both[..., None, None]).sum(axis=(0, 1))
    gold = (one[y] * real[..., None])
    seen = np.zeros_like(pair)
    np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1)
    return node - gold, pair - seen


def decode(model: Model, lookup: Lookup, read: Tokens) -> np.ndarray:
    """The best label number of every token."""
    count = len(read.found.start)
    best = np.zeros(count, np.int64)
    if not count:
        return best
    emit = np.zeros((count, len(model.labels)), np.float32)
    for keys, place in read.groups():
        emit += model.weights[lookup(keys)].sum(axis=1)[place]
    slack = 2 * (model.moves.max() - model.moves.min())
    open_ = np.flatnonzero(emit[:, 0] - emit[:, 1:].max(axis=1) <= slack)
    if not len(open_):
        return best
    own = read.found.doc[open_]
    new = np.ones(len(open_), bool)
    new[1:] = (np.diff(open_) != 1) | (own[1:] != own[:-1])
    begin = open_[new]
    end = np.append(open_[np.flatnonzero(new)[1:] - 1], open_[-1]) + 1
    size = end - begin
    has_left = begin > read.found.first[:-1][read.found.doc[begin]]
    has_right = end < read.found.first[1:][read.found.doc[begin]]
    for length in np.unique(size):
        here = size == length
        cells = begin[here, None] + np.arange(length)
        e = emit[cells].copy()
        e[:, 0] += np.where(has_left[here, None], model.moves[0], 0)
        e[:, -1] += np.where(has_right[here, None], model.moves[:, 0], 0)
        score, back = e[:, 0], []
        for t in range(1, length):
            step = score[:, :, None] + model.moves
            back.append(step.argmax(axis=1))
            score = step.max(axis=1) + e[:, t]
        last = score.argmax(axis=1)
        best[cells[:, -1]] = last
        for t in range(length - 2, -1, -1):
            last = back[t][np.arange(len(last)), last]
            best[cells[:, t]] = last
    return best


_TRIM = np.zeros(256, bool)
_TRIM[[ord(c) for c in "\"'`()[]{}<>,;:.!?#$%&*|="]] = True


def spans(model: Model, lookup: Lookup, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, str]]:
    """``(text, start, end, kind)`` in bytes of the slice, without punctuation at the ends."""
    read = tokens(data, at)
    label = decode(model, lookup, read)
    out = []
    hit = np.flatnonzero(label)
    kind_of = [n[2:] for n in model.labels]
    i = 0
    while i < len(hit):
        t = hit[i]
        j, kind, doc = i + 1, kind_of[label[t]], read.found.doc[t]
        while (
            j < len(hit) and hit[j] == hit[j - 1] + 1 and read.found.doc[hit[j]] == doc
            and label[hit[j]] % 2 == 0 and kind_of[label[hit[j]]] == kind
        ):
            j += 1
        size, i = j - i, j
        if size > model.longest[kind]:
            continue
        lo, hi = int(read.found.start[t]), int(read.found.end[hit[j - 1]])
        while lo < hi and _TRIM[data[lo]] and data[lo] != 40:
            lo += 1
        while lo < hi and _TRIM[data[hi - 1]]:
            hi -= 1
        if lo < hi:
            out.append((int(doc), lo, hi, kind))
    return out
