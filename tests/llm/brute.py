"""The operators' contracts, written plainly over lists in memory."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

SPACE_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM_WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return SPACE_WORDS.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def substrings(rows, window=20):
    first = {}
    order = lambda i: (i is not None, i or 0)
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - window + 1):
            key, place = tuple(w[s : s + window]), (order(i), s)
            first[key] = min(first.get(key, place), place)
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (order(i), s):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


def contamination(rows, items, window=10):
    cut = []
    for item, t in items:
        w = ALNUM_WORDS.findall(lower(t))
        n = min(window, len(w))
        cut += [(item, tuple(w[s : s + n])) for s in range(len(w) - n + 1) if n]
    out = []
    for i, t in rows:
        w = ALNUM_WORDS.findall(lower(t))
        hit, ids, counted = set(), set(), set()
        for item, g in cut:
            for s in range(len(w) - len(g) + 1):
                if tuple(w[s : s + len(g)]) == g:
                    hit.update(range(s, s + len(g)))
                    counted.add(item)
        ids = sorted(str(x) for x in counted if x is not None)
        out.append((i, len(w), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def shingles(text, size):
    w = words(lower(text))
    n = min(size, len(w))
    return {tuple(w[s : s + n]) for s in range(len(w) - n + 1)} if n else set()


def near(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            s = len(sets[a] & sets[b])
            # without an id only a copy can be linked
            least = 80 if None not in (rows[a][0], rows[b][0]) else 100
            if s and 100 * s >= least * len(sets[a] | sets[b]) or sets[a] and sets[b] and rows[a][0] == rows[b][0] is not None:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for n, (i, _) in enumerate(rows):
        if i is not None:
            least[find(n)].append(i)
    out = []
    for n, (i, _) in enumerate(rows):
        component = min(least[find(n)], default=None) if sets[n] else i
        out.append((i, len(sets[n]), component, component is None or i == component))
    return out


def spans(text, kinds):
    """``kinds``: name -> (compiled pattern, test of a match)."""
    found = []
    for k, (name, (pattern, good)) in enumerate(kinds.items()):
        found += [(m.start(), k, m.end(), name) for m in pattern.finditer(text or "") if good(m)]
    found.sort()
    return found, ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)


def luhn(s):
    d = [int(c) for c in re.sub("[^0-9]", "", s)][::-1]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d)) % 10 == 0


def _digits(s):
    return len(re.sub("[^0-9]", "", s))


PII = {
    "email": (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m: True),
    "ip": (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m: all(int(p) <= 255 for p in m[0].split("."))),
    "card": (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m: 14 <= _digits(m[0]) <= 19 and luhn(m[0])),
    "phone": (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m: 10 <= _digits(m[0]) <= 15),
}
SECRETS = {
    "assign": (
        re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
        lambda m: len(m[2]) >= 12,
    ),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def katz(rows, k=5, left=1e-3):
    """Scores, and the share of every word after every history (None: unknown word)."""
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    streams = [(i, words(lower(t)) + ["</end>"]) for i, t in rows]
    one, two = Counter(), Counter()
    for i, s in streams:
        if not held(i):
            one.update(s)
            two.update(zip(["<start>", *s], s))
    total = sum(one.values())
    history = Counter(one)
    history["<start>"] = sum(not held(i) for i, _ in streams)

    def discounts(counts):
        n = Counter(counts.values())
        n = [n[r] for r in range(1, k + 2)]
        if all(n[:k]) and n[0] != (k + 1) * n[k]:
            top = (k + 1) * n[k] / n[0]
            d = [((r + 1) * n[r] / n[r - 1] / r - top) / (1 - top) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return d
        less = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        return [(r - less) / r for r in range(1, k + 1)]

    d1, d2 = discounts(one), discounts(two)
    cut = lambda c, d: c * d[c - 1] if c <= k else c - left
    unknown = 1 - sum(cut(c, d1) for c in one.values()) / total if total else 1.0
    single = lambda w: cut(one[w], d1) / total if w in one else unknown
    after = defaultdict(set)
    for h, w in two:
        after[h].add(w)

    def share(h, w):
        if two[h, w]:
            return cut(two[h, w], d2) / history[h]
        if not history[h]:
            return single(w)
        rest = 1 - sum(cut(two[h, x], d2) for x in after[h]) / history[h]
        return rest / (1 - sum(single(x) for x in after[h])) * single(w)

    out = []
    for i, s in streams:
        base = sum(math.log10((one[w] + 1) / (total + len(one) + 1)) for w in s)
        score = sum(math.log10(share(h, w)) for h, w in zip(["<start>", *s], s))
        out.append((i, held(i), len(s), sum(w in one for w in s), total, base, score))
    return out, share, one
