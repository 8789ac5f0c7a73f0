"""Plain Python statements of the rules, for comparison on small inputs."""

import re

BAD = {"0123456789"} | {str(d) * 10 for d in range(10)}
PATTERNS = {
    "isbn10": re.compile(r"[0-9\-\t\n\f\r ]+[0-9Xx]"),
    "isbn13": re.compile(r"[0-9\-\t\n\f\r ]+[0-9]"),
}


def valid10(s):
    """The weighted digits sum to a multiple of 11; only the last may be an X, counting 10."""
    if "X" in s[:-1]:
        return False
    digits = sum((10 - p) * int(c) for p, c in enumerate(s) if c in "0123456789")
    return (digits + 10 * s.endswith("X")) % 11 == 0


def valid13(s):
    return sum((3 if p % 2 else 1) * (ord(c) - 48) for p, c in enumerate(s)) % 10 == 0


def candidate(s):
    return len(s) in (10, 13) and not set(s) - set("0123456789Xx") and s not in BAD


def runs(text, kind):
    return PATTERNS[kind].findall(text)


def isbns(text, kind):
    cleaned = [re.sub(r"[-\t\n\f\r ]", "", r).upper() for r in runs(text, kind)]
    return [s for s in cleaned if candidate(s) and (valid10 if kind == "isbn10" else valid13)(s)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]
