import hashlib
import zlib
from collections import Counter, defaultdict

import pytest

from colophon.llm import trie
from tests.llm.conftest import LONG


def rebuilt(rows):
    """conv_id -> rebuilt list of (role, text)."""
    said = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            r, x = role or "", text or ""
            digest = hashlib.md5(r.encode()).hexdigest() + hashlib.md5(x.encode()).hexdigest()
            said[c].append(((turn is not None, turn or 0, r[:32].encode(), x[:32].encode(), digest), (r, x)))
    said = {c: [t for _, t in sorted(v)] for c, v in said.items()}
    out = {}
    for c, own in said.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = said.get(base, [])[:h] + own[h:]
    return out


def plain(whole):
    """The nodes' rows, from conv_id -> list of turns."""
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    below = {p: [q for q in members if q[: len(p)] == p] for p in members}
    children = {p: [q for q in below[p] if len(q) == len(p) + 1] for p in members}
    out = Counter()
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(p))
        out[(
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]),
            sum(not children[q] for q in below[p]),
            sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below[p] if q),
            hashlib.sha256(ends.encode()).hexdigest(),
        )] += 1
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1, 2) for r in rows], "conv_id long, turn int, role string, text string, part string, depth int, at long"
    ).repartition(5)


def got(df):
    assert df.columns == COLUMNS
    return Counter(tuple(r) for r in df.collect())


HARD = [
    (0, 0, "user", "hi"), (0, 1, "bot", "hé"), (0, 2, "user", None), (0, 3, None, "x"), (0, 4, "user", LONG),
    (1, 0, "user", "hi"), (1, 1, "bot", "hé"), (1, 2, "user", ""), (1, None, "bot", "before"), (2, 5, "user", "hi"),
    (3, 1, "user", "hi"), (3, 1, "user", "hi"), (3, 1, "bot", "hi"), (4, 1, "", None), (-7, 1, "a", "b"), (-5, 1, "a", "c"), (-5, 2, "a", "d"),
    (None, 1, "user", "lost"), (11, 1, "user", "no base"), (12, 1, "user", "no base"), (13, 1, "user", "no base"),
    *[(20, n, "user", f"turn {n}") for n in range(30)], *[(21, n, "bot", f"own {n % 2}") for n in range(30)],
    *[(22, n, "bot", f"own {n % 2}") for n in range(25)],
]
# one conversation with most rows, many equal ones, one first turn that all share
HOT = [(500, n, "user", f"t{n}") for n in range(900)] + [(504, n, "user", f"t{n}") for n in range(700)] + [
    (1000 + c, t, "user", "hello" if t == 0 else f"say {c % 3} {t}") for c in range(200) for t in range(3)
] + [(7, None, "user", "same")] * 300


@pytest.mark.parametrize("rows", [HARD, HOT, [(c, 0, "user", "only") for c in range(60)], [(11, 1, "a", "b"), (11, None, "a", "c")]])
def test_trie_of_rebuilt_conversations(spark, hard, rows):
    out = trie.trie(*trie.rebuilt(trie.turns(made(spark, rows))))
    assert got(out) == plain(rebuilt(rows))


def test_trie_of_plain_conversations(spark, hard):
    said = defaultdict(list)
    rows = [(c, t, "user", f"{t if t < 3 else c}") for c in range(40) for t in range(c % 7 + 1)]
    for c, _, r, x in rows:
        said[c].append((r, x))
    placed = trie.turns(made(spark, rows))
    assert got(trie.trie(*trie.plain(placed))) == plain(said)


def test_nodes_of_many_children_are_split(spark, hard):
    rows = [(c, t, "user", f"{c if t else 'first'}") for c in range(300) for t in range(2)]
    out = trie.trie(*trie.plain(trie.turns(made(spark, rows))), min_hot=20)
    assert got(out) == plain({c: [("user", "first"), ("user", str(c))] for c in range(300)})


def test_end_lists_longer_than_a_chunk(spark, hard, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 7)
    rows = [(c, 0, "user", "same") for c in range(100)]
    out = trie.trie(*trie.plain(trie.turns(made(spark, rows)))).where("depth = 1").collect()
    assert [r.ends_sha256 for r in out] == [hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest()]


def test_empty_table(spark, hard):
    none = made(spark, HARD).limit(0)
    assert trie.trie(*trie.rebuilt(trie.turns(none))).count() == 0
