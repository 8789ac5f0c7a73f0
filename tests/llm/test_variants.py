import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from colophon.llm import variants
from tests.llm import brute
from tests.llm.conftest import HARD


def vocabulary(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = brute.lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(known):
    forms = {}
    for w, n in known.items():
        others = sorted((-known[o], o) for o in known if is_near(w, o))
        best = others[0] if others and -others[0][0] >= 2 * n else None
        forms[w] = (best and best[1], len(others), best and -best[0])
    out = Counter()
    for w, (form, count, form_n) in forms.items():
        root = w
        while forms[root][0]:
            root = forms[root][0]
        out[(w, form, root, known[w], count, form_n)] += 1
    return out


def crowded(n=700, seed=4):
    """Words so alike that most have near words, some with very long ones among them."""
    rng = random.Random(seed)
    known = {}
    for _ in range(n):
        w = "".join(rng.choice("abé") for _ in range(rng.randint(5, 8)))
        known[w] = rng.choice([3, 3, 4, 8, 20, 60])
    long = "x" * 300
    return known | {long: 9, long + "y": 3, long[1:]: 4, "y" + long: 50}


@pytest.mark.parametrize("block, queries", [(1 << 18, 1 << 14), (400, 1 << 14), (900, 30), (40, 7)])
def test_variants_of_a_crowded_vocabulary(spark, hard, monkeypatch, block, queries):
    monkeypatch.setattr(variants, "BLOCK", block)
    monkeypatch.setattr(variants, "QUERIES", queries)
    known = crowded()
    vocab = spark.createDataFrame(list(known.items()), "word string, n long").repartition(4)
    assert Counter(tuple(r) for r in variants.grouped(vocab).collect()) == plain(known)


def test_chain_of_forms(spark, hard):
    """Forms of forms, to the last."""
    known = {"abcdefgh"[:5] + "z" * i: 3 * 2**i for i in range(12)}
    vocab = spark.createDataFrame(list(known.items()), "word string, n long")
    got = variants.grouped(vocab).collect()
    assert Counter(tuple(r) for r in got) == plain(known) and len({r.root for r in got}) == 1


TEXTS = [
    *HARD, (None, "Straße STRASSE strasse straße strassé École école naïve×naïve÷x façade"),
    *[(i, "colour color colours coloúr Colour colouR tomorrow tommorow tomorow Ābcde abcdeĀ x中colour") for i in range(400)],
    (5000, "e" * 200_000 + " " + "f" * 70), (5000, None), (5001, "f" * 70 + "1" + "f" * 70),
]


def test_words_of_texts(spark, hard):
    docs = spark.createDataFrame([(*r, 1, "w") for r in TEXTS], "doc_id long, text string, n int, word string").repartition(3)
    known = vocabulary(TEXTS)
    assert dict(map(tuple, variants.vocabulary(docs).collect())) == known
    assert "colou" in known or "olour" in known  # made by a deletion alone
    assert Counter(tuple(r) for r in variants.variants(docs).collect()) == plain(known)


def test_suffix_ranks():
    """Every interval of the index is that of the words with the searched beginning."""
    listed = sorted({"banana", "bandana", "ananas", "nab", "an", "b", "banan"})
    index = variants.Index([w.encode("latin-1") for w in listed])
    for text in ("b", "ban", "an", "ana", "nab", "x", "banana", "bananab"):
        lo, hi = np.array([0]), np.array([len(listed)])
        for c in text.encode("latin-1"):
            lo, hi = index.narrow(np.array([c]), lo, hi)
        assert hi[0] - lo[0] == sum(w.startswith(text) for w in listed)
        a, b = index.narrow(np.array([0]), lo, hi)
        assert [listed[index.whole[i]] for i in range(a[0], b[0])] == [w for w in listed if w == text]


def test_empty_table(spark, hard):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants.variants(docs).count() == 0
