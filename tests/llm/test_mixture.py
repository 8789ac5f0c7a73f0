import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from colophon.llm import mixture
from tests.llm import brute
from tests.llm.conftest import HARD


def plain(rows, weights=mixture.WEIGHTS, epochs=3):
    """``(doc_id, size, source_size, target, taken)`` of rows ``(doc_id, text, source)``."""
    size = [len(brute.words(t)) for _, t, _ in rows]
    whole = Counter()
    for n, (_, _, s) in zip(size, rows):
        whole[s] += n
    order = sorted(whole, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, left = set(), sum(whole.values())
    while True:
        share = left / (sum(weight[s] for s in order if s not in full) or 1)
        more = {s for s in order if s not in full and epochs * whole[s] < share * weight[s]}
        if not more:
            break
        full |= more
        left = sum(whole.values()) - epochs * sum(whole[s] for s in full)
    target = {s: float(epochs * whole[s]) if s in full else share * weight[s] for s in order}
    lines = defaultdict(list)
    for i, (doc, _, s) in enumerate(rows):
        digest = "" if doc is None else hashlib.md5(str(doc).encode()).hexdigest()
        lines[s].append((digest, doc is not None, doc or 0, size[i], i))
    taken = Counter()
    for s, line in lines.items():
        left = int(target[s] + 0.5)
        for _ in range(epochs):
            for *_, n, i in sorted(line):
                taken[i] += min(n, left)
                left -= min(n, left)
    return Counter((rows[i][0], size[i], whole[rows[i][2]], target[rows[i][2]], taken[i]) for i in range(len(rows)))


def made(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", 1, 2.0) for r in rows], "doc_id long, text string, source string, size string, part int, target double"
    ).repartition(5)


def got(df):
    return Counter(tuple(r) for r in df.select("doc_id", "size", "source_size", "target", "taken").collect())


SOURCES = ["b", None, "a", "é", "Z", "", "b"]
ROWS = [(i, t, SOURCES[n % 7]) for n, (i, t) in enumerate(HARD)]
HOT = [(n % 50, "w " * (n % 13), "big") for n in range(600)] + [(n, "x y", f"s{n % 90}") for n in range(300)]


@pytest.mark.parametrize("rows", [ROWS, HOT, [(1, None, None), (2, "", "a")], [(1, "a b c", "s")] * 40])
def test_mixture(spark, hard, rows):
    assert got(mixture.mixed(made(spark, rows))) == plain(rows)


def test_small_sources_pass_their_excess_on(spark, hard):
    rows = [(0, "a " * 1000, "a"), (1, "b", "b"), (2, "c " * 30, "c"), (3, "d", "d")]
    targets = {r.doc_id: r for r in mixture.mixed(made(spark, rows)).collect()}
    assert [targets[i].target for i in (1, 2, 3)] == [3.0, 90.0, 3.0]
    assert targets[0].target == 1032 - 96 and targets[0].taken == 936 and targets[2].taken == 90


def test_curriculum(spark, hard):
    out = mixture.curriculum(made(spark, HOT))
    rows = out.collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows) and all(0 <= r.position <= 1 for r in rows)
    assert sum(r.words for r in rows) == pytest.approx(sum(len(brute.words(t)) for _, t, _ in HOT), abs=100)
    assert sorted(rows) == sorted(mixture.curriculum(made(spark, HOT)).collect())


@pytest.mark.parametrize("knots, rates", [
    (mixture.KNOTS, mixture.RATES), ((0.0, 1.0), ((0.0, 2.0),)), ((0.0, 0.3, 0.6, 1.0), ((3.0, 0.0, 0.0, 1.0), (1.0, 4.0, 1.0, 0.0))),
])
def test_position_inverts_the_demand(spark, knots, rates):
    """The integral of the rate up to a position is the share that is due by then."""
    rows = spark.range(0, 400).select(((F.col("id") % 100) / 100).alias("share"), F.floor(F.col("id") / 100).alias("nth"))
    for r in rows.select("share", "nth", mixture.position(F.col("share"), F.col("nth"), knots, rates).alias("t")).collect():
        own = rates[r.nth % len(rates)]
        done = 0.0
        for k in range(1, len(knots)):
            lo, hi = knots[k - 1], min(max(r.t, knots[k - 1]), knots[k])
            slope = (own[k] - own[k - 1]) / (knots[k] - knots[k - 1])
            done += own[k - 1] * (hi - lo) + slope * (hi - lo) ** 2 / 2
        whole = mixture._integrals(knots, own)[1]
        assert done / whole == pytest.approx(r.share, abs=1e-9)


def test_empty_table(spark, hard):
    none = made(spark, HOT).limit(0)
    assert mixture.mixed(none).count() == 0 and mixture.curriculum(none).count() == 0
