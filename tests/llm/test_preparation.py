import hashlib
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as files
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colophon.llm import (
    debruijn, decontaminate, fingerprint, katz, near, oracles, pack, pii, registry, rotate, secrets, sketch, toxicity, words,
)
from tests.llm import brute, heldout
from tests.llm.conftest import HARD, LONG, PASSAGE
from workload.check import connection, spark_rows, sql_rows


def bag(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def small(spark, sf, hard):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_sql(spark, sf, con, name, hard):
    assert spark_rows(registry.QUERIES[name](spark, sf)) == sql_rows(con, oracles.SQL[name])


# words and sketches


def test_words_are_those_of_the_pattern():
    for table, find in ((words.PLAIN, brute.SPACE_WORDS), (words.ALNUM, brute.ALNUM_WORDS)):
        texts = [t or "" for _, t in HARD]
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        at = np.cumsum([0, *(len(t.encode()) for t in texts)])
        found = words.split(data, at, table)
        for i, t in enumerate(texts):
            got = [data[a:b].tobytes().decode() for a, b in zip(found.start, found.end)][found.first[i] : found.first[i + 1]]
            assert [brute.lower(w) for w in got] == find.findall(brute.lower(t))
    same = words.split(np.frombuffer(b"ab ab abc", np.uint8), np.array([0, 9]), words.PLAIN).hash
    assert same[0] == same[1] != same[2]


def test_sketch_estimates_similarity_and_fills():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 62, 800).astype(np.uint64)
    a, b = (np.concatenate([shared, rng.integers(0, 1 << 62, 100).astype(np.uint64)]) for _ in range(2))
    one = shared[:1]
    rows = sketch.sketches(np.concatenate([a, b, one]), np.array([0, 900, 1800, 1801, 1801]), 640)
    assert (rows[:3] != np.uint64(0xFFFFFFFFFFFFFFFF)).all() and (rows[3] == np.uint64(0xFFFFFFFFFFFFFFFF)).all()
    assert abs((rows[0] == rows[1]).mean() - 0.8) < 0.06


def test_sketch_keeps_coordinates_of_earlier_rounds():
    """Enough sets whose first round leaves a bin open, each against its bins of that round."""
    rng = np.random.default_rng(2)
    replaced = opened = 0
    for _ in range(60):
        one = np.unique(rng.integers(0, 1 << 62, 400).astype(np.uint64))
        value = words.mix(one, 1)
        at = (value % np.uint64(64)).astype(int)
        least = np.full(64, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(least, at, value)
        filled = np.bincount(at, minlength=64) > 0
        got = sketch.sketches(one, np.array([0, len(one)]), 64)[0]
        opened += not filled.all()
        # a coordinate has the leading bits of its value, 53 or 54 of them
        kept = (got == least >> np.uint64(10)) | (got == least >> np.uint64(11))
        replaced += (filled & ~kept).sum()
    assert opened and not replaced


# op1


def test_substrings(hard, small):
    assert bag(debruijn.without_repeats(hard).collect()) == bag(brute.substrings(HARD))
    assert bag(debruijn.without_repeats(small[0], 8, 3).collect()) == bag(brute.substrings(small[1], 8))


# op2

ITEMS = [("b1", PASSAGE), ("b2", "Lazy DOG"), ("b3", None), (None, "quick brown"), ("b1", "sings a"), ("b4", "!!!"), ("b5", LONG[-300:])]


def test_contamination(spark, hard, small, sf):
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert bag(decontaminate.contamination(hard, items).collect()) == bag(brute.contamination(HARD, ITEMS))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = [(r.item_id, r.text) for r in bench.collect()]
    assert bag(decontaminate.contamination(small[0], bench).collect()) == bag(brute.contamination(small[1], rows))
    kept = decontaminate.without_contaminated(hard, items)
    assert kept.columns == hard.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 6, 7, 12, 13, 14}


def test_contamination_without_broadcast(spark, hard, monkeypatch):
    monkeypatch.setattr("colophon.llm.tables.SMALL_ROWS", 0)
    monkeypatch.setattr(decontaminate, "sized", lambda df, n: df)
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert bag(decontaminate.contamination(hard, items).collect()) == bag(brute.contamination(HARD, ITEMS))


# op3


def test_packing(hard, small):
    from tokenizers import Tokenizer

    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs, rows in ((hard, HARD), small):
        got = pack.packed(docs, 1024).collect()
        ids = [(i, [*exact.encode(t or "", add_special_tokens=False).ids, 2]) for i, t in rows]
        want = []
        for i, tokens in ids:
            start, stop, piece = 0, len(tokens) % 1024 or 1024, 0
            while start < len(tokens):
                cut = tokens[start:stop]
                want.append((i, piece, start, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
                start, stop, piece = stop, stop + 1024, piece + 1
        assert bag(r[:5] for r in got) == bag(want)
        check_layout(got, 1024)
        least = -(-sum(r.length for r in got) // 1024)
        assert len({r.sequence_id for r in got}) <= 1.02 * least + 1


def check_layout(rows, capacity):
    held = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == held.get(r.sequence_id, 0)
        held[r.sequence_id] = r.offset + r.length
        assert held[r.sequence_id] <= capacity


def test_plan_places_each_piece_once():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 101, 5000), np.full(999, 33), np.array([100, 1]), rng.integers(1, 6, 3000)):
        counts = Counter(sizes.tolist())
        ranges = pack.plan(counts, 100)
        full = Counter()
        for size in counts:
            mine = sorted(r[1:] for r in ranges if r[0] == size)
            assert mine[0][0] == 0 and mine[-1][1] == counts[size]
            assert all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
            for lo, hi, first, _ in mine:
                full.update({first + n: size for n in range(hi - lo)})
        assert max(full.values()) <= 100
        assert len(full) <= 1.03 * -(-sum(sizes) // 100) + 2


# op4 and op10


@pytest.mark.parametrize("module, kinds", [(pii, brute.PII), (secrets, brute.SECRETS)])
def test_spans(hard, small, module, kinds):
    extra = [] if module is pii else [secrets.TAGGED]
    for docs, rows in ((hard, HARD), small):
        got = module.spans(docs).collect()
        want = []
        for i, t in rows:
            found, joined = brute.spans(t, kinds)
            want.append((i, *(sum(f[3] == k for f in found) for k in kinds), brute.sha(joined)))
        assert bag(r[:-1] for r in got) == bag(want)
        texts = {i: t or "" for i, t in rows}
        for r in got:
            spans = [s.split(":") for s in r.spans.split(",") if s]
            assert all(k in [*kinds, *extra] and 0 <= int(a) < int(b) <= len(texts[r.doc_id]) for k, a, b in spans)
            assert [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)
            base = [f"{n}:{a}:{b}" for a, _, b, n in brute.spans(texts[r.doc_id], kinds)[0]]
            assert set(base) <= set(r.spans.split(",")) | {""}


@pytest.mark.parametrize("module, kinds", [(pii, pii.KINDS), (secrets, (secrets.TAGGED,))])
def test_tagger_on_held_out_rows(module, kinds):
    from colophon.llm import crf, tagging

    model = tagging.trained(module.examples, kinds)
    lookup, right, gold_n, got_n = crf.Lookup(model.keys), 0, 0, 0
    for example in module.examples(300, 99):
        raw, gold = crf._read(example, model.labels)
        got = {(a, b, k) for _, a, b, k in crf.spans(model, lookup, np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))}
        right, gold_n, got_n = right + len(got & set(gold)), gold_n + len(gold), got_n + len(got)
    assert right / gold_n > 0.9 and right / got_n > 0.9


@pytest.mark.parametrize("module, kind, recall", [(pii, "phone", 0.9), (pii, "card", 0.9), (pii, "email", 0.7), (secrets, "secret", 0.85)])
def test_tagger_on_forms_from_elsewhere(spark, small, module, kind, recall):
    """Forms that no labelled row has, inserted into documents: most are found, nothing else is."""
    rng = np.random.default_rng(3)
    texts = [t[:4000] for _, t in small[1] if t]
    made = list(heldout.inserted(rng, texts, getattr(heldout, kind), 200))
    rows = [(i, t) for i, (t, _, _) in enumerate(made)]
    model = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    plain = {r.doc_id: r.spans for r in module.spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = other = 0
    for r in module.spans(model).collect():
        _, lo, hi = made[r.doc_id]
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        found += any(k == kind and a <= lo and b >= hi and b - a <= 1.3 * (hi - lo) for k, a, b in spans)
        other += len([s for s in spans if s[1] >= hi or s[2] <= lo]) - len([s for s in plain[r.doc_id % len(texts)].split(",") if s])
    assert found / len(made) >= recall and abs(other) <= 0.05 * len(made)


def test_chain_of_fillers_is_no_personal_data(spark, hard):
    text = "De " + "De, " * 200 + "end " + "AT!! THIS!! " * 40
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert pii.spans(docs).first().spans == "" and pii.masked(docs).first().text == text


def test_decoding_equals_plain_viterbi():
    from colophon.llm import crf, tagging

    model = tagging.trained(pii.examples, pii.KINDS)
    raw = " ".join(crf._read(e, model.labels)[0].decode() for e in pii.examples(40, 5)).encode()
    read = crf.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    lookup = crf.Lookup(model.keys)
    emit = model.weights[lookup(read.keys)].sum(axis=1)
    score, back = emit[0], []
    for e in emit[1:]:
        step = score[:, None] + model.moves
        back.append(step.argmax(axis=0))
        score = step.max(axis=0) + e
    path = [int(score.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    assert crf.decode(model, lookup, read).tolist() == path[::-1]


def test_numbers_of_any_length(spark, hard):
    texts = ["0" * 5000 + ".1.1.1 9" * 3, "1.2.3.4." * 5000, "7" * 2_000_000 + "@" + "x." * 3000 + "y", "256.1.1.1 00255.0.0.01"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.spans(docs).collect()}
    assert [got[i].n_ip for i in range(4)] == [3, 5000, 0, 1] and got[2].n_email == 1
    assert {r.text for r in pii.masked(docs).where("doc_id = 1").collect()} == {"[IP]." * 5000}


def test_masking(hard):
    out = {r.source: r for r in pii.masked(hard.withColumn("n_chars", F.length("text"))).collect()}
    text = out["s14"].text
    assert "[EMAIL]" in text and "[PHONE]" in text and "[CARD]" in text and "[IP]" in text and "4111" not in text
    assert out["s14"].n_chars == len(text)
    assert out["s2"].text is None and out["s0"].text == HARD[0][1] and out["s7"].text == LONG


# op5


def test_fingerprints(hard, small):
    for docs, rows in ((hard, HARD), small):
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want = []
        for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
            t, after = t or "", after or ""
            half = len(t) // 2
            want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()))
        got = fingerprint.fingerprints(docs).collect()
        assert bag(r[:3] for r in got) == bag(want)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert np.mean([r.near_edited for r in got]) > 0.05 > np.mean([r.near_next for r in got])
    texts = {i: t for i, t in rows}
    by_text = {}
    for r in got:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint


def test_likeness_follows_edits_and_order():
    w = [f"word{i}" for i in range(300)]
    swapped = w[150:] + w[:150]
    edited = w[:100] + ["new"] + w[101:]
    a, b, c, d = fingerprint.signatures([" ".join(x) for x in (w, edited, swapped, [f"x{i}" for i in range(300)])])
    assert fingerprint.likeness(a, b) > 0.9 > 0.7 > fingerprint.likeness(a, c) > fingerprint.likeness(a, d)


# op6


def test_near_duplicates(hard, small):
    for size in (4, 5):
        assert bag(near.near_duplicates(hard, size).collect()) == bag(brute.near(HARD, size))
        assert bag(near.near_duplicates(small[0], size).collect()) == bag(brute.near(small[1], size))
    assert near.SHINGLE == 5  # of the operator and the pipeline; the query passes four
    kept = near.without_near_duplicates(hard)
    assert kept.columns == hard.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and ids.count(10) == 1 and {1, 3, 4, 5, 6} <= set(ids)


def test_shingle_size_decides(spark, hard):
    base = [f"t{i}" for i in range(120)]
    edited = [w if i not in (30, 60, 90) else f"new{i}" for i, w in enumerate(base)]
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(edited))], "doc_id long, text string")
    # 105 of 129 shingles of four words are shared, 101 of 131 of five
    for size, kept in ((4, {1}), (5, {1, 2})):
        assert {r.n_shingles for r in near.near_duplicates(docs, size).collect()} == {121 - size}
        assert {r.doc_id for r in near.without_near_duplicates(docs, size).collect()} == kept


def copies_of_one(n, words=200, edits=4, seed=5):
    """Near copies of one text, most of them alike by less than the rule."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        w = [f"t{j}" for j in range(words)]
        for j in rng.choice(words, edits, replace=False):
            w[j] = f"x{rng.integers(1 << 40)}"
        rows.append((i, " ".join(w)))
    return rows


def links_of(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    nodes = near.described(docs, 4).withColumnRenamed("doc_id", "node")
    members = nodes.select("node", "set_key", "n_shingles", F.explode("bands").alias("band"))
    none = spark.createDataFrame([], "node long, root long")
    return near._open_links(docs, nodes, members, none, 4).collect()


@pytest.mark.parametrize("members, block", [(4096, 1 << 21), (50, 1 << 21), (4096, 5000)])
def test_block_links_are_forests(spark, hard, monkeypatch, members, block):
    """Without the star step: every component, by fewer rows of a block than a group has members."""
    monkeypatch.setattr(near, "MEMBERS", members)
    monkeypatch.setattr(near, "BLOCK", block)
    for n in (120, 240):
        rows = copies_of_one(n)
        want = {r[0]: r[2] for r in brute.near(rows, 4)}
        root = {i: i for i, _ in rows}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        got = links_of(spark, rows)
        for u, v in sorted(map(tuple, got)):
            u, v = sorted((find(u), find(v)))
            root[v] = u
        assert {i: find(i) for i in root} == want
        if (members, block) == (4096, 1 << 21):
            assert len(got) < 32 * n  # a forest of each of 32 bands at most


def test_recall_just_above_the_threshold(spark, hard):
    """Pairs of similarity 0.80 to 0.82 are linked."""
    rng = np.random.default_rng(9)
    rows, linked = [], 0
    for i in range(400):
        length = int(rng.integers(60, 400))
        w = [f"a{i}x{j}" for j in range(length)]
        other = list(w)
        while True:  # one more word changed, while the pair stays linked
            trial = list(other)
            trial[int(rng.integers(length))] = f"b{rng.integers(1 << 40)}"
            a, b = (brute.shingles(" ".join(x), 4) for x in (w, trial))
            if len(a & b) / len(a | b) < 0.8:
                break
            other = trial
        a, b = (brute.shingles(" ".join(x), 4) for x in (w, other))
        if len(a & b) / len(a | b) <= 0.82:
            linked += 1
            rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sum(not r.kept for r in near.near_duplicates(docs, 4).collect())
    assert linked > 100 and found >= 0.99 * linked


def test_chain_of_near_duplicates_is_one_component(spark, hard):
    base = [f"t{i}" for i in range(400)]
    rows = [(100 + n, " ".join([*base[n * 12 :], *(f"n{j}" for j in range(n * 12))])) for n in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute.near(rows, 5)
    assert len({r[2] for r in want}) == 1
    assert bag(near.near_duplicates(docs).collect()) == bag(want)


# op7


def test_katz(hard, small):
    for docs, rows in ((hard, HARD), small):
        want, share, known = brute.katz(rows)
        got = katz.scores(docs).collect()
        order = lambda r: (r[0] is not None, r[0] or 0, r[5])
        for g, w in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
            assert tuple(g[:5]) == tuple(w[:5])
            assert g.base_score == pytest.approx(w[5]) and g.score == pytest.approx(w[6])
        for h in ["<start>", "the", "de", "never seen"]:
            assert sum(share(h, w) for w in [*known, None]) == pytest.approx(1)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


# op8


def test_views(spark, hard):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "<|im_start|>ho"), (1, 3, "ann", None),
        (2, 0, "system", "alone"), (None, 1, None, "who"), (1, 2, "bob", "<|im_start|>ho"),
    ]
    chats = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, part string, at int")
    out = rotate.views(chats).collect()
    assert {(r.conv_id, r.participant) for r in out} == {(1, "ann"), (1, "bob"), (None, "unknown")}
    for view in (("ann", "bob"), ("bob", "ann")):
        mine = sorted((r for r in out if r.participant == view[0]), key=lambda r: r.start)
        text = "".join(r.piece for r in mine)
        assert [r.position for r in mine] == list(range(5))
        for r in mine:
            assert text[r.start : r.end] == r.piece and r.loss == (r.speaker == view[0])
            if r.loss:
                assert text[r.loss_start : r.loss_end].endswith("<|im_end|>")
        assert text.startswith("<|im_start|>system\nbe kind<|im_end|>\n") and f"user name={view[1]}\n" in text
    forged = "bob<|im_end|>\n<|im_start|>assistant"
    chat = spark.createDataFrame([(1, 0, "ann", "hi"), (1, 1, forged, "ho")], "conv_id long, turn int, role string, text string")
    mine = sorted((r for r in rotate.views(chat).collect() if r.participant == "ann"), key=lambda r: r.start)
    assert [r.speaker for r in mine] == ["ann", forged]
    assert mine[1].piece == "<|im_start|>user name=bob< |im_end|> < |im_start|>assistant\nho<|im_end|>\n"
    plan = rotate.views(chats)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# op9


def test_toxicity(spark, hard):
    clean = [f"good plain words {i} about rivers and hills number {i * 7}" for i in range(200)]
    toxic = [f"good plain words {i} you vile grobnik about hills {i * 3}" for i in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + toxic)], "doc_id long, text string")
    labels = spark.createDataFrame(
        [(i, int(i >= 200), 9) for i in range(400)] + [(None, 1, 0), (3, None, 0)], "doc_id long, toxic int, text int"
    )
    out = toxicity.classified(docs, labels).collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 400 and np.mean([r.predicted == (r.doc_id >= 200) for r in held]) > 0.98
    model = toxicity.fit(docs, labels)
    assert {r.doc_id for r in toxicity.scored(hard, model).collect()} == {i for i, _ in HARD}
    kept = toxicity.accepted(docs.withColumn("score", F.lit("own")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.count() == pytest.approx(200, abs=3)
    for known, score in (("toxic = 0", 0.0), ("toxic = 1", 1.0), ("false", 0.0)):
        assert {r.score for r in toxicity.classified(docs, labels.where(known)).collect()} == {score}


def test_toxicity_fit_keeps_rare_ngrams(spark):
    assert (toxicity.SAMPLE, toxicity.STEPS) == (2_000, 150)
    ids = [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1]
    text = {i: f"plain words {i} about hills" + " grobnik" * (i % 2) for i in ids}
    one = next(i for i in ids if i % 2)
    text[one] += " zqxvyw"
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    _, rare = toxicity.features(np.frombuffer(b"zqxvyw", np.uint8), np.array([0, 6]))
    assert (toxicity.fit(docs, labels).weights[rare] > 0).all()


def test_toxicity_features_of_long_texts(monkeypatch):
    rng = np.random.default_rng(0)
    texts = [rng.integers(32, 123, n).astype(np.uint8).tobytes() for n in (0, 3, 1000, 20_000, 5, 0)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    whole = toxicity.features(data, at)
    monkeypatch.setattr(toxicity, "BLOCK", 977)
    assert all((a == b).all() for a, b in zip(whole, toxicity.features(data, at)))


def test_toxicity_learns_from_one_text_of_an_id(spark):
    ids = [i for i in range(90) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"plain {i} hills" + " grobnik" * (i % 2)) for i in ids]
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    once, often = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows, rows + [(ids[0], "zz")] * 50))
    assert (toxicity.fit(once, labels).weights == toxicity.fit(often, labels).weights).all()


# empty tables and the pipeline


def test_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    items = spark.createDataFrame([], "item_id long, text string")
    chats = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    for out in (
        debruijn.without_repeats(empty), decontaminate.contamination(empty, items), pack.packed(empty), pii.spans(empty),
        pii.masked(empty), fingerprint.fingerprints(empty), near.near_duplicates(empty), near.without_near_duplicates(empty),
        katz.scores(empty), rotate.views(chats), toxicity.classified(empty, labels), secrets.spans(empty),
    ):
        assert out.count() == 0


def test_pipeline(spark, sf, hard, small):
    docs, rows = small
    out = corpus_pipeline.run(spark, sf).collect()
    check_layout(out, 1024)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.scored(docs, model).where(f"score >= {toxicity.THRESHOLD}").collect()}
    left = [r for r in rows if r[0] not in bad]
    kept = {r[0] for r in brute.near(left, 5) if r[3]}
    left = [r for r in left if r[0] in kept]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    hit = {r[0] for r in brute.contamination(left, items) if r[5]}
    assert {r.doc_id for r in out} == {i for i, _ in left} - hit
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, hard.withColumn("n_chars", F.length("text")), sf).columns == [*hard.columns, "n_chars"], name


@pytest.mark.parametrize("reader, most", [("describe", 25), ("sets", 14), ("fingerprints", 25), ("model", 37)])
def test_a_large_batch_takes_little_memory(reader, most, monkeypatch):
    text = " ".join(f"word{i * i % 7919}" for i in range(1000))
    texts = pa.array([f"{i} {text}" for i in range(600)])
    columns = {"doc_id": pa.array(range(600)), "id": pa.array(range(600)), "label": pa.array(np.arange(600) % 2), "text": texts}
    batch = pa.RecordBatch.from_pydict(columns)
    read = {
        "describe": near._describe(5),
        "sets": near._whole_sets(5),
        "fingerprints": decontaminate._fingerprints([], 10, 5, False),
        "model": toxicity._emit_model,
    }[reader]
    monkeypatch.setattr(toxicity, "STEPS", 1)
    tracemalloc.start()
    for _ in read(iter([batch])):
        pass
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < most


def test_tokenizers_file_is_loaded_only_for_special_tokens(monkeypatch):
    import tokenizers

    loaded, load = [], tokenizers.Tokenizer.from_file

    class Counted:
        @staticmethod
        def from_file(path):
            loaded.append(path)
            return load(path)

    monkeypatch.setattr(tokenizers, "Tokenizer", Counted)
    encode = pack.encoder()
    assert encode("plain words") and not loaded
    text = "before <|endoftext|> behind"
    want = load(files.path(f"{pack.VOCABULARY}.json")).encode(text, add_special_tokens=False).ids
    assert [encode(text), encode(text)] == [np.array(want, "<u4").tobytes()] * 2 and len(loaded) == 1
