"""Katz backoff: a bigram model with Good-Turing discounts and exact backoff weights.

Tokens are words (runs without ASCII white space, A-Z lower-cased) and one end per
text. The model learns from the documents that are not held out:

* a seen pair has the discounted share ``d(c) * c / c(history)``,
* an unseen one backs off to ``alpha(history) * P(word)``, where ``alpha`` is exactly
  what the seen pairs leave over, divided by what their words leave over in ``P``,
* ``P`` is the discounted share of a known word; what the known words leave over is
  the probability of an unknown one. A history never seen backs off with weight 1.

Counts up to ``K`` get Good-Turing discounts from the counts of counts of the whole
corpus; if these are out of range, absolute ones. Higher counts lose ``LEFT`` of a
count, so that every history keeps something for unseen words. All probabilities of
a history sum to 1.

Counts travel, texts don't. Documents are written once as chunks of about
``CHUNK_BYTES``: a dictionary of word hashes, and numbers into it. Each chunk asks for
the counts of its words, then of its pairs: sorted, counted in the chunk, cut by the
hash of the word or of the history, one binary row for each range. A range sums what
all chunks sent and answers each. Histories with more than ``1 / HOT`` of all tokens
are cut by the whole pair, and their sums put together from all ranges; there are
fewer than ``HOT`` of them at any size. Chunks lie in buckets, so answers come to them.

A null text is empty: one end. A missing ``doc_id`` counts as an empty text for the
fold. Rows of one id are documents of their own. Without training documents every
token is unknown and has probability 1. An empty table gives no rows. Other columns
are ignored. Counts are exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

import uuid
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm import words
from colophon.llm.tables import documents_of, key_changes, runs, table
from colophon.sources.shared import materialize, new_path

K = 5
LEFT = 1e-3
HOT = 4096
CHUNK_BYTES = 8 << 20
RANGE = 1 << 19
FOLDS, HELD = 7, 2

_U = np.uint64
_END, _START = _U(0xE7D), _U(0x57A27)


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte by byte, compressed."""
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8).T.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().astype(np.int64)


class Discounts(NamedTuple):
    """Share kept of counts 1 to K, by Good-Turing from the counts of counts."""

    kept: np.ndarray

    @classmethod
    def of(cls, n: np.ndarray) -> Discounts:
        """``n[r - 1]``: how many have count ``r``, for r up to K + 1."""
        r = np.arange(1, K + 1)
        with np.errstate(all="ignore"):
            top = (K + 1) * n[K] / n[0]
            good = ((r + 1) * n[1:] / n[:-1] / r - top) / (1 - top)
        if np.all(np.isfinite(good)) and np.all(good > 0) and np.all(good < 1):
            return cls(good)
        less = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        return cls((r - less) / r)

    def counts(self, c: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        low = np.concatenate([[0.0], self.kept * np.arange(1, K + 1)])
        return np.where(c <= K, low[np.minimum(c, K)], c - LEFT)

    def left(self, n: np.ndarray) -> np.ndarray:
        """Counts left over, from the numbers of counts 1 to K, and of higher ones last."""
        return n[..., :K] @ ((1 - self.kept) * np.arange(1, K + 1)) + LEFT * n[..., K]


class Unigrams(NamedTuple):
    total: int
    distinct: int
    discounts: Discounts
    unknown: float

    def share(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, self.discounts.counts(c) / max(self.total, 1), self.unknown)


class Chunk(NamedTuple):
    """Documents with their tokens as numbers into ``words``."""

    docs: list
    size: np.ndarray
    words: np.ndarray
    tokens: np.ndarray

    @property
    def held(self) -> np.ndarray:
        text = ["" if d is None else str(d) for d in self.docs]
        return np.array([zlib.crc32(t.encode()) % FOLDS == HELD for t in text], bool)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs as ``history * len(words) + word``, and the pair of each token.

        A text begins after the history ``len(words)``.
        """
        before = np.concatenate([[0], self.tokens[:-1]])
        before[np.cumsum(self.size) - self.size] = len(self.words)
        return np.unique(before * len(self.words) + self.tokens, return_inverse=True)


_CHUNK = "chunk long, docs array<long>, size binary, words binary, tokens binary, n_words long, n_tokens long"


def _encode(batches):
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 32
    for rows, data, at in words.slices(batches, CHUNK_BYTES, 1 << 16):
        found = words.split(data, at, words.LOWER)
        size = np.diff(found.first) + 1
        stream = np.full(int(size.sum()), _END)
        stream[np.arange(len(found.hash)) + found.doc] = found.hash
        known, place, n = np.unique(stream, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number]),
                pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([_pack(size)]),
                pa.array([known[order].tobytes()]),
                pa.array([_pack(rank[place])]),
                pa.array([len(known)]),
                pa.array([len(stream)]),
            ],
            ["chunk", "docs", "size", "words", "tokens", "n_words", "n_tokens"],
        )
        number += 1


def _chunk(batch: pa.RecordBatch, i: int) -> Chunk:
    get = lambda c: batch.column(c)[i].as_py()
    return Chunk(get("docs"), _unpack(get("size")), np.frombuffer(get("words"), _U), _unpack(get("tokens")))


def _ranges(place: np.ndarray, bits: int) -> np.ndarray:
    return (place >> _U(64 - bits)).astype(np.int64) if bits else np.zeros(len(place), np.int64)


def _cuts(part: np.ndarray) -> list[tuple[int, int]]:
    """Runs of equal numbers."""
    edge = np.flatnonzero(np.diff(part)) + 1
    edges = [0, *edge.tolist(), len(part)] if len(part) else [0]
    return list(zip(edges, edges[1:]))


def _ask_words(bits: int):
    def of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                c = _chunk(batch, i)
                learned = np.repeat(~c.held, c.size)
                n = np.bincount(c.tokens[learned], minlength=len(c.words))
                order = np.argsort(c.words)
                hashed, n = c.words[order], n[order]
                part = _ranges(hashed, bits)
                cuts = _cuts(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(part[a]) for a, _ in cuts], pa.int32()),
                        pa.array([batch.column("chunk")[i].as_py()] * len(cuts)),
                        pa.array([hashed[a:b].tobytes() for a, b in cuts]),
                        pa.array([_pack(n[a:b]) for a, b in cuts]),
                    ],
                    ["part", "chunk", "words", "counts"],
                )

    return of


_WORD_ANSWER = "chunk long, part int, counts binary, stats array<long>"


def _groups(batches):
    for batch in runs(batches, ["part"]):
        edges = [0, *key_changes(batch, ["part"]).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def _answer_words(batches):
    for group in _groups(batches):
        asked = [np.frombuffer(w, _U) for w in group.column("words").to_pylist()]
        counts = np.concatenate([_unpack(c) for c in group.column("counts").to_pylist()])
        known, place = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(place, counts, len(known)).astype(np.int64)
        stats = [int(total.sum()), int((total > 0).sum()), *(int((total == r).sum()) for r in range(1, K + 2))]
        edges = np.cumsum([0, *map(len, asked)])
        answers = [_pack(total[place[a:b]]) for a, b in zip(edges, edges[1:])]
        yield pa.RecordBatch.from_arrays(
            [
                group.column("chunk"), group.column("part"), pa.array(answers),
                pa.array([stats] + [None] * (len(answers) - 1), pa.list_(pa.int64())),
            ],
            ["chunk", "part", "counts", "stats"],
        )


def _word_counts(c: Chunk, answers: list) -> np.ndarray:
    """Training counts of the chunk's words, from the answers of all ranges."""
    out = np.zeros(len(c.words), np.int64)
    got = [_unpack(a["counts"]) for a in sorted(answers, key=lambda a: a["part"])]
    out[np.argsort(c.words)] = np.concatenate(got)
    return out


class _Pairs(NamedTuple):
    """The distinct pairs of a chunk, in the order in which it asks for them."""

    history: np.ndarray  # number in the chunk
    word: np.ndarray
    key: np.ndarray
    part: np.ndarray
    hot: np.ndarray
    order: np.ndarray  # asked order -> distinct order
    of_token: np.ndarray


def _asked_pairs(c: Chunk, n: np.ndarray, starts: int, total: int, bits: int) -> tuple[_Pairs, np.ndarray, np.ndarray]:
    pair, of_token = c.pairs()
    history, word = pair // len(c.words), pair % len(c.words)
    hashed = np.append(c.words, _START)
    counts = np.append(n, starts)
    key = words.mix(hashed[history] * _U(0x9E3779B97F4A7C15) + words.mix(c.words[word], 21), 22)
    hot = counts[history] * HOT > total
    part = _ranges(np.where(hot, key, words.mix(hashed[history], 23)), bits)
    order = np.lexsort((history, part))
    return _Pairs(history[order], word[order], key[order], part[order], hot[order], order, of_token), hashed, counts


def _histories(p: _Pairs, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of one history within a range."""
    begin = a + np.concatenate([[0], np.flatnonzero(np.diff(p.history[a:b])) + 1])
    return begin, np.diff(np.append(begin, b))


_PAIR_QUESTION = "part int, chunk long, histories binary, hot binary, runs binary, keys binary, counts binary, known binary"


def _ask_pairs(starts: int, total: int, bits: int):
    def of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                c = _chunk(batch, i)
                n = _word_counts(c, batch.column("unigrams")[i].as_py())
                p, hashed, _ = _asked_pairs(c, n, starts, total, bits)
                learned = np.repeat(~c.held, c.size)
                seen = np.bincount(p.of_token[learned], minlength=len(p.order))[p.order]
                out: dict[str, list] = {k.split()[0]: [] for k in _PAIR_QUESTION.split(", ")}
                for a, b in _cuts(p.part):
                    begin, length = _histories(p, a, b)
                    row = (
                        int(p.part[a]), batch.column("chunk")[i].as_py(), hashed[p.history[begin]].tobytes(), _pack(p.hot[begin]),
                        _pack(length), p.key[a:b].tobytes(), _pack(seen[a:b]), _pack(np.where(seen[a:b] > 0, n[p.word[a:b]], 0)),
                    )
                    for k, v in zip(out, row):
                        out[k].append(v)
                kinds = [pa.int32(), pa.int64()] + [pa.binary()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    return of


_PAIR_ANSWER = (
    "chunk long, part int, counts binary, asked binary, numbers binary, shares binary, stats array<long>, "
    "hot array<struct<h:long,n:array<long>,share:double>>"
)


def _answer_pairs(unigrams: Unigrams):
    def of(batches):
        for group in _groups(batches):
            get = lambda c: group.column(c).to_pylist()  # noqa: B023, E731
            heads = [np.frombuffer(h, _U) for h in get("histories")]
            length = [_unpack(r) for r in get("runs")]
            hot = [_unpack(h) > 0 for h in get("hot")]
            keys = [np.frombuffer(k, _U) for k in get("keys")]
            counts = np.concatenate([_unpack(c) for c in get("counts")])
            known = np.concatenate([_unpack(c) for c in get("known")])
            pair, place = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(place, counts, len(pair)).astype(np.int64)
            of_word = np.zeros(len(pair), np.int64)
            np.maximum.at(of_word, place, known)  # only who has seen a pair sends its word's count
            history, at_history = np.unique(np.concatenate(heads), return_inverse=True)
            of_pair = np.zeros(len(pair), np.int64)
            of_pair[place] = np.repeat(at_history, np.concatenate(length))
            learned = total > 0
            level = np.minimum(total[learned], K + 1) - 1
            numbers = np.bincount(of_pair[learned] * (K + 1) + level, minlength=len(history) * (K + 1)).reshape(-1, K + 1)
            share = np.bincount(of_pair[learned], unigrams.share(of_word[learned]), len(history))
            stats = [int((total == r).sum()) for r in range(1, K + 2)]
            is_hot = np.zeros(len(history), bool)
            is_hot[at_history] = np.concatenate(hot)
            hot_rows = [
                {"h": int(history[x : x + 1].view(np.int64)[0]), "n": numbers[x].tolist(), "share": float(share[x])}
                for x in np.flatnonzero(is_hot)
            ]
            out: list[tuple] = []
            done, done_heads = 0, 0
            for h, r, k in zip(heads, length, keys):
                answer = total[place[done : done + len(k)]]
                mine = at_history[done_heads : done_heads + len(h)]
                # backoff sums go where a pair of the history is unseen
                need = (np.minimum.reduceat(answer, np.cumsum(r) - r) == 0) & ~is_hot[mine]
                out.append((_pack(answer), _pack(need), _pack(numbers[mine[need]].ravel()), share[mine[need]].tobytes()))
                done, done_heads = done + len(k), done_heads + len(h)
            col = list(zip(*out))
            n = len(out)
            kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.list_(pa.int64())), ("share", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [
                    group.column("chunk"), group.column("part"), *[pa.array(c, pa.binary()) for c in col],
                    pa.array([stats] + [None] * (n - 1), pa.list_(pa.int64())), pa.array([hot_rows] + [None] * (n - 1), kind),
                ],
                ["chunk", "part", "counts", "asked", "numbers", "shares", "stats", "hot"],
            )

    return of


_SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
)


def _score(unigrams: Unigrams, pairs: Discounts, starts: int, bits: int, hot: dict[int, tuple]):
    def of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                c = _chunk(batch, i)
                n = _word_counts(c, batch.column("unigrams")[i].as_py())
                yield _scored(c, n, batch.column("bigrams")[i].as_py(), unigrams, pairs, starts, bits, hot)

    return of


def _scored(c, n, answers, unigrams, pairs, starts, bits, hot) -> pa.RecordBatch:
    p, hashed, counts = _asked_pairs(c, n, starts, unigrams.total, bits)
    seen = np.zeros(len(p.order), np.int64)
    left, share = np.zeros(len(hashed)), np.zeros(len(hashed))
    at = 0
    by_part = sorted(answers, key=lambda a: a["part"])
    for (a, b), answer in zip(_cuts(p.part), by_part, strict=True):
        seen[a:b] = _unpack(answer["counts"])
        begin, _ = _histories(p, a, b)
        mine = p.history[begin[_unpack(answer["asked"]) > 0]]
        left[mine] = pairs.left(_unpack(answer["numbers"]).reshape(-1, K + 1).astype(float))
        share[mine] = np.frombuffer(answer["shares"], np.float64)
        at = b
    for x in np.unique(p.history[p.hot]):
        numbers, total_share = hot[int(hashed[x : x + 1].view(np.int64)[0])]
        left[x], share[x] = pairs.left(np.array(numbers, float)), total_share
    known = np.maximum(counts, 1)
    alpha = np.where(counts > 0, left / known / np.maximum(1 - share, 1e-300), 1.0)
    single = unigrams.share(n)
    prob = np.where(seen > 0, pairs.counts(seen) / known[p.history], alpha[p.history] * single[p.word])
    log = np.zeros(len(p.order))
    log[p.order] = np.log10(prob)
    begin = np.cumsum(c.size) - c.size
    add = lambda v: np.add.reduceat(v, begin)
    base = np.log10((n + 1) / (unigrams.total + unigrams.distinct + 1))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(c.docs, pa.int64()),
            pa.array(c.held),
            pa.array(c.size),
            pa.array(add((n > 0)[c.tokens].astype(np.int64))),
            pa.array(np.full(len(c.docs), unigrams.total)),
            pa.array(add(base[c.tokens])),
            pa.array(add(log[p.of_token])),
        ],
        [f.split()[0] for f in _SCORES.split(", ")],
    )


def _bits(entries: int) -> int:
    return max(0, int(np.ceil(np.log2(max(entries, 1) / RANGE))))


def _sums(df: DataFrame, size: int) -> list[int]:
    """Sums of the first ``size`` numbers of ``stats``: one row, whatever the data."""
    got = df.where("stats is not null").agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(size)]).first()
    return [int(v or 0) for v in got]


def _collected(chunks: DataFrame, answers: DataFrame, fields: list[str], name: str) -> DataFrame:
    """``chunks`` with all answers to each, as an array ``name``."""
    per = answers.groupBy("chunk").agg(F.collect_list(F.struct("part", *fields)).alias(name))
    return chunks.join(per, "chunk")


def scores(docs: DataFrame) -> DataFrame:
    """A row per document; see the module."""
    spark = docs.sparkSession
    # bucketed by chunk: answers are shuffled to the chunks, which stay where they are
    name, number = f"chunks_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    encoded, seen = documents_of(docs).mapInArrow(_encode, _CHUNK), None
    encoded.write.bucketBy(number, "chunk").option("path", new_path(spark, "chunks")).format("parquet").saveAsTable(name)
    chunks = spark.table(name)
    seen = chunks.agg(F.sum("n_words"), F.sum("n_tokens"), F.count(F.lit(1))).first()
    word_bits, pair_bits = _bits(seen[0] or 0), _bits(seen[1] or 0)

    asked = chunks.mapInArrow(_ask_words(word_bits), "part int, chunk long, words binary, counts binary")
    word_answers, _ = materialize(
        asked.repartition("part").sortWithinPartitions("part").mapInArrow(_answer_words, _WORD_ANSWER), "word-answers"
    )
    total, distinct, *n = _sums(word_answers, K + 3)
    n = np.array(n, float)
    discounts = Discounts.of(n)
    higher = distinct - n[:K].sum()
    unknown = float(discounts.left(np.append(n[:K], higher))) / total if total else 1.0
    unigrams = Unigrams(total, distinct, discounts, unknown)
    ends = documents_of(docs).where(
        F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS != HELD
    )
    starts = ends.select("doc_id").count()  # as many as training texts

    with_words = _collected(chunks, word_answers, ["counts"], "unigrams")
    questions = with_words.mapInArrow(_ask_pairs(starts, total, pair_bits), _PAIR_QUESTION)
    pair_answers, _ = materialize(
        questions.repartition("part").sortWithinPartitions("part").mapInArrow(_answer_pairs(unigrams), _PAIR_ANSWER),
        "pair-answers",
    )
    pairs = Discounts.of(np.array(_sums(pair_answers, K + 1), float))
    sums = [F.sum(F.col("x.n")[j]).alias(f"n{j}") for j in range(K + 1)]
    # fewer than HOT rows at any size
    rows = pair_answers.select(F.explode("hot").alias("x")).groupBy("x.h").agg(*sums, F.sum("x.share").alias("share")).collect()
    hot = {r.h: ([r[f"n{j}"] for j in range(K + 1)], r.share) for r in rows}

    full = _collected(with_words, pair_answers, ["counts", "asked", "numbers", "shares"], "bigrams")
    return full.mapInArrow(_score(unigrams, pairs, starts, pair_bits, hot), _SCORES)


def query(spark, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
