"""Spelling variant grouping by search schemes over a bidirectional FM-index.

The vocabulary is the delimited text that is searched. A word within one edit of a query
agrees with one half of it exactly: scheme 0 matches the first half from the delimiter
on and extends forward, scheme 1 matches the second half and extends backward; either
allows one inserted, deleted or replaced code point in the other half. The index that
is read forward and the one that is read backward are two FM-indexes; a search keeps an
interval of suffix ranks and narrows it by one code point a step.

1. Occurrences are counted per slice of texts, then by word.
2. For each scheme the vocabulary is sorted in the order in which its matches begin (as
   words, or as reversed words) and cut into blocks of about ``BLOCK`` code points, by a
   running sum. Words that share a query's exact half are neighbours in this order, so a
   query goes to its own block, and to others only if they hold such words too: found
   by bisection in the table of the blocks' first and last words, at most ``CLIP`` code
   points of each, two rows per ``BLOCK`` of vocabulary. A block with many queries is
   dealt over several tasks.
3. A task holds one block's index and streams queries past it. Per query and block it
   gives one row: the number of near words and the best of them. What scheme 0 finds
   scheme 1 leaves out, so that each pair is counted once.
4. Roots spread from the words without a form down, level by level. A word has at most
   some thousand near words (by its length and the alphabet), so no key of these joins
   is hot; the count more than doubles with every level, so levels are few.

Null texts have no words. A null ``doc_id`` is the empty string in the hash that marks a
run for a deletion. Repeated rows count again. An empty table gives no rows; other
columns are ignored. A run of any length is a word; texts are searched as a whole.
Within a slice of texts equality of words rests on 64-bit hashes.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm import running, words
from colophon.llm.tables import counted, documents_of, table, written

SHORTEST, RAREST, DOMINANT = 5, 3, 2
EVERY = 97
BLOCK = 1 << 18
QUERIES = 1 << 14
CLIP = 64
CHUNK = 2048
_FEW = 24  # intervals of at most so many ranks are read, wider ones tried with all letters

_LETTERS = words.byte_table(
    [*range(65, 91), *range(97, 123), 0xC3, *range(0x80, 0xC0)], lower=True
)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def letters_only(data: np.ndarray) -> np.ndarray:
    """The bytes with all that is no letter of U+0041 to U+00FF as blanks, A-Z lower-cased."""
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    keep = (_LETTERS[data] != 0) & ((data < 0x80) | (data == 0xC3) | after)
    return np.where(keep, _LETTERS[data] - 1, 32).astype(np.uint8)


def _crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of byte runs that go on from the CRC-32 of what comes before each."""
    crc = state ^ np.uint32(0xFFFFFFFF)
    size = end - start
    short = np.flatnonzero(size <= 64)
    for n in range(int(size[short].max(initial=0))):
        short = short[size[short] > n]
        byte = data[start[short] + n]
        crc[short] = _CRC[(crc[short] ^ byte) & np.uint32(0xFF)] ^ (crc[short] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > 64).tolist():
        crc[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i]))
    return crc


def _count(batches):
    """Words and their numbers in each slice of texts."""
    for rows, data, at in words.slices(batches):
        clean = letters_only(data)
        found = words.split(clean, at, _LETTERS)
        if not len(found.hash):
            continue
        order = np.lexsort((found.hash, found.doc))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(found.doc[order]) != 0) | (found.hash[order][1:] != found.hash[order][:-1])
        begins = np.flatnonzero(new)
        one, times = order[begins], np.diff(np.append(begins, len(order)))
        ids = ["" if i is None else str(i) for i in rows.column("doc_id").to_pylist()]
        state = np.array([zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
        crc = _crcs(clean, found.start[one], found.end[one], state[found.doc[one]])
        cut = crc % EVERY == 0
        counts: Counter[str] = Counter()
        raw = clean.tobytes()
        for i, n in zip(np.flatnonzero(cut).tolist(), times[cut].tolist()):
            w = raw[found.start[one[i]] : found.end[one[i]]].decode()
            place = int(crc[i]) % len(w)
            counts[w[:place] + w[place + 1 :]] += n
        same, which = np.unique(found.hash[one[~cut]], return_inverse=True)
        total = np.bincount(which, times[~cut], len(same)).astype(np.int64)
        sample = np.zeros(len(same), np.int64)
        sample[which] = one[~cut]
        for i, n in zip(sample.tolist(), total.tolist()):
            counts[raw[found.start[i] : found.end[i]].decode()] += n
        kept = [(w, n) for w, n in counts.items() if len(w) >= SHORTEST]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*kept)], ["word", "n"])


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word, n``: words of at least ``SHORTEST`` code points and ``RAREST`` occurrences."""
    seen = documents_of(docs).mapInArrow(_count, "word string, n long")
    return seen.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= RAREST)


class Index:
    """An FM-index of words that are matched from their first code point on.

    The text holds each word backward with a terminator, so that a backward search step
    reads the word forward. Suffix ranks come from doubling: ranks of the first 1, 2, 4,
    ... code points.
    """

    def __init__(self, listed: list[bytes]):
        self.words = listed
        size = np.array([len(w) + 1 for w in listed], np.int64)
        end = np.cumsum(size)
        text = np.frombuffer(b"".join(w[::-1] + b"\0" for w in listed), np.uint8)
        n = len(text)
        of = np.repeat(np.arange(len(listed)), size)
        left = end[of] - np.arange(n)  # code points to the end of the word, with the terminator
        rank = text.astype(np.int64)
        step = 1
        while step < int(size.max(initial=1)):
            beyond = np.zeros(n, np.int64)
            inner = np.flatnonzero(left > step)
            beyond[inner] = rank[inner + step] + 1
            _, rank = np.unique(rank * (n + 257) + beyond, return_inverse=True)
            step *= 2
        suffix = np.argsort(rank, kind="stable")
        first = left == size[of]
        self.before = np.where(first[suffix], 0, text[suffix - 1])
        self.whole = of[suffix[self.before == 0]]
        self.width = n + 1
        keys = self.before.astype(np.int64) * self.width + np.arange(n)
        keys.sort()
        self.keys = keys
        self.letters = np.unique(text[text != 0]).astype(np.int64)

    def step(self, letter: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Rank of ``letter`` followed by the suffix of a rank."""
        return np.searchsorted(self.keys, letter * self.width + rank)

    def narrow(self, letter: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letter = letter.astype(np.int64)
        return self.step(letter, lo), self.step(letter, hi)

    def followers(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which interval, and a letter that may come next in it."""
        width = hi - lo
        few = np.flatnonzero(width <= _FEW)
        state = np.repeat(few, width[few])
        nth = np.arange(len(state)) - np.repeat(np.cumsum(width[few]) - width[few], width[few])
        pair = words.distinct(state * 256 + self.before[lo[state] + nth])
        pair = pair[pair % 256 != 0]
        many = np.flatnonzero(width > _FEW)
        state = np.concatenate([pair // 256, np.repeat(many, len(self.letters))])
        return state, np.concatenate([pair % 256, np.tile(self.letters, len(many))])


def near(index: Index, queries: list[bytes], exact: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a query and a word of the index that differ by one edit after the exact part."""
    size = np.array([len(q) for q in queries], np.int64)
    letters = np.zeros((len(queries), int(size.max()) + 1), np.int64)
    for i, q in enumerate(queries):
        letters[i, : len(q)] = np.frombuffer(q, np.uint8)
    of = np.arange(len(queries))
    lo, hi = np.zeros(len(queries), np.int64), np.full(len(queries), len(index.words))
    for t in range(int(exact.max())):
        on = np.flatnonzero(exact[of] > t)
        lo[on], hi[on] = index.narrow(letters[of[on], t], lo[on], hi[on])
        alive = hi > lo
        of, lo, hi = of[alive], lo[alive], hi[alive]
    place = exact[of]
    found = []
    while len(of):
        state, letter = index.followers(lo, hi)
        nlo, nhi = index.narrow(letter, lo[state], hi[state])
        some = nhi > nlo
        state, letter, nlo, nhi = state[some], letter[some], nlo[some], nhi[some]
        q, t = of[state], place[state]
        more = t < size[q]
        same = more & (letters[q, t] == letter)
        other = more & ~same
        here = np.flatnonzero(place < size[of])
        found.append(_ended(
            index, letters, size,
            np.concatenate([q[other], q, of[here]]),  # replaced, inserted, deleted
            np.concatenate([t[other] + 1, t, place[here] + 1]),
            np.concatenate([nlo[other], nlo, lo[here]]),
            np.concatenate([nhi[other], nhi, hi[here]]),
        ))
        of, place, lo, hi = q[same], t[same] + 1, nlo[same], nhi[same]
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.concatenate(found)
    one = words.distinct(pairs[:, 0] * len(index.words) + pairs[:, 1])
    return one // len(index.words), one % len(index.words)


def _ended(index: Index, letters, size, q, t, lo, hi) -> np.ndarray:
    """Pairs of those searches that match exactly from here to the end of a word."""
    out = [np.zeros((0, 2), np.int64)]
    while len(q):
        done = t == size[q]
        if done.any():
            a, b = index.narrow(np.zeros(int(done.sum()), np.int64), lo[done], hi[done])
            hit = b > a  # words differ, so that at most one is whole here
            out.append(np.stack([q[done][hit], index.whole[a[hit]]], axis=1))
        q, t, lo, hi = q[~done], t[~done], lo[~done], hi[~done]
        lo, hi = index.narrow(letters[q, t], lo, hi)
        alive = hi > lo
        q, t, lo, hi = q[alive], t[alive] + 1, lo[alive], hi[alive]
    return np.concatenate(out)


def _halves(length: int, scheme: int) -> int:
    """Code points that a scheme matches exactly."""
    return length // 2 if scheme == 0 else length - length // 2


def _router(bounds: dict[int, tuple[list[str], list[str]]]):
    """Queries with every block that may hold words with their exact half."""

    def route(batches):
        for batch in batches:
            out = []
            for scheme, block, key, n in zip(*[batch.column(c).to_pylist() for c in ("scheme", "block", "key", "n")]):
                firsts, lasts = bounds[scheme]
                half = key[: _halves(len(key), scheme)][:CLIP]
                lo = bisect_left(lasts, half, key=lambda w: w[: len(half)])
                hi = bisect_right(firsts, half, key=lambda w: w[: len(half)])
                out += [(scheme, b, key, n) for b in range(lo, hi)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int64(), pa.string(), pa.int64()))],
                    ["scheme", "block", "key", "n"],
                )

    return route


class _Block:
    """A block's index, and what is known of its words."""

    def __init__(self, scheme: int, rows: list[tuple[str, int]]):
        self.scheme = scheme
        self.keys = [k for k, _ in rows]
        self.n = np.array([n for _, n in rows], np.int64)
        self.words = [self.turned(k) for k in self.keys]
        self.order = np.zeros(len(rows), np.int64)
        self.order[sorted(range(len(rows)), key=self.words.__getitem__)] = np.arange(len(rows))
        self.index = Index([k.encode("latin-1") for k in self.keys])

    def turned(self, key: str) -> str:
        return key if self.scheme == 0 else key[::-1]

    def answers(self, queries: list[str]) -> Iterator[tuple[str, int, int, str]]:
        """``word, n_near, best_n, best`` of the queries with near words in this block."""
        exact = np.array([_halves(len(q), self.scheme) for q in queries], np.int64)
        q, w = near(self.index, [k.encode("latin-1") for k in queries], exact)
        if self.scheme == 1:  # scheme 0 finds words that begin as the query does
            new = [not self.keys[b].endswith(queries[a][exact[a] :]) for a, b in zip(q.tolist(), w.tolist())]
            q, w = q[new], w[new]
        order = np.lexsort((self.order[w], -self.n[w], q))
        q, w = q[order], w[order]
        begins = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else []
        for lo, hi in zip(begins, [*begins[1:], len(q)]):
            best = int(w[lo])
            yield self.turned(queries[q[lo]]), int(hi - lo), int(self.n[best]), self.words[best]


def _answer_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"word": pa.string(), "n_near": pa.int64(), "best_n": pa.int64(), "best": pa.string()}
    cols = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds.values())], list(kinds))


def _search(batches):
    """Answers, from rows sorted by block and part, the words of a block before its queries."""
    key, held, block, queries = None, [], None, []
    for batch in batches:
        out = []
        for *now, asks, word, n in zip(*[batch.column(c).to_pylist() for c in ("scheme", "block", "share", "asks", "key", "n")]):
            if now != key:
                if queries:
                    out += block.answers(queries)
                key, held, block, queries = now, [], None, []
            if not asks:
                held.append((word, n))
                continue
            if block is None:
                block, held = _Block(now[0], held), []
            queries.append(word)
            if len(queries) == CHUNK:
                out += block.answers(queries)
                queries = []
        yield _answer_rows(out)
    if queries:
        yield _answer_rows(list(block.answers(queries)))


def near_words(vocab: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best`` of words that have near words."""
    both = vocab.select(
        F.posexplode(F.array(F.col("word"), F.reverse("word"))).alias("scheme", "key"), "n"
    ).withColumn("size", (F.length("key") + 1).cast("long"))
    rows = running.arranged(both, ["scheme", "key"], "variant-order")
    parts = running.before(
        running.key_parts(rows, ["scheme"], {"all": F.sum("size")}), ["scheme"], {"start": F.sum("all")}
    ).drop("all")
    here = F.coalesce("start", F.lit(0)) + F.col("inside") - F.col("size")
    blocks = written(
        rows.withColumn("inside", F.sum("size").over(running.inside(["scheme"]))).join(parts, ["scheme", "part"])
        .select("scheme", F.floor(here / BLOCK).cast("long").alias("block"), "key", "n"),
        "variant-blocks",
    )
    clipped = F.substring("key", 1, CLIP)
    edges = blocks.groupBy("scheme", "block").agg(F.min(clipped).alias("lo"), F.max(clipped).alias("hi")).collect()
    bounds: dict[int, tuple[list[str], list[str]]] = {0: ([], []), 1: ([], [])}
    number = [max((e.block for e in edges if e.scheme == s), default=-1) + 1 for s in (0, 1)]
    known = {(e.scheme, e.block): e for e in edges}
    for s in (0, 1):
        last = ""
        for b in range(number[s]):  # a block without words, behind a word longer than it, repeats the edge
            e = known.get((s, b))
            bounds[s][0].append(e.lo if e else last)
            bounds[s][1].append(last := e.hi if e else last)
    asked, n = counted(
        blocks.mapInArrow(_router(bounds), "scheme int, block long, key string, n long"), "variant-queries"
    )
    shares = asked.groupBy("scheme", "block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("shares"))
    share = F.pmod(F.xxhash64("key"), "shares").cast("int")
    each = F.explode(F.sequence(F.lit(0), F.col("shares") - 1))
    on = ["scheme", "block"]
    dealt = (
        blocks.join(shares, on).select(*on, each.alias("share"), F.lit(0).alias("asks"), "key", "n")
        .unionByName(asked.join(shares, on).select(*on, share.alias("share"), F.lit(1).alias("asks"), "key", "n"))
    )
    group = [*on, "share"]
    tasks = max(sum(number) + n // QUERIES, 1)  # about one a share: its work is far above its bytes
    found = dealt.repartition(tasks, *group).sortWithinPartitions(*group, "asks").mapInArrow(
        _search, "word string, n_near long, best_n long, best string"
    )
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select(
        "word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.best").alias("best")
    )


def forms(vocab: DataFrame) -> DataFrame:
    """``word, n, n_near, form, form_n`` of a vocabulary ``word, n``."""
    better = F.col("best_n") >= DOMINANT * F.col("n")
    return vocab.join(near_words(vocab), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(better, F.col("best")).alias("form"), F.when(better, F.col("best_n")).alias("form_n"),
    )


def grouped(vocab: DataFrame) -> DataFrame:
    """``forms`` with the ``root`` that a word's forms lead to."""
    rows = written(forms(vocab), "variant-forms")
    links = rows.where("form is not null").select(F.col("word").alias("child"), F.col("form").alias("word"))
    level, n = counted(rows.where("form is null").select("word", F.col("word").alias("root")), "variant-level")
    levels = [level]
    while n:
        below = links.join(level, "word").select(F.col("child").alias("word"), "root")
        level, n = counted(below, "variant-level")
        levels.append(level)
    roots = levels[0]
    for more in levels[1:]:
        roots = roots.unionByName(more)
    return rows.join(roots, "word").select("word", "form", "root", "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """Every word of the texts with its form and root."""
    return grouped(written(vocabulary(docs), "variant-words"))


def query(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
