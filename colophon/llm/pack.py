"""Best-fit packing of token pieces into sequences, in bulk-synchronous rounds.

A document is its token ids, then the id ``END``. Longer ones are cut into
pieces of ``CAPACITY`` tokens, the first piece taking what is left over. Pieces of
full length are sequences of their own; the others are packed.

Sizes are whole numbers up to the capacity, so range-sorted pieces and gaps are
runs of equal sizes: a piece is known by its size and its rank among the pieces
of that size, a gap likewise. A round sweeps the runs from the largest piece down
and gives each piece its successor, the smallest free gap it fits, every gap
taking one piece a round; of pieces that want the same gaps those of lower rank
win. Pieces above half the capacity that found no gap open sequences; if a round
matches none, the largest run left opens as many as the tokens left need. Gaps
are updated and rounds repeat until no piece is left. The sweep works on the
runs (at most ``CAPACITY`` of them, whatever the data); pieces are counted, sorted
by range, ranked and matched to the sweep's ranges as Spark jobs.

Null and empty texts are one piece of the id ``END``. Rows that share ``doc_id`` are
documents of their own. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.llm.tables import documents_of, table, written

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k"
CACHED = 200_000

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class _Ids(dict):
    """Bytes of the ids of a blank and a word; None where the text must stay whole.

    Byte-level BPE never merges over a single blank between two other characters,
    so a text may be cut there. A word that begins or ends with white space lies
    next to more white space, and its text is encoded as a whole.
    """

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, word: str):
        if len(self) >= CACHED:
            self.clear()
        clean = word and not word[0].isspace() and not word[-1].isspace()
        ids = self[word] = np.array(self.encode(" " + word), "<u4").tobytes() if clean else None
        return ids


def encoder(vocabulary: str = VOCABULARY):
    """Text to the bytes of its ids, those of the vocabulary's ``tokenizers`` file.

    That file is loaded only when a text needs it: it takes more memory than the rest.
    """
    import base64
    import json

    import public_tokenizers as files
    import tiktoken
    from tokenizers import Tokenizer

    with open(files.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding(vocabulary, pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    with open(files.path(f"{vocabulary}.json"), encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    exact = lru_cache(maxsize=1)(lambda: Tokenizer.from_file(files.path(f"{vocabulary}.json")))
    cache = _Ids(plain)

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return np.array(exact().encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *rest = text.split(" ")
        if not head or head[0].isspace() or head[-1].isspace():
            return np.array(plain(text), "<u4").tobytes()
        parts = [cache[w] for w in rest]
        if None in parts:
            return np.array(plain(text), "<u4").tobytes()
        return np.array(plain(head), "<u4").tobytes() + b"".join(parts)

    return encode


_encoders: dict[str, object] = {}


def _cutter(capacity: int, vocabulary: str):
    def cut(batches):
        encode = _encoders.get(vocabulary) or _encoders.setdefault(vocabulary, encoder(vocabulary))
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            out: list[tuple] = []
            for i in range(batch.num_rows):
                tokens = encode(texts[i].as_py() or "") + end
                n = len(tokens) // 4
                stop = n % capacity or min(n, capacity)
                start, piece = 0, 0
                while start < n:
                    out.append((i, piece, start, stop - start, zlib.crc32(tokens[4 * start : 4 * stop])))
                    start, stop, piece = stop, stop + capacity, piece + 1
            col = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(pa.array(col[0], pa.int64())),
                    pa.array(col[1], pa.int32()),
                    *[pa.array(c, pa.int64()) for c in col[2:]],
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return cut


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """All pieces of all documents, map-only."""
    return documents_of(docs).mapInArrow(_cutter(capacity, vocabulary), _PIECE)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rounds of best fit on the runs of sizes.

    Ranges ``(size, from_rank, to_rank, first_sequence, offset)``: the pieces of
    that size and those ranks go to consecutive sequences, all at that offset.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    given: dict[int, int] = defaultdict(int)  # ranks already placed, by size
    gaps: dict[int, list[tuple[int, int]]] = {}  # free room -> runs (first sequence, number)
    room: list[int] = []  # its keys, ascending
    out: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def place(size: int, sequence: int, n: int, free: int) -> None:
        out.append((size, given[size], given[size] + n, sequence, capacity - free))
        given[size] += n
        left[size] -= n
        if not left[size]:
            del left[size]

    def free_up(into: dict, size: int, sequence: int, n: int, free: int) -> None:
        if free > size:
            into.setdefault(free - size, []).append((sequence, n))

    while left:
        fresh: dict[int, list[tuple[int, int]]] = {}
        matched = False
        for size in sorted(left, reverse=True):
            at = bisect_left(room, size)
            while at < len(room) and left.get(size):
                free = room[at]
                runs = gaps[free]
                while runs and left.get(size):
                    first, n = runs.pop()
                    m = min(n, left[size])
                    place(size, first, m, free)
                    free_up(fresh, size, first, m, free)
                    matched = True
                    if m < n:
                        runs.append((first + m, n - m))
                if not runs:
                    del gaps[free], room[at]
        for size in sorted((s for s in left if 2 * s > capacity), reverse=True):
            n = left[size]
            place(size, opened, n, capacity)
            free_up(fresh, size, opened, n, capacity)
            opened += n
            matched = True
        if left and not matched:
            size = max(left)
            n = min(left[size], -(-sum(s * n for s, n in left.items()) // capacity))
            place(size, opened, n, capacity)
            free_up(fresh, size, opened, n, capacity)
            opened += n
        for free, runs in fresh.items():
            if free in gaps:
                gaps[free].extend(runs)
            else:
                gaps[free] = runs
                insort(room, free)
    return out


def ranked(parts: DataFrame) -> DataFrame:
    """``rank`` among pieces of equal length, by sorted ranges and their offsets."""
    order = ["length", "doc_id", "piece"]
    dealt = parts.repartitionByRange(*order, F.xxhash64("ids_crc32", "doc_id")).sortWithinPartitions(*order)
    sorted_parts = written(dealt.mapInArrow(_numbered, f"{_PIECE}, task int, nth long"), "pack-sorted")
    # a task holds consecutive lengths: about as many rows as tasks and lengths together
    per = written(
        sorted_parts.groupBy("task", "length").agg(F.max("nth").alias("n")), "pack-tasks"
    )
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    before = per.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return sorted_parts.join(F.broadcast(before), ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth") - 1)


def _numbered(batches):
    from pyspark import TaskContext

    task = TaskContext.get().partitionId()
    last, seen = None, 0
    for batch in batches:
        length = batch.column("length").to_numpy()
        if not len(length):
            continue
        new = np.ones(len(length), bool)
        new[1:] = length[1:] != length[:-1]
        begin = np.flatnonzero(new)
        nth = np.arange(len(length)) - np.repeat(begin, np.diff(np.append(begin, len(length)))) + 1
        if length[0] == last:
            head = len(length) if len(begin) == 1 else begin[1]
            nth[:head] += seen
        last, seen = length[-1], int(nth[-1])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(len(length), task, np.int32)), pa.array(nth)],
            [*batch.schema.names, "task", "nth"],
        )


def _placer(rows: list[tuple], capacity: int):
    by_size: dict[int, np.ndarray] = {}
    for size in {r[0] for r in rows}:
        by_size[size] = np.array(sorted(r[1:] for r in rows if r[0] == size), np.int64)

    def put(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                here = length == size
                table = by_size[int(size)]
                hit = table[np.searchsorted(table[:, 0], rank[here], side="right") - 1]
                sequence[here] = hit[:, 2] + rank[here] - hit[:, 0]
                offset[here] = hit[:, 3]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return put


def packed(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row per piece with ``sequence_id`` and ``offset``."""
    parts = ranked(written(pieces(docs, capacity, vocabulary), "pack-pieces"))
    # at most ``capacity`` rows
    counts = {r.length: r["count"] for r in parts.groupBy("length").count().collect()}
    return parts.mapInArrow(_placer(plan(counts, capacity), capacity), f"{_PIECE}, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"))
