"""Substring dedup over a compacted De Bruijn graph of words.

Words are runs without ASCII white space. Every run of ``WINDOW`` words is an edge of
the graph, from its first words to its last. Edges are compacted where they are made:
consecutive windows of a text that share their least ``GRAM``-word hash (their mark)
are one path, a row with its mark, a hash of all its words and its place. Equal windows
have equal marks, so a path whose mark occurs once repeats nothing.

1. Marks are counted; a join keeps the paths of repeated marks.
2. Equal paths are joined with their earliest place. Every other place repeats it
   as a whole: those words are covered. This settles the inside of every repeat.
3. Different paths that share a mark are branches: there some windows may agree and
   others not. Only for the earliest place of each such path the single windows
   are hashed, and joined with their own earliest place.
4. The covered places are put together per document and the other words hashed.

No step gathers a key: marks, paths and windows are counted or reduced to their
earliest place by partial aggregates, and joined back. Texts are shuffled once; of
documents without repeated marks only their digest goes on.

"Earlier" is a smaller ``doc_id`` (a missing one is the smallest), or an earlier start.
Rows that share ``doc_id`` are read as one document: repeated rows don't cover each
other, and places of one apply to all. Null and short texts lose nothing; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm import words
from colophon.llm.tables import documents_of, table, written

WINDOW = 20
GRAM = 6

_SPAN = "array<struct<start:int,n:int>>"
_U = np.uint64


def _paths(window: int, gram: int, only_marks: bool):
    """Compacted runs of windows of each text."""

    def of(batches):
        for rows, data, at in words.slices(batches):
            found = words.split(data, at, words.PLAIN)
            count = len(found.hash) - window + 1
            if count <= 0:
                continue
            one = np.flatnonzero(found.doc[:count] == found.doc[window - 1 :])
            if not len(one):
                continue
            short, _ = words.grams(found, gram)
            place, own = words.window_min(short, window - gram + 1)[one], found.doc[one]
            new = np.ones(len(one), bool)
            new[1:] = (place[1:] != place[:-1]) | (own[1:] != own[:-1])
            begin = np.flatnonzero(new)
            lo, n = one[begin], np.diff(np.append(begin, len(one)))
            mark = pa.array(short[place[begin]].view(np.int64))
            if only_marks:
                yield pa.RecordBatch.from_arrays([mark], ["mark"])
                continue
            up, down = words._WORD_POWERS(len(found.hash) + 1)
            total = np.zeros(len(found.hash) + 1, _U)
            np.cumsum(found.hash * up[:-1], out=total[1:])
            path = words.mix((total[lo + n + window - 1] - total[lo]) * down[lo] + n.astype(_U), 9)
            yield pa.RecordBatch.from_arrays(
                [
                    mark,
                    pa.array(path.view(np.int64)),
                    rows.column("doc_id").take(pa.array(own[begin])),
                    pa.array((lo - found.first[:-1][own[begin]]).astype(np.int32)),
                    pa.array(n.astype(np.int32)),
                ],
                ["mark", "path", "doc_id", "start", "n"],
            )

    return of


def _covered(count: int, spans, window: int) -> np.ndarray:
    """Flags of the words inside any window of the spans."""
    step = np.zeros(count + 1, np.int64)
    for span in spans:
        lo = span["start"]
        if lo < count:
            step[lo] += 1
            step[min(lo + span["n"] + window - 1, count)] -= 1
    return np.cumsum(step[:-1]) > 0


def _rest(raw: bytes, found: words.Words, i: int, gone: np.ndarray | None = None) -> str:
    """The digest of the words of text ``i`` that are not gone."""
    lo, hi = found.first[i], found.first[i + 1]
    start, end = found.start[lo:hi], found.end[lo:hi]
    if gone is not None:
        start, end = start[~gone], end[~gone]
    kept = b" ".join(raw[a:b] for a, b in zip(start.tolist(), end.tolist()))
    return hashlib.sha256(kept).hexdigest()


_DIGEST = "doc_id long, n_words long, kept_sha256 string, text string, gone " + _SPAN + ", asked " + _SPAN


def _digests(batches):
    """Finish texts that repeat nothing; the others go on with their text."""
    for rows, data, at in words.slices(batches):
        found = words.split(data, at, words.PLAIN)
        raw = data.tobytes()
        settled = [not g and not a for g, a in zip(rows.column("gone").to_pylist(), rows.column("asked").to_pylist())]
        sha = [_rest(raw, found, i) if s else None for i, s in enumerate(settled)]
        texts = [None if s else t or "" for s, t in zip(settled, rows.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays(
            [
                rows.column("doc_id"),
                pa.array(np.diff(found.first)),
                pa.array(sha, pa.string()),
                pa.array(texts, pa.string()),
                rows.column("gone"),
                rows.column("asked"),
            ],
            ["doc_id", "n_words", "kept_sha256", "text", "gone", "asked"],
        )


def _windows(window: int):
    """The single windows of the asked places."""

    def of(batches):
        for rows, data, at in words.slices(batches):
            found = words.split(data, at, words.PLAIN)
            hashed, _ = words.grams(found, window)
            asked = rows.column("asked").to_pylist()
            doc, start = [], []
            for i, spans in enumerate(asked):
                last = found.first[i + 1] - found.first[i] - window
                for s in spans or ():
                    place = np.arange(s["start"], min(s["start"] + s["n"], last + 1))
                    doc.append(np.full(len(place), i))
                    start.append(place)
            if not doc:
                continue
            doc, start = np.concatenate(doc), np.concatenate(start)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashed[found.first[doc] + start].view(np.int64)),
                    rows.column("doc_id").take(pa.array(doc)),
                    pa.array(start.astype(np.int32)),
                ],
                ["edge", "doc_id", "start"],
            )

    return of


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _results(window: int):
    def of(batches):
        for rows, data, at in words.slices(batches):
            found = words.split(data, at, words.PLAIN)
            raw = data.tobytes()
            sha, gone, more = (rows.column(c).to_pylist() for c in ("kept_sha256", "gone", "more"))
            removed = [0] * rows.num_rows
            for i in range(rows.num_rows):
                if sha[i] is None:
                    n = int(found.first[i + 1] - found.first[i])
                    flags = _covered(n, [*(gone[i] or ()), *(more[i] or ())], window)
                    removed[i], sha[i] = int(flags.sum()), _rest(raw, found, i, flags)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("n_words"), pa.array(removed, pa.int64()), pa.array(sha, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return of


def _same(left: str, right: str):
    return F.col(left).eqNullSafe(F.col(right))


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``, a row per document."""
    docs = documents_of(docs)
    marks = written(
        docs.select("text").mapInArrow(_paths(window, gram, True), "mark long")
        .groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark"),
        "marks",
    )
    every = docs.mapInArrow(_paths(window, gram, False), "mark long, path long, doc_id long, start int, n int")
    paths = written(every.join(marks, "mark", "left_semi"), "paths")

    place = F.struct("doc_id", "start")
    known = paths.groupBy("mark", "path").agg(F.min(place).alias("first"))
    branching = known.groupBy("mark").agg(F.count(F.lit(1)).alias("n_paths"))
    earliest = written(
        known.join(branching, "mark").select(
            F.col("path").alias("p"), F.col("mark").alias("m"), "first", (F.col("n_paths") > 1).alias("branches")
        ),
        "earliest",
    )
    span = F.struct("start", "n")
    per_doc = (
        paths.join(earliest, (F.col("path") == F.col("p")) & (F.col("mark") == F.col("m")))
        .withColumn("first_here", _same("doc_id", "first.doc_id") & (F.col("start") == F.col("first.start")))
        .where(~F.col("first_here") | F.col("branches"))
        .groupBy(F.col("doc_id").alias("of"))
        .agg(
            F.collect_list(F.when(~F.col("first_here"), span)).alias("gone"),
            F.collect_list(F.when(F.col("first_here") & F.col("branches"), span)).alias("asked"),
        )
    )
    texts = written(
        docs.join(per_doc, _same("doc_id", "of"), "left").select("doc_id", "text", "gone", "asked").mapInArrow(_digests, _DIGEST),
        "repeating",
    )
    edges = texts.where("size(asked) > 0").select("doc_id", "text", "asked").mapInArrow(
        _windows(window), "edge long, doc_id long, start int"
    )
    edges = written(edges.distinct(), "edges")
    repeated = edges.groupBy("edge").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    more = (
        edges.join(repeated, "edge")
        .where(~(_same("doc_id", "first.doc_id") & (F.col("start") == F.col("first.start"))))
        .groupBy(F.col("doc_id").alias("of"))
        .agg(F.collect_list(F.struct("start", F.lit(1).alias("n"))).alias("more"))
    )
    return (
        texts.join(more, _same("doc_id", "of"), "left")
        .select("doc_id", "n_words", "kept_sha256", "text", "gone", "more").mapInArrow(_results(window), _RESULT)
    )


def query(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"))
