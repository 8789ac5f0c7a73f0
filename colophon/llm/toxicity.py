"""Toxicity: a linear classifier over character n-grams scaled by log-count ratios.

Features are the n-grams of ``LENGTHS`` bytes of the text with A-Z lower-cased,
present or absent, hashed to ``2 ** BITS`` columns. Each column is scaled by its
naive Bayes log-count ratio, and logistic regression is fitted on the scaled
columns. Labels are read for training rows only; language, source and ids are no
inputs.

The fit uses at most ``SAMPLE`` labelled documents of each class, those of least
hashed id: a documented bound. Of rows that share an id the least text is learned from. One executor task fits on all n-grams of these, in
the order of ids and texts; the driver gets the weights only. All documents are
scored by their whole texts. A null or empty text has no features and gets the
score of the intercept; if the labels lack a class, every score is 0.0 (no toxic
rows) or 1.0. A document with several labels is toxic if one of them says so; null labels are left out.
Repeated rows are scored alike; an empty table gives no rows; other columns are
kept out of the way.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm.tables import documents_of, table
from colophon.llm.words import _BYTE_POWERS, STREAM_BYTES, distinct, slices

LENGTHS = (4, 5)
BITS = 20
SAMPLE = 2_000
BLOCK = 1 << 18
ALPHA = 0.5
RIDGE = 1e-4
STEPS = 150
THRESHOLD = 0.7

_FOLD = np.arange(256, dtype=np.uint64) + np.uint64(1)
_FOLD[65:91] += np.uint64(32)
for _b in (9, 10, 11, 12, 13):  # any white space is one
    _FOLD[_b] = _FOLD[32]


class Model(NamedTuple):
    weights: np.ndarray | None
    intercept: float


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature columns of each text, as ``(text, column)``, by text.

    Bytes are read in blocks that overlap by the longest n-gram, so that beside its
    features a long text takes no more memory than a short one.
    """
    # a blank before and after each text, so that words at its ends look like others
    size = np.diff(at) + 2
    first = np.concatenate([[0], np.cumsum(size)])
    code = np.full(int(first[-1]), 32, np.uint8)
    code[np.arange(len(data)) + 1 + 2 * np.repeat(np.arange(len(at) - 1), np.diff(at))] = data
    keys = [_keys(code, first, lo) for lo in range(0, len(code), BLOCK)]
    # at most 4096 texts a slice: 12 bits of text and BITS of column
    key = distinct(np.concatenate(keys)) if len(keys) > 1 else keys[0] if keys else np.zeros(0, np.uint32)
    return (key >> np.uint32(BITS)).astype(np.int32), (key & np.uint32((1 << BITS) - 1)).astype(np.int32)


def _keys(code: np.ndarray, first: np.ndarray, lo: int) -> np.ndarray:
    """Text and column, in one number, of the n-grams that begin in a block."""
    hi = min(lo + BLOCK, len(code))
    part = _FOLD[code[lo : hi + max(LENGTHS) - 1]]
    up, down = _BYTE_POWERS(len(part) + 1)
    total = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(part * up[:-1], out=total[1:])
    cuts = np.clip(first, lo, lo + len(part))
    owner = np.repeat(np.arange(len(first) - 1, dtype=np.uint32), np.diff(cuts))
    keys = []
    for n in LENGTHS:
        count = min(hi - lo, len(part) - n + 1)
        if count <= 0:
            continue
        hashed = (total[n : n + count] - total[:count]) * down[:count]
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xD6E8FEB86659FD93 + 2 * n)
        column = (hashed >> np.uint64(64 - BITS)).astype(np.uint32)
        one = owner[:count] == owner[n - 1 : n - 1 + count]
        keys.append((owner[:count][one] << np.uint32(BITS)) | column[one])
    return distinct(np.concatenate(keys)) if keys else np.zeros(0, np.uint32)



class Rows(NamedTuple):
    """Some rows of the sample: their labels, their columns, and where each row's begin."""

    label: np.ndarray
    column: np.ndarray
    first: np.ndarray


def _emit_model(batches):
    """The fit on all rows of the one task: a row of weights and intercept."""
    blocks = []
    for rows, data, at in slices(batches, STREAM_BYTES):
        owner, column = features(data, at)
        first = np.searchsorted(owner, np.arange(rows.num_rows + 1))
        blocks.append(Rows(rows.column("label").to_numpy().astype(np.float64), column, first))
    toxic = sum(b.label.sum() for b in blocks)
    if not toxic:
        model = Model(None, -np.inf)
    elif toxic == sum(len(b.label) for b in blocks):
        model = Model(None, np.inf)
    else:
        model = _regress(blocks)
    weights = None if model.weights is None else model.weights.tobytes()
    yield pa.RecordBatch.from_arrays(
        [pa.array([weights], pa.binary()), pa.array([model.intercept])], ["weights", "intercept"]
    )


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled rows that are not held out."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("toxic").cast("int").alias("label"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("label = 1").orderBy(*order).limit(SAMPLE).unionByName(
        known.where("label = 0").orderBy(*order).limit(SAMPLE)
    )
    rows = (
        documents_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    )
    # at most twice SAMPLE labelled ids; in this order sums are the same in every run
    found = rows.repartition(1).sortWithinPartitions("doc_id", "text").select("label", "text").mapInArrow(
        _emit_model, "weights binary, intercept double"
    ).collect()
    if not found:
        return Model(None, -np.inf)
    weights, intercept = found[0]
    return Model(None if weights is None else np.frombuffer(weights, np.float32), intercept)


def _regress(blocks: list[Rows]) -> Model:
    """Log-count ratios, then ridge-penalised logistic regression on the scaled columns.

    Features are held once, four bytes each, and read a block at a time; beside them
    there are only vectors of columns and of rows.
    """
    width = 1 << BITS
    seen = np.zeros(width, bool)
    for b in blocks:
        seen[b.column] = True
    known = np.flatnonzero(seen)
    place = np.zeros(width, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    for b in blocks:
        b.column[:] = place[b.column]
    y = np.concatenate([b.label for b in blocks])
    starts = np.cumsum([0] + [len(b.label) for b in blocks])

    def by_row(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y))
        for b, lo in zip(blocks, starts):
            filled = np.flatnonzero(np.diff(b.first))  # a row without features has no sum
            if len(filled):
                out[lo + filled] = np.add.reduceat(v[b.column], b.first[filled])
        return out

    def by_column(v: np.ndarray) -> np.ndarray:
        out = np.zeros(len(known))
        for b, lo in zip(blocks, starts):
            each = np.repeat(v[lo : lo + len(b.label)], np.diff(b.first))
            out += np.bincount(b.column, each, len(known))
        return out

    toxic, clean = ALPHA + by_column(y), ALPHA + by_column(1 - y)
    scale = np.log(toxic / toxic.sum()) - np.log(clean / clean.sum())
    length = by_row(scale**2)
    scale = scale / np.sqrt(max(length.mean(), 1e-12))  # rows of length 1 on average
    length = length / max(length.mean(), 1e-12)
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w, b = np.zeros(len(known)), 0.0
    fast, fast_b, t = w.copy(), b, 1.0
    # the curvature is at most a quarter of the mean squared length of a row
    step = 1.0 / (0.25 * (each @ (length + 1)) + RIDGE)
    for _ in range(STEPS):  # accelerated gradient steps
        z = by_row(scale * fast) + fast_b
        miss = each * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        new = fast - step * (scale * by_column(miss) + RIDGE * fast)
        new_b = fast_b - step * miss.sum()
        s = (1 + np.sqrt(1 + 4 * t * t)) / 2
        fast, fast_b = new + (t - 1) / s * (new - w), new_b + (t - 1) / s * (new_b - b)
        w, b, t = new, new_b, s
    weights = np.zeros(width, np.float32)
    weights[known] = w * scale
    return Model(weights, float(b))


def _scorer(model: Model):
    """Scores of an Arrow array of texts at a time."""

    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            out = []
            for rows, data, at in slices([pa.RecordBatch.from_arrays([array], ["text"])], STREAM_BYTES):
                total = np.full(rows.num_rows, model.intercept)
                if model.weights is not None:
                    owner, column = features(data, at)
                    total += np.bincount(owner, model.weights[column], rows.num_rows)
                if np.isfinite(model.intercept):
                    out.append(1 / (1 + np.exp(-np.clip(total, -60, 60))))
                else:
                    out.append(np.full(rows.num_rows, float(model.intercept > 0)))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return F.arrow_udf(score, "double")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score``, a row per document."""
    return documents_of(docs).select("doc_id", _scorer(model)("text").alias("score"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Only the text goes to Python, and only its score comes back.
    """
    score = _scorer(fit(docs, labels))(F.col("text").cast("string"))
    return docs.where(score < THRESHOLD)


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``."""
    return scored(docs, fit(docs, labels)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
