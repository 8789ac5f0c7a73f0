"""Document fingerprints by order MinHash.

Units are words (runs without ASCII white space), longer ones cut into pieces of
``UNIT_BYTES`` bytes; a k-mer is ``GRAM`` units in a row, or all units of a text that
has fewer. Equal k-mers of a text are told apart by their occurrence number. Each of
``ROWS`` hash functions selects the ``TUPLE`` least occurrence-numbered k-mers; these
are put back into text order and hashed as a tuple. As a row agrees only if two texts
share k-mers *in the same order*, the share of agreeing rows follows edit distance,
not just set overlap. A fingerprint is ``ROWS`` hashes of 16 bits, in hex.

The next document, in the order of ``doc_id``, is found without a global sort in one
task: documents are dealt by quantiles of ``doc_id`` that are ids themselves, the first
document of each range is sent to the range before as well (that of the first range
to the last one), and ranges are read in sorted order.

A null text is empty. Two texts without units are alike (1.0), one with and one
without are not (0.0). A missing ``doc_id`` sorts first; rows of one id are ordered by
text and follow each other; the only document is its own next one. An empty table
gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm import words
from colophon.llm.tables import documents_of, table

UNIT_BYTES = 8
GRAM = 2
ROWS = 64
TUPLE = 2

_U = np.uint64
_SEEDS = words.mix(np.arange(ROWS, dtype=_U), 77) | _U(1)
_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _occurrences(keys: np.ndarray) -> np.ndarray:
    """How often each key came before."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    begin = np.flatnonzero(new)
    out = np.empty(len(keys), np.int64)
    out[order] = np.arange(len(keys)) - np.repeat(begin, np.diff(np.append(begin, len(keys))))
    return out


def _signature(keys: np.ndarray) -> np.ndarray:
    """One tuple hash per row for the k-mers of a text, in text order."""
    numbered = words.mix(keys + _occurrences(keys).astype(_U) * _U(0x9E3779B97F4A7C15), 3)
    count = min(TUPLE, len(numbered))
    best = np.zeros((ROWS, count), np.int64)
    step = max(1, (1 << 17) // len(numbered))
    for lo in range(0, ROWS, step):  # a block of rows at a time bounds memory for long texts
        value = numbered ^ (numbered >> _U(29))
        value = value[None, :] * _SEEDS[lo : lo + step, None]
        value ^= value >> _U(32)
        value *= _U(0xD6E8FEB86659FD93)
        rows = np.arange(len(value))
        for j in range(count):
            least = value.argmin(axis=1)
            best[lo : lo + step, j] = least
            value[rows, least] = _U(0xFFFFFFFFFFFFFFFF)
    best.sort(axis=1)
    out = np.zeros(ROWS, _U)
    for j in range(count):
        out = words.mix(out * _U(3) + numbered[best[:, j]], j)
    return out >> _U(48)


def signatures(texts: list[str]) -> list[np.ndarray | None]:
    """A row of 16-bit tuple hashes per text; None for texts without units."""
    out: list[np.ndarray | None] = []
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], ["text"])
    for _, data, at in words.slices([batch]):
        found = words.split(data, at, words.PLAIN, UNIT_BYTES)
        pairs, _ = words.grams(found, GRAM)
        for lo, hi in zip(found.first, found.first[1:]):
            if hi - lo >= GRAM:
                out.append(_signature(pairs[lo : hi - GRAM + 1]))
            else:
                out.append(_signature(found.hash[lo:hi]) if hi > lo else None)
    return out


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Share of rows that agree."""
    if a is None or b is None:
        return float(a is b)
    return float((a == b).mean())


def _hex(s: np.ndarray | None) -> str:
    return "" if s is None else s.astype(">u2").tobytes().hex()


def _edited(text: str, after: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _compare(batches):
    """Rows sorted by range, with a copy of the next range's first document at its end."""
    held: list[tuple] = []
    size = 0
    for batch in batches:
        part, tail, ids = (batch.column(c).to_pylist() for c in ("part", "tail", "doc_id"))
        for i in range(batch.num_rows):
            text = batch.column("text")[i].as_py() or ""
            held.append((part[i], tail[i], ids[i], text))
            size += len(text)
            if size >= words.SLICE_BYTES // 2 or len(held) >= 4096:
                yield _pairs(held)
                held, size = held[-1:], len(held[-1][3])
    if held:
        yield _pairs(held)


def _pairs(held: list[tuple]) -> pa.RecordBatch:
    own = signatures([h[3] for h in held])
    at = [i for i in range(len(held) - 1) if not held[i][1] and held[i][0] == held[i + 1][0]]
    changed = [_edited(held[i][3], held[i + 1][3]) for i in at]
    other = signatures(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([held[i][2] for i in at], pa.int64()),
            pa.array([len(held[i][3]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed], pa.string()),
            pa.array([_hex(own[i]) for i in at], pa.string()),
            pa.array([_hex(s) for s in other], pa.string()),
            pa.array([likeness(own[i], s) for i, s in zip(at, other)], pa.float64()),
            pa.array([likeness(own[i], own[i + 1]) for i in at], pa.float64()),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _ranges(docs: DataFrame) -> list[int]:
    """Ids at which ranges begin, ascending: about four ranges for each shuffle partition."""
    number = min(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4096)
    at = F.percentile_approx("doc_id", [i / number for i in range(number)], 20 * number)
    return sorted(set(docs.agg(at.alias("q")).first().q or []))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and their likeness."""
    docs = documents_of(docs)
    bounds = _ranges(docs)
    starts = np.array(bounds[1:], np.int64)
    last = len(starts)

    @F.pandas_udf("int")
    def part_of(ids: pd.Series) -> pd.Series:
        known = ids.notna()
        part = np.searchsorted(starts, ids.where(known, 0).to_numpy(np.int64), side="right")
        return pd.Series(np.where(known, part, 0).astype(np.int32))

    first = F.col("doc_id").isin(bounds[1:])
    if bounds:
        first = first | F.col("doc_id").isNull() | (F.col("doc_id") == bounds[0])
    else:
        first = F.lit(True)  # no row has an id
    before = F.when(F.col("part") == 0, last).otherwise(F.col("part") - 1)
    here = F.struct(F.col("part").alias("part"), F.lit(0).alias("tail"))
    there = F.struct(before.alias("part"), F.lit(1).alias("tail"))
    dealt = (
        docs.withColumn("part", part_of("doc_id"))
        .withColumn("to", F.explode(F.when(F.coalesce(first, F.lit(False)), F.array(here, there)).otherwise(F.array(here))))
        .select("to.part", "to.tail", "doc_id", "text")
    )
    order = ["part", "tail", "doc_id", "text"]
    number = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(number, "part").sortWithinPartitions(*order).mapInArrow(_compare, _OUT)


def query(spark, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
