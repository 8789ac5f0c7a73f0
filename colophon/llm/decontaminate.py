"""Benchmark decontamination by winnowing.

Words are runs of ASCII letters and digits and of anything beyond ASCII, A-Z
lower-cased. A window is ``WINDOW`` consecutive words of a benchmark item; an
item of fewer words, but not none, is one window. A document word inside any
occurrence of a window is hit.

Winnowing keeps, of the ``GRAM``-word hashes inside each window, the least (the
first of equal ones), in items and documents alike. Equal windows keep equal
fingerprints, so every shared window meets in the join on fingerprints. A
fingerprint carries the hashes of the windows that chose it; a joined pair is
extended to those that are equal. For items shorter than a window the
fingerprint is the hash of the whole item, and documents give every run of that
many words, only if the benchmark has such items.

The benchmark's fingerprints are broadcast if their counted rows are few;
otherwise both sides are shuffled by fingerprint.

Null and wordless texts have no words and no hits. Rows that share ``doc_id``
are judged by their own words. Repeated rows give repeated results. Items
without ``item_id`` hit words but count as no item. Empty tables give no rows, or
no hits. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm import words
from colophon.llm.tables import counted, documents_of, sized, table, written

WINDOW = 10
GRAM = 5

_ROW = "id string, words_key long, fp long, size int, start long, windows array<long>"


def _chosen(found: words.Words, window: int, gram: int):
    """Places, and runs of windows that chose them, as ``(fp, first, last)``."""
    whole, one = words.grams(found, window)
    if not one.any():
        none = np.zeros(0, np.int64)
        return whole, none, none, none
    short, _ = words.grams(found, gram)
    place = words.window_min(short, window - gram + 1)[: len(whole)]
    at = np.flatnonzero(one)
    place, own = place[at], found.doc[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (own[1:] != own[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return whole, short[place[begin]], at[begin], at[end]


def _keys(found: words.Words) -> np.ndarray:
    """A hash of each text's whole sequence of words."""
    up, _ = words._WORD_POWERS(len(found.hash) + 1)
    place = np.arange(len(found.hash)) - found.first[:-1][found.doc]
    total = np.zeros(len(found.hash) + 1, np.uint64)
    np.cumsum(words.mix(found.hash * up[place]), out=total[1:])
    return (total[found.first[1:]] - total[found.first[:-1]]).view(np.int64)


def _fingerprints(sizes: list[int], window: int, gram: int, whole_only: bool):
    def of(batches):
        for rows, data, at in words.slices(batches, words.STREAM_BYTES):
            found = words.split(data, at, words.ALNUM)
            if not len(found.hash):
                continue
            keys = _keys(found)
            ids = rows.column("id")
            hashed, fp, lo, hi = _chosen(found, window, gram)
            yield _batch(ids, keys, found, fp, window, lo, hi, hashed)
            count = np.diff(found.first)
            for m in sizes:
                hashed, one = words.grams(found, m)
                lo = found.first[:-1][count == m] if whole_only else np.flatnonzero(one)
                yield _batch(ids, keys, found, hashed[lo], m, lo, lo, hashed)

    return of


def _batch(ids, keys, found, fp, size, lo, hi, hashed) -> pa.RecordBatch:
    own = found.doc[lo]
    length = hi - lo + 1
    first = np.concatenate([[0], np.cumsum(length)])
    # the windows of a run lie side by side
    each = np.arange(first[-1]) - np.repeat(first[:-1] - lo, length)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(own)),
            pa.array(keys[own]),
            pa.array(fp.view(np.int64)),
            pa.array(np.full(len(lo), size, np.int32)),
            pa.array(lo - found.first[:-1][own]),
            pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashed[each].view(np.int64))),
        ],
        ["id", "words_key", "fp", "size", "start", "windows"],
    )


def _counts(batches):
    for rows, data, at in words.slices(batches, words.STREAM_BYTES):
        found = words.split(data, at, words.ALNUM)
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), pa.array(_keys(found)), pa.array(np.diff(found.first))],
            ["doc_id", "words_key", "n_words"],
        )


def _short_sizes(window: int):
    def of(batches):
        for _, data, at in words.slices(batches, words.STREAM_BYTES):
            count = np.diff(words.split(data, at, words.ALNUM).first)
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(count[(count > 0) & (count < window)]))], ["n"])

    return of


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``(doc_id, words_key, start, size, item_id)`` per occurrence of an item's window."""
    texts = items.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    # at most window - 1 numbers
    sizes = sorted(r.n for r in texts.mapInArrow(_short_sizes(window), "n long").distinct().collect())
    known, n = counted(
        texts.mapInArrow(_fingerprints(sizes, window, gram, True), _ROW)
        .select(F.col("fp"), F.col("size"), F.col("id").alias("item_id"), F.col("windows").alias("own"))
        .distinct(),
        "fingerprints",
    )
    rows = documents_of(docs).select(F.col("doc_id").cast("string").alias("id"), "text")
    found = rows.mapInArrow(_fingerprints(sizes, window, gram, False), _ROW)
    met = found.join(sized(known, n), ["fp", "size"]).where(F.arrays_overlap("windows", "own"))
    return (
        met.select(F.col("id").cast("long").alias("doc_id"), "words_key", "start", "size", "item_id", "own", F.posexplode("windows").alias("i", "hash"))
        .where(F.array_contains("own", F.col("hash")))
        .select("doc_id", "words_key", (F.col("start") + F.col("i")).alias("start"), "size", "item_id")
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``, a row per document."""
    found = hits(docs, items, window, gram)
    spans = F.transform(F.collect_set(F.struct("start", "size")), lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1))
    ids = F.array_sort(F.collect_set("item_id"))
    per = found.groupBy("doc_id", "words_key").agg(
        F.size(F.array_distinct(F.flatten(spans))).cast("long").alias("n_hit"),
        ids.alias("ids"),
    )
    per = written(per.select(F.col("doc_id").alias("hit_id"), F.col("words_key").alias("hit_key"), "n_hit", "ids"), "hits")
    base = documents_of(docs).mapInArrow(_counts, "doc_id long, words_key long, n_words long")
    both = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("words_key") == F.col("hit_key"))
    none = F.array().cast("array<string>")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return base.join(per, both, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(F.coalesce("ids", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", none), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document has no hit, with all their columns."""
    bad, n = counted(hits(docs, items).select(F.col("doc_id").alias("__hit")).distinct(), "contaminated")
    return docs.join(sized(bad, n), F.col("doc_id").cast("long").eqNullSafe(F.col("__hit")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
