"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.sources.shared import materialize as _write

# keys are broadcast up to this many rows of a few numbers, else they are shuffled
SMALL_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(df: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, whatever other columns there are."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, which cuts its lineage."""
    return _write(df, name)[0]


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The same, with its number of rows."""
    out, seen = _write(df, name, rows=F.count(F.lit(1)))
    return out, int(seen["rows"] or 0)


def sized(df: DataFrame, rows: int, most: int = SMALL_ROWS) -> DataFrame:
    """Marked for a broadcast if its counted rows are few; else Spark shuffles."""
    return F.broadcast(df) if rows <= most else df


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Whole groups of a stream sorted by ``keys``: batches that end where a key ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        cut = _last_start(batch, keys)
        if cut == 0 and len(held) > 1 and _same(held[-2], batch, keys):
            continue  # all of it goes on with the group that is open
        if cut == 0 and len(held) == 1:
            continue
        held[-1:] = [batch.slice(0, cut)] if cut else []
        yield _joined(held)
        held = [batch.slice(cut)]
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(parts) if len(parts) > 1 else parts[0]


def _last_start(batch: pa.RecordBatch, keys: list[str]) -> int:
    change = key_changes(batch, keys)
    return int(change[-1]) if len(change) else 0


def _same(a: pa.RecordBatch, b: pa.RecordBatch, keys: list[str]) -> bool:
    return all(a.column(k)[a.num_rows - 1].as_py() == b.column(k)[0].as_py() for k in keys)


def key_changes(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Rows, other than the first, at which a group begins."""
    new = np.zeros(max(batch.num_rows - 1, 0), bool)
    for k in keys:
        v = batch.column(k).to_numpy(zero_copy_only=False)
        new |= v[1:] != v[:-1]
    return np.flatnonzero(new) + 1
