"""Carrying earlier output through and doing only the rest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.sources.shared import materialize

# Paths of new files are broadcast to the text scan up to this many bytes.
BROADCAST_BYTES = 64 * 1024 * 1024


def drop_failed(cache: DataFrame) -> DataFrame:
    """Cached books without an error."""
    return cache.where(F.coalesce(F.length("error"), F.lit(0)) == 0)


def skip_processed(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Rows of ``files`` whose path is not in the cache.

    Meant for narrow rows (paths, terms); see ``skip_processed_texts``.
    """
    return files.join(cache.select("filepath"), "filepath", "left_anti")


def skip_processed_texts(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """J1 for rows with whole texts, which are never shuffled.

    Only the path column is compared with the cache. If the new paths are few
    they are broadcast to the scan of the texts. Otherwise the texts come back
    as they are, together with the new paths, to be joined after extraction.
    """
    # a bucketed cache stays where it is, and the distinct paths too: they are of one key
    fresh, size = materialize(
        skip_processed(texts.select("filepath"), cache).distinct(), "fresh-paths", bytes=F.sum(F.octet_length("filepath"))
    )
    if (size["bytes"] or 0) <= BROADCAST_BYTES:
        return texts.join(F.broadcast(fresh), "filepath", "left_semi"), None
    return texts, fresh


def emit_once(records: DataFrame) -> DataFrame:
    """O1: one record per path, so that a rerun gives the same.

    A book goes before a failure; of several the least one stays.
    """
    others = [c for c in records.columns if c != "filepath"]
    failed = F.coalesce(F.length("error") > 0, F.lit(False)) if "error" in others else F.lit(False)
    return (
        records.groupBy("filepath")
        .agg(F.min(F.struct(failed.alias("__failed"), *others)).alias("r"))
        .select(*[F.col("filepath") if c == "filepath" else F.col(f"r.{c}").alias(c) for c in records.columns])
    )


def carry_through(cache: DataFrame, books: DataFrame) -> DataFrame:
    """O2: cached books and the new ones. J1 keeps the two apart."""
    return cache.unionByName(books)


def processed_count(books: DataFrame) -> DataFrame:
    """Number of processed files."""
    return books.agg(F.count(F.lit(1)).alias("processed"))
