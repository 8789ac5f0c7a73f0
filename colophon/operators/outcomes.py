"""What became of every file."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from colophon.operators.collate import book_struct

STAGES = ["extract", "search", "collate"]


def failed_extraction(extracted: DataFrame) -> DataFrame:
    """E1 for a dry run: the files without text, each once."""
    failed = (
        extracted.groupBy("filepath")
        .agg(F.max(F.col("error").isNull()).alias("ok"), F.max("error").alias("error"))
        .where(~F.col("ok"))
    )
    return failed.select(
        "filepath",
        F.lit("extract").alias("stage"),
        F.lit("failed").alias("status"),
        "error",
        book_struct(filepath=F.col("filepath"), error=F.col("error")).alias("book"),
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """Files per stage and status."""
    return outcomes.groupBy("stage", "status").agg(F.count(F.lit(1)).alias("files"))


def observe_outcomes(outcomes: DataFrame, observation: Observation) -> DataFrame:
    """A6 without a pass of its own: counts noted while ``outcomes`` are used."""
    stage, ok = F.col("stage"), F.col("status") == "ok"
    return outcomes.observe(
        observation,
        F.count(F.lit(1)).alias("files"),
        F.count_if(ok).alias("ok"),
        *[F.count_if(~ok & (stage == s)).alias(f"{s}_failed") for s in STAGES],
    )


def books_of(outcomes: DataFrame, compat: bool = False) -> DataFrame:
    """One book per file. ``compat`` keeps only successes and files without
    text, which is all that the reference writes."""
    if compat:
        outcomes = outcomes.where((F.col("status") == "ok") | (F.col("stage") == "extract"))
    return outcomes.select("book.*")
