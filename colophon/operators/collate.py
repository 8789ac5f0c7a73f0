"""Candidate results to one book per file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.records import has_confidence, or_empty
from colophon.schemas import BOOK, RESULT

NO_RESULTS = "error: no results found"
NOT_COLLATED = "could not collate: none of the results had a confidence"


def gather_results(per_provider: list[DataFrame]) -> DataFrame:
    """A5: the results of all providers."""
    return reduce(DataFrame.unionByName, per_provider)


def choose_best(results: DataFrame) -> DataFrame:
    """A2: the most confident result per file.

    Ties go to the first provider, then to the first term. A file none of whose
    results has a confidence comes back with the result columns NULL.
    """
    fields = [f.name for f in RESULT if f.name != "filepath"]
    rank = F.struct(F.col("confidence"), -F.col("provider_ord"), -F.col("ord"))
    best = F.max_by(
        F.struct(*fields), F.when(has_confidence(F.col("confidence")), rank)
    ).alias("best")
    return results.groupBy("filepath").agg(best).select(
        "filepath", *[F.col(f"best.{f}").alias(f) for f in fields]
    )


def book_struct(**fields: Column) -> Column:
    """A BOOK struct; fields that are not given are NULL, the title is ''."""
    fields["title"] = or_empty(fields.get("title", F.lit("")))
    return F.struct(
        *[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in BOOK]
    )


def to_book(results: DataFrame) -> DataFrame:
    """Results as books."""
    names = [f.name for f in BOOK if f.name != "error"]
    return results.select(book_struct(**{n: F.col(n) for n in names}).alias("book")).select(
        "book.*"
    )
