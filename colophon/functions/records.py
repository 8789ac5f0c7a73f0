"""Field rules of books and results as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colophon.schemas import BOOK


def or_empty(c: Column) -> Column:
    """Absent becomes the empty string."""
    return F.coalesce(c, F.lit(""))


def pick_identifier(identifiers: Column, kind: str) -> Column:
    """H8: last identifier of a type (isbn_10, isbn_13, uom), any case."""
    matching = F.filter(identifiers, lambda x: F.lower(x["type"]) == kind)
    return F.try_element_at(matching, F.lit(-1))["identifier"]


def has_confidence(confidence: Column) -> Column:
    """Above zero and not NaN (Spark orders NaN above every number)."""
    return F.coalesce(~F.isnan(confidence) & (confidence > 0), F.lit(False))


def is_unidentified() -> Column:
    """A result with neither title, authors nor ISBN."""
    return (
        F.col("title").isNull()
        & F.col("authors").isNull()
        & F.col("isbn10").isNull()
        & F.col("isbn13").isNull()
    )


def best_identifier() -> Column:
    """H9: the most specific non-empty identifier of a book."""
    return F.coalesce(
        *[F.nullif(F.col(c), F.lit("")) for c in ("isbn13", "isbn10", "uom", "title")],
        F.col("filepath"),
    )


def written_book() -> Column:
    """A book as it is written: empty fields are NULL, which to_json leaves out."""

    def field(f):
        c = F.col(f.name)
        if f.name in ("title", "filepath"):
            return or_empty(c)
        if f.name == "authors":
            return F.when(F.size(c) > 0, c)
        if f.name in ("low_year", "high_year"):
            return F.nullif(c, F.lit(0).cast("bigint"))
        return F.nullif(c, F.lit(""))

    return F.struct(*[field(f).alias(f.name) for f in BOOK])


def book_json() -> Column:
    """A book as JSON without its empty fields."""
    return F.to_json(written_book())


def object_key(filepath: Column, mode: str = "escaped") -> Column:
    """A quoted JSON key. ``mode="compat"`` drops quotes, escapes nothing."""
    if mode == "compat":
        return F.concat(F.lit('"'), F.replace(filepath, F.lit('"'), F.lit("")), F.lit('"'))
    if mode != "escaped":
        raise ValueError(f"unknown key mode: {mode}")
    # {"<key>":0} without the braces and the value
    pair = F.to_json(F.create_map(filepath, F.lit(0)))
    return F.substr(pair, F.lit(2), F.length(pair) - 4)
