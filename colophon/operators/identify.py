"""Texts to search terms (P3, P4, P13, A4, O3, H4). No shuffle but for A4."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions import isbn, text as tx

NO_TEXT = "no texts extracted"


def _or_none(isbns: Column) -> Column:
    return F.coalesce(isbns, F.array().cast("array<string>"))


def supported(files: DataFrame) -> DataFrame:
    """Rows whose ``filepath`` has an accepted extension."""
    return files.where(tx.is_supported(F.col("filepath")))


def extract_terms(
    texts: DataFrame,
    max_bytes: int | None = None,
    min_bytes: int | None = None,
    strict_length: bool = False,
) -> DataFrame:
    """``(filepath, text[, error])`` to ``(filepath, isbn10s, isbn13s, error)``.

    The whole text is searched. With ``max_bytes`` only its first bytes are
    (P3), and a text shorter than that fails unless ``min_bytes`` says
    otherwise (P4). A failed row keeps its place with ``error`` set.
    """
    if min_bytes is None:
        min_bytes = max_bytes or 1
    text = F.col("text")
    enough = tx.enough_text(text, min_bytes)
    if "error" in texts.columns:
        enough = enough & F.col("error").isNull()
    window = tx.truncate_bytes(text, max_bytes) if max_bytes else text
    windows = texts.select(
        "filepath",
        F.when(~enough, NO_TEXT).alias("error"),
        F.when(enough, window).alias("text"),
    )
    found = isbn.identify_isbns(windows, "text", strict_length)
    return found.select(
        "filepath",
        _or_none(F.col("isbn10s")).alias("isbn10s"),
        _or_none(F.col("isbn13s")).alias("isbn13s"),
        "error",
    )


def gather_terms(extracted: list[DataFrame]) -> DataFrame:
    """A4: one row per file from the outputs of several extractors.

    Terms are appended in extractor order; a failed extractor is skipped, and a
    file fails if all of them failed. If an extractor returned a path more than
    once, its different readable rows are appended in a fixed order.
    """
    tagged = reduce(
        DataFrame.unionByName,
        [df.withColumn("extractor_ord", F.lit(i)) for i, df in enumerate(extracted)],
    )
    per_extractor = tagged.groupBy("filepath").agg(
        *[
            F.array_sort(
                F.collect_set(
                    F.when(
                        (F.col("extractor_ord") == i) & F.col("error").isNull(),
                        F.struct("isbn10s", "isbn13s"),
                    )
                )
            ).alias(f"terms_{i}")
            for i in range(len(extracted))
        ]
    )
    parts = [F.col(f"terms_{i}") for i in range(len(extracted))]

    def appended(name: str) -> Column:
        return F.concat(*[F.flatten(p[name]) for p in parts]).alias(name)

    return per_extractor.select(
        "filepath",
        appended("isbn10s"),
        appended("isbn13s"),
        F.when(F.size(F.concat(*parts)) == 0, NO_TEXT).alias("error"),
    )


def search_terms(extracted: DataFrame) -> DataFrame:
    """The terms of the files whose text was extracted."""
    return extracted.where(F.col("error").isNull()).select("filepath", "isbn10s", "isbn13s")


def has_any_terms() -> Column:
    """P10: at least one identifier of either kind."""
    return F.size("isbn10s") + F.size("isbn13s") > 0


def lookup_terms(terms: DataFrame) -> DataFrame:
    """O3: one row per identifier, ISBN-10s first, with its place ``ord``."""

    def tagged(name, kind):
        return F.transform(name, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("isbn")))

    terms_col = F.concat(tagged("isbn10s", "isbn10"), tagged("isbn13s", "isbn13"))
    return terms.select("filepath", F.posexplode(terms_col).alias("ord", "term")).select(
        "filepath", "ord", "term.kind", "term.isbn"
    )


def asked_isbns(terms: DataFrame) -> DataFrame:
    """O3 for a run: ``(filepath, ord, isbn)`` with each ISBN of a file once.

    A number in the footer of every page is one lookup. ``ord`` keeps the order
    of first occurrence, which is all that choosing the best result needs.
    """
    isbns = F.array_distinct(F.concat("isbn10s", "isbn13s"))
    return terms.select("filepath", F.posexplode(isbns).alias("ord", "isbn"))
