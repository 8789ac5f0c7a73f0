"""The whole run: texts and providers to one book or error per file.

The texts are read once, map-only, into a narrow table of terms. Everything
that shuffles works on that table, and what providers returned about a book is
fetched only for the one ISBN that won for a file.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from colophon.functions.records import has_confidence
from colophon.functions.text import basename
from colophon.operators import answers as an
from colophon.operators import collate, identify, incremental, lookup, outcomes
from colophon.operators.skew import MIN_HOT_ROWS, salted_left_join
from colophon.schemas import BOOK
from colophon.sources.shared import materialize


@dataclass(frozen=True)
class Provider:
    """Where ISBNs are looked up.

    ``responses`` is a table ``(isbn, status, body)`` or a function from the
    distinct ISBNs to one; of a table with a column ``provider`` only this
    provider's rows count. ``volumes`` is a catalogue. ``missing`` says what an
    ISBN without a row means: ``"error"`` (responses) or ``"zero_hit"``
    (catalogues).
    """

    name: str
    responses: DataFrame | Callable[[DataFrame], DataFrame] | None = None
    volumes: DataFrame | None = None
    missing: str | None = None
    confidence: float = an.CONFIDENCE
    enabled: bool = True

    def __post_init__(self):
        if (self.responses is None) == (self.volumes is None):
            raise ValueError("a provider has either responses or volumes")
        if self.missing not in (None, *lookup.MISSING_MODES):
            raise ValueError(f"unknown missing mode: {self.missing}")

    @property
    def missing_fails(self) -> bool:
        return (self.missing or ("error" if self.volumes is None else "zero_hit")) == "error"

    def answers(self, provider_ord: int, isbns: DataFrame | None) -> DataFrame:
        if self.volumes is not None:
            return an.catalogue_answers(
                self.volumes, self.name, provider_ord, self.confidence, isbns=isbns
            )
        rows = self.responses(isbns) if callable(self.responses) else self.responses
        if "provider" in rows.columns:
            rows = rows.where(F.col("provider") == self.name)
        return an.response_answers(rows, self.name, provider_ord, self.confidence, isbns)


@dataclass(frozen=True)
class ScanResult:
    """Tables of one run. ``outcomes`` has one row per newly scanned file:
    ``(filepath, stage, status, error, book)``."""

    outcomes: DataFrame
    search_terms: DataFrame
    answers: DataFrame | None
    cached: DataFrame | None
    providers: tuple[str, ...] = ()

    def books(self, compat: bool = False) -> DataFrame:
        """Cached books and those of this run."""
        new = outcomes.books_of(self.outcomes, compat)
        return new if self.cached is None else incremental.carry_through(self.cached, new)

    def summary(self) -> DataFrame:
        """Files per stage and status."""
        return outcomes.run_summary(self.outcomes)

    def observed(self, observation: Observation) -> ScanResult:
        """The same run, its counts noted in ``observation`` as it is written."""
        return replace(self, outcomes=outcomes.observe_outcomes(self.outcomes, observation))

    def plan_lookups(self, answers: DataFrame | None = None, budget: int | None = None) -> DataFrame:
        """Requests worth making (L1), given answers or those of the run.

        After a dry run without answers that is all the run would ask for.
        """
        known = self.answers if answers is None else answers
        terms = identify.asked_isbns(self.search_terms)
        return lookup.plan_lookups(terms, known, list(self.providers), budget)


def enabled_providers(providers: list[Provider]) -> list[Provider]:
    """The enabled providers; there must be one."""
    enabled = [p for p in providers if p.enabled]
    if not enabled:
        raise ValueError("at least one provider must be enabled")
    return enabled


def answer_table(providers: list[Provider], isbns: DataFrame | None = None) -> DataFrame:
    """The answers of all enabled providers, written once for any number of runs.

    With ``isbns`` only these are looked up in each provider's table.
    """
    parts = [p.answers(k, isbns) for k, p in enumerate(enabled_providers(providers))]
    return materialize(reduce(DataFrame.unionByName, parts), "answers")[0]


def scan(
    texts: DataFrame | list[DataFrame],
    providers: list[Provider],
    cache: DataFrame | None = None,
    retry: bool = False,
    dry_run: bool = False,
    max_bytes: int | None = None,
    min_bytes: int | None = None,
    strict_length: bool = False,
    distance: str = "levenshtein",
    answers: DataFrame | None = None,
    hot_rows: int = MIN_HOT_ROWS,
) -> ScanResult:
    """Identify the books in ``texts``.

    ``texts`` is ``(filepath, text[, error])``, or a list of such tables, one
    per extractor. ``cache`` holds the books of earlier runs, each path once (see
    ``emit_once``): they are kept and their files skipped, with ``retry`` only
    those without an error. A ``dry_run`` stops before the lookups. The reference's own limits are
    ``max_bytes=10_000``; by default whole texts are searched. ``answers`` from
    ``answer_table`` saves reading the providers again.
    """
    extractors = texts if isinstance(texts, list) else [texts]
    if not extractors:
        raise ValueError("at least one extractor must be enabled")
    providers = enabled_providers(providers)
    if retry and cache is None:
        raise ValueError("retry needs a cache")
    if cache is not None:
        cache = cache.select(*BOOK.fieldNames())
        cache = incremental.drop_failed(cache) if retry else cache

    def extract(table: DataFrame) -> DataFrame:
        table, fresh = identify.supported(table), None
        if cache is not None:
            table, fresh = incremental.skip_processed_texts(table, cache)
        rows = identify.extract_terms(table, max_bytes, min_bytes, strict_length)
        return rows if fresh is None else rows.join(fresh, "filepath", "left_semi")

    extracted, seen = materialize(
        identify.gather_terms([extract(t) for t in extractors]),
        "terms",
        terms=F.sum(F.size("isbn10s") + F.size("isbn13s")),
    )
    searched = identify.search_terms(extracted)
    names = tuple(p.name for p in providers)
    if dry_run:
        return ScanResult(outcomes.failed_extraction(extracted), searched, answers, cache, names)

    terms = identify.asked_isbns(searched)
    if answers is None:
        asked, _ = materialize(lookup.distinct_isbns(terms).select("isbn"), "asked-isbns")
        answers = answer_table(providers, asked)
    hot = lookup.hot_isbns(terms, hot_rows, at_most=seen["terms"] or 0)
    decided = _decide(extracted, terms, answers, providers, hot)
    found = _outcomes(decided, answers, providers, hot, distance)
    return ScanResult(found, searched, answers, cache, names)


def _decide(extracted, terms, answers, providers, hot) -> DataFrame:
    """A3, A5 and A2 in one aggregation by file, on narrow rows.

    Gives ``filepath, extracted, answered`` and ``best``, the winning provider
    and ISBN. Files without a term take no part in the join.
    """
    judged = salted_left_join(
        terms, an.verdicts(answers, len(providers)), ["isbn"], hot, F.struct("filepath", "ord")
    )
    asked = judged.withColumn("error", F.lit(None).cast("string"))
    silent = extracted.where(~identify.has_any_terms()).select("filepath", "error")
    rows = asked.unionByName(silent, allowMissingColumns=True)

    aggregates = [F.max(F.col("error").isNull()).alias("extracted")]
    for k, provider in enumerate(providers):
        failed = F.coalesce(f"failed_{k}", F.lit(provider.missing_fails))
        confidence = F.col(f"confidence_{k}")
        rank = F.struct(
            confidence.alias("confidence"),
            F.lit(-k).alias("provider"),
            (-F.col("ord")).alias("ord"),
            F.col("isbn").alias("isbn"),
        )
        aggregates += [
            F.max(F.when(F.col("isbn").isNotNull(), failed)).alias(f"failed_{k}"),
            F.max(F.when(has_confidence(confidence), rank)).alias(f"best_{k}"),
        ]
    grouped = rows.groupBy("filepath").agg(*aggregates)

    # NULL where a file asked nothing: it has no results either
    passed = [F.coalesce(~F.col(f"failed_{k}"), F.lit(False)) for k in range(len(providers))]
    bests = [F.when(ok, F.col(f"best_{k}")) for k, ok in enumerate(passed)]
    return grouped.select(
        "filepath",
        "extracted",
        reduce(lambda a, b: a | b, passed).alias("answered"),
        (F.greatest(*bests) if len(bests) > 1 else bests[0]).alias("best"),
    )


def _outcomes(decided, answers, providers, hot, distance) -> DataFrame:
    """Fetch the winners' answers, match titles (A1), build books."""
    payload = answers.where(has_confidence(F.col("confidence"))).select(
        "provider_ord", "isbn", "items"
    )
    keyed = decided.select(
        "filepath",
        "extracted",
        "answered",
        F.col("best").isNotNull().alias("won"),
        F.coalesce(-F.col("best.provider"), F.lit(-1)).alias("provider_ord"),
        # files without a winner join nothing; their own path spreads them
        F.coalesce("best.isbn", F.concat(F.lit("-"), "filepath")).alias("isbn"),
    )
    matched = salted_left_join(
        keyed, payload, ["provider_ord", "isbn"], hot, F.col("filepath")
    ).select(
        "filepath",
        "extracted",
        "answered",
        "won",
        lookup.nearest_item(F.col("items"), basename(F.col("filepath")), distance).alias("match"),
    )
    if any(p.volumes is not None for p in providers):
        matched = lookup.nearest_over_chunks(matched, ["filepath"])
    stage = (
        F.when(~F.col("extracted"), "extract").when(~F.col("answered"), "search").otherwise("collate")
    )
    error = (
        F.when(~F.col("extracted"), identify.NO_TEXT)
        .when(~F.col("answered"), collate.NO_RESULTS)
        .when(~F.col("won"), collate.NOT_COLLATED)
    )
    item = F.col("match.item")
    return matched.select(
        "filepath",
        stage.alias("stage"),
        F.when(error.isNull(), "ok").otherwise("failed").alias("status"),
        error.alias("error"),
        collate.book_struct(
            filepath=F.col("filepath"),
            error=error,
            **{f: item[f] for f in ("title", "authors", "isbn10", "isbn13", "uom", "publish_date")},
        ).alias("book"),
    )
