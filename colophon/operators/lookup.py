"""Terms against answers: per-term results, the provider gate, the request plan
(J2, J3, A1, A3, L1, P14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.distance import title_distance
from colophon.functions.text import basename
from colophon.operators.skew import MIN_HOT_ROWS, hot_keys, salted_left_join
from colophon.sources.shared import materialize

NOT_ANSWERED = "not answered"

MISSING_MODES = ("error", "zero_hit")


def nearest_item(items: Column, name: Column, mode: str = "levenshtein") -> Column:
    """A1: ``struct<distance, ord, item>`` of the item with the nearest title.

    The first of equally near items wins; NULL without items.
    """
    return F.array_min(
        F.transform(
            items,
            lambda x: F.struct(
                title_distance(x["title"], name, mode).alias("distance"),
                x["ord"].alias("ord"),
                x.alias("item"),
            ),
        )
    )


def nearest_over_chunks(matched: DataFrame, keys: list[str]) -> DataFrame:
    """The nearest match per key where an ISBN's items fill several rows.

    Nearly every key has one row, so combining before the shuffle would only sort every
    row once more, in the tasks that already sort for the join.
    """
    others = [c for c in matched.columns if c not in (*keys, "match")]
    return matched.repartition(*keys).groupBy(*keys).agg(
        F.min("match").alias("match"), *[F.first(c).alias(c) for c in others]
    )


def distinct_isbns(terms: DataFrame) -> DataFrame:
    """Every ISBN once, with ``uses``, however many files ask for it."""
    return terms.groupBy("isbn").agg(F.count(F.lit(1)).alias("uses"))


def hot_isbns(
    terms: DataFrame, hot_rows: int = MIN_HOT_ROWS, at_most: int | None = None
) -> DataFrame | None:
    """The ISBNs of written ``terms`` whose rows a join must deal over tasks.

    If there are ``at_most`` so few rows that none can be hot, none is counted.
    """
    if at_most is not None and at_most <= hot_rows:
        return None
    demand, seen = materialize(distinct_isbns(terms), "demand", total=F.sum("uses"))
    hot = hot_keys(demand.withColumnRenamed("uses", "n"), seen["total"] or 0, hot_rows)
    return None if hot is None else materialize(hot, "hot-isbns")[0]


def lookup(
    terms: DataFrame,
    answers: DataFrame,
    providers: list[tuple[str, str]],
    distance: str = "levenshtein",
    hot: DataFrame | None = None,
    chunked: bool = False,
) -> DataFrame:
    """Every term with each provider's answer, matched to its own file.

    ``providers`` are ``(name, missing)`` in rank order: an ISBN without an
    answer is a failed lookup (``"error"``), or a zero hit where the provider's
    table is complete (``"zero_hit"``). ``hot`` is from ``hot_isbns``;
    ``chunked`` is for catalogue answers.
    """
    for _, missing in providers:
        if missing not in MISSING_MODES:
            raise ValueError(f"unknown missing mode: {missing}")
    asked = [
        F.struct(
            F.lit(k).alias("provider_ord"),
            F.lit(name).alias("provider"),
            F.lit(missing == "error").alias("missing_fails"),
        )
        for k, (name, missing) in enumerate(providers)
    ]
    found = salted_left_join(
        terms.select("*", F.inline(F.array(*asked))),
        answers.drop("provider"),
        ["provider_ord", "isbn"],
        hot,
        F.struct("filepath", "ord"),
        shuffled=True,  # answers are parsed: their size is not that of the table behind them
    )
    not_answered = F.col("failed").isNull() & F.col("missing_fails")
    matched = found.select(
        "filepath",
        "ord",
        "kind",
        "isbn",
        "provider",
        "provider_ord",
        F.coalesce("failed", "missing_fails").alias("failed"),
        F.when(not_answered, NOT_ANSWERED).otherwise(F.col("error")).alias("error"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        nearest_item(F.col("items"), basename(F.col("filepath")), distance).alias("match"),
    )
    if chunked:
        matched = nearest_over_chunks(matched, ["filepath", "ord", "provider_ord"])
    return matched.select(
        "filepath",
        "ord",
        "kind",
        "isbn",
        "provider",
        "provider_ord",
        "failed",
        "error",
        "confidence",
        F.col("match.distance").alias("distance"),
        F.col("match.item").alias("item"),
    )


def failed_providers(lookups: DataFrame) -> DataFrame:
    """Files and providers with at least one failed lookup."""
    return lookups.where("failed").select("filepath", "provider").distinct()


def provider_gate(lookups: DataFrame) -> DataFrame:
    """A3: drop everything a provider returned for a file it failed once.

    The lookups are written first: they are read twice, and a window over a
    file's lookups would put a file with very many of them into one task.
    """
    lookups, _ = materialize(lookups, "lookups")
    return lookups.join(failed_providers(lookups), ["filepath", "provider"], "left_anti")


def to_results(lookups: DataFrame) -> DataFrame:
    """Lookups as candidate results. A zero hit stays, with confidence 0."""
    text, year = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    return lookups.select(
        "filepath",
        "item.title",
        "item.authors",
        "item.isbn10",
        "item.isbn13",
        "item.uom",
        year.alias("low_year"),
        year.alias("high_year"),
        "item.publish_date",
        text.alias("publisher"),
        "confidence",
        F.col("provider").alias("source_provider_name"),
        "provider_ord",
        "ord",
    )


def plan_lookups(
    terms: DataFrame, answers: DataFrame | None, providers: list[str], budget: int | None = None
) -> DataFrame:
    """L1: requests worth making, ``(provider, isbn, files)``, by number of files.

    An ISBN that a provider has not answered, or answered with a failure, is
    open for this provider; without ``answers`` every one is. ``budget`` is the
    number of requests one may spend; without it the whole list is returned.
    """
    demand = terms.groupBy("isbn").agg(F.count_distinct("filepath").alias("files"))
    plan = demand.select(F.explode(F.array(*map(F.lit, providers))).alias("provider"), "isbn", "files")
    if answers is not None:
        answered = answers.where(~F.col("failed")).select("provider", "isbn").distinct()
        plan = plan.join(answered, ["provider", "isbn"], "left_anti")
    plan = plan.orderBy(F.desc("files"), "isbn", "provider")
    return plan if budget is None else plan.limit(budget)
