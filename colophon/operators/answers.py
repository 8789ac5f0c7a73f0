"""Provider responses and catalogues to answers, one per provider and ISBN
(S5, J3, J4, P14, P16, P17, H8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.functions.records import has_confidence, pick_identifier
from colophon.schemas import ANSWER, RESPONSE_BODY
from colophon.sources.shared import materialize

NO_MATCH = "unable to identify a good match from multiple returned works"
CONFIDENCE = 100.0

# Distinct titles of one ISBN that share a row, about.
CHUNK_TITLES = 1_000


def _items(items: Column) -> Column:
    def item(x, i):
        volume = x["volumeInfo"]
        identifiers = volume["industryIdentifiers"]
        return F.struct(
            i.cast("bigint").alias("ord"),
            F.coalesce(volume["title"], F.lit("")).alias("title"),
            volume["authors"].alias("authors"),
            pick_identifier(identifiers, "isbn_10").alias("isbn10"),
            pick_identifier(identifiers, "isbn_13").alias("isbn13"),
            pick_identifier(identifiers, "uom").alias("uom"),
            F.coalesce(volume["publishedDate"], F.lit("")).alias("publish_date"),
        )

    return F.transform(items, item)


def _select_answer(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in ANSWER])


def response_answers(
    responses: DataFrame,
    provider: str,
    provider_ord: int = 0,
    confidence: float = CONFIDENCE,
    isbns: DataFrame | None = None,
) -> DataFrame:
    """Answers from raw ``(isbn, status, body[, confidence])`` rows.

    A status other than 200 or an unreadable body fails (P17), no hits give
    confidence 0 (P16), hits give ``confidence`` and their items (P14). A
    provider that is not always equally sure has its own column for it. With
    ``isbns``, the table of those asked for, no other body is parsed.
    """
    if isbns is not None:
        responses = responses.join(isbns.select("isbn").distinct(), "isbn", "left_semi")
    body = F.from_json("body", RESPONSE_BODY, {"columnNameOfCorruptRecord": "_corrupt"})
    sure = F.col("confidence") if "confidence" in responses.columns else F.lit(confidence)
    parsed = responses.select("isbn", "status", body.alias("body"), sure.alias("confidence"))
    read = F.coalesce(F.col("status") == 200, F.lit(False))
    readable = F.col("body").isNotNull() & F.col("body._corrupt").isNull()
    hits = F.coalesce(F.col("body.totalItems"), F.lit(0)) != 0
    some = F.coalesce(F.size("body.items"), F.lit(0)) > 0
    error = (
        F.when(~read, F.concat(F.lit("bad status code "), F.coalesce(F.col("status").cast("string"), F.lit("none"))))
        .when(~readable, F.lit("unreadable response body"))
        .when(hits & ~some, F.lit(NO_MATCH))
    )
    # A copied or repeated response counts once; a good answer beats a failed one.
    unique = (
        parsed.select(
            "isbn",
            F.struct(
                error.isNotNull().alias("failed"),
                (~hits).alias("empty"),
                error.alias("error"),
                F.when(error.isNull() & hits, _items(F.col("body.items"))).alias("items"),
                F.when(error.isNull() & hits, F.col("confidence")).otherwise(0.0).alias("confidence"),
            ).alias("answer"),
        )
        .groupBy("isbn")
        .agg(F.min("answer").alias("answer"))
    )
    return _select_answer(
        unique.select(
            F.lit(provider_ord).alias("provider_ord"),
            F.lit(provider).alias("provider"),
            "isbn",
            "answer.*",
            F.lit(0).alias("chunk"),
        )
    )


def catalogue_answers(
    volumes: DataFrame,
    provider: str,
    provider_ord: int = 0,
    confidence: float = CONFIDENCE,
    chunk_titles: int = CHUNK_TITLES,
    isbns: DataFrame | None = None,
) -> DataFrame:
    """Answers from a table of volumes ``(ord, title, authors, identifiers,
    publish_date)``; an ISBN is answered by every volume that carries it.

    Of volumes with the same ISBN and title only the first can be the match.
    The remaining titles of an ISBN are kept in rows of bounded length. With
    ``isbns``, the table of those asked for, nothing else is grouped.
    """
    ids = F.col("identifiers")
    carried = volumes.select(
        F.explode(
            F.array_distinct(
                F.transform(
                    F.filter(ids, lambda x: F.lower(x["type"]).isin("isbn_10", "isbn_13")),
                    lambda x: x["identifier"],
                )
            )
        ).alias("isbn"),
        F.coalesce("title", F.lit("")).alias("title"),
        F.struct(
            F.col("ord").cast("bigint").alias("ord"),
            "authors",
            pick_identifier(ids, "isbn_10").alias("isbn10"),
            pick_identifier(ids, "isbn_13").alias("isbn13"),
            pick_identifier(ids, "uom").alias("uom"),
            F.coalesce("publish_date", F.lit("")).alias("publish_date"),
        ).alias("volume"),
    )
    if isbns is not None:
        carried = carried.join(isbns.select("isbn").distinct(), "isbn", "left_semi")
    titles, _ = materialize(
        carried.groupBy("isbn", "title").agg(F.min("volume").alias("volume")), "catalogue-titles"
    )
    # an ISBN of very many titles fills several rows, whatever the total
    counts = titles.groupBy("isbn").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk_titles)
    many = counts.select("isbn", F.ceil(F.col("n") / chunk_titles).cast("int").alias("parts"))
    titles = titles.join(many, "isbn", "left").withColumn(
        "chunk", F.coalesce(F.pmod(F.xxhash64("title"), "parts"), F.lit(0)).cast("int")
    )
    item = F.struct(
        "volume.ord", "title", "volume.authors", "volume.isbn10",
        "volume.isbn13", "volume.uom", "volume.publish_date",
    )
    return _select_answer(
        titles.groupBy("isbn", "chunk")
        .agg(F.array_sort(F.collect_list(item)).alias("items"))
        .select(
            F.lit(provider_ord).alias("provider_ord"),
            F.lit(provider).alias("provider"),
            "isbn",
            F.lit(False).alias("failed"),
            F.lit(None).alias("error"),
            F.lit(confidence).alias("confidence"),
            "chunk",
            "items",
        )
    )


def verdicts(answers: DataFrame, n_providers: int) -> DataFrame:
    """One narrow row per ISBN: did provider k fail, how sure is it otherwise."""

    def of(k, c):
        return F.when(F.col("provider_ord") == k, F.col(c))

    per_provider = []
    for k in range(n_providers):
        per_provider += [
            F.max(of(k, "failed")).alias(f"failed_{k}"),
            F.max(F.when(has_confidence(F.col("confidence")), of(k, "confidence"))).alias(
                f"confidence_{k}"
            ),
        ]
    return answers.groupBy("isbn").agg(*per_provider)
