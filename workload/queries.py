"""The registered queries: every operator over whole tables."""

from __future__ import annotations

import os
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon import Provider, scan
from colophon.functions import isbn, records, text as tx
from colophon.functions.distance import title_distance
from colophon.operators import answers, collate, identify, incremental, lookup
from colophon.plans.scan import answer_table
from colophon.sources import books as book_io
from colophon.sources import files
from colophon.sources.shared import materialize, new_path
from colophon.streaming.incremental import identify_stream, read_output
from workload import corpus as wc

# The reference's own window and its free daily quota.
WINDOW = 10_000
BUDGET = 1_000
LIBRARY_CONFIDENCE = 60.0

BOOK_COLUMNS = ("filepath", "title", "isbn10", "isbn13", "publish_date", "error")


def _joined(c: str):
    return F.array_join(c, "|").alias(c)


# Keys of several stores, with a quote in some; for Spark and DuckDB alike.
STORED_PATH = (
    "case length(filepath) % 3 when 0 then 'hdfs://nn' || filepath "
    "when 1 then 's3a://b\"k' || filepath else filepath end"
)


def _flat(books: DataFrame) -> DataFrame:
    return books.select(*BOOK_COLUMNS, _joined("authors"))


# functions ------------------------------------------------------------------


def isbn_runs(spark: SparkSession, sf: str) -> DataFrame:
    """H1, H2: identifier-like runs in every document."""
    return wc.table(spark, sf, "documents").select(
        "doc_id",
        *[F.size(isbn.find_runs(F.col("text"), k)).alias(f"{k}_runs") for k in ("isbn10", "isbn13")],
    )


def document_isbns(spark: SparkSession, sf: str) -> DataFrame:
    """H4 over every document."""
    rows = wc.table(spark, sf, "documents").select(
        F.col("doc_id").alias("filepath"), "text"
    )
    return identify.extract_terms(rows).select(
        F.col("filepath").alias("doc_id"), _joined("isbn10s"), _joined("isbn13s")
    )


def page_isbns(spark: SparkSession, sf: str) -> DataFrame:
    """S3 and H4 over every page."""
    pages = wc.table(spark, sf, "pages").select(
        "page_id", tx.html_to_text(F.col("html")).alias("text")
    )
    found = isbn.identify_isbns(pages.withColumn("text_md5", F.md5("text")))
    return found.select("page_id", "text_md5", _joined("isbn10s"), _joined("isbn13s"))


def identifier_checks(spark: SparkSession, sf: str) -> DataFrame:
    """P5, P6, P7 on numbers made from every event."""
    key = F.col("event_id") * 48611
    numbers = wc.table(spark, sf, "events").select(
        "event_id",
        F.explode(
            F.array(
                F.lpad(key.cast("string"), 10, "0"),
                F.concat(F.lpad(key.cast("string"), 9, "0"), F.lit("X")),
                F.concat(F.lit("978"), F.lpad(key.cast("string"), 10, "0")),
                key.cast("string"),
            )
        ).alias("number"),
    )
    n = F.col("number")
    return numbers.select(
        "event_id",
        "number",
        isbn.is_candidate(n).alias("candidate"),
        isbn.isbn10_valid(n).alias("valid10"),
        isbn.isbn13_valid(n).alias("valid13"),
    )


def text_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The window of a document and whether the document fills it."""
    window = tx.truncate_bytes(F.col("text"), WINDOW)
    return wc.table(spark, sf, "documents").select(
        "doc_id",
        F.octet_length("text").alias("n_bytes"),
        tx.enough_text(F.col("text"), WINDOW).alias("enough"),
        F.md5(window.cast("binary")).alias("window_md5"),
    )


def title_distances(spark: SparkSession, sf: str) -> DataFrame:
    """H5 in both modes for every part."""
    name = F.concat(F.replace(F.col("p_brand"), F.lit("#"), F.lit(" ")), F.lit(".epub"))
    return wc.table(spark, sf, "part").select(
        "p_partkey",
        title_distance(F.col("p_name"), name).alias("distance"),
        title_distance(F.col("p_name"), name, "compat").alias("compat_distance"),
    )


# texts to terms -------------------------------------------------------------


def _extracted(spark: SparkSession, sf: str) -> DataFrame:
    return identify.extract_terms(identify.supported(wc.texts(spark, sf)))


def _search_terms(spark: SparkSession, sf: str) -> DataFrame:
    return identify.search_terms(_extracted(spark, sf))


def supported_files(spark: SparkSession, sf: str) -> DataFrame:
    """P1, H6, H7 for every file."""
    path = F.col("filepath")
    return wc.texts(spark, sf).select(
        "filepath",
        tx.basename(path).alias("name"),
        tx.extension(path).alias("ext"),
        tx.is_supported(path).alias("supported"),
    )


def _terms_of(name: str, kind: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return _search_terms(spark, sf).select(
            "filepath", F.posexplode(name).alias("ord", "isbn")
        )

    query.__doc__ = f"H4, P8: the {kind}s of every file in text order."
    return query


def search_terms(spark: SparkSession, sf: str) -> DataFrame:
    """The terms of every file with text."""
    return _search_terms(spark, sf).select("filepath", _joined("isbn10s"), _joined("isbn13s"))


def search_terms_size(spark: SparkSession, sf: str) -> DataFrame:
    """P10: files with and without terms."""
    return (
        _search_terms(spark, sf)
        .groupBy(identify.has_any_terms().alias("has_terms"))
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.sum(F.size("isbn10s")).alias("isbn10s"),
            F.sum(F.size("isbn13s")).alias("isbn13s"),
        )
    )


def lookup_terms(spark: SparkSession, sf: str) -> DataFrame:
    """O3: all terms of a file, ISBN-10s first."""
    return identify.lookup_terms(_search_terms(spark, sf))


def gather_texts(spark: SparkSession, sf: str) -> DataFrame:
    """A4: terms from two extractors, the first with an empty and a repeated row for every path."""
    second = identify.extract_terms(identify.supported(wc.returned_texts(spark, sf)))
    first = _extracted(spark, sf)
    none = F.array().cast("array<string>")
    failed = first.withColumns({"isbn10s": none, "isbn13s": none, "error": F.lit(identify.NO_TEXT)})
    return identify.gather_terms([first.unionByName(failed).unionByName(first), second]).select(
        "filepath", _joined("isbn10s"), _joined("isbn13s"), "error"
    )


# lookups --------------------------------------------------------------------


def _google(spark: SparkSession, sf: str) -> Provider:
    return Provider("google", wc.responses(spark, sf))


def _library(spark: SparkSession, sf: str) -> Provider:
    return Provider(
        "library",
        wc.library_responses(spark, sf),
        missing="zero_hit",
        confidence=LIBRARY_CONFIDENCE,
    )


def _answered(spark: SparkSession, sf: str, found: DataFrame, providers, **options) -> DataFrame:
    terms, seen = materialize(lookup_terms(spark, sf), "lookup-terms", n=F.count(F.lit(1)))
    hot = lookup.hot_isbns(terms, at_most=seen["n"])
    return lookup.lookup(terms, found, providers, hot=hot, **options)


def _lookups(spark: SparkSession, sf: str) -> DataFrame:
    found = answers.response_answers(wc.responses(spark, sf), "google")
    return _answered(spark, sf, found, [("google", "error")])


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    found = answer_table([_google(spark, sf), _library(spark, sf)])
    both = _answered(spark, sf, found, [("google", "error"), ("library", "zero_hit")])
    return lookup.provider_gate(both)


def lookup_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Every term of every file against the responses."""
    return _lookups(spark, sf).select("filepath", "ord", "kind", "isbn", "failed", "confidence")


def lookup_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Each ISBN is requested once, however often it is used."""
    return lookup.distinct_isbns(lookup_terms(spark, sf))


def title_match(spark: SparkSession, sf: str) -> DataFrame:
    """A1, H5: the work of each answer whose title is nearest to the file name."""
    return (
        _lookups(spark, sf)
        .where(F.col("item").isNotNull())
        .select("filepath", "ord", "item.title", "distance")
    )


def identifiers_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """The identifiers of every work in the responses."""
    found = answers.response_answers(wc.responses(spark, sf), "google")
    return found.select("isbn", F.explode("items").alias("item")).select(
        "isbn", "item.ord", "item.title", "item.isbn10", "item.isbn13", "item.uom"
    )


def catalogue_join(spark: SparkSession, sf: str) -> DataFrame:
    """Every term against a table of volumes."""
    found = answers.catalogue_answers(wc.catalogue(spark, sf), "catalogue")
    matched = _answered(spark, sf, found, [("catalogue", "zero_hit")], chunked=True)
    distance = F.coalesce("distance", F.lit(-1)).alias("distance")
    return matched.select("filepath", "ord", "isbn", "item.title", distance, "confidence")


def provider_gate(spark: SparkSession, sf: str) -> DataFrame:
    """A3: results left of each provider after the gate."""
    return (
        _gated(spark, sf)
        .groupBy("filepath", "provider")
        .agg(F.count(F.lit(1)).alias("results"))
    )


def gather_results(spark: SparkSession, sf: str) -> DataFrame:
    """The candidate results of both providers."""
    gated = _gated(spark, sf)
    per_provider = [
        lookup.to_results(gated.where(F.col("provider") == p)) for p in ("google", "library")
    ]
    return collate.gather_results(per_provider).select(
        "filepath", "source_provider_name", "ord", "title", "isbn13", "confidence"
    )


def choose_best(spark: SparkSession, sf: str) -> DataFrame:
    """The most confident result of every file with results."""
    best = collate.choose_best(lookup.to_results(_gated(spark, sf)))
    return best.select(
        "filepath",
        "source_provider_name",
        F.coalesce("ord", F.lit(-1)).alias("ord"),
        "title",
        "isbn10",
        "isbn13",
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def unidentified(spark: SparkSession, sf: str) -> DataFrame:
    """Results that say nothing about the book."""
    return (
        lookup.to_results(_lookups(spark, sf))
        .groupBy(records.is_unidentified().alias("unidentified"))
        .agg(F.count(F.lit(1)).alias("results"))
    )


def plan_lookups(spark: SparkSession, sf: str) -> DataFrame:
    """L1: the requests worth a day's quota, given the answers of two providers."""
    known = answer_table([_google(spark, sf), _library(spark, sf)])
    return lookup.plan_lookups(lookup_terms(spark, sf), known, ["google", "library"], BUDGET)


# whole runs -----------------------------------------------------------------


def _scan(spark: SparkSession, sf: str, providers=None, texts=None, **options):
    return scan(
        wc.texts(spark, sf) if texts is None else texts,
        providers or [_google(spark, sf)],
        **options,
    )


def _gated_scan(spark: SparkSession, sf: str, **options):
    """A run for which texts shorter than a complete file are not extracted."""
    return _scan(spark, sf, min_bytes=wc.FULL_TEXT, **options)


def _shelf(spark: SparkSession, sf: str) -> DataFrame:
    """The earlier books, written as runs keep them: bucketed by path."""
    path = new_path(spark, "shelf")
    book_io.write_books(wc.cache(spark, sf), path, layout="buckets")
    return book_io.read_books(spark, path, layout="buckets")


def books_full(spark: SparkSession, sf: str) -> DataFrame:
    """One book or error per supported file."""
    return _flat(_gated_scan(spark, sf).books())


def books_compat(spark: SparkSession, sf: str) -> DataFrame:
    """Only what the reference writes."""
    return _flat(_gated_scan(spark, sf).books(compat=True))


def books_two_providers(spark: SparkSession, sf: str) -> DataFrame:
    """A3, A5, A2 in one run over two providers."""
    return _flat(_scan(spark, sf, [_google(spark, sf), _library(spark, sf)]).books())


def books_catalogue(spark: SparkSession, sf: str) -> DataFrame:
    """J4 as the only provider of a run."""
    provider = Provider("catalogue", volumes=wc.catalogue(spark, sf))
    return _flat(_scan(spark, sf, [provider]).books())


def books_cached(spark: SparkSession, sf: str) -> DataFrame:
    """A run that keeps all earlier books."""
    return _flat(_scan(spark, sf, cache=_shelf(spark, sf)).books())


def books_retried(spark: SparkSession, sf: str) -> DataFrame:
    """A run that tries the earlier failures again."""
    return _flat(_scan(spark, sf, cache=_shelf(spark, sf), retry=True).books())


def outcomes_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Files per stage and status."""
    return _gated_scan(spark, sf).summary()


def dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """What a dry run writes, the earlier books and the files without text."""
    return _flat(_gated_scan(spark, sf, cache=wc.cache(spark, sf), dry_run=True).books())


def best_identifier(spark: SparkSession, sf: str) -> DataFrame:
    """H9 for every book."""
    return _scan(spark, sf).books().select(
        "filepath", records.best_identifier().alias("identifier")
    )


def book_json(spark: SparkSession, sf: str) -> DataFrame:
    """Every book as it is written."""
    return _scan(spark, sf).books().select(
        records.object_key(F.col("filepath")).alias("key"), records.book_json().alias("json")
    )


def object_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All books, with keys of several stores, written as one JSON object and read back."""
    path = new_path(spark, "books.json")
    texts = wc.texts(spark, sf).withColumn("filepath", F.expr(STORED_PATH))
    book_io.write_books(_scan(spark, sf, texts=texts).books(), path, layout="object")
    return _flat(book_io.read_books(spark, path, layout="object"))


def lines_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """All books written as JSON Lines and read back."""
    path = new_path(spark, "books.jsonl")
    book_io.write_books(_scan(spark, sf).books(), path)
    return _flat(book_io.read_books(spark, path))


def incremental_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus arriving in several batches."""
    source, out, checkpoint = (new_path(spark, n) for n in ("in", "out", "state"))
    texts = wc.texts(spark, sf)
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts.repartition(2 * number, "filepath").write.parquet(source)
    arriving = spark.readStream.schema(texts.schema).option("maxFilesPerTrigger", number).parquet(source)
    query = identify_stream(arriving, [_google(spark, sf)], out, checkpoint)
    query.awaitTermination()
    return _flat(read_output(spark, out))


def file_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a file of its own, listed and read.

    Every seventh page lies in a hidden folder; a link beside leads there once more. The
    root is given relative to the working folder, paths come back absolute.
    """
    root = new_path(spark, "pages").removeprefix("file://").removeprefix("file:")
    hidden = F.col("page_id") % 7 == 0
    files.write_texts(wc.page_files(spark, sf, hidden), root)
    if root.startswith("/"):
        os.symlink(f"{root}/.kept", f"{root}/linked")
    given = os.path.relpath(root) if root.startswith("/") else root
    (read,) = files.extract_files(spark, given)
    both = files.scan_files(spark, given).join(read, "filepath")
    below = F.replace(F.col("filepath"), F.lit(f"{root}/"), F.lit(""))
    return both.select(
        F.regexp_extract("filepath", "/page_id=([0-9]+)/", 1).cast("bigint").alias("page_id"),
        F.regexp_extract(below, "^(.*)/[^/]*$", 1).alias("folder"),
        tx.extension(F.col("filepath")).alias("ext"),
        F.col("length").alias("n_bytes"),
        F.md5("text").alias("text_md5"),
        "error",
    )


def responses_read(spark: SparkSession, sf: str) -> DataFrame:
    """All responses written as JSON Lines and read back."""
    path = new_path(spark, "responses.jsonl")
    wc.responses(spark, sf).write.json(path)
    read = book_io.read_responses(spark, path)
    return read.select("provider", "isbn", "status", F.col("body").isNotNull().alias("has_body"))


def two_extractors(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a file, read by two extractors of the caller's."""
    root = new_path(spark, "pages")
    files.write_texts(wc.page_files(spark, sf), root)

    def size(contents: DataFrame) -> DataFrame:
        return contents.select("filepath", F.octet_length("content").cast("string").alias("text"))

    first, second = files.extract_files(spark, root, [files.native_text, size])
    both = first.join(second.withColumnRenamed("text", "size"), "filepath")
    page = F.regexp_extract("filepath", "/page_id=([0-9]+)/", 1).cast("bigint")
    return both.select(page.alias("page_id"), F.md5("text").alias("text_md5"), "size", "error")


def stage_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Stages in a row are DataFrame.transform."""
    return (
        wc.texts(spark, sf)
        .transform(identify.supported)
        .transform(identify.extract_terms)
        .transform(identify.search_terms)
        .select("filepath", _joined("isbn10s"), _joined("isbn13s"))
    )


def own_writer(spark: SparkSession, sf: str) -> DataFrame:
    """U4: books handed to the caller's writer."""
    path = new_path(spark, "own-books")
    book_io.write_with(_scan(spark, sf).books(), lambda books: books.write.orc(path))
    return _flat(spark.read.orc(path))


def disabled_provider(spark: SparkSession, sf: str) -> DataFrame:
    """A disabled provider is not asked."""
    library = replace(_library(spark, sf), enabled=False)
    return _flat(_scan(spark, sf, [library, _google(spark, sf)]).books())


# incremental operators ------------------------------------------------------


def skip_processed(spark: SparkSession, sf: str) -> DataFrame:
    """Files without an earlier book."""
    files = identify.supported(wc.texts(spark, sf)).select("filepath")
    return incremental.skip_processed(files, _shelf(spark, sf))


def retry_set(spark: SparkSession, sf: str) -> DataFrame:
    """Earlier books that a retry keeps."""
    return incremental.drop_failed(wc.cache(spark, sf)).select("filepath", "title")


def carry_through(spark: SparkSession, sf: str) -> DataFrame:
    """O2, O1: earlier and new records, each file once, a book before its failures."""
    cache = wc.cache(spark, sf)
    new = incremental.skip_processed(
        wc.texts(spark, sf).select("filepath", F.lit("New").alias("title"), F.lit(None).cast("string").alias("error")),
        cache,
    )
    failed = new.withColumns({"title": F.lit(""), "error": F.lit(identify.NO_TEXT)})
    old = cache.select("filepath", "title", "error")
    records = incremental.carry_through(old, failed.unionByName(new).unionByName(new))
    return incremental.emit_once(records).select("filepath", "title")


def processed_count(spark: SparkSession, sf: str) -> DataFrame:
    """Number of earlier books."""
    return incremental.processed_count(wc.cache(spark, sf))


QUERIES = {
    f.__name__: f
    for f in (
        isbn_runs, document_isbns, page_isbns, identifier_checks, text_gate, title_distances,
        supported_files, search_terms, search_terms_size, lookup_terms, gather_texts,
        lookup_outcomes, lookup_cache, title_match, identifiers_pivot, catalogue_join,
        provider_gate, gather_results, choose_best, unidentified, plan_lookups,
        books_full, books_compat, books_two_providers, books_catalogue, books_cached,
        books_retried, outcomes_summary, dry_run, best_identifier, book_json,
        object_round_trip, lines_round_trip, incremental_stream, file_scan,
        skip_processed, retry_set, carry_through, processed_count,
        responses_read, two_extractors, stage_chain, own_writer, disabled_provider,
    )
}
QUERIES["isbn10_terms"] = _terms_of("isbn10s", "ISBN-10")
QUERIES["isbn13_terms"] = _terms_of("isbn13s", "ISBN-13")
