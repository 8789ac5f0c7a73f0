"""Spark job for one run over a folder or a table of texts.

    python -m colophon --scan /books --responses /responses --output /out
    ... --cache /out --retry --output /out2
    ... --dry-run --requests /plan --output /out3

With ``spark-submit`` the package goes along as ``--py-files``.
"""

from __future__ import annotations

import argparse

from pyspark.sql import Observation, SparkSession

from colophon import Provider, scan
from colophon.operators.incremental import drop_failed, emit_once
from colophon.sources.books import read_books, read_responses, write_books
from colophon.sources.files import extract_files
from colophon.sources.shared import materialize

LAYOUTS = ["lines", "parquet", "buckets", "object"]


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    args = argparse.ArgumentParser(prog="colophon", description="identify the books in a corpus")
    source = args.add_mutually_exclusive_group(required=True)
    source.add_argument("--scan", help="folder of files to scan")
    source.add_argument("--texts", help="parquet table (filepath, text)")
    args.add_argument("--responses", help="provider responses (provider, isbn, status, body)")
    args.add_argument("--responses-layout", choices=["lines", "parquet"], default="lines")
    args.add_argument("--providers", nargs="+", default=["google"], help="providers by rank")
    args.add_argument("--missing", choices=["error", "zero_hit"], help="what an ISBN without a response means")
    args.add_argument("--catalogue", help="parquet table of volumes, the last provider")
    args.add_argument("--output", required=True, help="new path for the books")
    args.add_argument("--layout", choices=LAYOUTS, default="lines")
    args.add_argument("--cache", help="books of an earlier run")
    args.add_argument("--cache-layout", choices=LAYOUTS, default="lines")
    args.add_argument("--key-mode", choices=["escaped", "compat"], default="escaped", help="keys of the object layout")
    args.add_argument("--distance", choices=["levenshtein", "compat"], default="levenshtein")
    args.add_argument("--strict-length", action="store_true", help="an ISBN-10 has 10, an ISBN-13 13 characters")
    args.add_argument("--retry", action="store_true", help="try the cache's failures again")
    args.add_argument("--dry-run", action="store_true", help="stop before the lookups")
    args.add_argument("--compat", action="store_true", help="no rows for failed searches")
    args.add_argument("--max-bytes", type=int, help="search only the first bytes of a text")
    args.add_argument("--min-bytes", type=int, help="shorter texts fail")
    args.add_argument("--requests", help="new path for the ISBNs still to be requested")
    args.add_argument("--budget", type=int, help="at most so many requests")
    options = args.parse_args(argv)
    if options.retry and not options.cache:
        args.error("--retry needs --cache")
    if not (options.responses or options.catalogue):
        args.error("--responses or --catalogue is needed")
    return options


def run(spark: SparkSession, options: argparse.Namespace) -> None:
    cache = None
    if options.cache:
        cache = emit_once(read_books(spark, options.cache, options.cache_layout))
        if options.cache_layout != "buckets":
            # written once: the listing, the scan and the output all read it
            cache, _ = materialize(cache, "cache")
    if options.scan:
        kept = drop_failed(cache) if options.retry else cache
        texts = extract_files(spark, options.scan, cache=kept)
    else:
        texts = spark.read.schema("filepath string, text string").parquet(options.texts)
    providers = []
    if options.responses:
        rows = read_responses(spark, options.responses, options.responses_layout)
        providers += [Provider(p, rows, missing=options.missing) for p in options.providers]
    if options.catalogue:
        providers.append(Provider("catalogue", volumes=spark.read.parquet(options.catalogue)))
    result = scan(
        texts,
        providers,
        cache=cache,
        retry=options.retry,
        dry_run=options.dry_run,
        max_bytes=options.max_bytes,
        min_bytes=options.min_bytes,
        strict_length=options.strict_length,
        distance=options.distance,
    )
    counts = Observation("outcomes")
    write_books(result.observed(counts).books(options.compat), options.output, options.layout, options.key_mode)
    print(counts.get)
    if options.requests:
        result.plan_lookups(budget=options.budget).write.mode("errorifexists").json(options.requests)


if __name__ == "__main__":
    options = parse()
    run(SparkSession.builder.appName("colophon").getOrCreate(), options)
