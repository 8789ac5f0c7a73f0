"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query
runs once on the smallest tables to warm up, then once measured. The ``scan_*``
entries measure the engine alone, on a corpus written beforehand; the others
derive their corpus as part of the query.
"""

from __future__ import annotations

import json
import os
import re
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from colophon import Provider, scan
from colophon.operators import identify
from colophon.sources.shared import materialize
from workload import corpus as wc
from workload.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "isbn_runs", "document_isbns", "page_isbns", "search_terms", "lookup_outcomes", "catalogue_join",
    "choose_best", "plan_lookups", "books_full", "books_two_providers", "books_catalogue",
    "books_retried", "object_round_trip",
]


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(make) -> float:
    start = time.perf_counter()
    run(make())
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = session()
    small = str(Path(SF_DIR).with_name("sf0.001"))
    warm = small if Path(small).is_dir() else SF_DIR
    seconds = {}
    for name in HEADLINE:
        run(QUERIES[name](spark, warm))
        seconds[name] = timed(lambda: QUERIES[name](spark, SF_DIR))

    texts, _ = materialize(wc.texts(spark, SF_DIR).repartition(int(CPUS)), "bench-texts")
    responses, _ = materialize(wc.responses(spark, SF_DIR), "bench-responses")
    volumes, _ = materialize(wc.catalogue(spark, SF_DIR), "bench-volumes")
    engine = {
        "scan_terms": lambda: identify.extract_terms(identify.supported(texts)),
        "scan_books": lambda: scan(
            texts, [Provider("google", responses)], min_bytes=wc.FULL_TEXT
        ).books(),
        "scan_catalogue": lambda: scan(
            texts, [Provider("catalogue", volumes=volumes)], min_bytes=wc.FULL_TEXT
        ).books(),
    }
    files = texts.count()
    for name, make in engine.items():
        run(make())
        seconds[name] = timed(make)

    documents = wc.table(spark, SF_DIR, "documents").count()
    sf = re.search(r"sf([0-9.]+)/?$", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf.group(1)) if sf else SF_DIR,
                "files": files,
                "files_per_sec": {n: round(files / seconds[n]) for n in engine},
                "documents_per_sec": round(documents / seconds["document_isbns"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
