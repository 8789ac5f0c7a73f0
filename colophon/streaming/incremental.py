"""Continuous identification of arriving texts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from colophon.operators.incremental import BROADCAST_BYTES
from colophon.operators.outcomes import books_of
from colophon.plans.scan import Provider, scan
from colophon.schemas import BOOK
from colophon.sources.shared import materialize, scratch
from colophon.streaming.paths import FOLDER, bucket_of, filters_of, places_of


_OUTPUT = T.StructType([*BOOK, T.StructField("batch", T.LongType())])


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """Books of all finished batches, with the number of their ``batch``."""
    return spark.read.schema(_OUTPUT).option("basePath", path).parquet(path).select(*_OUTPUT.fieldNames())


def earlier_books(paths: DataFrame, output: str, batch_id: int) -> DataFrame:
    """Books of ``paths`` in batches before ``batch_id``: only folders that may hold one are read."""
    spark = paths.sparkSession
    places = places_of(paths, output, batch_id)
    if not places:
        return spark.createDataFrame([], _OUTPUT)
    held = spark.read.schema(_OUTPUT).option("basePath", output).parquet(*places).select(*_OUTPUT.fieldNames())
    return held.join(paths, "filepath", "left_semi")


def identify_stream(
    texts: DataFrame,
    providers: list[Provider],
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    on_batch: Callable[[int, dict], None] | None = None,
    **options,
) -> StreamingQuery:
    """Write one book or error per new file of the stream ``texts``.

    The output is the state: a path that an earlier batch wrote is skipped. A batch
    reads the filters of its paths' buckets and the folders that may hold one of them
    (``paths``), not all of the output; its intermediate tables go when it is written. A
    repeated batch writes its own folder anew and looks only at the folders of
    batches before it, so a restart neither loses nor doubles a file. Every
    batch asks the providers' tables or functions anew, for its own ISBNs only.
    ``on_batch`` is told the counts of each batch (A6). Other options are those
    of ``scan``.
    """
    spark = texts.sparkSession

    def process(batch: DataFrame, batch_id: int) -> None:
        with scratch(spark):
            done = None if batch_id == 0 else known_books(batch, batch_id)
            result = scan(batch, providers, cache=done, **options)
            counts = Observation("outcomes")
            # counted behind the shuffle: what is before an empty one leaves the plan, counts and all
            dealt = replace(result, outcomes=result.outcomes.repartition(bucket_of(F.col("filepath"))))
            books = books_of(dealt.observed(counts).outcomes).withColumn("bucket", bucket_of(F.col("filepath")))
            place = f"{path}/batch={batch_id}"
            books.write.partitionBy("bucket").mode("overwrite").parquet(place)
            seen = counts.get
            paths = spark.read.schema("filepath string").parquet(place)
            filters_of(paths).write.mode("overwrite").parquet(f"{path}/{FOLDER}/batch={batch_id}")
        if on_batch is not None:
            on_batch(batch_id, seen)

    def known_books(batch: DataFrame, batch_id: int) -> DataFrame:
        # The batch is small and the output large: its paths are sent to the folders
        # that may hold one of them.
        paths, size = materialize(
            batch.select("filepath").distinct(), "batch-paths", bytes=F.sum(F.octet_length("filepath"))
        )
        if (size["bytes"] or 0) <= BROADCAST_BYTES:
            paths = F.broadcast(paths)
        return earlier_books(paths, path, batch_id)

    writer = texts.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
