"""Books and responses on storage.

Layouts of books:

* ``lines``: one JSON record per line, the default;
* ``parquet``: for caches that are read often;
* ``buckets``: Parquet, hashed and sorted by path: a cache that is joined without a
  shuffle of its own, run after run;
* ``object``: the reference's single JSON object ``{filepath: book}``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions.records import book_json, object_key, written_book
from colophon.schemas import BOOK, RESPONSE
from colophon.sources.json_object import object_entries
from colophon.sources.shared import materialize

_COUNT = "_buckets"

# An entry of an object: its key, then the book.
_ENTRY = r'(?s)^\s*"[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:\s*(\{.*\})\s*\z'


def write_books(books: DataFrame, path: str, layout: str = "lines", key_mode: str = "escaped") -> None:
    """Write books to a new ``path``; an existing one is refused.

    The ``object`` layout is written by all tasks: its part files, one after
    the other in name order, are the JSON document.
    """
    if layout == "lines":
        books.select(written_book().alias("b")).select("b.*").write.mode("errorifexists").json(path)
    elif layout == "parquet":
        books.select(*BOOK.fieldNames()).write.mode("errorifexists").parquet(path)
    elif layout == "buckets":
        _write_buckets(books, path)
    elif layout == "object":
        _write_object(books, path, key_mode)
    else:
        raise ValueError(f"unknown layout: {layout}")


def _bucketed(path: str) -> str:
    return f"books_{hashlib.sha256(path.encode()).hexdigest()[:16]}_{uuid.uuid4().hex[:8]}"


def _write_buckets(books: DataFrame, path: str) -> None:
    """One sorted file per bucket of paths, as many as shuffle partitions; their number lies beside them."""
    spark, name = books.sparkSession, _bucketed(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        raise ValueError(f"{path} exists")
    rows = books.select(*BOOK.fieldNames()).repartition(buckets, "filepath")
    try:
        rows.write.format("parquet").bucketBy(buckets, "filepath").sortBy("filepath").option("path", path).saveAsTable(name)
    finally:
        spark.sql(f"drop table if exists {name}")  # the files stay
    spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.text(f"{path}/{_COUNT}")


def _read_buckets(spark: SparkSession, path: str) -> DataFrame:
    name = _bucketed(path)
    buckets = int(spark.read.text(f"{path}/{_COUNT}").first().value)
    place = path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(
        f"create table {name} ({BOOK.toDDL()}) using parquet "
        f"clustered by (filepath) sorted by (filepath) into {buckets} buckets location '{place}'"
    )
    books = spark.table(name)  # resolved here: it keeps its files and buckets
    spark.sql(f"drop table {name}")
    return books


def _write_object(books: DataFrame, path: str, key_mode: str) -> None:
    """One record alone opens the document; the others follow in no order, a comma before each."""
    spark = books.sparkSession
    # Each value goes without its last brace: the text writer adds it as the "line" end.
    entry = F.concat(object_key(F.col("filepath"), key_mode), F.lit(": "), F.rtrim(book_json(), F.lit("}")))
    # a number tells repeated records apart
    numbered = books.select(entry.alias("entry"), F.monotonically_increasing_id().alias("n"))
    entries, _ = materialize(numbered, "entries")
    first = entries.first()
    ends = [["{"], []] if first is None else [["{" + first.entry], [""]]
    head, tail = (spark.createDataFrame([(v,) for v in end], "value string").coalesce(1) for end in ends)
    rest = entries.where(F.lit(False) if first is None else F.col("n") != first.n)
    # a union keeps the order of its parts, and part files are named in it
    document = head.unionByName(rest.select(F.concat(F.lit(","), "entry").alias("value"))).unionByName(tail)
    document.write.mode("errorifexists").option("lineSep", "}").text(path)


def read_books(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Books of an earlier run.

    An ``object`` file is split at its entries, however it is formatted, and read
    into a table at once. A last entry that an interrupted run left unfinished is
    not a book, so its file is scanned again; any other entry that can't be read
    fails the run.
    """
    if layout == "lines":
        return spark.read.schema(BOOK).option("mode", "FAILFAST").json(path)
    if layout == "parquet":
        return spark.read.schema(BOOK).parquet(path)
    if layout == "buckets":
        return _read_buckets(spark, path)
    if layout != "object":
        raise ValueError(f"unknown layout: {layout}")
    entries = object_entries(spark, path).withColumn("value", F.col("value").cast("string"))
    read = entries.where(F.col("value").rlike(r"\S")).select(
        "file", "done", F.from_json(F.regexp_extract("value", _ENTRY, 1), BOOK).alias("book")
    )
    unreadable = F.col("done") & F.col("book.filepath").isNull()
    books, seen = materialize(read, "object-books", bad=F.min(F.when(unreadable, F.col("file"))))
    if seen["bad"] is not None:
        raise ValueError(f"unreadable entries in {seen['bad']}")
    return books.where(F.col("book.filepath").isNotNull()).select("book.*")


def read_responses(spark: SparkSession, path: str, layout: str = "lines") -> DataFrame:
    """Raw provider responses ``(provider, isbn, status, body)``."""
    reader = spark.read.schema(RESPONSE)
    return reader.parquet(path) if layout == "parquet" else reader.json(path)


def write_with(books: DataFrame, writer: Callable[[DataFrame], None]) -> None:
    """U4: hand the books to a caller's own writer."""
    writer(books)
