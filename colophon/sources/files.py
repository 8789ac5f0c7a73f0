"""Files as input: listing and text of the types that need no codec.

Folders are listed and files opened by tasks, through the stores that Arrow
knows (local or mounted paths, ``hdfs``, ``s3``, ``gs``). For others, pass a table of
texts to ``scan``. The functions that run in tasks are nested so that they travel
by value: executors need not have this package.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon.functions import text as tx
from colophon.operators.incremental import skip_processed
from colophon.sources.shared import materialize

# Bytes of files that one task opens, about.
TASK_BYTES = 1 << 30
# A value of a table holds less than 2 GB: larger files fail, the run goes on.
FILE_BYTES = (1 << 31) - (1 << 20)
# The name of a written file in its folder.
PART = "part-0.txt"
UNREADABLE = "the file can't be read, or has more than 2 GB"

Extractor = Callable[[DataFrame], DataFrame]


def _store():
    """``path -> (store, place in it, what stands before places in its paths)``."""

    def of(path: str):
        from pyarrow import fs

        if path.startswith("/"):
            return fs.LocalFileSystem(), path, ""
        store, place = fs.FileSystem.from_uri(path)
        return store, place, path.rstrip("/").removesuffix(place.rstrip("/"))

    return of


def _lister():
    store_of = _store()

    def children(batches):
        import os

        from pyarrow import fs

        for batch in batches:
            out = []
            for folder in batch.column("folder").to_pylist():
                store, place, prefix = store_of(folder)
                root = store.get_file_info(place)
                infos = [root] if root.is_file else store.get_file_info(fs.FileSelector(place))
                for x in infos:
                    if x.is_file or x.type == fs.FileType.Directory:
                        linked = not prefix and x is not root and os.path.islink(x.path)
                        if not linked:
                            out.append((prefix + x.path, None if not x.is_file else x.size, not x.is_file))
            cols = list(zip(*out)) or [(), (), ()]
            kinds = (pa.string(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["filepath", "length", "folder"])

    return children


def _opener(most: int):
    store_of = _store()

    def content(path):
        store, place, _ = store_of(path)
        try:
            if store.get_file_info(place).size > most:
                return None
            with store.open_input_stream(place) as f:
                return f.read()
        except OSError:
            return None

    def contents(batches):
        for batch in batches:
            for path in batch.column("filepath").to_pylist():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([content(path)], pa.binary())], ["filepath", "content"]
                )

    return contents


def _writer(root: str):
    store_of = _store()

    def write(batches):
        import uuid

        store, place, _ = store_of(root)
        folder = out = temporary = None
        files = 0

        def close():
            out.close()
            store.move(temporary, f"{place}/{folder}/{PART}")

        for batch in batches:
            for name, text in zip(batch.column("folder").to_pylist(), batch.column("text").cast(pa.binary())):
                if name != folder:
                    if out is not None:
                        close()
                    folder, files = name, files + 1
                    store.create_dir(f"{place}/{folder}")
                    temporary = f"{place}/{folder}/{PART}.{uuid.uuid4().hex}"
                    out = store.open_output_stream(temporary)
                if text.is_valid:
                    out.write(text.as_buffer())
                out.write(b"\n")
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], ["files"])

    return write


def write_texts(texts: DataFrame, root: str) -> int:
    """``(folder, text)`` as one file per folder below ``root``, a line per text; the number of files.

    Tasks write them through Arrow, as files are read: Hadoop's local store without its
    native library starts processes for every file. A file gets its name when it is whole, so a
    task can run again.
    """
    store, place, _ = _store()(root)
    store.create_dir(place)
    # sorted, so that a task has one file open and holds no folder's texts
    dealt = texts.select("folder", "text").repartition("folder").sortWithinPartitions("folder")
    written = dealt.mapInArrow(_writer(root), "files long")
    return written.agg(F.sum("files")).first()[0] or 0


def absolute_root(root: str) -> str:
    """A root as an absolute path, or the URI of another store. It must exist."""
    from pyarrow import fs

    path = re.sub(r"^file:(?://)?(?=/)", "", root)
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", path):
        path = os.path.abspath(path)
    store, place, _ = _store()(path)
    if store.get_file_info(place).type == fs.FileType.NotFound:
        raise FileNotFoundError(f"nothing to scan at {root}")
    return path


def scan_files(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """``(filepath, length)`` of the accepted regular files below ``root``, each once.

    Paths are absolute, whatever the root is; a root that does not exist is refused
    before any task runs. Hidden names are listed too, links are not followed. One
    round of tasks per level of folders; contents are not opened.
    """
    roots = [root] if isinstance(root, str) else root
    folders = [(absolute_root(r),) for r in roots]
    level, found = spark.createDataFrame(folders, "folder string"), []
    number = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        listed = level.repartition(number).mapInArrow(_lister(), "filepath string, length long, folder boolean")
        wanted = listed.where(F.col("folder") | tx.is_supported(F.col("filepath")))
        rows, seen = materialize(wanted, "listing", folders=F.count_if("folder"))
        found.append(rows.where("not folder").select("filepath", "length"))
        if not seen["folders"]:
            break
        level = rows.where("folder").select(F.col("filepath").alias("folder"))
    files = reduce(DataFrame.unionByName, found)
    return files if isinstance(root, str) else files.dropDuplicates(["filepath"])


def read_contents(spark: SparkSession, root: str | list[str], cache: DataFrame | None = None) -> DataFrame:
    """``(filepath, content)`` of the accepted files below ``root``; known ones stay closed.

    With a cache the listed paths are compared with its paths first, and only
    files without a book are opened, however many they are. A file that can't be
    opened, or of more than ``FILE_BYTES``, has no content.
    """
    files = scan_files(spark, root)
    if cache is not None:
        files = skip_processed(files, cache)
    fresh, seen = materialize(files, "fresh-files", bytes=F.sum("length"))
    number = max((seen["bytes"] or 0) // TASK_BYTES + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return fresh.select("filepath").repartition(number).mapInArrow(_opener(FILE_BYTES), "filepath string, content binary")


def native_text(contents: DataFrame) -> DataFrame:
    """S3: an extractor for plain text and HTML; other types fail.

    ``(filepath, content)`` to ``(filepath, text, error)``.
    """
    ext = tx.extension(F.col("filepath"))
    decoded = tx.decode_utf8(F.col("content"))
    text = F.when(ext.isin(tx.PLAIN_EXTENSIONS), decoded).when(
        ext.isin(tx.HTML_EXTENSIONS), tx.html_to_text(decoded)
    )
    known = ext.isin(tx.PLAIN_EXTENSIONS + tx.HTML_EXTENSIONS)
    return contents.select(
        "filepath", text.alias("text"),
        F.when(~known, "no codec for this type").when(F.col("content").isNull(), UNREADABLE).alias("error"),
    )


def extract_files(
    spark: SparkSession,
    root: str | list[str],
    extractors: list[Extractor] | None = None,
    cache: DataFrame | None = None,
) -> list[DataFrame]:
    """One text table per extractor, in order, as ``scan`` takes them."""
    if extractors is None:
        extractors = [native_text]
    if not extractors:
        raise ValueError("at least one extractor must be enabled")
    contents = read_contents(spark, root, cache)
    return [extractor(contents) for extractor in extractors]
