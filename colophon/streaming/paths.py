"""Which paths a stream has written, as split-block Bloom filters.

Every batch leaves one filter per hash bucket of its paths, in a narrow table beside
the output. A later batch asks the filters of its own buckets and opens only those
folders of the output that may hold one of its paths. A false hit costs a read, no
more: the paths that are read are compared exactly. The functions that run in tasks
are nested so that they travel by value: executors need not have this package.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
# 32 bits a path: about one false hit in 50,000 questions
BITS = 32
FOLDER = "_paths"
_SCHEMA = "bucket int, n long, bits binary"


def bucket_of(path: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(path, F.lit("bucket")), F.lit(buckets)).cast("int")


def _masks():
    """Eight bits of a block for each hash, and the block: nested for the tasks."""

    def of(hashed, blocks):
        import numpy as np

        low = hashed & np.uint64(0xFFFFFFFF)
        block = ((hashed >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
        # odd multipliers, one per word of a block
        salt = np.arange(1, 9, dtype=np.uint64) * np.uint64(0x9E3779B1) | np.uint64(1)
        bit = ((low[:, None] * (salt & np.uint64(0xFFFFFFFF))) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        return block.astype(np.int64), np.uint32(1) << bit.astype(np.uint32)

    return of


def _builder(bits: int):
    masks = _masks()

    def build(batches):
        import numpy as np
        import pyarrow as pa

        state = None  # bucket, number of paths, words of the filter

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([state[0]], pa.int32()), pa.array([state[1]], pa.int64()), pa.array([state[2].tobytes()], pa.binary())],
                ["bucket", "n", "bits"],
            )

        for batch in batches:
            bucket, n, hashed = (batch.column(c).to_numpy() for c in ("bucket", "n", "hashed"))
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(bucket)]):
                if state is None or state[0] != bucket[lo]:
                    if state is not None:
                        yield row()
                    blocks = -(-int(n[lo]) * bits // 256)
                    state = (int(bucket[lo]), int(n[lo]), np.zeros((blocks, 8), np.uint32))
                block, bit = masks(hashed[lo:hi].view(np.uint64), len(state[2]))
                np.bitwise_or.at(state[2], block, bit)
        if state is not None:
            yield row()

    return build


def filters_of(paths: DataFrame, buckets: int = BUCKETS, bits: int = BITS) -> DataFrame:
    """``bucket, n, bits``: a filter per bucket of the distinct paths ``filepath``."""
    keyed = paths.select(bucket_of(F.col("filepath"), buckets).alias("bucket"), F.xxhash64("filepath").alias("hashed"))
    counts = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    rows = keyed.join(F.broadcast(counts), "bucket")  # at most ``buckets`` rows
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_builder(bits), _SCHEMA)


def _prober():
    masks = _masks()

    def probe(batches):
        import numpy as np
        import pyarrow as pa

        bucket, asked = None, []
        for batch in batches:
            hits = []
            cols = (batch.column(c).to_pylist() for c in ("bucket", "hashed", "batch", "bits"))
            for b, hashed, number, filter_bits in zip(*cols):
                if b != bucket:
                    bucket, asked = b, []
                if filter_bits is None:
                    asked.append(hashed)
                elif len(asked):
                    if isinstance(asked, list):
                        asked = np.array(asked, np.int64).view(np.uint64)
                    words = np.frombuffer(filter_bits, np.uint32).reshape(-1, 8)
                    block, bit = masks(asked, len(words))
                    if ((words[block] & bit) == bit).all(axis=1).any():
                        hits.append((number, b))
            cols = list(zip(*hits)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32())], ["batch", "bucket"])

    return probe


def folders_with(paths: DataFrame, filters: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``batch, bucket`` of the filters that may hold one of ``paths``.

    A task holds the hashes of one bucket of the new paths; filters stream past them.
    """
    none = F.lit(None)
    asked = paths.select(
        bucket_of(F.col("filepath"), buckets).alias("bucket"), F.xxhash64("filepath").alias("hashed"),
        none.cast("long").alias("batch"), none.cast("binary").alias("bits"),
    )
    held = filters.select("bucket", none.cast("long").alias("hashed"), F.col("batch").cast("long").alias("batch"), "bits")
    rows = asked.unionByName(held).repartition("bucket").sortWithinPartitions("bucket", F.col("batch").asc_nulls_first())
    return rows.mapInArrow(_prober(), "batch long, bucket int")


def _folders(spark: SparkSession, place: str) -> list[str]:
    """Names of the folders in ``place``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    return [s.getPath().getName() for s in store.listStatus(path) if s.isDirectory()]


def _batches(spark: SparkSession, place: str, before: int) -> set[int]:
    numbers = (int(n.removeprefix("batch=")) for n in _folders(spark, place) if n.startswith("batch="))
    return {n for n in numbers if n < before}


def places_of(paths: DataFrame, output: str, batch_id: int, buckets: int = BUCKETS) -> list[str]:
    """Folders of an output, of batches before ``batch_id``, that may hold one of ``paths``.

    They are at most as many as the output has, by name only. A batch without filters is read whole.
    """
    spark = paths.sparkSession
    known = _batches(spark, f"{output}/{FOLDER}", batch_id)
    whole = sorted(_batches(spark, output, batch_id) - known)
    places = [f"{output}/batch={n}" for n in whole]
    if known:
        filters = spark.read.schema(f"{_SCHEMA}, batch long").parquet(f"{output}/{FOLDER}").where(F.col("batch") < batch_id)
        hits = folders_with(paths, filters, buckets).distinct().collect()
        places += [f"{output}/batch={h.batch}/bucket={h.bucket}" for h in sorted(hits)]
    return places
