"""Intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one only locally."""
    path = spark.conf.get(CONF, None)
    if path:
        return path
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError(f"set {CONF} to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="colophon-")
    spark.conf.set(CONF, path)
    return path


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, below a folder of this application."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written in this block are deleted at its end: nothing may read them any more."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        for place in made:
            path = spark._jvm.org.apache.hadoop.fs.Path(place)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in schema])


def materialize(df: DataFrame, name: str, **metrics) -> tuple[DataFrame, dict]:
    """Write ``df`` once and read it back, with aggregates observed on the way.

    The written table cuts the lineage (a lost executor never repeats the work
    behind it) and has a known size, on which the choice of joins rests.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    observed = {}
    if metrics:
        observation = Observation(name)
        df = df.observe(observation, *[c.alias(m) for m, c in metrics.items()])
    df.write.parquet(path)
    if metrics:
        observed = observation.get
    return spark.read.schema(_nullable(df.schema)).parquet(path), observed
