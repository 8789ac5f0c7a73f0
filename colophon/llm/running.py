"""Running sums in a global order, with one key's rows spread over many tasks.

Rows are sorted by range, so that a key of very many rows lies in many sorted parts.
Sums run inside each part; a part's start is the sum of the key's parts before it,
a table of one row per key and part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.llm.tables import written


def arranged(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` written in order of some columns, with its ``part`` and its place ``at``.

    Rows that are equal in all of ``order`` may be split over parts; they are
    interchangeable. Places rise with the order but have gaps.
    """
    line = df.withColumn("__line", F.monotonically_increasing_id())
    dealt = line.repartitionByRange(*order, "__line").sortWithinPartitions(*order, "__line").drop("__line")
    at = F.monotonically_increasing_id()  # has the number of the part in its upper bits
    return written(dealt.withColumn("at", at).withColumn("part", F.shiftright("at", 33)), name)


def key_parts(df: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """Per key and part, aggregates named ``sums`` over its rows."""
    return df.groupBy(*keys, "part").agg(*[c.alias(n) for n, c in sums.items()])


def before(parts: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """``parts`` with aggregates over the earlier parts of the same key.

    A window holds one row per part of a key, so it is as small as the number of parts.
    """
    window = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    return parts.select("*", *[c.over(window).alias(n) for n, c in sums.items()])


def inside(keys: list[str], through: int = W.currentRow):
    """The window of a row and the rows before it in its part."""
    return W.partitionBy(*keys, "part").orderBy("at").rowsBetween(W.unboundedPreceding, through)
