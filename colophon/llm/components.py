"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colophon.llm.tables import written
from colophon.sources.shared import materialize

ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
        .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(u, v)`` links of numbers to ``(node, root)``, root the least of the component.

    Only nodes other than their root are listed. A hub of very many links is a
    key of a partial aggregate and of a join that Spark may split. Each round is
    written, so a lost executor repeats one round only.
    """
    seen = None
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "links")
    for _ in range(ROUNDS):
        edges, now = materialize(
            _small_star(_large_star(edges)),
            "stars",
            rows=F.count(F.lit(1)),
            mark=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        )
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
