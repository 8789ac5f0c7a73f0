"""Left joins on keys of which a few may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A key is hot above MIN_HOT_ROWS rows and above 1/MAX_HOT_KEYS of all rows, so
# there are fewer than MAX_HOT_KEYS hot keys whatever the size of the data.
MAX_HOT_KEYS = 10_000
MIN_HOT_ROWS = 1_000_000


def hot_keys(
    counts: DataFrame, total: int, min_rows: int = MIN_HOT_ROWS
) -> DataFrame | None:
    """Keys of ``counts`` (key columns and ``n``) to be split, with ``parts``.

    ``total`` is at least the sum of ``n``. None if no key can be hot.
    """
    if total <= min_rows:
        return None
    limit = max(min_rows, total // MAX_HOT_KEYS + 1)
    return counts.where(F.col("n") > limit).select(
        *[c for c in counts.columns if c != "n"],
        F.ceil(F.col("n") / limit).cast("int").alias("parts"),
    )


def salted_left_join(
    many: DataFrame, one: DataFrame, on: list[str], hot: DataFrame | None, spread: Column, shuffled: bool = False
) -> DataFrame:
    """``many LEFT JOIN one`` where hot keys are dealt over several tasks.

    ``spread`` deals the rows of a hot key; the few rows that ``one`` has for
    the key are repeated for every part. ``hot`` is bounded by MAX_HOT_KEYS. With
    ``shuffled``, ``one`` is never broadcast, however small Spark takes it to be.
    """
    if hot is None:
        return many.join(one.hint("merge") if shuffled else one, on, "left")
    hot_on = [c for c in hot.columns if c != "parts"]
    dealt = F.pmod(F.xxhash64(spread), "parts").cast("int")
    many = many.join(F.broadcast(hot), hot_on, "left").withColumn(
        "salt", F.when(F.col("parts").isNull(), 0).otherwise(dealt)
    )
    one = one.join(F.broadcast(hot), hot_on, "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    )
    one = one.drop("parts")
    joined = many.drop("parts").join(one.hint("merge") if shuffled else one, [*on, "salt"], "left")
    return joined.drop("salt")
