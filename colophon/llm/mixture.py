"""Mixing sources to target weights by a time-varying curriculum.

A source's target is its share of all words by weight, at most ``EPOCHS`` times its
own size; what a full source cannot take is shared among the others by weight, until
none is above. Over training time 0 to 1 a source's rate is given by a schedule, one
relative weight per knot and linear in between. Its integral, scaled to the target,
is the source's cumulative demand of words. The documents of a source stand in a
fixed pseudo-random order, repeated from the start when it ends; the words before a
document are the demand at which its turn comes, and the inverse of the cumulative
demand gives its position in training. Documents are range-sorted by position. The
last document of a source is cut so that the source gives the words of its target.

Sizes are numbers of ``[^\\x20\\x09-\\x0D]+`` in the whole text; null and empty texts
have none, take none and have no position. Rows without a source are a source of
their own, the last one. Rows that share a ``doc_id`` are mixed as documents of their
own. Ties of the order fall to ``doc_id`` and size; rows equal in these are
interchangeable. An empty table gives no rows; other columns are ignored. Reruns
agree. Texts never leave their scan: only sizes are shuffled. The running sums of a source
are spread over many tasks, and its rows learn of their source by joins on parts
of the sorted table, so one huge source is spread like many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colophon.llm import running
from colophon.llm.tables import table, written

EPOCHS = 3
WEIGHTS = (1, 2, 3)
KNOTS = (0.0, 0.5, 1.0)
# relative rates at the knots, taken in turn as the weights are: the light source
# comes early, the heavy one late
RATES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
WORDS = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size``, map-only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORDS)).cast("long").alias("size"),
    )


def ranked(sources: DataFrame, name: str) -> DataFrame:
    """``source, source_size, nth``: the number of each source in code-point order, null last."""
    rows = running.arranged(sources.withColumn("last", F.col("source").isNull()), ["last", "source"], name)
    parts = running.before(
        running.key_parts(rows, [], {"n": F.count(F.lit(1))}), [], {"first": F.sum("n")}
    )
    nth = F.coalesce("first", F.lit(0)) + F.count(F.lit(1)).over(running.inside([])) - 1
    return rows.join(parts, "part").select("source", "source_size", nth.alias("nth"))


def targets(sources: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, nth, target``.

    Every round shares what the full sources leave among the others by weight. A full
    source stays full, since the share of a unit of weight only grows; the rounds end
    when no further one fills.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    rows = written(sources.withColumn("weight", weight.cast("long")), "mix-sources")
    cap = epochs * F.col("source_size")
    total = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first().t
    share, full = 0.0, -1  # words per unit of weight, and the sources that are full at that
    while True:
        is_full = cap < F.lit(share) * F.col("weight")
        seen = rows.agg(
            F.coalesce(F.sum(F.when(is_full, cap)), F.lit(0)).alias("taken"),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0)).alias("open"),
            F.count_if(is_full).alias("n"),
        ).first()
        if seen.n == full or not seen.open:
            break
        full, share = seen.n, (total - seen.taken) / seen.open
    even = F.lit(share) * F.col("weight")
    return rows.select("source", "source_size", "nth", F.when(cap < even, cap.cast("double")).otherwise(even).alias("target"))


def _integrals(knots, rates) -> tuple[list[float], float]:
    """Cumulative integral of a piecewise linear rate at its knots, and its end."""
    done = [0.0]
    for i in range(1, len(knots)):
        done.append(done[-1] + (knots[i] - knots[i - 1]) * (rates[i] + rates[i - 1]) / 2)
    return done, done[-1]


def position(share: Column, nth: Column, knots=KNOTS, rates=RATES) -> Column:
    """The time by which a ``share`` (0 to 1) of a source's demand is due.

    On the piece between two knots the demand is ``r t + s t t / 2`` with rate ``r``
    and slope ``s``; the stable form of the root has no division by the slope.
    """
    found = F.lit(None).cast("double")
    for turn, own in enumerate(rates):
        done, whole = _integrals(knots, own)
        at = F.lit(float(knots[-1]))
        for i in range(len(knots) - 1, 0, -1):
            r, slope = own[i - 1], (own[i] - own[i - 1]) / (knots[i] - knots[i - 1])
            left = share * whole - done[i - 1]
            root = F.sqrt(F.greatest(r * r + 2 * slope * left, F.lit(0.0)))
            # a rate that starts from 0 has demand 0 at its knot
            t = knots[i - 1] + F.when(left > 0, 2 * left / (r + root)).otherwise(0.0)
            at = F.when(share * whole <= done[i], t).otherwise(at)
        found = F.when(nth % len(rates) == turn, at).otherwise(found)
    return found


def mixed(docs: DataFrame, weights=WEIGHTS, epochs: int = EPOCHS, knots=KNOTS, rates=RATES) -> DataFrame:
    """A row per document: ``doc_id, size, source_size, target, taken, passes``.

    ``passes`` lists what training takes of the document, each time with its
    ``position`` (0 to 1) and its ``words``; all but a source's last are whole.
    """
    counted = written(sizes(docs), "mix-sizes")  # texts are read once, the sort samples its input first
    rows = running.arranged(
        counted.withColumn("shuffled", F.md5(F.col("doc_id").cast("string"))),
        ["source", "shuffled", "doc_id", "size"], "mix-rows",
    )
    parts = written(running.key_parts(rows, ["source"], {"part_size": F.sum("size")}), "mix-parts")
    sources = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    aims = targets(ranked(sources, "mix-ranked"), weights, epochs)
    starts = running.before(parts, ["source"], {"start": F.sum("part_size")})
    of, within = F.col("source").eqNullSafe(F.col("s")), F.col("part") == F.col("p")
    known = (
        starts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce("start", F.lit(0)).alias("start"))
        .join(aims, of).drop("source")
    )
    due = rows.withColumn("inside", F.sum("size").over(running.inside(["source"])) - F.col("size")).join(known, of & within)
    here = F.col("start") + F.col("inside")
    whole = F.round("target").cast("long")
    passes = F.array(*[
        F.struct(
            position(F.try_divide(e * F.col("source_size") + here, F.col("target")), F.col("nth"), knots, rates).alias("position"),
            F.least(F.col("size"), whole - e * F.col("source_size") - here).alias("words"),
        )
        for e in range(epochs)
    ])
    taken = F.filter(passes, lambda p: p.words > 0)
    return due.withColumn("passes", taken).select(
        "doc_id", "size", "source_size", "target",
        F.aggregate("passes", F.lit(0).cast("long"), lambda n, p: n + p.words).alias("taken"), "passes",
    )


def curriculum(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, position, words`` in training order: a row each time a document is taken."""
    turns = mixed(docs, **options).select("doc_id", F.explode("passes").alias("one"))
    out = turns.select("doc_id", "one.position", "one.words")
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def query(spark, sf_dir: str) -> DataFrame:
    """Documents in the order of their first position, those that are not taken first."""
    rows = mixed(table(spark, sf_dir, "documents"))
    first = F.get("passes", F.lit(0))["position"]
    out = rows.select("doc_id", "size", "source_size", "target", "taken", F.size("passes").alias("passes"), first.alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")
