"""Chat formatting: a dialogue from the view of each of its participants.

For every participant of a conversation the dialogue is rendered with that speaker
as the assistant and the others as named users; the loss mask is set on the
assistant's words alone. Narrators (``system``) are no participants: their turns stay
system turns in every view, without loss.

A view is returned in pieces, one row per turn, with the place of the piece in the
rendered dialogue: the pieces of a view in the order of ``start`` are its text, and
no conversation is ever gathered in one task. DataFrame functions only. Turns are
sorted by range; places are running sums inside each sorted part, plus the sums of
the parts before, so that one huge conversation is spread like many small ones.

Turns are ordered by ``turn``, then role, then text (nulls first). A null role is the
speaker ``unknown``; a null text is empty; rows without ``conv_id`` are one
conversation. Repeated rows are turns of their own. Marks inside a text or a rendered
name are broken up (``<|`` becomes ``< |``), line breaks in a name become blanks. Conversations without participants and empty tables give
no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colophon.llm.tables import table, written

NARRATORS = ("system",)
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def views(conversations: DataFrame) -> DataFrame:
    """A row per conversation, participant and turn, with text, place and mask."""
    speaker = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    turns = conversations.select(
        "conv_id",
        "turn",
        speaker.alias("speaker"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("content"),
    )
    order = ["conv_id", "turn", "speaker", "content"]
    # the id has the number of the sorted part in its upper bits
    at = F.monotonically_increasing_id()
    spoken = written(
        turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at), "chat-turns"
    )
    people = (
        spoken.where(~F.col("speaker").isin(*NARRATORS))
        .select(F.col("conv_id").alias("of"), F.col("speaker").alias("participant")).distinct()
    )
    narrated, own = F.col("speaker").isin(*NARRATORS), F.col("speaker") == F.col("participant")
    chat_role = F.when(narrated, "system").when(own, "assistant").otherwise("user")
    # a name can't end its own turn or open another
    name = F.translate(F.replace(F.col("speaker"), F.lit("<|"), F.lit("< |")), "\n\r", "  ")
    named = F.when(chat_role == "user", F.concat(F.lit(" name="), name)).otherwise("")
    seen = (
        spoken.join(people, F.col("conv_id").eqNullSafe(F.col("of")))
        .select(
            "conv_id", "participant", "turn", "speaker", chat_role.alias("chat_role"), "content", "at",
            F.shiftright("at", 33).alias("part"),
            F.concat(F.lit(OPEN), chat_role, named, F.lit("\n")).alias("head"),
        )
        .withColumn("size", F.length("head") + F.length("content") + len(CLOSE))
    )
    view = ["conv_id", "participant"]
    parts = seen.groupBy(*view, "part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_turns"))
    earlier = W.partitionBy(*view).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = parts.select(
        F.col("conv_id").alias("c"), F.col("participant").alias("p"), F.col("part").alias("q"),
        F.coalesce(F.sum("part_size").over(earlier), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_turns").over(earlier), F.lit(0)).alias("turns_before"),
    )
    inside = W.partitionBy(*view, "part").orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = seen.withColumn("done", F.sum("size").over(inside)).withColumn("nth", F.count(F.lit(1)).over(inside))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("participant") == F.col("p")) & (F.col("part") == F.col("q"))
    start = F.col("size_before") + F.col("done") - F.col("size")
    said = F.when(F.col("chat_role") == "assistant", start + F.length("head"))
    return placed.join(before, same).select(
        "conv_id",
        "participant",
        (F.col("turns_before") + F.col("nth") - 1).alias("position"),
        "turn",
        "speaker",
        "chat_role",
        F.concat("head", "content", F.lit(CLOSE)).alias("piece"),
        start.alias("start"),
        (start + F.col("size")).alias("end"),
        (F.col("chat_role") == "assistant").alias("loss"),
        said.alias("loss_start"),
        # the end mark is learned too, the line break after it is not
        (said + F.length("content") + len(CLOSE) - 1).alias("loss_end"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return views(table(spark, sf_dir, "conversations"))
