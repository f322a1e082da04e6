"""Chat formatting by multi-party perspective rotation. DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that
speaker as the assistant and the others as named users; only the assistant's
texts are to be learned. One row per (conversation, perspective, message)
carries the rendered piece, its offset in the rendering and the learned range,
so a conversation of any length is never gathered into one row or task: offsets
are prefix sums in two levels over a range partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from usagelens.llm.common import col, stored

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
NOBODY = "unknown"


def _broken(text):
    """Control markers inside a text or name lose their meaning by one space."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))


def rotate(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """One row per conversation, participant and message: conv_id, perspective,
    turn, speaker, chat_role, rendered, start, mask_start, mask_end (offsets in
    code points into the rendering; the mask is null where nothing is learned).

    Messages follow (turn, speaker, text), nulls first. Speakers named "system"
    set the scene and are no participants; a null speaker is "unknown", a null
    text empty; line breaks in a name become one space in its header; messages without a conversation id form one conversation;
    repeated rows are repeated messages; a conversation of system messages only
    has no participant and no rows; an empty table gives an empty result."""
    rows = messages.select(col(messages, conv_col).alias("conv_id"), col(messages, turn_col).alias("turn"),
                           F.coalesce(col(messages, speaker_col).cast("string"), F.lit(NOBODY)).alias("speaker"),
                           _broken(col(messages, text_col)).alias("text"))
    order = ["conv_id", "turn", "speaker", "text"]
    # a conversation with many messages spans several ranges; stored, so that the ranges stay as they are
    rows = stored(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "chat")
    name = F.regexp_replace(_broken(F.col("speaker")), "[\\r\\n]+", " ")  # a name stays within its header line
    system = F.col("speaker") == SYSTEM
    user_head = F.when(system, F.lit(f"{START}system\n")).otherwise(F.concat(F.lit(f"{START}user name="), name, F.lit("\n")))
    own_head = F.lit(f"{START}assistant\n")
    tail = F.lit(f"{END}\n")
    rows = rows.withColumn("as_user", F.concat(user_head, "text", tail)).withColumn("as_own", F.concat(own_head, "text", tail))
    rows = rows.withColumn("n", F.char_length("as_user").cast("bigint"))
    gain = (F.char_length("as_own") - F.char_length("as_user")).cast("bigint")  # the same for all messages of a speaker

    # lengths before a message: all messages as user, and how many the perspective itself has said
    here = W.partitionBy("part", "conv_id").orderBy("turn", "speaker", "text").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("gain", gain).withColumn("before", F.coalesce(F.sum("n").over(here), F.lit(0)))
    rows = rows.withColumn("at", F.row_number().over(W.partitionBy("part", "conv_id").orderBy("turn", "speaker", "text")))

    parts = rows.groupBy("conv_id", "part").agg(F.sum("n").alias("total"))
    earlier = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    people = rows.where(~system).select(F.col("conv_id").alias("pc"), F.col("speaker").alias("perspective")).distinct()

    gains = rows.where(~system).groupBy("conv_id", "part", "speaker").agg(F.sum("gain").alias("g"))
    # every (part, perspective) of a conversation, so that a part in which somebody is silent keeps the running sum
    grid = parts.join(people, F.col("c").eqNullSafe(F.col("pc"))).select("c", "p", "base", "perspective")
    gains = gains.select(F.col("conv_id").alias("gc"), F.col("part").alias("gp"), F.col("speaker").alias("gs"), "g")
    grid = grid.join(gains, F.col("c").eqNullSafe(F.col("gc")) & (F.col("p") == F.col("gp")) & (F.col("perspective") == F.col("gs")), "left")
    ahead = W.partitionBy("c", "perspective").orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    grid = grid.select("c", "p", F.col("perspective").alias("who"), "base", F.coalesce(F.sum("g").over(ahead), F.lit(0)).alias("own_base"))
    # messages meet the perspectives by (conversation, part): a long conversation stays split
    each = rows.join(grid, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).withColumnRenamed("who", "perspective")
    own = F.col("speaker") == F.col("perspective")
    own_gain = F.when(own, F.col("gain")).otherwise(F.lit(0))
    view = W.partitionBy("part", "conv_id", "perspective").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("own_before", F.coalesce(F.sum(own_gain).over(view), F.lit(0)))

    start = F.col("base") + F.col("own_base") + F.col("before") + F.col("own_before")
    learned = start + len(f"{START}assistant\n")
    return each.select(
        "conv_id", "perspective", "turn", "speaker",
        F.when(own, "assistant").when(system, "system").otherwise("user").alias("chat_role"),
        F.when(own, F.col("as_own")).otherwise(F.col("as_user")).alias("rendered"), start.alias("start"),
        F.when(own, learned).alias("mask_start"),
        F.when(own, learned + F.char_length("text") + len(END)).alias("mask_end"))
