"""Multi-party perspective rotation, in DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered with that
speaker as assistant and all others as users named after themselves; system
turns stay system turns. The loss mask covers what the assistant says, its end
mark included. A turn is

    <|im_start|>assistant\\n...<|im_end|>\\n
    <|im_start|>user name=<speaker>\\n...<|im_end|>\\n
    <|im_start|>system\\n...<|im_end|>\\n

Scale: a dialogue is rendered in consecutive parts of `part_turns` turns (most
have one), so no task or row holds a whole hot dialogue; the texts of the parts
in order are the whole rendering. Turns are numbered by a range partitioning of
(dialogue, turn, speaker) with a prefix sum over the counts of its partitions,
and gathered once a part, not once a participant.

Defined cases: a null or empty speaker is `unknown`; a null text is empty; a
null dialogue id is a dialogue of its own; turns of equal number are ordered by
speaker and text, null numbers come first; repeated rows are repeated turns; a
dialogue of system turns alone has no participant and no row; `<|` in texts and
names is written `< |`; very long texts are rendered whole; an empty table gives an empty
result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlake.llm.common import col, written

START, END = "<|im_start|>", "<|im_end|>"


def _clean(c: Column) -> Column:
    return F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("<|"), F.lit("< |"))


def numbered_turns(turns: DataFrame, *, conv_col: str, turn_col: str, speaker_col: str, text_col: str) -> DataFrame:
    """(conv, speaker, text, at): every turn with its place in its dialogue, from 0."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    speaker = _clean(col(speaker_col))
    t = turns.select(col(conv_col).alias("conv"), col(turn_col).alias("turn"),
                     F.when(speaker == "", "unknown").otherwise(speaker).alias("speaker"), _clean(col(text_col)).alias("text"))
    # equal turns may be split between partitions: the row number decides between them
    t = t.withColumn("tie", F.monotonically_increasing_id())
    t = (t.repartitionByRange(n, "conv", "turn", "speaker", "text", "tie").withColumn("range", F.spark_partition_id()))
    t = written(t, "turns")
    counts = t.groupBy("conv", "range").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select(F.col("conv").alias("_c"), F.col("range").alias("_r"), F.coalesce(
        F.sum("n").over(Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("conv", "range").orderBy("turn", "speaker", "text", "tie")) - 1
    return (t.withColumn("_in", inside)
             .join(before, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r")))
             .select("conv", "speaker", "text", (F.col("_before") + F.col("_in")).alias("at")))


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role",
           text_col: str = "text", system: str = "system", part_turns: int = 256) -> DataFrame:
    """(conv, participant, part, n_turns, text, mask): `mask` lists the
    character spans of the assistant's words within `text` as
    ARRAY<STRUCT<start, end>>."""
    t = written(numbered_turns(turns, conv_col=conv_col, turn_col=turn_col, speaker_col=speaker_col, text_col=text_col)
                .withColumn("part", F.floor(F.col("at") / part_turns)), "numbered-turns")
    who = (t.where(F.col("speaker") != system).select(F.col("conv").alias("_c"), F.col("speaker").alias("participant"))
            .distinct())
    parts = t.groupBy("conv", "part").agg(F.array_sort(F.collect_list(F.struct("at", "speaker", "text"))).alias("turns"))
    both = parts.join(who, F.col("conv").eqNullSafe(F.col("_c")))
    mine = lambda x: x["speaker"] == F.col("participant")
    head = lambda x: F.concat(F.lit(START), F.when(x["speaker"] == system, system).when(mine(x), "assistant")
                              .otherwise(F.concat(F.lit("user name="), x["speaker"])), F.lit("\n"))
    body = lambda x: F.concat(x["text"], F.lit(END))
    pieces = both.select(
        "conv", "participant", "part", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda x: F.concat(head(x), body(x), F.lit("\n"))), "").alias("text"),
        F.transform("turns", lambda x: F.struct(F.char_length(head(x)).cast("long").alias("head"),
                                                F.char_length(body(x)).cast("long").alias("body"),
                                                mine(x).alias("mine"))).alias("sizes"))
    span = "array<struct<start:bigint,end:bigint>>"
    step = lambda acc, x: F.struct(
        (acc["at"] + x["head"] + x["body"] + 1).alias("at"),
        F.when(x["mine"], F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + x["head"]).alias("start"), (acc["at"] + x["head"] + x["body"]).alias("end"))).cast(span)))
         .otherwise(acc["spans"]).alias("spans"))
    mask = F.aggregate("sizes", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans")), step,
                       lambda acc: acc["spans"])
    return pieces.select("conv", "participant", "part", "n_turns", "text", mask.alias("mask"))
