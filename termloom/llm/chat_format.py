"""Conversations rendered from the view of each participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _shown(speaker: Column) -> Column:
    """A name that can't open or close a message nor end the line it stands in."""
    return F.regexp_replace(F.replace(speaker, F.lit("<|im_"), F.lit("<| im_")), r'[\x00-\x1f\x7f"]+', " ")


def _head(speaker: Column, view: Column) -> Column:
    return (
        F.when(speaker == "system", F.lit(f"{OPEN}system\n"))
        .when(speaker == view, F.lit(f"{OPEN}assistant\n"))
        .otherwise(F.concat(F.lit(f"{OPEN}user name="), _shown(speaker), F.lit("\n")))
    )


def rotate_perspectives(turns: DataFrame, segment_turns: int = 64, part_messages: int = 1024) -> DataFrame:
    """``conv_id, perspective, segment, part, n_messages, rendered, masks, n_target_chars``.

    For every participant (each speaker but ``system``) the dialogue is rendered with that speaker as the
    assistant, other speakers as users with their names, and the system's turns as such. ``masks`` lists
    ``start:length`` of the parts to learn from, the assistant's texts with their closing mark, in code
    points of ``rendered``. A dialogue is rendered in segments of ``segment_turns`` turn numbers, so that one
    very long conversation is spread over many rows, and a segment in parts of ``part_messages`` messages, so that
    many messages of one turn (or of none) are too; segments and parts in order are the whole dialogue.

    Messages with one turn number are ordered by speaker, then text; equal messages are one. A null role is
    the speaker ``unknown``, a null text is empty, a null turn counts as turn 0, a null conversation is a
    conversation. Marks inside texts and names are broken up so that they can't open or close a message, and line
    ends, control characters and double quotes in names are blanks. A very long text is one message. A conversation
    with only system turns has no perspective and gives no row, nor does an empty table. Native functions only.
    """
    plain = F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|im_"), F.lit("<| im_"))
    rows = turns.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0).cast("long")).alias("turn"), F.coalesce("role", F.lit("unknown")).alias("speaker"), plain.alias("body"))
    # Dealt once, by segment: equal messages meet there, are put in order by a sort that can spill, and are gathered.
    rows = rows.withColumn("segment", F.floor(F.col("turn") / segment_turns).cast("long")).repartition("conv_id", "segment").distinct()
    order = Window.partitionBy("conv_id", "segment").orderBy("turn", "speaker", "body")
    placed = rows.withColumn("part", F.floor((F.row_number().over(order) - 1) / part_messages).cast("long"))
    parts = placed.groupBy("conv_id", "segment", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "speaker", "body"))).alias("messages"))
    people = rows.where("speaker <> 'system'").groupBy("conv_id").agg(F.collect_set("speaker").alias("people"))
    views = people.select(F.col("conv_id").alias("of"), F.explode("people").alias("perspective"))
    joined = parts.join(views, F.col("conv_id").eqNullSafe(F.col("of")))
    pieces = F.transform("messages", lambda m: F.struct(m["speaker"].alias("speaker"), _head(m["speaker"], F.col("perspective")).alias("head"), F.concat(m["body"], F.lit(f"{CLOSE}\n")).alias("rest")))
    sized = joined.withColumn("pieces", pieces)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("masks"), F.lit(0).alias("n"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        length = F.length(p["rest"]) - 1
        own = p["speaker"] == F.col("perspective")
        mark = F.concat(start.cast("string"), F.lit(":"), length.cast("string"))
        return F.struct((start + length + 1).alias("at"), F.when(own, F.concat(acc["masks"], F.array(mark))).otherwise(acc["masks"]).alias("masks"), F.when(own, acc["n"] + length).otherwise(acc["n"]).alias("n"))

    walked = sized.withColumn("walk", F.aggregate("pieces", state, step))
    return walked.select(
        "conv_id",
        "perspective",
        "segment",
        "part",
        F.size("messages").cast("long").alias("n_messages"),
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["rest"])), "").alias("rendered"),
        F.array_join("walk.masks", ",").alias("masks"),
        F.col("walk.n").cast("long").alias("n_target_chars"),
    )


ORACLE = r"""
    WITH r AS (
        SELECT DISTINCT conv_id, coalesce(turn, 0)::BIGINT AS turn, coalesce(role, 'unknown') AS speaker,
               replace(coalesce(text, ''), '<|im_', '<| im_') AS body
        FROM conversations
    ), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM r WHERE speaker <> 'system'),
    n AS (
        SELECT *, floor(turn / 64)::BIGINT AS segment,
               floor((row_number() OVER (PARTITION BY conv_id, floor(turn / 64) ORDER BY turn, speaker, body) - 1) / 1024)::BIGINT AS part FROM r
    ), m AS (
        SELECT n.conv_id, p.perspective, n.segment, n.part, n.turn, n.speaker, n.body,
               CASE WHEN n.speaker = 'system' THEN '<|im_start|>system' || chr(10)
                    WHEN n.speaker = p.perspective THEN '<|im_start|>assistant' || chr(10)
                    ELSE '<|im_start|>user name=' || regexp_replace(replace(n.speaker, '<|im_', '<| im_'), '[\x00-\x1f\x7f"]+', ' ', 'g') || chr(10) END AS head,
               n.body || '<|im_end|>' || chr(10) AS rest
        FROM n JOIN p ON n.conv_id IS NOT DISTINCT FROM p.conv_id
    ), w AS (
        SELECT *, coalesce(sum(length(head) + length(rest)) OVER (PARTITION BY conv_id, perspective, segment, part
               ORDER BY turn, speaker, body ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM m
    )
    SELECT conv_id, perspective, segment, part, count(*)::BIGINT AS n_messages,
           string_agg(head || rest, '' ORDER BY turn, speaker, body) AS rendered,
           coalesce(string_agg((pos + length(head))::VARCHAR || ':' || (length(rest) - 1)::VARCHAR, ',' ORDER BY turn, speaker, body)
                    FILTER (speaker = perspective), '') AS masks,
           coalesce(sum(length(rest) - 1) FILTER (speaker = perspective), 0)::BIGINT AS n_target_chars
    FROM w GROUP BY conv_id, perspective, segment, part
"""
