"""Chat formatting (operator 6): multi-party perspective rotation.

For every participant of a conversation the dialogue is rendered with that participant as the assistant and all others as
named users; the mask marks what the assistant says. System turns are rendered as such from every perspective, and the
system is no participant. A turn is rendered as

    <|role|>name\\n text <|end|>\\n

with role system, user or assistant (the name is left out for system and assistant), without the blanks around the text.
The mask of an assistant turn is its text and end mark, as a span of code points of the rendered dialogue.

A long dialogue is rendered in parts of part_turns consecutive turn numbers, a row each, so a row is bounded by the part
and not by the conversation; parts joined in order are the dialogue, and offsets count from the part's start.

Turns come in the order of turn, role, text. A null turn number comes first, in part 0; a null role is the participant
"unknown"; a null text is empty. Turns that repeat in all columns are rendered each time. A conversation of system turns
alone has no participant and no row; a null conv_id is one conversation. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_TURNS = 256
SYSTEM, UNKNOWN = "system", "unknown"


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_turns: int = PART_TURNS) -> DataFrame:
    """(conv, speaker, part, n_turns, rendered, mask): a row for each participant and part; mask is an array of (start, end)."""
    rows = turns.select(
        F.col(conv).alias("c"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit(UNKNOWN)).alias("r"), F.coalesce(F.col(text), F.lit("")).alias("x"),
        F.coalesce(F.floor(F.col(turn) / part_turns), F.lit(0)).cast("long").alias("part"))
    speakers = rows.where(F.col("r") != SYSTEM).select("c", F.col("r").alias("speaker")).distinct()
    seen = rows.alias("a").join(speakers.alias("b"), F.expr("a.c <=> b.c")).select("a.*", "speaker")
    own = F.col("r") == F.col("speaker")
    head = F.when(F.col("r") == SYSTEM, "<|system|>\n").when(own, "<|assistant|>\n").otherwise(F.concat(F.lit("<|user|>"), F.col("r"), F.lit("\n")))
    seen = seen.withColumn("said", F.struct("t", "r", "x", head.alias("head"), own.alias("own")))
    parts = seen.groupBy("c", "speaker", "part").agg(F.sort_array(F.collect_list("said")).alias("s"))
    step = """aggregate(s, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,end:bigint>>)),
      (acc, e) -> named_struct('at', acc.at + length(e.head) + length(e.x) + 8,
        'spans', if(e.own, array_append(acc.spans, named_struct('start', acc.at + length(e.head), 'end', acc.at + length(e.head) + length(e.x) + 7)), acc.spans)))"""
    rendered = F.expr("array_join(transform(s, e -> concat(e.head, e.x, '<|end|>\\n')), '')")
    return parts.select(F.col("c").alias(conv), "speaker", "part", F.size("s").cast("long").alias("n_turns"), rendered.alias("rendered"), F.expr(step).getField("spans").alias("mask"))
