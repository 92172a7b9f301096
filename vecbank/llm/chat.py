"""Chat formatting by multi-party perspective rotation, with DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that participant as the assistant and the
others as named users. The result is a row per message and perspective, with its place in the rendered dialogue, so a
conversation of any length is spread over tasks: places are running sums in two levels (within blocks of
``BLOCK_TURNS`` turns, then over the blocks), and no row ever holds a whole dialogue. Participants meet messages by an
equi-join that adaptive execution may split, as their side has one row per participant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TURNS = 256
START, END = "<|im_start|>", "<|im_end|>\n"
UNNAMED = "unknown"


def header(role: Column, speaker: Column) -> Column:
    """What stands before a message: the assistant has no name, users carry theirs."""
    named = F.concat(F.lit(f"{START}user name="), role, F.lit("\n"))
    return F.when(role == speaker, F.lit(f"{START}assistant\n")).otherwise(named)


def rotate(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row per message and perspective: ``conv_id, speaker, turn, position, segment, start, is_target, mask_start, mask_end``.

    ``speaker`` is the participant rendered as assistant, ``segment`` the rendered message, ``start`` its first character in
    the dialogue, ``position`` its number there (from 0). Characters ``mask_start`` to ``mask_end`` (exclusive) of the
    dialogue are trained on: the assistant's text and its end mark; for other messages both are null.

    Messages are ordered by turn (missing ones first), then role and text. A null or empty role is the participant
    ``unknown``; a null text is empty; messages without conversation id form one conversation. Repeated messages are
    all rendered. Further columns of ``turns`` are not looked at. An empty table gives an empty result.
    """
    role = F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit(UNNAMED))
    messages = turns.select(
        "conv_id", "turn", role.alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / block_turns), F.lit(-(1 << 62))).alias("block"),
    )
    speakers = messages.select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    views = messages.join(speakers, messages["conv_id"].eqNullSafe(speakers["of"])).drop("of")
    target = F.col("role") == F.col("speaker")
    views = views.withColumn("is_target", target).withColumn(
        "segment", F.concat(header(F.col("role"), F.col("speaker")), F.col("text"), F.lit(END))
    ).withColumn("size", F.length("segment"))
    sums = views.groupBy("conv_id", "speaker", "block").agg(F.sum("size").alias("block_size"), F.count("*").alias("block_count"))
    earlier = Window.partitionBy("conv_id", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        F.col("conv_id").alias("c"), F.col("speaker").alias("s"), F.col("block").alias("b"),
        F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("base"),
        F.coalesce(F.sum("block_count").over(earlier), F.lit(0)).alias("first"),
    )
    order = Window.partitionBy("conv_id", "speaker", "block").orderBy("turn", "role", "text")
    inside = views.withColumn("nth", F.row_number().over(order) - 1).withColumn(
        "before", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    placed = inside.join(
        bases, inside["conv_id"].eqNullSafe(bases["c"]) & (inside["speaker"] == bases["s"]) & (inside["block"] == bases["b"])
    )
    start = (F.col("base") + F.col("before")).cast("long")
    first = start + F.length(header(F.col("role"), F.col("speaker")))
    return placed.select(
        "conv_id", "speaker", "turn", (F.col("first") + F.col("nth")).cast("long").alias("position"), "segment", start.alias("start"),
        "is_target", F.when(F.col("is_target"), first).alias("mask_start"),
        F.when(F.col("is_target"), start + F.col("size")).alias("mask_end"),
    )


#: The same rows in DuckDB.
ROTATE_SQL = f"""
    with messages as (
      select conv_id, turn, coalesce(nullif(role, ''), '{UNNAMED}') as role, coalesce(text, '') as text from conversations),
    speakers as (select distinct conv_id, role as speaker from messages),
    views as (
      select m.*, s.speaker, m.role = s.speaker as is_target,
             case when m.role = s.speaker then '{START}assistant' else '{START}user name=' || m.role end || chr(10) as head
      from messages m join speakers s on m.conv_id is not distinct from s.conv_id),
    placed as (
      select *, head || text || '{END.strip()}' || chr(10) as segment,
             row_number() over w - 1 as position,
             coalesce(sum(length(head || text || '{END.strip()}' || chr(10)))
                      over (partition by conv_id, speaker order by turn nulls first, role, text
                            rows between unbounded preceding and 1 preceding), 0)::bigint as start
      from views window w as (partition by conv_id, speaker order by turn nulls first, role, text))
    select conv_id, speaker, turn, position, segment, start, is_target,
           case when is_target then start + length(head) end as mask_start,
           case when is_target then start + length(segment) end as mask_end
    from placed"""
