"""Multi-party perspective rotation of conversations, by DataFrame functions alone.

For every participant the whole dialogue is rendered with that speaker as the assistant and the others as
named users; masks are the character spans that the assistant produces (its words and the end mark). System
turns stay system turns and aren't participants.

A conversation is cut into blocks of TURNS turn numbers: a conversation of any length is then many rows of
bounded size, and the blocks of a perspective, one after the other, are its rendering.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = 64
SYSTEM, UNNAMED, END = "system", "unknown", "<|end|>"


def rotate(turns: DataFrame, block_turns: int = TURNS) -> DataFrame:
    """(conv_id, perspective, block, n_turns, rendered, masks) from (conv_id, turn, role, text).

    `masks` lists `start:end` of the block's trained spans in code points, comma-separated; empty if the speaker
    is silent in the block. Turns are ordered by number, then role and text; repeated rows stay. A null role is
    a speaker named `unknown`, a null text is empty, a null turn comes before all and is in block -1; a null
    conversation is one of its own. A conversation of system turns alone has no perspective and gives no row.
    """
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(UNNAMED)).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.floor(F.col("turn") / block_turns).cast("long"), F.lit(-1).cast("long")).alias("block"),
    )
    speakers = rows.where(F.col("role") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("role").alias("perspective")).distinct()
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    seen = blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("_conv")))

    def head(t: Column) -> Column:
        named = F.concat(F.lit("<|user "), t["role"], F.lit("|>\n"))
        return F.when(t["role"] == SYSTEM, F.lit("<|system|>\n")).when(t["role"] == F.col("perspective"), F.lit("<|assistant|>\n")).otherwise(named)

    parts = F.transform("turns", lambda t: F.struct(
        head(t).alias("head"), F.concat(t["text"], F.lit(END)).alias("body"), (t["role"] == F.col("perspective")).alias("own")
    ))
    at = F.lit(0).cast("long")
    start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(s: Column, p: Column) -> Column:
        a = s["at"] + F.char_length(p["head"])
        b = a + F.char_length(p["body"])
        span = F.concat_ws(":", a.cast("string"), b.cast("string"))
        return F.struct((b + 1).cast("long").alias("at"), F.when(p["own"], F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    return seen.withColumn("parts", parts).select(
        "conv_id", "perspective", "block", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("\n"))), "").alias("rendered"),
        F.array_join(F.aggregate("parts", start, step, lambda s: s["spans"]), ",").alias("masks"),
    )


SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '{UNNAMED}') AS role, coalesce(text, '') AS text,
                  coalesce(CAST(floor(turn / {TURNS}) AS BIGINT), -1) AS block FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{SYSTEM}'),
p AS (SELECT t.conv_id, s.perspective, block, turn, t.role, text, t.role = s.perspective AS own,
             CASE WHEN t.role = '{SYSTEM}' THEN '<|system|>' || chr(10) WHEN t.role = s.perspective THEN '<|assistant|>' || chr(10)
                  ELSE '<|user ' || t.role || '|>' || chr(10) END AS head,
             text || '{END}' AS body,
             row_number() OVER (PARTITION BY t.conv_id, s.perspective, block ORDER BY turn NULLS FIRST, t.role, text) AS rn
      FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, block ORDER BY rn
                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS a FROM p)
SELECT conv_id, perspective, block, count(*) AS n_turns, string_agg(head || body || chr(10), '' ORDER BY rn) AS rendered,
       coalesce(string_agg(CAST(a AS BIGINT) || ':' || CAST(a + length(body) AS BIGINT), ',' ORDER BY rn) FILTER (own), '') AS masks
FROM o GROUP BY conv_id, perspective, block
"""
