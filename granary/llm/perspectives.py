"""Chat formatting by perspective rotation: each participant's view of a dialogue of any number of parties.

For every participant of a conversation (a role but ``system``), the dialogue is rendered with that speaker as assistant, all others as
users under their names, and system turns as such.  The mask has the characters that the assistant is to learn: what the
speaker says and the marker that ends it.

    <|system|>\\nTEXT<|end|>\\n     <|user:NAME|>\\nTEXT<|end|>\\n     <|assistant|>\\nTEXT<|end|>\\n

A view is cut into parts of ``PART_TURNS`` turn numbers, each a row, so that no conversation, however long, is gathered in one task;
a view is its parts' texts end to end.  Participants meet parts in a join on conv_id that AQE splits.

A null role is the speaker ``unknown``, a null text is empty; rows with a null conv_id or turn have no place in a dialogue and are left out.
Equal rows count once; different rows of one turn are ordered by role and text.  ``<|`` in texts and names becomes ``< |``, and in names ``|>``
becomes ``| >`` and a line break a space, so that no text and no name is taken for a marker.  A conversation of system turns alone has no
participant and so no view; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART_TURNS, SYSTEM, UNKNOWN = 256, "system", "unknown"
END = "<|end|>\n"


def _safe(column) -> F.Column:
    return F.replace(column, F.lit("<|"), F.lit("< |"))


def _name(column) -> F.Column:
    return F.replace(F.replace(_safe(column), F.lit("|>"), F.lit("| >")), F.lit("\n"), F.lit(" "))


def views(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row per conversation, participant and part: conv_id, perspective, part, n_turns, text, mask (array of start, end in characters of the part)."""
    turns = conversations.filter("conv_id is not null and turn is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _name(
            F.coalesce("role", F.lit(UNKNOWN))
        ).alias("role"), _safe(F.coalesce("text", F.lit(""))).alias("text")
    ).distinct()
    parts = turns.groupBy("conv_id", F.floor(F.col("turn") / part_turns).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns")
    )
    speakers = turns.filter(F.col("role") != SYSTEM).select(F.col("conv_id").alias("g_conv"), F.col("role").alias("perspective")).distinct()
    both = parts.join(speakers, F.col("conv_id") == F.col("g_conv")).drop("g_conv")

    def said(x) -> F.Column:
        own = x["role"] == F.col("perspective")
        head = F.when(own, F.lit("<|assistant|>\n")).when(x["role"] == SYSTEM, F.lit("<|system|>\n")).otherwise(
            F.concat(F.lit("<|user:"), x["role"], F.lit("|>\n"))
        )
        return F.struct(own.alias("own"), head.alias("head"), F.concat(x["text"], F.lit(END)).alias("body"))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def grow(a, x) -> F.Column:
        start = (a["at"] + F.length(x["head"])).cast("long")
        end = (start + F.length(x["body"])).cast("long")
        return F.struct(
            end.alias("at"),
            F.when(x["own"], F.array_append(a["spans"], F.struct(start.alias("start"), end.alias("end")))).otherwise(a["spans"]).alias("spans")
        )

    said_all = both.withColumn("g_said", F.transform("turns", said))
    return said_all.select(
        "conv_id", "perspective", "part", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("g_said", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
        F.aggregate("g_said", none, grow, lambda a: a["spans"]).alias("mask")
    )


def with_mask_text(found: DataFrame) -> DataFrame:
    """The mask as text: start-end of each span, joined by commas."""
    return found.withColumn("mask", F.array_join(F.transform("mask", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ","))


SQL = f"""
WITH t AS (SELECT DISTINCT conv_id, turn, replace(replace(replace(coalesce(role, '{UNKNOWN}'), '<|', '< |'), '|>', '| >'), chr(10), ' ') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
           FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> '{SYSTEM}'),
s AS (SELECT t.conv_id, perspective, (turn - (turn % {PART_TURNS} + {PART_TURNS}) % {PART_TURNS}) // {PART_TURNS} AS part, turn, role, text, role = perspective AS own,
             CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = '{SYSTEM}' THEN '<|system|>' ELSE '<|user:' || role || '|>' END || chr(10) AS head, text || '<|end|>' || chr(10) AS body
      FROM t JOIN p ON t.conv_id = p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, part ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM s)
SELECT conv_id, perspective, part, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn, role, text) AS text,
       coalesce(string_agg((stop - length(body))::VARCHAR || '-' || stop::VARCHAR, ',' ORDER BY turn, role, text) FILTER (WHERE own), '') AS mask
FROM o GROUP BY conv_id, perspective, part
"""
