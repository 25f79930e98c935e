"""Perspective rotation: a dialogue is rendered once for every participant, who then is the assistant.

The other participants speak as named users; system turns stay system turns in every rendering. The mask lists the spans of
characters that the assistant of that rendering says, with the end marker that closes each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .support import read

# The markers of the rendered text.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
#: Turns of one block, at most: what a task renders at once. The rendered text does not depend on it.
BLOCK_TURNS = 1024


def escaped(text: Column) -> Column:
    """Text in which no marker can be read: "<|" before a marker's name gets a backslash, which also is doubled where one stands there already, so that nothing is lost."""
    return F.regexp_replace(text, r"<(\\*)\|(im_start|im_end)\|>", r"<\\$1|$2|>")


def rotated(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """Rows (conversation, perspective, n_turns, n_own_turns, text, mask, n_masked_chars), one for every participant of every conversation.

    Turns stand in the order of their numbers, ties by speaker and text, null numbers first. A null speaker is the
    participant "unknown"; a null text is empty. A turn without a conversation is a dialogue of its own. A conversation of
    system turns only has no participant and no row. Repeated turns are said twice. A marker within a text or a name is
    escaped, and a line break in a name is a blank, so that nothing that is said opens or closes a turn. mask has the spans
    start:end in characters, comma-joined. Turns of one number, or of none, are cut into blocks like any others.

    Blocks of turns are rendered in tasks of their own, and a perspective's row joins their texts, so a task holds one
    dialogue as one participant sees it, which is one value of the result and must fit the 2 GB of a Spark string.
    """
    said = turns.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("who"), escaped(F.coalesce(F.col(text), F.lit(""))).alias("said"))
    numbered = said.where("conv IS NOT NULL").withColumn("numbers", F.floor(F.col("turn") / BLOCK_TURNS))
    place = F.row_number().over(Window.partitionBy("conv", "numbers").orderBy("turn", "who", "said"))
    here = numbered.withColumn("piece", F.floor((place - 1) / BLOCK_TURNS))
    blocks = here.groupBy("conv", "numbers", "piece").agg(F.array_sort(F.collect_list(F.struct("turn", "who", "said"))).alias("turns")).select("conv", F.struct("numbers", "piece").alias("block"), "turns")
    people = here.where(F.col("who") != SYSTEM).select("conv", F.col("who").alias("perspective")).distinct()
    alone = said.where((F.col("conv").isNull()) & (F.col("who") != SYSTEM)).select("conv", F.col("who").alias("perspective"), F.array(F.struct("turn", "who", "said")).alias("turns"))
    parts = _rendered(blocks.join(people, "conv")).groupBy("conv", "perspective").agg(F.array_sort(F.collect_list(F.struct("block", "part"))).alias("parts"))
    whole = parts.select("conv", "perspective", F.expr("transform(parts, p -> p.part)").alias("parts"))
    single = _rendered(alone).select("conv", "perspective", F.array("part").alias("parts"))
    begins = "transform(sequence(0, size(parts) - 1), i -> aggregate(slice(parts, 1, i), 0L, (n, p) -> n + p.n_chars))"
    shifted = "flatten(zip_with(parts, begins, (p, b) -> transform(p.spans, s -> concat(b + s.begin, ':', b + s.end))))"
    total = lambda field: F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p[field])
    return whole.unionByName(single).withColumn("begins", F.expr(begins)).select(
        F.col("conv").alias(conversation), "perspective", total("n_turns").alias("n_turns"), total("n_own").alias("n_own_turns"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"), F.expr(f"array_join({shifted}, ',')").alias("mask"), total("n_masked").alias("n_masked_chars")
    )


def _rendered(rows: DataFrame) -> DataFrame:
    """rows (turns, perspective, more) with part: the text of the turns, its characters, the spans that the perspective says, and counts."""
    head = f"CASE WHEN t.who = '{SYSTEM}' THEN '{OPEN}system\\n' WHEN t.who = perspective THEN '{OPEN}assistant\\n' ELSE concat('{OPEN}user name=', t.name, '\\n') END"
    named = rows.withColumn("turns", F.transform("turns", lambda t: F.struct(t["who"].alias("who"), escaped(F.translate(t["who"], "\r\n", "  ")).alias("name"), t["said"].alias("said"))))
    cut = named.withColumn("turns", F.expr(f"transform(turns, t -> struct({head} AS head, t.said AS said, t.who = perspective AS own))"))
    # where each turn ends in the block: running sums of lengths, from one pass over the turns
    walk = f"""aggregate(turns, named_struct('at', 0L, 'spans', cast(array() AS array<struct<begin: bigint, end: bigint>>)), (s, t) -> named_struct(
        'at', s.at + length(t.head) + length(t.said) + {len(CLOSE) + 1},
        'spans', CASE WHEN t.own THEN concat(s.spans, array(struct(s.at + length(t.head) AS begin, s.at + length(t.head) + length(t.said) + {len(CLOSE)} AS end))) ELSE s.spans END))"""
    part = f"""named_struct('text', array_join(transform(turns, t -> concat(t.head, t.said, '{CLOSE}\\n')), ''), 'n_chars', walk.at, 'spans', walk.spans, 'n_turns', cast(size(turns) AS bigint),
        'n_own', cast(size(walk.spans) AS bigint), 'n_masked', aggregate(walk.spans, 0L, (n, s) -> n + s.end - s.begin))"""
    return cut.withColumn("walk", F.expr(walk)).withColumn("part", F.expr(part)).drop("turns", "walk")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotated(read(spark, sf_dir, "conversations"))


DUCK_ESCAPED = r"regexp_replace({0}, '<(\\*)\|(im_start|im_end)\|>', '<\\\1|\2|>', 'g')"
OP6_SQL = f"""
WITH said AS (SELECT conv_id, turn, role, {DUCK_ESCAPED.format('text')} AS text, {DUCK_ESCAPED.format("translate(role, chr(13) || chr(10), '  ')")} AS name FROM conversations),
people AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations WHERE role <> 'system'),
lines AS (
  SELECT p.conv_id, p.perspective, c.turn, c.role, c.text, c.role = p.perspective AS own,
         CASE WHEN c.role = 'system' THEN '{OPEN}system' WHEN c.role = p.perspective THEN '{OPEN}assistant' ELSE '{OPEN}user name=' || c.name END || chr(10) AS head
  FROM people p JOIN said c USING (conv_id)),
placed AS (
  SELECT *, sum(length(head) + length(text) + {len(CLOSE) + 1}) OVER (PARTITION BY conv_id, perspective ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) - length(text) - {len(CLOSE) + 1} AS start
  FROM lines)
SELECT conv_id, perspective, count(*) AS n_turns, count(*) FILTER (WHERE own) AS n_own_turns,
       string_agg(head || text || '{CLOSE}' || chr(10), '' ORDER BY turn, role, text) AS text,
       coalesce(string_agg(CASE WHEN own THEN CAST(start AS BIGINT) || ':' || CAST(start + length(text) + {len(CLOSE)} AS BIGINT) END, ',' ORDER BY turn, role, text), '') AS mask,
       CAST(coalesce(sum(length(text) + {len(CLOSE)}) FILTER (WHERE own), 0) AS BIGINT) AS n_masked_chars
FROM placed GROUP BY conv_id, perspective
"""
