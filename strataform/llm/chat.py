"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation (every role but `system`) the dialogue is rendered with
that speaker as the assistant and all others as named users; system turns stay system turns. The
mask holds the character spans that train: the assistant's contents with their end marks.

A conversation is cut into parts of `PART_TURNS` turn numbers, and every part is rendered for
every participant of the whole conversation, so no group grows with the longest conversation.
Texts are shuffled once, by conversation and part; who takes part is gathered from the role column.

Defined results
    null conversation id: the turn belongs to no conversation and is left out.
    null role or a role of white space only: a participant named `unknown`; white space in a name
    becomes `_`.
    null text: an empty content. Marks of the format inside a text are broken up.
    null turn: comes first, in part 0. Equal turns, and repeated rows: all kept, in order of role and text.
    only system turns: no participant, no row. Empty table: empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_TURNS = 256
START, END, SYSTEM = "<|im_start|>", "<|im_end|>\n", "system"


def _head(role: Column, speaker: Column) -> Column:
    who = F.when(role == SYSTEM, F.lit("system")).when(role == speaker, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(START), who, F.lit("\n"))


def rotate(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, part, speaker, n_turns, n_trained, rendered, spans (array of start and stop, in characters)."""
    name = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce("role", F.lit("")), r"\s+", " ")), " ", "_")
    rows = turns.filter("conv_id is not null").select(
        "conv_id",
        F.floor(F.coalesce("turn", F.lit(0)) / part_turns).cast("long").alias("part"),
        "turn",
        F.when(name == "", F.lit("unknown")).otherwise(name).alias("role"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|im_"), F.lit("<| im_")).alias("content"),
    )
    seen = rows.groupBy("conv_id", "part", "role").agg(F.count("*").alias("n"))
    speakers = seen.filter(F.col("role") != SYSTEM).groupBy("conv_id").agg(F.array_sort(F.collect_set("role")).alias("speakers"))
    parts = seen.select("conv_id", "part").distinct().join(speakers, "conv_id")
    grouped = rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(-(1 << 63))).alias("turn"), "role", "content"))).alias("turns"))
    each = grouped.join(parts, ["conv_id", "part"]).withColumn("speaker", F.explode("speakers"))

    speaker = F.col("speaker")
    messages = F.transform("turns", lambda t: F.struct(_head(t.role, speaker).alias("head"), t.content.alias("content"), (t.role == speaker).alias("trained")))
    each = each.select("conv_id", "part", "speaker", messages.alias("messages"))
    rendered = F.array_join(F.transform("messages", lambda m: F.concat(m.head, m.content, F.lit(END))), "")

    def step(state, m):
        start = state.at + F.length(m.head)
        stop = start + F.length(m.content) + len(END)
        return F.struct(stop.alias("at"), F.when(m.trained, F.array_append(state.spans, F.struct(start.alias("start"), stop.alias("stop")))).otherwise(state.spans).alias("spans"))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans"))
    spans = F.aggregate("messages", zero, step, lambda state: state.spans)
    return each.select(
        "conv_id",
        "part",
        "speaker",
        F.size("messages").cast("long").alias("n_turns"),
        F.size(F.filter("messages", lambda m: m.trained)).cast("long").alias("n_trained"),
        rendered.alias("rendered"),
        spans.alias("spans"),
    )


def span_text(spans) -> Column:
    """Spans as text: start-stop, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat(s.start.cast("string"), F.lit("-"), s.stop.cast("string"))), ",")


#: The query's SQL twin: conversations of the test tables have no blank roles or null turns.
SQL = f"""
WITH t AS (
  SELECT conv_id, CAST(floor(coalesce(turn, 0) / {PART_TURNS}.0) AS BIGINT) AS part, turn, role,
         replace(coalesce(text, ''), '<|im_', '<| im_') AS content
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> '{SYSTEM}'),
m AS (
  SELECT t.conv_id, t.part, s.speaker, t.turn, t.role, t.content, t.role = s.speaker AS trained,
         '{START}' || CASE WHEN t.role = '{SYSTEM}' THEN 'system' WHEN t.role = s.speaker THEN 'assistant'
           ELSE 'user name=' || t.role END || chr(10) AS head
  FROM t JOIN s ON t.conv_id = s.conv_id),
l AS (
  SELECT *, CAST(sum(length(head) + length(content) + {len(END)}) OVER (
    PARTITION BY conv_id, part, speaker ORDER BY turn, role, content ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop FROM m)
SELECT conv_id, part, speaker, count(*) AS n_turns, count(*) FILTER (WHERE trained) AS n_trained,
       string_agg(head || content || '{END.strip()}' || chr(10), '' ORDER BY turn, role, content) AS rendered,
       coalesce(string_agg(CAST(stop - length(content) - {len(END)} AS VARCHAR) || '-' || CAST(stop AS VARCHAR), ','
         ORDER BY turn, role, content) FILTER (WHERE trained), '') AS spans
FROM l GROUP BY conv_id, part, speaker
"""
