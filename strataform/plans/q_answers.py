"""Queries on a model's replies: shapes, retries, salvage and proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataform.operators import answers as M
from strataform.plans import bindings as B
from strataform.plans.bindings import with_
from strataform.plans.query import query

QUESTIONS = ("verify", "name", "choose", "kind", "support", "vocabulary", "length")
_GOOD = {
    "verify": '{"verdict": "RELABEL", "label": "@"}',
    "name": '<think>x</think>{"name": " The  @ "}',
    "choose": '```json {"choice": "B", "label": "@"} ```',
    "kind": '{"relation": "part_or_whole"}',
    "support": '{"verdict": "CONFIRM"}',
    "vocabulary": '{"objects": ["@", "desk"], "distractors": []}',
    "length": '{"length_m": "1.5"}',
}
#: A reply of a wrong shape, and what is wrong with it.
_WRONG = {
    "verify": ('{"verdict": "RELABEL", "label": " "}', "RELABEL without a label"),
    "name": ('{"name": ""}', "no name"),
    "choose": ('{"choice": "E"}', "choice is E"),
    "kind": ('{"relationship": "other"}', "relation is missing"),
    "support": ('{"verdict": "RELABEL"}', "verdict is RELABEL"),
    "vocabulary": ('{"objects": ["@", 3], "distractors": []}', "objects is not a list of strings"),
    "length": ('{"length_m": "-2"}', "length_m is not a positive number"),
}
_CUT = '{"distractors": ["sofa"], "objects": ["@", "lamp", "brok'


def _pick(index, texts):
    return F.element_at(F.array(*map(F.lit, texts)), (index + 1).cast("int"))


def replies(s, d):
    """Three attempts at a question for each object; by object and attempt an answer, no JSON, a wrong shape, or a reply cut off."""
    a = B.answers(s, d).select(F.col("object_idx").alias("id"), "label").withColumn("attempt", F.explode(F.array(*map(F.lit, range(3)))))
    q, kind = F.col("id") % 7, (F.col("id") + F.col("attempt")) % 4
    reply = F.when(kind == 0, _pick(q, [_GOOD[x] for x in QUESTIONS])).when(kind == 1, "no braces").when(kind == 2, _pick(q, [_WRONG[x][0] for x in QUESTIONS])).otherwise(_CUT)
    return a.select("id", _pick(q, QUESTIONS).alias("question"), "attempt", F.replace(reply, F.lit("@"), F.col("label")).alias("reply"), (kind == 3).alias("capped"))


_Q = "[" + ", ".join(f"'{q}'" for q in QUESTIONS) + "][object_idx % 7 + 1]"
_FAULTS = "[" + ", ".join(f"'{_WRONG[q][1]}'" for q in QUESTIONS) + "][object_idx % 7 + 1]"


@query("G16_answer_shapes", with_(f"SELECT object_idx AS id, attempt, CASE (object_idx + attempt) % 4 WHEN 1 THEN 'no JSON object' WHEN 2 THEN {_FAULTS} WHEN 3 THEN 'ran to the token limit' END AS fault, CASE WHEN (object_idx + attempt) % 4 = 0 AND {_Q} = 'name' THEN 'the ' || label END AS name FROM answers, (SELECT CAST(unnest([0, 1, 2]) AS INT) AS attempt)", "answers"))
def g16(s, d):
    rows = M.checked(replies(s, d))
    return rows.select("id", "attempt", "fault", F.when(F.col("fault").isNull(), F.col("answer.name")).alias("name"))


@query("E05_answer_retries", with_(f"SELECT object_idx AS id, {_Q} AS question, CAST([0, 2, 2, 1][object_idx % 4 + 1] AS INT) AS attempt, CASE WHEN object_idx % 4 = 1 AND {_Q} <> 'vocabulary' THEN 'ran to the token limit' END AS fault, object_idx % 4 = 1 AND {_Q} = 'vocabulary' AS salvaged, object_idx % 4 = 1 AND {_Q} <> 'vocabulary' AS unanswered FROM answers", "answers"))
def e05(s, d):
    rows = M.settled(replies(s, d))
    return rows.select("id", "question", "attempt", "fault", "salvaged", F.col("answer").isNull().alias("unanswered"))


@query("G17_vocabulary_job", with_("+ v AS (SELECT object_idx, unnest([label, CASE WHEN object_idx % 4 = 1 THEN 'lamp' ELSE 'desk' END]) AS t FROM answers WHERE object_idx % 7 = 5), e AS (SELECT DISTINCT object_idx, t FROM v), m AS (SELECT DISTINCT object_idx, coalesce(b.t, e.t) AS term FROM e LEFT JOIN (SELECT DISTINCT t FROM e) b ON e.t = b.t || 's') SELECT term, count(*) AS n_views, 0 AS failed FROM m GROUP BY 1", "answers"))
def g17(s, d):
    terms, failed = M.proposal(replies(s, d))
    return terms.withColumn("failed", F.lit(failed))
