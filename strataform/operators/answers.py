"""Replies of a model as a table: shapes by question, retries, salvage, and vocabulary proposals.

Replies are rows (id, question, attempt, reply, capped); the model itself is outside. `capped` marks a
reply that ran to its token limit, which is no answer even if it parses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions import text as X
from strataform.functions.config import Refusal

#: The fields that replies may have.
FIELDS = "verdict string, label string, rationale string, name string, reason string, choice string, relation string, length_m string, what string, objects array<string>, distractors array<string>"
#: The answers that each question with a closed set allows.
CLOSED = {"verify": ("verdict", ("CONFIRM", "REJECT", "RELABEL")), "support": ("verdict", ("CONFIRM", "REJECT")), "choose": ("choice", ("A", "B", "C", "D")), "kind": ("relation", ("specific", "part_or_whole", "other"))}
_STRINGS = r'^\[(?:"(?:[^"\\]|\\.)*"(?:,(?=")|(?=\])))*\]$'


def _blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _fault(question: Column, a: Column, body: Column) -> Column:
    """Why a parsed reply does not answer its question; null where it does."""
    out = F.when(a.isNull(), F.lit("no JSON object"))
    for q, (field, allowed) in CLOSED.items():
        out = out.when((question == q) & ~F.coalesce(a[field].isin(*allowed), F.lit(False)), F.concat(F.lit(f"{field} is "), F.coalesce(a[field], F.lit("missing"))))
    out = out.when((question == "verify") & (a["verdict"] == "RELABEL") & _blank(a["label"]), F.lit("RELABEL without a label"))
    out = out.when((question == "name") & _blank(a["name"]), F.lit("no name"))
    length = a["length_m"].try_cast("double")
    out = out.when((question == "length") & ~F.coalesce((length > 0) & ~F.isnan(length), F.lit(False)), F.lit("length_m is not a positive number"))
    for k in ("objects", "distractors"):
        out = out.when((question == "vocabulary") & ~F.coalesce(F.get_json_object(body, f"$.{k}").rlike(_STRINGS), F.lit(False)), F.lit(f"{k} is not a list of strings"))
    return out.when((question == "vocabulary") & (F.size(a["objects"]) == 0), F.lit("no objects proposed"))


def checked(replies: DataFrame) -> DataFrame:
    """Each reply with its parsed fields (`answer`) and why it is no answer (`fault`, null for an answer)."""
    rows = replies.withColumn("body", X.json_body(F.col("reply")))
    rows = rows.withColumn("answer", F.from_json("body", f"{FIELDS}, _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    rows = rows.withColumn("answer", F.when(F.col("answer._bad").isNull() & F.col("body").isNotNull(), F.col("answer").dropFields("_bad")))
    fault = F.when(F.col("capped"), F.lit("ran to the token limit")).otherwise(_fault(F.col("question"), F.col("answer"), F.col("body")))
    shaped = F.when(F.col("question").isin("name", "choose"), F.col("answer").withField("name", X.phrase(F.col("answer.name"))).withField("label", X.phrase(F.col("answer.label")))).otherwise(F.col("answer"))
    return rows.withColumn("fault", fault).withColumn("answer", shaped).drop("body")


def settled(replies: DataFrame) -> DataFrame:
    """(id, question, attempt, answer, fault, salvaged): the first attempt that answers, else a null answer and the last fault.

    A vocabulary whose last attempt ran to the limit keeps the entries that it had closed.
    """
    rows = checked(replies)
    good = F.col("fault").isNull()
    last = F.struct("attempt", "fault", "reply", "capped")
    each = rows.groupBy("id", "question").agg(F.min(F.when(good, F.struct("attempt", "answer"))).alias("first"), F.max_by(last, "attempt").alias("last"))
    objects, distractors = (X.complete_strings(F.col("last.reply"), k) for k in ("objects", "distractors"))
    kept = F.col("first").isNull() & (F.col("question") == "vocabulary") & F.col("last.capped") & (F.size(objects) > 0)
    fields = [f.strip().split(" ") for f in FIELDS.split(",")]
    salvage = F.struct(*(({"objects": objects, "distractors": distractors}.get(n) if n in ("objects", "distractors") else F.lit(None).cast(t)).alias(n) for n, t in fields))
    return each.select("id", "question", F.coalesce("first.attempt", "last.attempt").alias("attempt"), F.coalesce("first.answer", F.when(kept, salvage)).alias("answer"), F.when(F.col("first").isNull() & ~kept, F.col("last.fault")).alias("fault"), kept.alias("salvaged"))


def proposal(replies: DataFrame) -> tuple[DataFrame, int]:
    """(term, views) over the views whose vocabulary question was answered, and how many were not.

    One view that cannot be read costs that view; none that can be read is a refusal.
    """
    views = settled(replies.filter("question = 'vocabulary'"))
    n, failed = views.agg(F.count("*"), F.count_if(F.col("answer").isNull())).first()
    if n == failed:
        raise Refusal(f"no view gave a vocabulary that can be read ({n} asked)", gate="vocabulary")
    return X.vocabulary(views.filter("answer is not null").select(F.col("id").alias("view"), F.explode("answer.objects").alias("term"))), failed
