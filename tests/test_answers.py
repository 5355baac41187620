"""Shapes of replies that the queries do not make, and refusals."""

import json

import pytest
from pyspark.sql import functions as F

from strataform.functions.config import Refusal
from strataform.operators import answers as M


def faults(spark, question, *objects):
    rows = [(k, question, 0, o if isinstance(o, str) or o is None else json.dumps(o), False) for k, o in enumerate(objects)]
    got = M.checked(spark.createDataFrame(rows, "id long, question string, attempt int, reply string, capped boolean"))
    return [r.fault is None for r in got.orderBy("id").collect()]


def test_shapes(spark):
    assert faults(spark, "verify", {"verdict": "CONFIRM"}, {"verdict": "RELABEL", "label": "x"}, {"verdict": "maybe"}, {}, None, "") == [True, True, False, False, False, False]
    assert faults(spark, "vocabulary", {"objects": ["a"], "distractors": ["b"]}, {"objects": [], "distractors": []}, {"objects": ["a"]}, {"objects": "a", "distractors": []}, {"objects": ["a", None], "distractors": []}, {"objects": ['say "hi"'], "distractors": []}) == [True, False, False, False, False, True]
    assert faults(spark, "length", {"length_m": 2}, {"length_m": "2.5"}, {"length_m": 0}, {"length_m": "far"}, {"length_m": "NaN"}) == [True, True, False, False, False]
    assert faults(spark, "kind", {"relation": "other"}, {"relation": "Other"}, "[1]", '{"relation": "other"') == [True, False, False, False]


def test_a_job_without_a_readable_view_is_refused(spark):
    schema = "id long, question string, attempt int, reply string, capped boolean"
    bad = spark.createDataFrame([(1, "vocabulary", 0, "x", False), (2, "vocabulary", 0, '{"objects": ["brok', True)], schema)
    with pytest.raises(Refusal):
        M.proposal(bad)
    cut = spark.createDataFrame([(2, "vocabulary", 0, '{"objects": ["a", "b", "brok', True), (1, "vocabulary", 0, "x", False)], schema)
    terms, failed = M.proposal(cut)
    assert failed == 1 and {r.term for r in terms.collect()} == {"a", "b"}
    row = M.settled(cut).filter("id = 2").select("salvaged", F.size("answer.distractors").alias("n")).first()
    assert row.salvaged and row.n == 0
