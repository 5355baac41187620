"""Exact percentiles against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strataform.functions.quantiles import exact_percentiles


def interpolated(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    a, b, t = v[math.floor(at)], v[math.ceil(at)], at - math.floor(at)
    return a if a == b else (1 - t) * a + t * b


@pytest.mark.parametrize("bins", [2, 512])
def test_exact_percentiles(spark, bins):
    rng = random.Random(4)
    columns = {
        "even": [rng.uniform(-5, 5) for _ in range(3000)],
        "ties": [float(rng.choice([1, 1, 1, 2, 7])) for _ in range(3000)],
        "long_tail": [math.exp(rng.uniform(-30, 30)) for _ in range(3000)],
        "one": [3.5] * 3000,
    }
    rows = spark.createDataFrame([(*v, None) for v in zip(*columns.values(), strict=True)], ", ".join(f"{c} double" for c in columns) + ", none double").repartition(5)
    ps = (0.0, 0.01, 0.5, 0.95, 1.0)
    got = exact_percentiles(rows, {f"{c} {p}": (F.col(c), p) for c in (*columns, "none") for p in ps}, bins)
    assert got == {f"{c} {p}": interpolated(v, p) for c, v in columns.items() for p in ps} | {f"none {p}": None for p in ps}


def test_percentiles_of_odd_values(spark):
    assert exact_percentiles(spark.createDataFrame([], "v double"), {"a": (F.col("v"), 0.5)}) == {"a": None}
    with_null = spark.createDataFrame([(1.0,), (None,), (4.0,)], "v double")
    assert exact_percentiles(with_null, {"a": (F.col("v"), 0.5), "b": (-F.col("v"), 0.0)}) == {"a": 2.5, "b": -4.0}
    assert exact_percentiles(with_null, {}) == {}
    for odd in (math.inf, math.nan):
        with pytest.raises(ValueError):
            exact_percentiles(spark.createDataFrame([(1.0,), (odd,)], "v double"), {"a": (F.col("v"), 0.5)})
