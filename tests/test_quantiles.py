"""Quantiles by counting against NumPy."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators.quantiles import quantile


def values_of(rng, kind):
    n = rng.randrange(1, 60)
    if kind == "ties":
        return [float(rng.randrange(4)) for _ in range(n)]
    if kind == "outlier":  # nearly all values in one cell
        return [rng.random() for _ in range(n)] + [1e300]
    if kind == "huge":
        return [rng.choice([-1.7e308, 1.7e308, 0.0, -0.0, 5e-324]) for _ in range(n)]
    if kind == "one":
        return [7.25] * n
    return [rng.gauss(0, 50) for _ in range(n)]


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_matches_numpy(spark, q):
    rng = random.Random(int(q * 100))
    lists = {kind: values_of(rng, kind) for kind in ("ties", "outlier", "huge", "one", "even")}
    lists[None] = values_of(rng, "even")
    rows = [(k, v) for k, vs in lists.items() for v in vs] + [("even", None), ("even", math.nan), ("empty", None), ("empty", math.nan)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v double")
    for cells, parts in ((4096, 0), (3, 5), (1, None)):
        got = {r.k: r.quantile for r in quantile(df, ["k"], "v", q, cells, parts).collect()}
        assert got.keys() == lists.keys()
        for k, vs in lists.items():
            place, ranked = q * (len(vs) - 1), sorted(vs)
            a, b, part = ranked[math.floor(place)], ranked[math.ceil(place)], place - math.floor(place)
            assert got[k] == pytest.approx(a if a == b else (1 - part) * a + part * b, rel=1e-12)


def test_infinite_values_and_empty_tables(spark):
    inf = math.inf
    df = spark.createDataFrame([("a", v) for v in (-inf, -inf, 1.0, 2.0, inf)] + [("b", inf)], "k string, v double")
    assert {r.k: r.quantile for r in quantile(df, ["k"], "v", 0.5).collect()} == {"a": 1.0, "b": inf}
    assert {r.k: r.quantile for r in quantile(df, ["k"], "v", 0.0).collect()} == {"a": -inf, "b": inf}
    assert quantile(df.limit(0), ["k"], "v", 0.5).collect() == []
    with pytest.raises(ValueError):
        quantile(df, ["k"], "v", 1.5)


def test_one_key_with_distinct_values_in_one_cell(spark):
    """An outlier puts half a million distinct values into one cell; no aggregate holds them as a list."""
    df = spark.range(500_001).select(F.lit("s").alias("k"), F.col("id").cast("double").alias("v")).unionAll(spark.sql("SELECT 's', 1e300"))
    got = quantile(df, ["k"], "v", 0.5, parts=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_" not in plan
    assert got.first()["quantile"] == np.percentile(np.r_[np.arange(500_001.0), 1e300], 50)
