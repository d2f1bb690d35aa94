"""Ordered operators with and without cut keys against plain Python."""
import random

import pytest
from pyspark.sql import functions as F

from crestline.operators import ordered as O
from crestline.operators.ranged import PART, Ranged, release, running


def rows_of(seed, n=400, hot=250):
    rng = random.Random(seed)
    rows = [("hot" if i < hot else f"k{rng.randrange(6)}", rng.randrange(5000) / 10, i, rng.randrange(100)) for i in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def points(spark):
    rows = rows_of(3)
    return rows, spark.createDataFrame(rows, "k string, t double, id long, v long").cache()


#: Plain windows, and two-level scans over few and over very many range partitions.
LIMITS = [None, 0, 37]


@pytest.mark.parametrize("limit", LIMITS)
def test_neighbours(points, limit):
    rows, df = points
    got = {r.id: (r.was, r.next) for r in O.neighbours(df, ["k"], ["t", "id"], {"was": "v"}, {"next": "v"}, limit).collect()}
    want = {}
    for key in {r[0] for r in rows}:
        line = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(line):
            want[r[2]] = (line[i - 1][3] if i else None, line[i + 1][3] if i + 1 < len(line) else None)
    assert got == want


@pytest.mark.parametrize("limit", LIMITS)
def test_prefix_and_ordinal(points, limit):
    rows, df = points
    sums = {r.id: r.before for r in O.prefix_sum(df, ["k"], ["t", "id"], F.col("v"), "before", parts=limit).collect()}
    places = {r.id: r.at for r in O.ordinal(df, ["k"], ["t", "id"], "at", parts=limit).collect()}
    for key in {r[0] for r in rows}:
        total = 0
        for i, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))):
            assert sums[r[2]] == total and places[r[2]] == i + 1
            total += r[3]


@pytest.mark.parametrize("limit", LIMITS)
def test_as_of_and_nearest(spark, points, limit):
    rows, df = points
    rng = random.Random(9)
    marks = [("hot", rng.randrange(5000) / 10) for _ in range(15)] + [("k1", 17.0), ("k2", 480.0)]
    right = spark.createDataFrame(marks, "k string, at double")
    both = {r.id: (r.b, r.a) for r in O.as_of(df, right, ["k"], "t", "at", "b", "a", parts=limit).collect()}
    near = {r.id: r.near for r in O.nearest(df, right, ["k"], "t", "at", "near", parts=limit).collect()}
    for k, t, i, _ in rows:
        mine = [at for key, at in marks if key == k]
        before, after = [x for x in mine if x <= t], [x for x in mine if x >= t]
        assert both[i] == (max(before, default=None), min(after, default=None))
        assert near[i] == (min(mine, key=lambda x: (round(abs(x - t), 9), x)) if mine else None)


@pytest.mark.parametrize("limit", LIMITS)
def test_span_bounds(spark, limit):
    rng = random.Random(4)
    keys = ["hot"] * 5 + ["k1", "k2", "none", None]
    spans = [(rng.choice(keys), i, float(rng.randrange(400)), float(rng.randrange(1, 60))) for i in range(300)]
    marks = [(rng.choice(["hot", "hot", "k1", "k2", None]), float(rng.randrange(460))) for _ in range(90)] + [("k1", None), ("idle", 3.0)]
    df = spark.createDataFrame([(k, i, s, s + n) for k, i, s, n in spans], "k string, id long, start double, `end` double")
    got = O.span_bounds(df, spark.createDataFrame(marks, "k string, at double"), ["k"], ["id"], "at", parts=limit)
    assert "ArrayType" not in str(got.schema) and "collect_" not in got._jdf.queryExecution().executedPlan().toString()
    found = {r.id: (r.k, r.bound, r.nearest, r.n_bounds) for r in got.collect()}
    want = {}
    for k, i, start, n in spans:
        mine = sorted({at for key, at in marks if key == k and at is not None})
        center = start + n / 2
        want[i] = (k, next((x for x in mine if start < x < start + n), None), min(mine, key=lambda x: (abs(x - center), x), default=None), len(mine))
    assert found == want


def test_span_bounds_of_a_series_with_very_many(spark):
    """One series holds all boundaries; each range partition gets its share of the merged rows."""
    marks = spark.range(200_000).select(F.lit("s").alias("k"), (F.col("id") * 3.0).alias("at"))
    spans = spark.range(1_000).select(F.lit("s").alias("k"), F.col("id"), (F.col("id") * 600.0 + 1.0).alias("start"), (F.col("id") * 600.0 + 5.0).alias("end"))
    got = O.span_bounds(spans, marks, ["k"], ["id"], "at", parts=16)
    row = got.agg(F.count("*").alias("n"), F.sum((F.col("bound") == F.col("id") * 600 + 3).cast("int")).alias("inside"),
                  F.sum((F.col("nearest") == F.col("id") * 600 + 3).cast("int")).alias("near"), F.min("n_bounds").alias("of")).first()
    assert tuple(row) == (1_000, 1_000, 1_000, 200_000)


@pytest.mark.parametrize("limit", LIMITS)
def test_state_changes_close_an_open_state(spark, limit):
    rows = [("a", float(i), i in (2, 3, 7, 8, 9)) for i in range(10)] + [("b", 0.0, True), ("b", 1.0, False)]
    df = spark.createDataFrame(rows, "k string, t double, on boolean")
    got = sorted((r.k, r.bound) for r in O.state_changes(df, ["k"], ["t"], F.col("on"), 1.0, parts=limit).collect())
    assert got == [("a", 2.0), ("a", 4.0), ("a", 7.0), ("a", 10.0), ("b", 0.0), ("b", 1.0)]


def test_a_bursty_key_is_cut_by_rows(spark):
    """Half of all rows of one key lie in a millionth of its time: no partition holds more than twice its share."""
    rng = random.Random(5)
    rows = [("burst", 100 + rng.random() * 1e-4 if i % 2 else rng.random() * 1000, i) for i in range(20000)] + [(None, float(i), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, t double, id long").repartition(6)
    sizes = [r["count"] for r in Ranged(df, ["k"], ["t", "id"], 20).rows.groupBy(PART).count().collect()]
    assert len(sizes) >= 18 and max(sizes) <= 2 * len(rows) / 20
    assert release() > 0


def test_running_folds_with_null_keys_and_values(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), rng.randrange(50), i, rng.choice([None, 3, 5, 9])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t long, id long, v long").repartition(4)
    folds = {"total": (F.sum, F.col("v")), "low": (F.min, F.col("v")), "high": (F.max, F.col("v")), "mix": (F.bit_xor, F.col("v"))}
    for inclusive in (False, True):
        got = {r.id: (r.total, r.low, r.high, r.mix) for r in running(df, ["k"], ["t", "id"], folds, inclusive, 9).collect()}
        for key in {r[0] for r in rows}:
            line = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2]))
            for i, r in enumerate(line):
                seen = [x[3] for x in line[:i + inclusive] if x[3] is not None]
                mix = 0
                for x in seen:
                    mix ^= x
                assert got[r[2]] == ((sum(seen), min(seen), max(seen), mix) if seen else (None,) * 4)


def test_latest_row_wins_whatever_the_order(spark):
    rows = [("a", 1, "old"), ("a", 3, "new"), ("a", 2, "mid"), ("b", 1, "only")]
    df = spark.createDataFrame(rows, "k string, version int, v string")
    assert {(r.k, r.v) for r in O.newest_per(df, ["k"], ["version"]).collect()} == {("a", "new"), ("b", "only")}


def test_segments_are_bounded(spark):
    df = spark.createDataFrame([("a", 0.0, 5.0), ("a", 0.01, 5.0), ("a", 4.0, 5.0)], "k string, t double, d double")
    got = sorted((r.t, round(r.end, 6)) for r in O.segments(df, ["k"], ["t"], 2.0, 0.05, "d", None).collect())
    assert got == [(0.0, 0.05), (0.01, 2.01), (4.0, 5.0)]


def test_delta_encoding_puts_off_before_on(spark):
    df = spark.createDataFrame([("a", 0, 10, 1), ("a", 10, 5, 2)], "k string, tick long, len long, id long")
    got = [(r.tick, r.kind, r.delta) for r in O.delta_encode(df, ["k"], "tick", "len", "id", None).orderBy("tick", "kind").collect()]
    assert got == [(0, 1, 0), (10, 0, 10), (10, 1, 0), (15, 0, 5)]
