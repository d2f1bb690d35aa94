"""Greedy folds: known answers, and random series with whole and with cut keys."""
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from crestline.operators import folds as D

SCALE = 100


def thin_plain(points, gap):
    kept = []
    for t, i, _ in points:
        if not kept or t - kept[-1][0] >= gap:
            kept.append((t, i))
    return [i for _, i in kept]


def merge_plain(points, gap):
    out = []
    for t, i, s in points:
        if out and t - out[-1][0] < gap:
            if s > out[-1][2]:
                out[-1] = (t, i, s)
        else:
            out.append((t, i, s))
    return [i for _, i, _ in out]


def test_known_answers(spark):
    thin = spark.createDataFrame([("a", t, i) for i, t in enumerate([0.0, .1, .3, .5, .6, 1.0])], "k string, t double, id long")
    assert sorted(r.t for r in D.thin(thin, "k", "t", "id", 0.25).collect()) == [0.0, .3, .6, 1.0]
    rows = [("a", 0.0, 0, 1.0), ("a", .1, 1, 3.0), ("a", .25, 2, 2.0), ("a", .5, 3, 1.0)]
    merge = spark.createDataFrame(rows, "k string, t double, id long, s double")
    assert sorted((r.t, r.s) for r in D.merge_stronger(merge, "k", "t", "id", "s", 0.20).collect()) == [(.1, 3.0), (.5, 1.0)]


@pytest.mark.parametrize("limit,gap,span", [(None, 30, 4000), (1_000_000, 30, 4000), (40, 30, 4000), (25, 3, 30_000), (20, 200, 3000), (8, 5, 60_000), (30, 7, 700)])
def test_random_series(spark, limit, gap, span):
    rng = random.Random(limit or 0)
    series = {f"s{k}": sorted((rng.randrange(span), i + 1000 * k, rng.randrange(40)) for i in range(n)) for k, n in enumerate((700, 300, 3, 1))}
    rows = [(k, float(t), i, float(s)) for k, pts in series.items() for t, i, s in pts]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t double, id long, s double")
    kept = D.thin(df, "k", "t", "id", float(gap), limit).collect()
    merged = D.merge_stronger(df, "k", "t", "id", "s", float(gap), limit).collect()
    for k, pts in series.items():
        assert sorted(r.id for r in kept if r.k == k) == sorted(thin_plain(pts, gap))
        assert sorted(r.id for r in merged if r.k == k) == sorted(merge_plain(pts, gap))


def batches_of(points, rng):
    """Sorted rows of one or two keys, cut into batches of random length (empty ones as well)."""
    rows = [(k, p, 1, float(t), i, float(s), False) for k, pts in points for p, t, i, s in pts]
    pdf = pd.DataFrame(rows, columns=["_key", D.PART, "_side", "_t", "_id", "_s", "taken"])
    cuts = sorted(rng.randrange(len(pdf) + 1) for _ in range(rng.randrange(6)))
    return [pdf.iloc[a:b].reset_index(drop=True) for a, b in zip([0, *cuts], [*cuts, len(pdf)])]


@pytest.mark.parametrize("gap,span", [(0, 50), (1, 20), (7, 200), (60, 500), (10_000, 300)])
def test_batches_may_end_anywhere(gap, span):
    rng = random.Random(gap)
    for _ in range(150):
        series = [(k, sorted((rng.randrange(span), i + 100 * n, rng.choice([0, 1, 2, rng.randrange(9)])) for i in range(rng.randrange(1, 40)))) for n, k in enumerate("abc")]
        flat = [(k, [(0, *p) for p in pts]) for k, pts in series]
        for stronger, plain in ((False, thin_plain), (True, merge_plain)):
            out = [f for f in D._replay(float(gap), stronger)(iter(batches_of(flat, rng)))]
            got = pd.concat(out) if out else pd.DataFrame({"_key": [], "_id": []})
            for k, pts in series:
                assert sorted(got["_id"][got["_key"] == k]) == sorted(plain(pts, gap))


def test_exits_of_a_part_for_every_entry():
    """The end of a walk from each entry, also when the part comes in several batches."""
    rng = random.Random(8)
    for _ in range(150):
        gap = rng.choice([3, 10, 30])
        entries = sorted((100 - rng.randrange(gap), 900 + i, rng.randrange(9)) for i in range(rng.randrange(5)))
        pts = sorted((100 + rng.randrange(80), i, rng.randrange(9)) for i in range(rng.randrange(40)))
        for stronger in (False, True):
            rows = [("k", 4, side, float(t), i, float(s), False) for side, ps in ((0, entries), (1, pts)) for t, i, s in ps]
            if not rows:
                continue
            pdf = pd.DataFrame(rows, columns=["_key", D.PART, "_side", "_t", "_id", "_s", "taken"])
            cut = rng.randrange(len(pdf) + 1)
            frames = [f for f in (pdf.iloc[:cut], pdf.iloc[cut:]) if len(f)]
            table = pd.concat(list(D._transfer(float(gap), stronger)(iter(frames))))
            want = {}
            for entry in [None, *entries]:
                now = entry
                for p in pts:
                    if now is None or p[0] - now[0] >= gap or (stronger and p[2] > now[2]):
                        now = p
                want[entry[1] if entry else D.FRESH] = now[1] if now else D.FRESH
            assert dict(zip(table["entry"], table["exit"])) == want


def test_points_without_time_or_strength(spark):
    rows = [("a", None, 1, 9.0), ("a", 0.0, 2, None), ("a", 0.1, 3, 0.5), ("a", 5.0, None, 1.0), ("a", float("nan"), 5, 1.0), (None, 1.0, 4, None), (None, 1.1, 6, None)]
    df = spark.createDataFrame(rows, "k string, t double, id long, s double")
    for limit in (None, 0, 1):
        assert sorted(r.id for r in D.thin(df.where("k IS NOT NULL"), "k", "t", "id", 0.5, limit).collect()) == [2]
        assert sorted(r.id for r in D.merge_stronger(df.where("k IS NOT NULL"), "k", "t", "id", "s", 0.5, limit).collect()) == [3]
    assert sorted(r.id for r in D.merge_stronger(df, "k", "t", "id", "s", 0.5, None).collect()) == [3, 4]
    assert D.thin(df.limit(0), "k", "t", "id", 0.5).collect() == []


def test_a_long_series_in_one_part(spark):
    """Half a million points of one key without a step of Python for each."""
    df = spark.range(500_000).select(F.lit("a").alias("k"), (F.col("id") * 1.0).alias("t"), "id", (F.col("id") % 11).cast("double").alias("s"))
    assert D.thin(df, "k", "t", "id", 10.0).agg(F.count("*"), F.max("id")).first()[:] == (50_000, 499_990)


def test_end_of_span_closes_the_list(spark):
    kept = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 1.9)], "k string, t double")
    spans = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", 3.0)], "k string, d double")
    got = sorted((r.k, r.t) for r in D.with_span_end(kept, spans, "k", "t", "d", 0.25).collect())
    assert got == [("a", 0.0), ("a", 1.0), ("a", 2.0), ("b", 1.9), ("c", 3.0)]


def test_short_segments_are_absorbed(spark):
    rows = [("a", t) for t in (0.0, 2.0, 2.5, 6.0, 6.2, 9.0)] + [("b", t) for t in (0.0, 0.5, 1.0)]
    df = spark.createDataFrame(rows, "k string, t double")
    got = sorted((r.k, r.t) for r in D.absorb_short(df, "k", "t", 1.0).collect())
    # 6.0-6.2 is the shortest and joins 2.5-6.0, which is the larger one; then 2.0-2.5 joins 2.5-6.2.
    assert got == [("a", 0.0), ("a", 2.0), ("a", 6.2), ("a", 9.0), ("b", 0.0), ("b", 0.5), ("b", 1.0)]
