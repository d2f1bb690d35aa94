"""Grids in cells: the same results for every cell size, bounded tasks for one long series."""
import pytest
from pyspark.sql import functions as F

from check import compare
from crestline.operators import frames as FR
from crestline.operators import halo

QUERIES = ["moving_avg", "peaks", "periodicity", "smoothness", "decay", "trim_edges", "edge_fades", "percentile_ratio", "snap_zero",
           "master_mix", "window_features", "memorability", "structure_bounds"]


@pytest.mark.parametrize("cell", [5, 64])
@pytest.mark.parametrize("name", QUERIES)
def test_cells_change_nothing(spark, duck, sf, name, cell, monkeypatch):
    monkeypatch.setattr(halo, "CELL", cell)
    assert compare(spark, duck, sf, name).startswith("ok")


@pytest.mark.parametrize("cell", [1, 3, 7, 1000])
def test_dense_grid(spark, cell):
    rows = [("a", 0, 1.0), ("a", 3, 2.0), ("a", 12, 3.0), ("b", 6, 4.0), ("n", -4, 5.0), ("n", 1, None), (None, 2, 6.0)]
    df = spark.createDataFrame(rows, "k string, bin long, v double")
    got = {(r.k, r.bin): r.v for r in halo.dense(df, "k", ["v"], cell).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        mine = {r[1]: r[2] for r in rows if r[0] == k}
        for b in range(min(0, *mine), max(mine) + 1):
            want[k, b] = mine.get(b, 0.0)
    assert got == want


def test_moving_average_by_brute_force(spark):
    values = [float((i * 7919) % 101) for i in range(200)]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(values)], "k string, bin long, v double")
    for reach in (1, 9):
        for cell in (4, 50):
            cells = halo.Cells(df, "k", reach, reach, cell)
            got = {r.bin: r.m for r in cells.add(m=F.avg("v").over(cells.window.rowsBetween(-reach, reach))).collect()}
            for i in range(200):
                near = values[max(0, i - reach):i + reach + 1]
                assert got[i] == pytest.approx(sum(near) / len(near))


def test_one_long_series_is_spread(spark):
    """Ten million bins of one series: no task of the moving average gets more than a few cells."""
    frames = spark.createDataFrame([("a", 0, 1.0), ("a", 9_999_999, 2.0)], "k string, bin long, v double")
    soft = FR.moving_average(FR.filled(frames, "k", ["v"]), "k", "v", 12, "m")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = soft.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r.n for r in parts) == 10_000_000 and len(parts) == 8 and max(r.n for r in parts) < 2 * 10_000_000 / 8
