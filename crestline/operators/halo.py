"""Series grids in cells: no window spans a series.

A series of bins is cut into cells of equal numbers of bins. A moving frame needs rows on both sides of an edge, so bins
within its reach of an edge are copied to the neighbouring cell as ghosts: they are seen there and dropped afterwards.
Every window is then partitioned by (key, cell) and a task's work is bounded by the cell, however long a series is.
Figures of a whole series (its peak, its ends) are aggregates combined before they move, joined back to the bins.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins per cell.
CELL = 4096
_CELL, _OWN = "_cell", "_own"


def cell_of(at: Column, cell: int | None = None) -> Column:
    return F.floor(at / (cell or CELL))


class Cells:
    """Dense bins (see :func:`dense`) with ghosts: ``back`` bins before and ``ahead`` bins after each cell."""

    def __init__(self, grid: DataFrame, key: str, back: int, ahead: int, cell: int | None = None):
        first, last = cell_of(F.col("bin") - ahead, cell), cell_of(F.col("bin") + back, cell)
        own = cell_of(F.col("bin"), cell)
        self.columns = grid.columns
        self.rows = grid.withColumn(_CELL, F.explode(F.sequence(first, last))).withColumn(_OWN, F.col(_CELL) == own)
        self.window = Window.partitionBy(key, _CELL).orderBy("bin")

    def add(self, **columns: Column) -> DataFrame:
        """The grid with new columns, made by expressions over :attr:`window`; ghosts are gone."""
        return self.rows.withColumns(columns).where(_OWN).select(*self.columns, *columns)


def with_totals(df: DataFrame, key: str, **aggregates: Column) -> DataFrame:
    """``df`` with aggregates of its whole key. Null is a key like any other."""
    totals = df.groupBy(F.col(key).alias("_of")).agg(*[a.alias(n) for n, a in aggregates.items()])
    return df.join(totals, F.col(key).eqNullSafe(F.col("_of"))).drop("_of")


def dense(frames_: DataFrame, key: str, values: list[str], cell: int | None = None) -> DataFrame:
    """One row per bin from 0 (or the first bin, if that is negative) to the last bin of each key; missing bins are 0.

    Each cell of a series gets a marker at its first bin; frames and markers of a cell write the empty bins up to the next
    one. Only the ends of each series are needed to place the markers.
    """
    size = cell or CELL
    own = cell_of(F.col("bin"), cell)
    ends = frames_.groupBy(key).agg(F.least(F.min("bin"), F.lit(0)).alias("_low"), F.max("bin").alias("_high"))
    cells = F.explode(F.sequence(cell_of(F.col("_low"), cell), cell_of(F.col("_high"), cell)))
    marks = ends.select(key, "_low", "_high", cells.alias(_CELL)).select(
        key, _CELL, F.greatest(F.col(_CELL) * size, "_low").alias("bin"), F.least((F.col(_CELL) + 1) * size - 1, "_high").alias("_stop"),
        *[F.lit(None).cast(frames_.schema[v].dataType).alias(v) for v in values], F.lit(0).alias("_real"))
    rows = frames_.select(key, own.alias(_CELL), "bin", F.lit(None).cast("long").alias("_stop"), *values, F.lit(1).alias("_real")).unionByName(marks)
    group = Window.partitionBy(key, _CELL)
    upto = F.coalesce(F.lead("bin").over(group.orderBy("bin", "_real")) - 1, F.max("_stop").over(group))
    spread = rows.withColumn("_upto", upto).where("_upto >= bin").withColumn("_own_bin", F.col("bin")).withColumn(
        "bin", F.explode(F.sequence("bin", "_upto")))
    here = (F.col("bin") == F.col("_own_bin")) & (F.col("_real") == 1)
    return spread.select(key, "bin", *[F.when(here, F.col(v)).otherwise(0).cast("double").alias(v) for v in values])
