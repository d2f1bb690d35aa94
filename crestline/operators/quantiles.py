"""Exact quantiles by counting, without a buffer of a key's values."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import AUTO, prefix_sum

#: Equal cells between the least and the greatest value of a key.
CELLS = 4_096


def _with(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with a table of one row per key; null is a key like any other."""
    renamed = other.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return df.join(renamed, match, how).drop(*[f"_of_{k}" for k in keys])


def _cell(cells: int) -> Column:
    """Cell of a value, rising with it; values at infinity have cells of their own, outside of the others."""
    value, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    width = high / cells - low / cells
    inner = F.when(width > 0, F.floor(F.least(F.lit(cells - 1.0), (value - low) / width))).otherwise(F.lit(0))
    return F.when(value == float("-inf"), -1).when(value == float("inf"), cells).otherwise(inner).cast("int")


def quantile(df: DataFrame, keys: list[str], value: str, q: float, cells: int = CELLS, parts: int | None = AUTO) -> DataFrame:
    """The ``q`` quantile of ``value`` per key as column ``quantile``, between the two nearest ranks, exactly.

    NULL and NaN values don't count; a key without any other value has no row. Three aggregates with map-side combine: the
    range of a key, how many of its values fall into each of ``cells`` cells of that range, and how often each value of the
    one or two cells occurs that hold the wanted ranks. Running counts over these values, in two levels over range
    partitions, tell the value of a rank, so even a key whose values all fall into one cell needs no large task: a buffer
    holds at most ``cells + 2`` numbers of a key. ``df`` is read once for each aggregate.
    """
    if not 0 <= q <= 1:
        raise ValueError(f"a quantile lies between 0 and 1, not at {q}")
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    # 0.0 and -0.0 are one value
    rows = rows.withColumn("_v", F.when(F.col("_v") == 0, F.lit(0.0)).otherwise(F.col("_v")))
    finite = F.when(F.abs("_v") < float("inf"), F.col("_v"))
    ranges = rows.groupBy(*keys).agg(F.min(finite).alias("_low"), F.max(finite).alias("_high"), F.count(F.lit(1)).alias("_n"))
    place = q * (F.col("_n") - 1)
    ranges = ranges.withColumns({"_from": F.floor(place), "_to": F.ceil(place), "_part": place - F.floor(place)})
    celled = _with(rows, ranges.select(*keys, "_low", "_high"), keys).withColumn("_cell", _cell(cells)).select(*keys, "_v", "_cell")
    counted = celled.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_in"))
    reached = prefix_sum(counted, keys, ["_cell"], F.col("_in"), "_before", parts=None)
    holds = lambda rank: (F.col(rank) >= F.col("_before")) & (F.col(rank) < F.col("_before") + F.col("_in"))
    wanted = _with(reached, ranges.select(*keys, "_from", "_to"), keys).where(holds("_from") | holds("_to"))
    wanted = wanted.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_cell").alias("_of_cell"), F.col("_before").alias("_below"))
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_cell") == F.col("_of_cell"))
    values = celled.join(wanted, match).groupBy(*keys, "_cell", "_v").agg(F.count(F.lit(1)).alias("_in"), F.min("_below").alias("_below"))
    ranked = prefix_sum(values, [*keys, "_cell"], ["_v"], F.col("_in"), "_here", parts=parts)
    ranked = _with(ranked.withColumn("_before", F.col("_below") + F.col("_here")), ranges.select(*keys, "_from", "_to", "_part"), keys)
    ends = ranked.groupBy(*keys).agg(F.max(F.when(holds("_from"), F.col("_v"))).alias("_a"), F.max(F.when(holds("_to"), F.col("_v"))).alias("_b"),
                                     F.first("_part").alias("_part"))
    between = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise((1 - F.col("_part")) * F.col("_a") + F.col("_part") * F.col("_b"))
    return ends.select(*keys, between.alias("quantile"))
