"""Two-level scans over range partitions, for order-dependent work inside keys of any size.

Rows are dealt by ranges of (key, order), so that the cuts fall between rows and not between equal widths: however many
rows one key holds and however they bunch, every partition gets about as many. A partition is scanned on its own; what
must cross its edges is one summary row per key and partition, of which only keys that reach over an edge are wanted:
at most one per partition. Their prefix is brought back to the rows by a broadcast of that bounded table.

The cuts are drawn when the rows are first dealt. Both levels must see the same ones, so the dealt rows are persisted on
disk: lazily, without a job while a query is built, and without a second shuffle. A lost executor's part is dealt again
by the same partitioner, hence with the same cuts. :func:`release` frees what the session has persisted this way; a
query built before that (or before ``spark.catalog.clearCache``) must be built anew. Callers that write tables anyway
pass ``keep``, which stores the dealt rows and returns them.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART = "_part"
_KEPT: list[DataFrame] = []


def release() -> int:
    """Free the dealt rows of all queries built so far, and tell how many there were."""
    kept, _KEPT[:] = list(_KEPT), []
    for rows in kept:
        rows.unpersist()
    return len(kept)


def persisted(rows: DataFrame) -> DataFrame:
    """Keep dealt rows on the executors' disks until :func:`release`."""
    rows = rows.persist(StorageLevel.DISK_ONLY)
    _KEPT.append(rows)
    return rows


def _same(left: str, right: str) -> Column:
    return F.col(left).eqNullSafe(F.col(right))


class Ranged:
    """Rows dealt by ranges of ``keys`` and ``order``; ``rows`` has the partition number in ``PART``.

    Keys may be null: null is a key like any other. Rows that agree in key and order stay in one partition.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], parts: int | None = None,
                 keep: Callable[[DataFrame], DataFrame] = persisted):
        self.keys, self.order, self.columns = list(keys), list(order), df.columns
        by = [F.col(c) for c in [*keys, *order]]
        dealt = df.repartitionByRange(parts, *by) if parts else df.repartitionByRange(*by)
        self.rows = keep(dealt.withColumn(PART, F.spark_partition_id()))

    def window(self, descending: bool = False) -> Window:
        """Rows of a key inside one partition, in order."""
        by = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.keys, PART).orderBy(*by)

    def crossing(self) -> DataFrame:
        """Keys (``_k0``, ``_k1``, ...) that hold rows on both sides of an edge: at most one per partition."""
        key = F.struct(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(self.keys)])
        edges = self.rows.groupBy(PART).agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
        after = edges.withColumn("_then", F.lead("_first").over(Window.orderBy(PART)))
        return after.where(F.col("_last").eqNullSafe(F.col("_then"))).select("_last.*").distinct()

    def summaries(self, aggregates: list[Column]) -> DataFrame:
        """One row of ``aggregates`` per partition of every crossing key, combined before it moves."""
        few = F.broadcast(self.crossing())
        on = None
        for i, k in enumerate(self.keys):
            match = _same(k, f"_k{i}")
            on = match if on is None else on & match
        names = [f"_k{i}" for i in range(len(self.keys))]
        return self.rows.join(few, on, "inner").groupBy(*names, F.col(PART).alias("_p")).agg(*aggregates)

    def carry(self, aggregates: list[Column], carried: list[Column], rows: DataFrame | None = None) -> DataFrame:
        """``rows`` (those dealt, by default) with ``carried`` columns over the summaries; null where nothing crosses.

        ``carried`` are window expressions over :meth:`before`, :meth:`after` and :meth:`across`. The joined table has at most two
        rows per partition, so it may be broadcast.
        """
        names = [f"_k{i}" for i in range(len(self.keys))]
        few = F.broadcast(self.summaries(aggregates).select(*names, "_p", *carried))
        on = _same(PART, "_p")
        for i, k in enumerate(self.keys):
            on = on & _same(k, f"_k{i}")
        return (self.rows if rows is None else rows).join(few, on, "left").drop(*names, "_p")

    def across(self) -> Window:
        """Partitions of the same key in order, for lag and lead: each of them has rows of it."""
        return Window.partitionBy(*[f"_k{i}" for i in range(len(self.keys))]).orderBy("_p")

    def before(self) -> Window:
        """Earlier partitions of the same key."""
        return self.across().rowsBetween(Window.unboundedPreceding, -1)

    def after(self) -> Window:
        """Later partitions of the same key, nearest first."""
        keys = [f"_k{i}" for i in range(len(self.keys))]
        return Window.partitionBy(*keys).orderBy(F.col("_p").desc()).rowsBetween(Window.unboundedPreceding, -1)


#: How two partial results become one, for the aggregates that :func:`running` takes.
PAIRS: dict[Callable[[Column], Column], Callable[[Column, Column], Column]] = {
    F.sum: lambda a, b: a + b,
    F.bit_xor: lambda a, b: a.bitwiseXOR(b),
    F.min: F.least,
    F.max: F.greatest,
}


def joined(fold: Callable[[Column], Column], earlier: Column, later: Column) -> Column:
    """Partial results of two neighbouring stretches as one; null is an empty stretch."""
    return F.when(earlier.isNull(), later).when(later.isNull(), earlier).otherwise(PAIRS[fold](earlier, later))


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[Callable[[Column], Column], Column]],
            inclusive: bool = False, parts: int | None = None, keep: Callable[[DataFrame], DataFrame] = persisted) -> DataFrame:
    """``df`` with an aggregate over all earlier rows of the key per name in ``values``: {name: (aggregate, value)}.

    The aggregate is one of ``PAIRS``, which give their own kind of value in any order. The first row of a key has null,
    unless ``inclusive``. ``order`` must be unique inside a key.
    """
    dealt = Ranged(df, keys, order, parts, keep)
    frame = dealt.window().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = dealt.rows.select("*", *[fold(value).over(frame).alias(f"_in_{n}") for n, (fold, value) in values.items()])
    rows = dealt.carry([fold(value).alias(f"_of_{n}") for n, (fold, value) in values.items()],
                       [fold(F.col(f"_of_{n}")).over(dealt.before()).alias(f"_up_{n}") for n, (fold, _) in values.items()], rows)
    return rows.select(*dealt.columns, *[joined(fold, F.col(f"_up_{n}"), F.col(f"_in_{n}")).alias(n) for n, (fold, _) in values.items()])
