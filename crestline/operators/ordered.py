"""Order-dependent operators inside a key: neighbours, prefixes, as-of lookups, changes."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranged import Ranged, running

#: Two-level scan over as many range partitions as the session's shuffles have; ``parts=None`` is a plain window, for input
#: whose rows per key are bounded by its making (windows, bins and boundaries of a series).
AUTO = 0


def _plain(keys: list[str], order: list[Column]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def neighbours(df: DataFrame, keys: list[str], order: list[str], back: dict[str, str] = {},
               ahead: dict[str, str] = {}, parts: int | None = AUTO) -> DataFrame:
    """Values of the previous and the next row of the key; both maps give new names to columns.

    ``order`` must be unique inside a key.
    """
    sides = []
    for values, near, pick, name in ((back, F.lag, F.max_by, "_back"), (ahead, F.lead, F.min_by, "_ahead")):
        if values:
            packed = F.struct(*[F.col(c).alias(n) for n, c in values.items()])
            sides.append((values, packed, near, pick, name))
    if parts is None:
        w = _plain(keys, [F.col(c) for c in order])
        out = df.select("*", *[near(packed).over(w).alias(name) for _, packed, near, _, name in sides])
        return out.select(*df.columns, *[F.col(f"{name}.{n}").alias(n) for values, _, _, _, name in sides for n in values])
    dealt = Ranged(df, keys, order, parts or None)
    out = dealt.rows.select("*", *[near(packed).over(dealt.window()).alias(name) for _, packed, near, _, name in sides])
    out = dealt.carry([pick(packed, F.struct(*order)).alias(f"{name}_of") for _, packed, _, pick, name in sides],
                      [near(f"{name}_of").over(dealt.across()).alias(f"{name}_far") for _, _, near, _, name in sides], out)
    found = [F.when(F.col(name).isNotNull(), F.col(f"{name}.{n}")).otherwise(F.col(f"{name}_far.{n}")).alias(n)
             for values, _, _, _, name in sides for n in values]
    return out.select(*df.columns, *found)


def neighbour(df: DataFrame, keys: list[str], order: list[str], values: dict[str, str],
              ahead: bool = False, parts: int | None = AUTO) -> DataFrame:
    """Values of the previous row, or of the next one."""
    return neighbours(df, keys, order, {} if ahead else values, values if ahead else {}, parts)


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str,
               inclusive: bool = False, parts: int | None = AUTO) -> DataFrame:
    """Sum of ``value`` over all earlier rows of the key (0 for the first row)."""
    if parts is None:
        frame = _plain(keys, [F.col(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        return df.select("*", F.coalesce(F.sum(value).over(frame), F.lit(0)).alias(name))
    out = running(df, keys, order, {name: (F.sum, value)}, inclusive, parts or None)
    return out.withColumn(name, F.coalesce(name, F.lit(0)))


def ordinal(df: DataFrame, keys: list[str], order: list[str], name: str, parts: int | None = AUTO) -> DataFrame:
    """1-based position of every row inside its key."""
    return prefix_sum(df, keys, order, F.lit(1).cast("long"), name, inclusive=True, parts=parts)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], t: str, at: str,
          earlier: str | None = None, later: str | None = None, parts: int | None = AUTO) -> DataFrame:
    """Nearest right time at or before (``earlier``) and at or after (``later``) each left row.

    Right times become the stretches between them, each with both its ends. Left rows and stretches are merged in one
    order, sorted once, and a row takes the last stretch that has begun; that of a range partition is carried over its
    edge, so no array of times and no range join is needed.
    """
    columns, lowest = left.columns, F.lit(float("-inf"))
    marks = right.select(*keys, F.col(at).cast("double").alias("_t")).where("_t IS NOT NULL").distinct()
    between = neighbours(marks, keys, ["_t"], {"_was": "_t"}, {"_then": "_t"}, parts)
    stretch = lambda start, low, high: F.struct(start.alias("from"), low.alias("low"), high.alias("high"))
    head = F.when(F.col("_was").isNull(), stretch(lowest, F.lit(None).cast("double"), F.col("_t")))
    r = between.select(*keys, F.explode(F.array_compact(F.array(stretch(F.col("_t"), F.col("_t"), F.col("_then")), head))).alias("_in"))
    r = r.withColumn("_t", F.col("_in.from")).withColumn("_is", F.lit(0))
    l = left.withColumn("_t", F.coalesce(F.col(t).cast("double"), lowest)).withColumn("_is", F.lit(1))
    both = l.unionByName(r, allowMissingColumns=True)
    frame = (Window.unboundedPreceding, Window.currentRow)
    dealt = None if parts is None else Ranged(both, keys, ["_t"], parts or None)
    order = _plain(keys, [F.col("_t")]) if dealt is None else dealt.window()
    out = both if dealt is None else dealt.rows
    out = out.withColumn("_found", F.last("_in", ignorenulls=True).over(order.rangeBetween(*frame))).where("_is = 1")
    if dealt is not None:
        out = dealt.carry([F.max("_in").alias("_hi")], [F.max("_hi").over(dealt.before()).alias("_prev")], out)
        out = out.withColumn("_found", F.coalesce("_found", "_prev"))
    low, high = F.col("_found.low"), F.col("_found.high")
    found = []
    if earlier:
        found.append(low.alias(earlier))
    if later:
        found.append(F.when(low == F.col("_t"), low).otherwise(high).alias(later))
    return out.select(*columns, *found)


def nearest(left: DataFrame, right: DataFrame, keys: list[str], t: str, at: str, name: str,
            parts: int | None = AUTO) -> DataFrame:
    """Closest right time of the key; of two equally close ones the earlier. NULL without any."""
    both = as_of(left, right, keys, t, at, "_early", "_late", parts=parts)
    closer_late = F.col("_early").isNull() | (F.col("_late") - F.col(t) < F.col(t) - F.col("_early"))
    pick = F.when(F.col("_late").isNotNull() & closer_late, F.col("_late")).otherwise(F.col("_early"))
    return both.select(*left.columns, pick.alias(name))


def first_inside(windows: DataFrame, bounds: DataFrame, keys: list[str], at: str, name: str,
                 eps: float = 1e-6, parts: int | None = AUTO) -> DataFrame:
    """First boundary strictly inside ``(start+eps, end-eps)``: the first one after the start,
    if it comes before the end. No range join is needed."""
    shifted = windows.withColumn("_from", F.col("start").cast("double") + eps)
    found = as_of(shifted, bounds, keys, "_from", at, later="_hit", parts=parts)
    inside = F.when(F.col("_hit") < F.col("end") - eps, F.col("_hit"))
    return found.select(*windows.columns, inside.alias(name))


def span_bounds(spans: DataFrame, bounds: DataFrame, keys: list[str], ident: list[str], at: str, inside: str = "bound",
                closest: str = "nearest", count: str = "n_bounds", eps: float = 1e-6, parts: int | None = AUTO) -> DataFrame:
    """Per span, unique by ``keys`` and ``ident``: the first boundary inside ``[start+eps, end-eps)``, the closest one to its
    center (of two equally close ones the earlier), and how many boundaries its key has; NULL, NULL and 0 without any.

    A span is two probes, one at its start and one at its center. Probes and boundaries are merged in one order and passed
    once; no row ever holds the boundaries of a key.
    """
    center = (F.col("start") + F.col("end")) / 2.0
    probe = lambda t, side: F.struct(t.cast("double").alias("at"), F.lit(side).alias("side"))
    probes = spans.select(*keys, *ident, "end", F.explode(F.array(probe(F.col("start") + eps, 0), probe(center, 1))).alias("_probe"))
    probes = probes.select(*keys, *ident, "end", F.col("_probe.at").alias("_at"), F.col("_probe.side").alias("_side"))
    found = as_of(probes, bounds, keys, "_at", at, "_early", "_late", parts)
    later = F.col("_early").isNull() | (F.col("_late") - F.col("_at") < F.col("_at") - F.col("_early"))
    first = F.when((F.col("_side") == 0) & (F.col("_late") < F.col("end") - eps), F.col("_late"))
    near = F.when(F.col("_side") == 1, F.when(F.col("_late").isNotNull() & later, F.col("_late")).otherwise(F.col("_early")))
    both = found.groupBy(*keys, *ident).agg(F.max(first).alias(inside), F.max(near).alias(closest))
    counts = bounds.where(F.col(at).isNotNull()).select(*keys, at).distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias(count))
    counts = counts.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return both.join(counts, match, "left").select(*keys, *ident, inside, closest, F.coalesce(count, F.lit(0)).alias(count))


def state_changes(df: DataFrame, keys: list[str], order: list[str], state: Column, width: float,
                  name: str = "bound", parts: int | None = AUTO) -> DataFrame:
    """Times where a boolean state flips (it starts as false), plus a closing time ``width``
    after the last row of a key that ends in the true state."""
    t = order[0]
    marked = df.withColumn("_state", state).withColumn("_one", F.lit(True))
    near = neighbours(marked, keys, order, {"_was": "_state"}, {"_more": "_one"}, parts)
    flip = F.when(F.col("_state") != F.coalesce(F.col("_was"), F.lit(False)), F.col(t))
    close = F.when(F.col("_more").isNull() & F.col("_state"), F.col(t) + width)
    return near.select(*keys, F.explode(F.array_compact(F.array(flip, close))).alias(name))


def segments(df: DataFrame, keys: list[str], order: list[str], longest: float, shortest: float,
             duration: str, parts: int | None = AUTO) -> DataFrame:
    """From each point to the next one, at most ``longest`` and at least ``shortest`` long."""
    t = order[0]
    ahead = neighbour(df, keys, order, {"_next": t}, ahead=True, parts=parts)
    limit = F.col(t) + longest
    end = F.least(F.coalesce(F.col("_next"), limit), limit, F.col(duration))
    return ahead.select(*df.columns, F.greatest(end, F.col(t) + shortest).alias("end"))


def pieces(points: DataFrame, spans: DataFrame, keys: list[str], t: str, duration: str,
           shortest: float, parts: int | None = AUTO) -> DataFrame:
    """Pieces between consecutive points, both ends of the span included; short ones dropped."""
    ends = [spans.select(*keys, F.lit(0.0).alias("start")),
            spans.select(*keys, F.col(duration).cast("double").alias("start"))]
    marks = reduce(DataFrame.unionByName, [points.select(*keys, F.col(t).cast("double").alias("start")), *ends]).distinct()
    cut = neighbour(marks, keys, ["start"], {"end": "start"}, ahead=True, parts=parts)
    return cut.where(F.col("end") - F.col("start") >= shortest)


def delta_encode(notes: DataFrame, keys: list[str], start: str, length: str, ident: str,
                 parts: int | None = AUTO) -> DataFrame:
    """Intervals to on/off rows with the distance to the previous row; off sorts before on."""
    sides = F.array(
        F.struct(F.greatest(F.lit(0).cast("long"), F.col(start)).alias("tick"), F.lit(1).alias("kind")),
        F.struct((F.greatest(F.lit(0).cast("long"), F.col(start))
                  + F.greatest(F.lit(1).cast("long"), F.col(length))).alias("tick"), F.lit(0).alias("kind")),
    )
    rows = notes.select(*keys, F.col(ident), F.explode(sides).alias("_side")).select(
        *keys, ident, F.col("_side.tick").alias("tick"), F.col("_side.kind").alias("kind"))
    back = neighbour(rows, keys, ["tick", "kind", ident], {"_was": "tick"}, parts=parts)
    return back.select(*keys, ident, "tick", "kind",
                       (F.col("tick") - F.coalesce(F.col("_was"), F.lit(0))).alias("delta"))


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """First ``k`` rows per key. Spark cuts each map task to ``k`` rows per key before the
    shuffle (WindowGroupLimit), so a large key costs one task only ``k`` rows per map task."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(name) <= k)


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_per(df, keys, order, 1, "_rank").drop("_rank")


def newest_per(df: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Row with the greatest version per key, as an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*version))
    return df.groupBy(*keys).agg(best.alias("_row")).select(*keys, "_row.*").select(*df.columns)
