"""Greedy folds over ordered points.

Both folds keep one anchor point per key. Given the anchor on entry, the points of one part decide
the anchor on exit, so a part is a function from entry to exit anchor. Keys small enough for one
task are replayed directly. A key of more rows is cut into parts of equal width and folded in three
steps, each spread over tasks: the functions of its parts, their composition in groups of ``FANOUT``
parts, and a replay of each part from its entry anchor. A part can only be entered with an anchor
that lies less than ``gap`` before it; every other entry acts like a fresh start. Parts are at
least ``gap`` wide, so such an anchor is in the part before.

Inside a task, rows are handled a batch at a time as arrays. Each point as an anchor has one successor, the point that
takes over from it: a bisection finds the first point far enough away, a table of maxima the first stronger one. The
anchors that a walk visits, and the one it ends with, follow from successors of successors, doubled until the batch ends
(logarithmically many steps for all rows together). Only the open anchors are kept from batch to batch.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranged import PART, persisted

#: Rows of a key up to which it is one part.
MAX_ROWS = 1_000_000
AUTO = 0
CUT = "_cut"
FRESH = -1
FANOUT = 64
_TABLE = ["_key", "_part", "first", "last", "entry", "t", "s", "exit"]
_TABLE_TYPES = "_key string, _part long, first long, last long, entry long, t double, s double, exit long"
_WALK = ["_key", "first", "entry", "t", "s", "taken"]
_WALK_TYPES = "_key string, first long, entry long, t double, s double, taken boolean"
_FAR = float("-inf")


def _runs(pdf: pd.DataFrame) -> np.ndarray:
    """Edges of the (key, part) groups of a sorted batch."""
    key, part = pdf["_key"].to_numpy(), pdf[PART].to_numpy()
    new = (key[1:] != key[:-1]) | (part[1:] != part[:-1])
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(pdf)]])


class _Points:
    """Points of a batch in order, and who takes over from an anchor among them."""

    def __init__(self, t: np.ndarray, s: np.ndarray, gap: float, stronger: bool):
        self.t, self.n, self.gap = t, len(t), gap
        # strengths: maximum of the 1, 2, 4, ... points from each point on
        self.tops = [np.where(np.isnan(s), _FAR, s)] if stronger else []
        while self.tops and 1 << len(self.tops) <= self.n:
            reach, wide = 1 << (len(self.tops) - 1), self.tops[-1].copy()
            np.maximum(wide[:-reach], self.tops[-1][reach:], out=wide[:-reach])
            self.tops.append(wide)

    def successor(self, t: np.ndarray, s: np.ndarray, low: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place from ``low`` on, before ``end``, of the point that takes over from each anchor (t, s); ``n`` if none does."""
        low, high = np.minimum(low, end), end.copy()
        first = low.copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            far = open_ & (self.t[np.minimum(middle, self.n - 1)] - t >= self.gap)
            high = np.where(far, middle, high)
            low = np.where(open_ & ~far, middle + 1, low)
        found = high
        if self.tops:
            s, at = np.where(np.isnan(s), _FAR, s), first
            for k in reversed(range(len(self.tops))):
                weaker = (at < self.n) & (self.tops[k][np.minimum(at, self.n - 1)] <= s)
                at = np.where(weaker, np.minimum(at + (1 << k), self.n), at)
            found = np.minimum(found, at)
        return np.where(found < end, found, self.n)

    def steps(self, s: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Successor of every point, up to the end of its group; ``n`` follows itself."""
        return np.append(self.successor(self.t, s, np.arange(1, self.n + 1), end), self.n)

    def visited(self, steps: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """All places on the ways from the starts, in order."""
        places = more = starts[starts < self.n]
        while len(more):
            more = steps[places]
            more = more[more < self.n]
            places, steps = np.concatenate([places, more]), steps[steps]
        return np.sort(places)

    def last(self, steps: np.ndarray) -> np.ndarray:
        """Last place on the way from every place."""
        at = np.where(steps < self.n, steps, np.arange(self.n + 1))
        while not np.array_equal(at, further := at[at]):
            at = further
        return at


def _transfer(gap: float, stronger: bool):
    """Exit anchor of a part for each entry anchor. Entries that reach the same anchor are one from there on."""
    def run(frames):
        group, given, now, slot = None, [], None, None  # open part, its entries, their anchors (id, t, s), and which entry has which

        def closed() -> pd.DataFrame:
            ident, t, s = (np.concatenate(column) for column in zip(*given))
            return pd.DataFrame({"_key": [group[0]] * len(ident), "_part": group[1], "first": group[1], "last": group[1],
                                 "entry": ident, "t": t, "s": s, "exit": now[0][slot]}, columns=_TABLE)

        for pdf in frames:
            edges = _runs(pdf)
            for start, stop in zip(edges[:-1].tolist(), edges[1:].tolist()):
                rows = pdf.iloc[start:stop]
                key = (rows["_key"].iloc[0], int(rows[PART].iloc[0]))
                if key != group:
                    if group is not None:
                        yield closed()
                    fresh = (np.array([FRESH]), np.array([_FAR]), np.array([_FAR]))
                    group, given, now, slot = key, [fresh], fresh, np.zeros(1, np.int64)
                side = rows["_side"].to_numpy()
                ident, t, s = (rows[c].to_numpy() for c in ("_id", "_t", "_s"))
                if (side == 0).any():
                    entries = tuple(c[side == 0] for c in (ident, t, s))
                    given.append(entries)
                    slot = np.concatenate([slot, len(now[0]) + np.arange(len(entries[0]))])
                    now = tuple(np.concatenate(both) for both in zip(now, entries))
                ident, t, s = (c[side == 1] for c in (ident, t, s))
                if not len(t):
                    continue
                points, n = _Points(t, s, gap, stronger), len(t)
                taken = points.successor(now[1], now[2], np.zeros(len(now[0]), np.int64), np.full(len(now[0]), n))
                ends = points.last(points.steps(s, np.full(n, n)))[taken]
                moved = ends < n
                now = tuple(np.where(moved, new[np.minimum(ends, n - 1)], old) for old, new in zip(now, (ident, t, s)))
                _, one, of = np.unique(now[0], return_index=True, return_inverse=True)
                now, slot = tuple(c[one] for c in now), of[slot]
        if group is not None:
            yield closed()
    return run


def _functions(pdf: pd.DataFrame):
    for first, rows in pdf.groupby("first", sort=True):
        given = {e: (t, s) for e, t, s in zip(rows["entry"].tolist(), rows["t"].tolist(), rows["s"].tolist())}
        yield int(first), int(rows["last"].iloc[0]), dict(zip(rows["entry"].tolist(), rows["exit"].tolist())), given


def _compose(pdf: pd.DataFrame) -> pd.DataFrame:
    """One function for a whole group of parts, from the entries of its first part."""
    result, begin, end, start = None, None, None, None
    for first, last, function, given in _functions(pdf):
        if result is None:
            result, begin, start = function, first, given
        else:
            adjacent = first == end + 1
            result = {e: function.get(x, function[FRESH]) if adjacent else function[FRESH] for e, x in result.items()}
        end = last
    rows = [(pdf["_key"].iloc[0], int(pdf["_group"].iloc[0]), begin, end, e, *start[e], x) for e, x in result.items()]
    return pd.DataFrame(rows, columns=_TABLE)


def _walk(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry anchor of each part in turn, from the entry anchor of the group, and whether the part
    after it takes its exit anchor over."""
    seed = pdf[pdf["is_seed"]]
    anchor = int(seed["entry"].iloc[0]) if len(seed) else FRESH
    after = bool(seed["taken"].iloc[0]) if len(seed) else False
    end, out = None, []
    for first, last, function, given in _functions(pdf[~pdf["is_seed"]]):
        if end is not None and first != end + 1:
            anchor = FRESH
        entry = anchor if anchor in function else FRESH
        if out:
            out[-1][-1] = entry != FRESH
        out.append([pdf["_key"].iloc[0], first, entry, *given[entry], after])
        anchor, end = function[entry], last
    return pd.DataFrame(out, columns=_WALK)


def _parts(points: DataFrame, gap: float, max_rows: int) -> DataFrame:
    """Part number and end of every point, and whether its key has several parts. Nothing is counted while the plan is
    built: sizes and ranges of the keys are an aggregate that is joined, and split by the engine where a key is hot."""
    sizes = points.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"), F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    width = F.greatest((F.col("_high") - F.col("_low")) / F.ceil(F.col("_n") / max_rows), F.lit(float(gap)), F.lit(1e-9))
    sized = sizes.select(F.col("_key").alias("_k"), "_low", width.alias("_width"), (F.col("_n") > max_rows).alias(CUT))
    part = F.when(F.col(CUT), F.floor((F.col("_t") - F.col("_low")) / F.col("_width"))).otherwise(0).cast("long")
    out = points.join(sized, F.col("_key").eqNullSafe(F.col("_k"))).withColumn(PART, part)
    return out.withColumn("_end", F.col("_low") + (F.col(PART) + 1) * F.col("_width")).drop("_k", "_low", "_width")


def _seeds(points: DataFrame, gap: float, stronger: bool) -> DataFrame:
    """One row in front of every part of a cut key: its entry anchor, and whether its exit anchor
    is taken over. The table of functions is read several times and therefore persisted. Only
    entries that the part before can end with are kept; they are far fewer than its points."""
    own = F.struct(F.col(PART).alias("part"), F.lit(1).alias("side"))
    tail = F.when(F.col("_end") - F.col("_t") < gap, F.struct((F.col(PART) + 1).alias("part"), F.lit(0).alias("side")))
    rows = points.where(CUT).select("_key", "_t", "_id", "_s", F.explode(F.array_compact(F.array(own, tail))).alias("_p"))
    table = persisted(
        rows.select("_key", F.col("_p.part").alias(PART), F.col("_p.side").alias("_side"), "_t", "_id", "_s")
        .repartition("_key", PART).sortWithinPartitions("_key", PART, "_side", "_t", "_id")
        .mapInPandas(_transfer(gap, stronger), _TABLE_TYPES))
    reached = table.select("_key", (F.col(PART) + 1).alias(PART), F.col("exit").alias("entry")).distinct()
    useful = table.where(F.col("entry") == FRESH).unionByName(table.join(reached, ["_key", PART, "entry"], "left_semi"))
    grouped = useful.withColumn("_group", F.floor(F.col(PART) / FANOUT))
    plain = [F.lit(False).alias("is_seed"), F.lit(False).alias("taken")]
    tops = grouped.groupBy("_key", "_group").applyInPandas(_compose, _TABLE_TYPES)
    entries = tops.select("*", *plain).groupBy("_key").applyInPandas(_walk, _WALK_TYPES)
    blank = F.lit(None).cast("long")
    group_seeds = entries.select("_key", blank.alias("_part"), "first", "first", "entry", "t", "s", blank.alias("exit"),
                                 F.floor(F.col("first") / FANOUT).alias("_group"), F.lit(True).alias("is_seed"), "taken")
    group_seeds = group_seeds.toDF(*_TABLE, "_group", "is_seed", "taken")
    walked = grouped.select("*", *plain).unionByName(group_seeds).groupBy("_key", "_group").applyInPandas(_walk, _WALK_TYPES)
    return walked.select("_key", F.col("first").alias(PART), F.lit(0).alias("_side"), F.col("t").alias("_t"),
                         F.col("entry").alias("_id"), F.col("s").alias("_s"), "taken")


def _replay(gap: float, stronger: bool):
    """Walk every part from its anchor. A thinned point is emitted when it is kept, a merged one
    when the next anchor opens or the part ends with it and no later part takes it over."""
    columns = ["_key", "_t", "_id", "_s"]

    def run(frames):
        current, anchor, taken = None, None, False  # open group, its anchor (t, id, s), and whether a later part takes that over
        for pdf in frames:
            if not len(pdf):
                continue
            edges = _runs(pdf)
            key, part, side, flag = (pdf[c].to_numpy() for c in ("_key", PART, "_side", "taken"))
            values = [pdf[c].to_numpy() for c in ("_t", "_id", "_s")]
            k = len(edges) - 1
            goes_on = current is not None and (key[0], part[0]) == current
            if stronger and anchor and not taken and not goes_on:
                yield pd.DataFrame([(current[0], *anchor)], columns=columns)
            # anchor of every group: its seed, or what the batch before left open
            heads = edges[:-1]
            seeded = side[heads] == 0
            has = seeded & (values[1][heads] != FRESH)
            later = seeded & flag[heads].astype(bool)
            held = [v[heads].copy() for v in values]
            if goes_on and not seeded[0]:
                has[0], later[0] = anchor is not None, taken
                for column, value in zip(held, anchor or ()):
                    column[0] = value
            # points only; groups are stretches of them
            own = side == 1
            bounds = np.concatenate([[0], np.cumsum(own)])[edges]
            t, ident, s = (v[own] for v in values)
            n = len(t)
            group = np.repeat(np.arange(k), np.diff(bounds))
            if n:
                points = _Points(t, s, gap, stronger)
                taking = points.successor(held[0], held[2], bounds[:-1], bounds[1:])
                starts = np.where(has, taking, np.where(bounds[:-1] < bounds[1:], bounds[:-1], n))
                places = points.visited(points.steps(s, bounds[1:][group]), starts)
            else:
                places = np.zeros(0, np.int64)
            # the anchors of all groups in order, those they began with first
            began = np.flatnonzero(has)
            of = np.concatenate([began, group[places]])
            order = np.argsort(of, kind="stable")
            of = of[order]
            walk = [np.concatenate([h[began], v[places]])[order] for h, v in zip(held, (t, ident, s))]
            new = np.concatenate([np.zeros(len(began), bool), np.ones(len(places), bool)])[order]
            ends = np.append(of[1:] != of[:-1], True) if len(of) else np.zeros(0, bool)
            if stronger:
                opens = np.append(walk[0][1:] - walk[0][:-1] >= gap, False) if len(of) else ends
                out = np.where(ends, (of < k - 1) & ~later[of], opens)
            else:
                out = new
            if out.any():
                yield pd.DataFrame({"_key": key[heads][of[out]], "_t": walk[0][out], "_id": walk[1][out], "_s": walk[2][out]})
            current, taken = (key[-1], part[-1]), bool(later[-1])
            anchor = tuple(c[-1].item() for c in walk) if len(of) and of[-1] == k - 1 else None
        if stronger and anchor and not taken:
            yield pd.DataFrame([(current[0], *anchor)], columns=columns)
    return run


def _fold(df: DataFrame, key: str, t: str, ident: str, strength: str | None, gap: float,
          max_rows: int | None) -> DataFrame:
    stronger = strength is not None
    points = df.select(
        F.col(key).cast("string").alias("_key"), F.col(t).cast("double").alias("_t"), F.col(ident).cast("long").alias("_id"),
        (F.col(strength).cast("double") if stronger else F.lit(0.0)).alias("_s"))
    points = points.where(F.col("_t").isNotNull() & ~F.isnan("_t") & F.col("_id").isNotNull())
    points = points.withColumn(PART, F.lit(0).cast("long")) if max_rows is None else _parts(points, gap, max_rows or MAX_ROWS)
    rows = points.select("_key", PART, F.lit(1).alias("_side"), "_t", "_id", "_s", F.lit(False).alias("taken"))
    if max_rows is not None:
        rows = rows.unionByName(_seeds(points, gap, stronger))
    return (
        rows.repartition("_key", PART).sortWithinPartitions("_key", PART, "_side", "_t", "_id")
        .mapInPandas(_replay(gap, stronger), "_key string, _t double, _id long, _s double"))


def thin(df: DataFrame, key: str, t: str, ident: str, gap: float, max_rows: int | None = AUTO) -> DataFrame:
    """Keep a point when it lies at least ``gap`` after the last kept one; the first is kept.

    ``ident`` is a unique non-negative number that also breaks ties of ``t``. Rows without a time or number are left out.
    """
    kept = _fold(df, key, t, ident, None, gap, max_rows)
    return kept.select(F.col("_key").cast(df.schema[key].dataType).alias(key),
                       F.col("_t").alias(t), F.col("_id").alias(ident))


def merge_stronger(df: DataFrame, key: str, t: str, ident: str, strength: str, gap: float,
                   max_rows: int | None = AUTO) -> DataFrame:
    """Merge points closer than ``gap`` to the current one; a stronger point takes its place.

    Rows without a time or number are left out; a point without a strength is weaker than all others.
    """
    kept = _fold(df, key, t, ident, strength, gap, max_rows)
    return kept.select(F.col("_key").cast(df.schema[key].dataType).alias(key), F.col("_t").alias(t),
                       F.col("_id").alias(ident), F.col("_s").alias(strength))


def with_span_end(kept: DataFrame, spans: DataFrame, key: str, t: str, duration: str, gap: float) -> DataFrame:
    """Add the end of the span when it lies more than ``gap`` after the last kept point."""
    last = kept.groupBy(key).agg(F.max(t).alias("_last"))
    tail = spans.join(last, key, "left").where(
        F.col("_last").isNull() | (F.col(duration) - F.col("_last") > gap))
    return kept.select(key, t).unionByName(tail.select(key, F.col(duration).cast("double").alias(t)))


def absorb_short(bounds: DataFrame, key: str, t: str, shortest: float) -> DataFrame:
    """Absorb the shortest segment into its larger neighbour (the left one of equals) while one
    is shorter than ``shortest`` and more than two remain. Input: the few boundaries of ``novelty_bounds``,
    at most nine per key, so an array of them is always small."""
    def without_shortest(marks: Column, _: Column) -> Column:
        sizes = F.transform(F.slice(marks, 2, F.size(marks) - 1), lambda end, i: end - F.get(marks, i))
        least = F.array_min(sizes)
        place = (F.array_position(sizes, least) - 1).cast("int")
        to_right = (place == 0) | F.coalesce(F.get(sizes, place + 1) > F.get(sizes, place - 1), F.lit(False))
        gone = F.when((F.size(marks) > 3) & (least < shortest), place + to_right.cast("int")).otherwise(-1)
        return F.filter(marks, lambda _, i: i != gone)

    marks = F.array_sort(F.collect_list(F.col(t).cast("double")))
    each = bounds.groupBy(key).agg(marks.alias("_marks"))
    left = F.aggregate("_marks", F.col("_marks"), without_shortest)
    return each.select(key, F.explode(left).alias(t))
