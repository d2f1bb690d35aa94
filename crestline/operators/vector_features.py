"""Aggregates over frame vectors.

Per-dimension sums are plain aggregates (one per dimension), so vectors are never exploded and
each map task sends one row per series whatever the series' length.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.scalar import clamp, round_to
from ..session import checkpointed
from .ordered import AUTO, neighbour, ordinal, top_per

EPS = 1e-9


def _means(vec: str, dims: int, by=F.avg) -> Column:
    return F.array(*[by(F.col(vec)[i]) for i in range(dims)])


def mean_vectors(df: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    return df.groupBy(key).agg(_means(vec, dims).alias("mean"))


def peak_purity(df: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """Distance of the two largest entries of the mean vector, relative to the largest."""
    ordered = mean_vectors(df, key, vec, dims).withColumn("_o", F.sort_array("mean", asc=False))
    top, second = F.col("_o")[0], F.col("_o")[1]
    return ordered.select(key, clamp(F.try_divide(top - second, top + EPS), 0.0, 1.0).alias("purity"))


def stability(df: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """Mean cosine of the frames to their mean vector, mapped so that 0.4 off is 0.

    The mean of ``cos(m, f)`` equals the dot product of ``m/|m|`` with the mean of ``f/|f|``, so one
    aggregate is enough and the mean vector is not joined back to the frames.
    """
    unit = df.withColumn("_len", V.norm(F.col(vec))).withColumn(
        "_unit", F.transform(vec, lambda x: F.try_divide(x, F.col("_len"))))
    sums = unit.groupBy(key).agg(_means(vec, dims).alias("_m"), _means("_unit", dims).alias("_u"), F.min("_len").alias("_least"))
    length = V.norm(F.col("_m"))
    near = F.try_divide(V.dot(F.col("_m"), F.col("_u")), length)
    score = clamp(1.0 - (1.0 - near) / 0.4, 0.0, 1.0)
    silent = (length < EPS) | (F.col("_least") < EPS)
    return sums.select(key, F.when(silent, 0.0).otherwise(near).alias("cosine"),
                       F.when(silent, 0.0).otherwise(score).alias("stability"))


def timbre(df: DataFrame, key: str, vec: str, dims: int, full: float = 40.0) -> DataFrame:
    """Half: mean over dimensions of the deviation over time. Half: variation of the centroid."""
    centered = df.withColumn("_c", V.centroid(F.col(vec)))
    sums = centered.groupBy(key).agg(_means(vec, dims, F.stddev_pop).alias("_d"), F.avg("_c").alias("_cm"), F.stddev_pop("_c").alias("_cd"))
    spread = V.total(F.col("_d")) / dims
    varied = clamp(spread / full, 0.0, 1.0)
    moved = clamp(F.try_divide(F.col("_cd"), F.col("_cm")), 0.0, 1.0)
    score = F.when(F.col("_cm") < 1e-6, varied).otherwise(0.5 * varied + 0.5 * moved)
    return sums.select(key, spread.alias("spread"), F.col("_cm").alias("centroid"), score.alias("timbre"))


def harmonicity(df: DataFrame, key: str, vec: str, active: float = 0.1) -> DataFrame:
    """1 minus the mean spectral flatness of the frames above a share of the loudest."""
    leveled = df.select(key, V.norm(F.col(vec)).alias("_len"), V.flatness(V.power(F.col(vec))).alias("_flat"))
    tops = leveled.groupBy(key).agg(F.max("_len").alias("_top"))
    joined = leveled.join(tops, key)
    loud = F.col("_len") > active * F.col("_top")
    return joined.groupBy(key).agg(
        F.count(F.when(loud, 1)).alias("active"),
        F.coalesce(1.0 - F.avg(F.when(loud, F.col("_flat"))), F.lit(0.0)).alias("harmonicity"))


def continuity(df: DataFrame, key: str, order: str, vec: str, dims: int, divisor: int = 4,
               parts: int | None = AUTO) -> DataFrame:
    """Correlation of the mean vectors of the first and the last n frames, mapped to 0..1."""
    placed = ordinal(df.select(key, order, vec), [key], [order], "_pos", parts)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    sized = placed.join(counts, key)
    n = F.floor(F.col("_n") / divisor)
    head, tail = F.col("_pos") <= n, F.col("_pos") > F.col("_n") - n
    def part(where):
        return F.array(*[F.avg(F.when(where, F.col(vec)[i])) for i in range(dims)])
    ends = sized.groupBy(key).agg(part(head).alias("_h"), part(tail).alias("_t"), F.max("_n").alias("frames"))
    def centered(name):
        mean = V.total(F.col(name)) / dims
        return F.transform(name, lambda x: x - mean)
    ends = ends.withColumn("_hc", centered("_h")).withColumn("_tc", centered("_t"))
    flat = (V.norm(F.col("_hc")) / dims ** 0.5 <= EPS) | (V.norm(F.col("_tc")) / dims ** 0.5 <= EPS)
    corr = F.when(flat, 0.0).otherwise(V.cosine(F.col("_hc"), F.col("_tc")))
    return ends.select(key, "frames", clamp((corr + 1.0) / 2.0, 0.0, 1.0).alias("continuity"))


def novelty_bounds(df: DataFrame, key: str, order: str, vec: str, per_segment: float = 2.0,
                   fewest: int = 2, most: int = 8, parts: int | None = AUTO) -> DataFrame:
    """Places where neighbouring frames differ most: one less than the number of segments,
    which grows with the length and stays within 2..8."""
    steps = neighbour(df.select(key, order, vec), [key], [order], {"_was": vec}, parts=parts)
    novelty = steps.where(F.col("_was").isNotNull()).select(
        key, F.col(order), round_to(1.0 - V.cosine(F.col(vec), F.col("_was")), 6).alias("novelty"))
    ranked = top_per(novelty, [key], [F.col("novelty").desc(), F.col(order)], most - 1)
    lengths = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    pieces = F.greatest(F.lit(fewest), F.least(F.lit(most), F.floor(F.col("_n") / per_segment)))
    return ranked.join(lengths, key).where(F.col("rank") <= pieces - 1).select(key, order, "novelty", F.col("rank").cast("long").alias("rank"))


def spectrum_class(vec: Column, duration: Column, bin_hz: float, dims: int) -> Column:
    """Drum class from band shares, centroid and duration; NULL for unusable lengths."""
    def band(low, high):
        first = max(0, -(-int(low) // int(bin_hz)))
        last = min(dims - 1, int(high // bin_hz))
        return V.share(vec, first, last)
    low, mid = band(40, 120), band(150, 500)
    center = V.centroid(vec) * bin_hz
    return (
        F.when((duration > 1.2) | (duration < 0.015), F.lit(None))
        .when((center < 2000) & (low > 0.25) & (duration < 0.6), "kick")
        .when((mid > 0.18) & (center > 1200) & (center < 6000) & (duration < 0.5) & (low < 0.3), "snare")
        .when((center > 6000) & (duration < 0.15), "hat")
        .when((center > 5000) & (duration >= 0.15), "oh")
        .otherwise("perc"))


ANGLES = 256
#: About as many blocks a long series is cut into: a frame is copied to its pairs of blocks that many times, twice, however
#: long its series is.
GRID = 8
#: Cosines a task holds at once.
CHUNK = 1 << 21


def _best(left: pd.DataFrame, right: pd.DataFrame, ident: str, vec: str, k: int) -> pd.DataFrame:
    """Best ``k`` right frames of every left frame, by cosine (6 digits) and then by number."""
    def unit(pdf):
        m = np.stack(pdf[vec].to_numpy()).astype("float64")
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    right = right.sort_values(ident)
    ids, others, rows = left[ident].to_numpy(), right[ident].to_numpy(), []
    vectors, columns = unit(left), unit(right).T
    step = max(1, CHUNK // len(others))
    for at in range(0, len(ids), step):
        scores = np.floor(vectors[at:at + step] @ columns * 1e6 + 0.5000001) / 1e6
        scores[ids[at:at + step, None] == others[None, :]] = -np.inf
        n = min(k, len(others))
        least = np.partition(scores, len(others) - n, axis=1)[:, len(others) - n]
        row, column = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
        value = scores[row, column]
        order = np.lexsort((column, -value, row))
        place = np.arange(len(row)) - np.searchsorted(row, row)  # row is in order, before and after
        order = order[place < k]
        rows.append(pd.DataFrame({ident: ids[at + row[order]], "other": others[column[order]], "cosine": value[order]}))
    return pd.concat(rows, ignore_index=True)


def recurrence_topk(df: DataFrame, key: str, ident: str, vec: str, k: int, block: int = 2048) -> DataFrame:
    """The ``k`` most similar other frames of the same series for every frame, exactly.

    A task compares one block of frames with another as a matrix product, a bounded part of it at a time,
    and returns the best ``k`` per frame, so no pair is ever a row. A series of more than ``block`` frames
    is ordered by the angle to its first frame and cut into about ``GRID`` blocks, fewer where they would
    have less than ``block`` frames: neighbouring slices of that angle together (many frames in one slice
    are split by hash). A frame thus moves a bounded number of times, however long its series is. The best
    frames of the own block come first. Two frames cannot be closer than their angles to the first frame
    differ, so a block is then compared only with the blocks that the worst of these could still lose to.
    Frames without energy have no direction and are left out.
    """
    width = np.pi / ANGLES
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    frames = df.select(key, ident, vec).where(V.norm(F.col(vec)) >= EPS)
    found_types = f"{ident} {types[ident]}, other {types[ident]}, cosine double, {key} {types[key]}"

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _best(pdf, pdf, ident, vec, k)
        return pd.DataFrame() if out.empty else out.assign(**{key: pdf[key].iloc[0]})

    if frames.groupBy(key).count().where(F.col("count") > block).isEmpty():
        return _numbered(frames.groupBy(key).applyInPandas(whole, found_types), key, ident, k)
    firsts = frames.groupBy(key).agg(F.min_by(vec, ident).alias("_first"), F.count(F.lit(1)).alias("_n"))
    angle = F.acos(clamp(V.cosine(F.col(vec), F.col("_first")), -1.0, 1.0))
    slice_ = F.least(F.lit(ANGLES - 1).cast("long"), F.floor(angle / float(width)))
    sliced = frames.join(firsts, key).select(
        key, ident, vec, "_n", F.when(F.col("_n") <= block, F.lit(0).cast("long")).otherwise(slice_).alias("_slice"))
    # at most ANGLES rows a series
    size = F.greatest(F.lit(float(block)), F.ceil(F.col("_n") / GRID))
    before = F.sum("_count").over(Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = sliced.groupBy(key, "_slice").agg(F.count(F.lit(1)).alias("_count"), F.max("_n").alias("_n")).select(
        key, "_slice", F.ceil(F.col("_count") / size).cast("long").alias("_subs"),
        F.floor(F.coalesce(before, F.lit(0)) / size).cast("long").alias("i"))
    slices = checkpointed(slices)
    cells = slices.groupBy(key, "i").agg(F.min("_slice").alias("_low"), F.max("_slice").alias("_high"), F.max("_subs").alias("_subs"))
    placed = checkpointed(sliced.join(slices, [key, "_slice"]).select(key, ident, vec, "i", F.pmod(F.xxhash64(ident), F.col("_subs")).alias("si")))

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        """The best of the own block and the least k-th cosine in it, noted on one row that pairs
        the first frame with itself; -2 when a frame has fewer than k others."""
        found = _best(pdf, pdf, ident, vec, k)
        last = found.groupby(ident)["cosine"].agg(["size", "min"])
        sure = last.loc[last["size"] == k, "min"]
        bound = float(sure.min()) if len(sure) == len(pdf) else -2.0
        first = pdf[ident].iloc[0]
        note = pd.DataFrame({ident: [first], "other": [first], "cosine": [0.0]})
        return pd.concat([note, found]).assign(**{key: pdf[key].iloc[0], "i": pdf["i"].iloc[0], "si": pdf["si"].iloc[0], "bound": bound})

    own = checkpointed(placed.groupBy(key, "i", "si").applyInPandas(inside, found_types + ", i long, si long, bound double"))
    reach = F.when(F.col("bound") < -1.5, F.lit(float(np.pi))).otherwise(F.acos(clamp(F.col("bound") - 2e-6, -1.0, 1.0)) + 1e-6)
    low = F.floor(F.col("_low") - reach / float(width) - 1e-6)
    high = F.floor(F.col("_high") + 1 + reach / float(width) + 1e-6)
    wanted = own.where(F.col("other") == F.col(ident)).join(cells, [key, "i"]).select(key, "i", "si", low.alias("_from"), high.alias("_to"))
    there = cells.select(key, F.col("i").alias("j"), "_low", "_high", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_subs") - 1)).alias("sj"))
    pairs = wanted.join(there, key).where("(i <> j or si <> sj) and _high >= _from and _low <= _to").select(key, "i", "si", "j", "sj")
    left = placed.join(pairs, [key, "i", "si"]).withColumn("side", F.lit(0))
    right = placed.withColumnsRenamed({"i": "j", "si": "sj"}).join(pairs, [key, "j", "sj"]).withColumn("side", F.lit(1))

    def across(pdf: pd.DataFrame) -> pd.DataFrame:
        asked, offered = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        if asked.empty or offered.empty:
            return pd.DataFrame()
        out = _best(asked, offered, ident, vec, k)
        return pd.DataFrame() if out.empty else out.assign(**{key: pdf[key].iloc[0]})

    others = left.unionByName(right).groupBy(key, "i", "si", "j", "sj").applyInPandas(across, found_types)
    every = own.where(F.col("other") != F.col(ident)).select(*others.columns).unionByName(others)
    return _numbered(every, key, ident, k)


def _numbered(found: DataFrame, key: str, ident: str, k: int) -> DataFrame:
    ranked = top_per(found, [key, ident], [F.col("cosine").desc(), F.col("other")], k)
    return ranked.select(key, ident, "other", "cosine", F.col("rank").cast("long").alias("rank"))
