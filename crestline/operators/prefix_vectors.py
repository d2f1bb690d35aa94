"""Sums of vectors inside windows as differences of two prefix rows.

Rows of a series carry additive vectors (sums, sums of squares, counts). They are merged with the edges of all windows in
one order and dealt by ranges, as in :mod:`ranged`; each partition is scanned once in NumPy, and an edge gets the sum of
all rows before it. A window of any length then costs two edges, a quarter of it two more, however many rows it holds, and
no row is repeated for the windows that cover it. Windows inside a partition are scored there.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from .ranged import PART, Ranged, persisted

EPS = 1e-9


def _segments(batch: pa.RecordBatch) -> np.ndarray:
    """First rows of runs with equal keys."""
    codes = batch["_key"].dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1]))


def _matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """Vectors of all rows; edges have none and count as zeros."""
    out = np.zeros((batch.num_rows, width))
    has = batch["stats"].is_valid().to_numpy(zero_copy_only=False)
    if has.any():
        out[has] = pc.list_flatten(batch["stats"]).to_numpy(zero_copy_only=False).reshape(-1, width)
    return out


def prefix_at(rows: DataFrame, edges: DataFrame, key: str, at: str, stats: str, width: int, parts: int | None = None) -> DataFrame:
    """(key, at, upto): for every edge (key, at) the sum of the vectors ``stats`` of all rows of the key before it.

    ``stats`` has ``width`` numbers. Rows at the very place of an edge come after it. An edge before all rows of its key,
    or of a key without rows, has zeros. Edges should be distinct.
    """
    kind = rows.schema[key].dataType
    points = rows.select(F.col(key).alias("_key"), F.col(at).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.col(stats).alias("stats"))
    marks = edges.select(F.col(key).alias("_key"), F.col(at).cast("double").alias("_at"), F.lit(0).alias("_kind"),
                         F.lit(None).cast("array<double>").alias("stats"))
    dealt = Ranged(points.unionByName(marks), ["_key"], ["_at", "_kind"], parts)
    ordered = dealt.rows.sortWithinPartitions("_key", "_at", "_kind")
    out = T.StructType([T.StructField("_key", kind), T.StructField(PART, T.IntegerType()), T.StructField("_at", T.DoubleType()),
                        T.StructField("upto", T.ArrayType(T.DoubleType()))])

    def scan(batches: Iterator[pa.RecordBatch], every: bool) -> Iterator[pa.RecordBatch]:
        """Edges with their sums inside the partition; or, instead, the whole sums of its first and last key."""
        now, state, ends, part, key_type = None, np.zeros(width), [], None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            part, key_type = batch[PART][0].as_py(), batch["_key"].type
            upto, first = np.cumsum(_matrix(batch, width), axis=0), _segments(batch)
            last = np.append(first[1:], batch.num_rows) - 1
            before = np.where(first[:, None] > 0, upto[first - 1], 0.0)
            head = batch["_key"][0].as_py()
            if ends and head == now:
                before[0] -= state
                ends.pop()
            sums = upto - np.repeat(before, last - first + 1, axis=0)
            now, state = batch["_key"][batch.num_rows - 1].as_py(), sums[-1].copy()
            for i in {0, len(first) - 1}:
                ends.append((batch["_key"][int(first[i])].as_py(), sums[last[i]].copy()))
            ends[1:-1] = []
            if every:
                edge = np.flatnonzero(batch["_kind"].to_numpy() == 0)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(edge) + 1, dtype=np.int32) * width), pa.array(sums[edge].ravel()))
                take = pa.array(edge)
                yield pa.RecordBatch.from_arrays([batch["_key"].take(take), batch[PART].take(take), batch["_at"].take(take), flat], names=out.names)
        if ends and not every:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in ends], key_type), pa.array([part] * len(ends), pa.int32()), pa.array([0.0] * len(ends)),
                                              pa.array([s.tolist() for _, s in ends], pa.list_(pa.float64()))], names=out.names)

    local = ordered.mapInArrow(lambda b: scan(b, True), out)
    totals = ordered.mapInArrow(lambda b: scan(b, False), out)
    # at most two rows per partition
    zeros = F.array_repeat(F.lit(0.0), width)
    named = totals.select(F.col("_key").alias("_k0"), F.col(PART).alias("_p"), "upto")
    earlier = named.withColumn("_sums", F.collect_list("upto").over(dealt.before()))
    carried = earlier.where(F.size("_sums") > 0).select("_k0", "_p", F.aggregate("_sums", zeros, lambda a, x: F.zip_with(a, x, lambda p, q: p + q)).alias("_up"))
    both = local.join(F.broadcast(carried), F.col("_key").eqNullSafe(F.col("_k0")) & (F.col(PART) == F.col("_p")), "left")
    whole = F.when(F.col("_up").isNull(), F.col("upto")).otherwise(F.zip_with("upto", "_up", lambda a, b: a + b))
    return both.select(F.col("_key").alias(key), F.col("_at").alias(at), whole.alias("upto"))


def vector_stats(vec: Column, *more: Column) -> Column:
    """What :func:`window_scores` adds up of one frame: its vector (null: no frame) and further additive values. Sums of
    squares, unit vectors and centroids are made of it inside the scan, so a frame moves with no more than its own numbers."""
    return F.struct(vec.alias("vec"), F.array(*[m.cast("double") for m in more]).cast("array<double>").alias("more"))


def _additive(stats: pa.Array, dims: int, n_more: int) -> np.ndarray:
    """Per frame: values, squares, unit vector, then count, silent frames, centroid and its square, more."""
    vec, more = stats.field("vec"), stats.field("more")
    out = np.zeros((len(stats), 3 * dims + 4 + n_more))
    has = np.flatnonzero(vec.is_valid().to_numpy(zero_copy_only=False))
    if len(has):
        v = pc.list_flatten(vec).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
        length, size = np.sqrt((v * v).sum(axis=1)), np.abs(v)
        weight = size.sum(axis=1)
        center = (size * np.arange(dims)).sum(axis=1) / np.where(weight == 0, 1.0, weight)
        silent = ~(length > EPS)
        unit = np.where(silent[:, None], 0.0, v / np.where(silent, 1.0, length)[:, None])
        out[has, :3 * dims + 4] = np.column_stack([v, v * v, unit, np.ones(len(v)), length < EPS, center, center * center])
    if n_more:
        out[:, 3 * dims + 4:] = pc.list_flatten(more).to_numpy(zero_copy_only=False).reshape(-1, n_more)
    return out


def _scores(whole: np.ndarray, head: np.ndarray, tail: np.ndarray, dims: int, spread: float, full: float) -> list[np.ndarray]:
    """Continuity, stability and timbre of windows, from the sums in each, and the values and count in its first and last
    quarter."""
    n, silent, center, center_sq = (whole[:, 3 * dims + i] for i in range(4))
    some = np.maximum(n, 1.0)
    # a correlation does not depend on the scale, so sums stand for means
    a, b = head[:, :dims], tail[:, :dims]
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    size_a, size_b = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    flat = (head[:, dims] < 0.5) | (tail[:, dims] < 0.5) | (size_a <= EPS) | (size_b <= EPS)
    alike = np.where(flat, 0.0, (a * b).sum(axis=1) / np.where(flat, 1.0, size_a * size_b))
    continuity = np.clip((alike + 1.0) / 2.0, 0.0, 1.0)
    # the mean cosine of frames f to their mean m is the product of m / |m| with the mean of f / |f|
    sums, length = whole[:, :dims], np.sqrt((whole[:, :dims] ** 2).sum(axis=1))
    mute = (n < 0.5) | (silent > 0.5) | (length < EPS)
    near = (sums * whole[:, 2 * dims:3 * dims]).sum(axis=1) / np.where(mute, 1.0, length * some)
    stability = np.where(mute, 0.0, np.clip(1.0 - (1.0 - near) / spread, 0.0, 1.0))
    mean = sums / some[:, None]
    varied = np.clip(np.sqrt(np.maximum(whole[:, dims:2 * dims] / some[:, None] - mean * mean, 0.0)).mean(axis=1) / full, 0.0, 1.0)
    at = center / some
    still = at < 1e-6
    moved = np.clip(np.sqrt(np.maximum(center_sq / some - at * at, 0.0)) / np.where(still, 1.0, at), 0.0, 1.0)
    timbre = np.where(n < 0.5, 0.0, np.where(still, varied, 0.5 * varied + 0.5 * moved))
    return [continuity, stability, timbre]


_SIDES = 4
#: A row with the sums of a whole key inside a partition, where others have the side of an edge.
_TOTAL = 4


class _Edges:
    """Edges of windows: ids, sides (0..3) and the rows of a matrix that hold the sums before them. Edges without a frame
    between them share a row, so a scan holds as many sums as it has frames and not as it has edges."""

    def __init__(self, ids: pa.Table, side: np.ndarray, at: np.ndarray):
        self.ids, self.side, self.at = ids, side, at

    def __add__(self, other: "_Edges") -> "_Edges":
        return _Edges(pa.concat_tables([self.ids, other.ids]), np.concatenate([self.side, other.side]), np.concatenate([self.at, other.at]))

    def take(self, rows: np.ndarray) -> "_Edges":
        return _Edges(self.ids.take(pa.array(rows)), self.side[rows], self.at[rows])

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the windows with all their edges, one row a window with a column per side; and the other places."""
        code = np.zeros(len(self.side), np.int64)
        for column in self.ids.columns:
            values = column.combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * (len(values.dictionary) + 1) + values.indices.to_numpy(), return_inverse=True)[1]
        order = np.lexsort((self.side, code))
        full = np.bincount(code)[code[order]] == _SIDES
        return order[full].reshape(-1, _SIDES), order[~full]


def window_scores(rows: DataFrame, windows: DataFrame, key: str, at: str, stats: str, dims: int, ident: list[str], longest: float,
                  more: tuple[str, ...] = (), spread: float = 0.4, full: float = 40.0, parts: int | None = None) -> DataFrame:
    """(key, ident, continuity, key_stability, timbre, more) of windows [start, end) no longer than ``longest``, unique by key
    and ``ident``.

    ``stats`` holds :func:`vector_stats` of ``dims`` numbers and one additive value per name in ``more``. continuity is
    the correlation of the mean vectors of the first and last quarter, mapped to 0..1 (0.5 when one is empty or flat);
    key_stability the mean cosine of the frames to their mean, 0 when ``spread`` off or when a frame is silent; timbre half
    the deviation over time (``full`` gives 1), half the variation of the centroid. A window without frames has 0.5, 0, 0.

    Frames and the four edges of each window are merged in one order and dealt by ranges. One scan of a partition keeps the
    sums before the edges of windows that are open, and scores a window at its last edge: no sums leave the task, however
    many windows there are. Only windows cut by the edge of a partition, of which there are about as many as cover one
    moment, pass their sums on, and so does the first and last key of a partition; they meet by key.
    """
    n_more = len(more)
    width = 3 * dims + 4 + n_more
    quarter = (F.col("end") - F.col("start")) / 4.0
    places = [F.col("start"), F.col("start") + quarter, F.col("end") - quarter, F.col("end")]
    sides = F.array(*[F.struct(p.cast("double").alias("at"), F.lit(i).alias("side")) for i, p in enumerate(places)])
    each = windows.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_i{i}") for i, c in enumerate(ident)], F.explode(sides).alias("_e"))
    marks = each.select("_key", F.col("_e.at").alias("_at"), F.col("_e.side").alias("_side"), *[f"_i{i}" for i in range(len(ident))])
    frames = rows.select(F.col(key).alias("_key"), F.col(at).cast("double").alias("_at"), F.lit(_TOTAL).alias("_side"), F.col(stats).alias("_stats"))
    # frames at the very place of an edge come after it
    dealt = Ranged(marks.unionByName(frames, allowMissingColumns=True), ["_key"], ["_at", "_side"], parts, keep=lambda d: d)
    ordered = dealt.rows.sortWithinPartitions("_key", "_at", "_side")
    names = ["_key", *[f"_i{i}" for i in range(len(ident))]]
    kinds = [marks.schema[c].dataType for c in names]
    found = [f"_f{i}" for i in range(3 + n_more)]
    final = T.StructType([*[T.StructField(n, t) for n, t in zip(names, kinds)], *[T.StructField(f, T.DoubleType()) for f in found]])
    out = T.StructType([*final.fields, T.StructField("_side", T.IntegerType()), T.StructField(PART, T.IntegerType()), T.StructField("_sums", T.ArrayType(T.DoubleType()))])

    def scores(sums: np.ndarray, rows_: np.ndarray) -> list[np.ndarray]:
        """Of windows with their edges' rows of ``sums``."""
        quarters = sums[:, [*range(dims), 3 * dims]]
        whole, q = sums[rows_[:, 3]] - sums[rows_[:, 0]], [quarters[rows_[:, i]] for i in range(_SIDES)]
        return [*_scores(whole, q[1] - q[0], q[3] - q[2], dims, spread, full), *[whole[:, 3 * dims + 4 + i] for i in range(n_more)]]

    def done(ids: pa.Table, values: list[np.ndarray]) -> pa.RecordBatch:
        n = len(ids)
        columns = [*[c.combine_chunks() for c in ids.columns], *[pa.array(v, pa.float64()) for v in values],
                   pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, names=out.names)

    def passed(edges: _Edges, sums: np.ndarray, part: int) -> pa.RecordBatch:
        n = len(edges.side)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(sums[edges.at].ravel()))
        columns = [*[c.combine_chunks() for c in edges.ids.columns], *[pa.nulls(n, pa.float64()) for _ in found],
                   pa.array(edges.side, pa.int32()), pa.array(np.full(n, part), pa.int32()), flat]
        return pa.RecordBatch.from_arrays(columns, names=out.names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, open_, waiting, head, part, last_id = np.zeros(width), None, None, True, None, None
        one = np.array([_TOTAL]), np.array([0])

        def total() -> pa.RecordBatch:
            return passed(_Edges(last_id, *one), state[None, :], part)

        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch[PART][0].as_py()
            ids = pa.Table.from_batches([batch.select(names)])
            first = _segments(batch)
            same = last_id is not None and last_id["_key"][0].as_py() == ids["_key"][0].as_py()
            if last_id is not None and not same:
                if head:
                    yield total()
                    head = False
                if open_ is not None and len(open_.side):
                    yield passed(open_, waiting, part)
                state, open_ = np.zeros(width), None
            side = batch["_side"].to_numpy()
            is_frame = side == _TOTAL
            frames_ = _additive(batch["_stats"].filter(pa.array(is_frame)), dims, n_more)
            upto = np.concatenate([state[None, :], state + np.cumsum(frames_, axis=0)]) if same else np.concatenate([np.zeros((1, width)), np.cumsum(frames_, axis=0)])
            # frames before each row, and before the first row of its key; the key that goes on starts from its own state
            place = np.cumsum(is_frame) - is_frame
            start = place[first]
            base = upto[start]
            if same:
                base[0] = 0.0
            segment = np.repeat(np.arange(len(first)), np.diff(np.append(first, batch.num_rows)))
            edge = np.flatnonzero(~is_frame)
            # sums of edges that wait come first; those of a batch count from its start, which cancels out inside a key
            shift = 0 if open_ is None else len(waiting)
            sums = upto if open_ is None else np.concatenate([waiting, upto])
            edges, of = _Edges(ids.take(pa.array(edge)), side[edge], place[edge] + shift), segment[edge]
            if open_ is not None:
                edges, of = open_ + edges, np.concatenate([np.zeros(len(open_.side), np.int64), of])
            whole, rest = edges.split()
            if len(whole):
                yield done(edges.ids.take(pa.array(whole[:, 0])), scores(sums, edges.at[whole]))
            ends = upto[np.append(start[1:], len(frames_))] - base
            if head and len(first) > 1:
                yield passed(_Edges(ids.slice(0, 1), *one), ends[:1], part)
                head = False
            last_id, state = ids.slice(batch.num_rows - 1, 1), ends[-1].copy()
            # what stays open keeps its sums from the start of its key
            held, at = np.unique(np.stack([edges.at[rest], of[rest]]), axis=1, return_inverse=True)
            waiting = sums[held[0]] - np.where(held[0] < shift, 0, 1)[:, None] * base[held[1]]
            rest, of = edges.take(rest), of[rest]
            rest.at = at.ravel()
            if len(first) > 1 and len(rest.side):
                here = of == len(first) - 1
                if not here.all():
                    yield passed(rest.take(np.flatnonzero(~here)), waiting, part)
                rest = rest.take(np.flatnonzero(here))
            open_ = rest
        if last_id is not None:
            yield total()
            if len(open_.side):
                yield passed(open_, waiting, part)

    def finish(table: pa.Table) -> pa.Table:
        """Cut windows of a key, from the sums inside the partitions and those of the key in earlier partitions."""
        table = table.take(pc.sort_indices(table[PART]))
        part, side = table[PART].to_numpy(), table["_side"].to_numpy()
        sums = pc.list_flatten(table["_sums"]).to_numpy().reshape(-1, width)
        whole = side == _TOTAL
        upto = np.concatenate([np.zeros((1, width)), np.cumsum(sums[whole], axis=0)])
        edge = np.flatnonzero(~whole)
        earlier = np.searchsorted(part[whole], part[edge], side="left")
        edges, sums = _Edges(table.select(names).take(pa.array(edge)), side[edge], np.arange(len(edge))), sums[edge] + upto[earlier]
        complete, rest = edges.split()
        if len(rest):
            raise ValueError("windows are not unique by key and ident")
        ids = edges.ids.take(pa.array(complete[:, 0]))
        return pa.Table.from_arrays([*ids.columns, *[pa.chunked_array([pa.array(v)]) for v in scores(sums, complete)]], names=final.names)

    scanned = persisted(ordered.mapInArrow(scan, out))
    cut = scanned.where(F.col("_side").isNotNull()).groupBy("_key").applyInArrow(finish, final)
    every = scanned.where(F.col("_side").isNull()).select(*final.names).unionByName(cut)
    return every.withColumnsRenamed(dict(zip(final.names, [key, *ident, "continuity", "key_stability", "timbre", *more])))
