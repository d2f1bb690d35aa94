"""Row generators: windows over spans, grids over sections, splits of intervals."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, col, round_to

# Window sizes in bars and in seconds, and their limits.
BAR_SIZES = (1, 2, 4, 8)
PHRASE_SIZES = (2.0, 4.0, 8.0, 16.0)
WINDOW_MIN = 2.0
WINDOW_MAX = 16.0

# Steps hit inside a bar by each placement style.
STEP_PATTERNS = {
    "long_tail": (0,),
    "phrase_2bar_even": (0, 5, 8, 13),
    "phrase_2bar_odd": (3, 10),
    "syncopated": (0, 4, 7, 9, 12, 15),
    "breath": (0, 10),
}


def bar_seconds(tempo: Column) -> Column:
    return 4.0 * 60.0 / clamp(tempo.cast("double"), 40.0, 240.0)


def tempo_sizes(tempo: Column, longest: float = WINDOW_MAX) -> Column:
    """Window sizes of a series: 1, 2, 4 and 8 bars when the tempo is known, phrases otherwise."""
    known = F.coalesce(tempo, F.lit(0.0)) != 0
    bars = F.array(*[F.least(F.lit(longest), bar_seconds(tempo) * float(n)) for n in BAR_SIZES])
    return F.when(known, bars).otherwise(F.array(*[F.lit(s) for s in PHRASE_SIZES]))


def usable_sizes(sizes: Column, duration: Column, shortest: float = WINDOW_MIN) -> Column:
    """Sizes above the duration shrink to it; too short and repeated ones go."""
    fitted = F.transform(sizes, lambda w: F.least(w, duration.cast("double")))
    return F.when(duration >= shortest, F.array_distinct(F.filter(fitted, lambda w: w >= shortest - 1e-6)))


def window_interval(index: Column, size: Column, duration: Column) -> tuple[Column, Column]:
    start = index * (size / 2.0)
    return round_to(start, 3), round_to(F.least(start + size, duration.cast("double")), 3)


def multires_windows(spans: DataFrame, key: str, duration: str, sizes: Column,
                     shortest: float = WINDOW_MIN, bar: Column | None = None) -> DataFrame:
    """Half-overlapping windows of several sizes over ``[0, duration)`` of every series.

    Windows come from one generated sequence per size, and repeated sizes are removed in the
    array, so nothing is shuffled.
    """
    size = F.col("size")
    last = F.floor((F.col(duration) - size + 1e-6) / (size / 2.0)).cast("long")
    start, end = window_interval(F.col("index"), size, F.col(duration))
    windows = (
        spans.withColumn("size", F.explode(usable_sizes(sizes, F.col(duration), shortest)))
        .withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumns({"start": start, "end": end})
        .where(F.col("end") - F.col("start") >= shortest - 1e-6)
    )
    bars = F.lit(None).cast("double") if bar is None else round_to((F.col("end") - F.col("start")) / bar, 2)
    return windows.select(key, duration, "size", "index", "start", "end", bars.alias("bars"))


def phrase_windows(spans: DataFrame, key: str, duration: str, tempo: Column, bars: float = 2.0,
                   shortest: float = 0.5, low: float = 1.0, high: float = 6.0) -> DataFrame:
    """Half-overlapping windows of two bars; a shorter series has one window at 0."""
    size = clamp(bar_seconds(tempo) * bars, low, high)
    last = F.floor((F.col(duration) - F.col("size") + 1e-6) / (F.col("size") / 2.0)).cast("long")
    return (
        spans.where(F.col(duration) >= shortest)
        .withColumn("size", size)
        .withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), last))))
        .withColumn("start", F.col("index") * (F.col("size") / 2.0))
        .withColumn("end", F.least(F.col("start") + F.col("size"), F.col(duration).cast("double")))
        .select(key, "index", "start", "end")
    )


def split_even(df: DataFrame, start: str, end: str, n: int) -> DataFrame:
    """``n + 1`` evenly spaced cut points per interval."""
    span = F.greatest(F.lit(0.0), F.col(end) - F.col(start))
    point = round_to(F.col(start) + span * F.col("i") / float(n), 6)
    return df.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n).cast("long")))).withColumn("point", point)


def step_of(t: Column, tempo: Column | float) -> Column:
    """Sixteenth step (0..15) of a time."""
    seconds = 60.0 / (F.lit(tempo) if isinstance(tempo, float) else tempo) / 4.0
    return F.pmod(F.floor(t / seconds), F.lit(16)).cast("long")


def bar_rows(sections: DataFrame, bars: str = "bars") -> DataFrame:
    """One row per bar of every section; ``k`` counts from 0."""
    some = sections.where(F.col(bars) > 0)
    return some.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col(bars).cast("long") - 1)))


def pattern_steps(style: Column, k: Column) -> Column:
    """Steps hit in bar ``k`` of a section; ``phrase_2bar`` alternates between two patterns."""
    even = F.pmod(k, F.lit(2)) == 0
    name = F.when(style == "phrase_2bar", F.when(even, "phrase_2bar_even").otherwise("phrase_2bar_odd")).otherwise(style)
    entries = []
    for key, steps in STEP_PATTERNS.items():
        entries += [F.lit(key), F.array(*[F.lit(s).cast("long") for s in steps])]
    return F.coalesce(F.create_map(*entries)[name], F.array(F.lit(0).cast("long")))


def chunk_of(start: Column, end: Column, k: Column, bar: Column) -> Column:
    """Piece of an interval played in bar ``k``: the interval in bar-sized pieces, in turn."""
    span = F.greatest(F.lit(0.5), end - start)
    pieces = F.greatest(F.lit(1).cast("long"), F.floor(span / bar + 0.5))
    size = span / pieces
    at = F.pmod(k, pieces)
    return F.struct(at.alias("piece"), round_to(start + at * size, 6).alias("from"),
                    round_to(F.least(start + at * size + size, end), 6).alias("to"))


def allocate(df: DataFrame, keys: list[str], name: str, base: str, total: str, fixed: list[str]) -> DataFrame:
    """Distribute ``total`` units over weighted rows by largest remainder; ``fixed`` rows keep
    their base and every other row gets at least one.

    Runs on the template rows of each key (five sections), never on data rows.
    """
    from pyspark.sql import Window

    group = Window.partitionBy(*keys)
    movable = ~F.col(name).isin(*fixed)
    weight = F.sum(F.when(movable, F.col(base))).over(group)
    free = F.col(total) - F.coalesce(F.sum(F.when(~movable, F.col(base))).over(group), F.lit(0))
    shared = (
        df.withColumn("_move", movable).withColumn("_free", free).withColumn("_weight", weight)
        .withColumn("_raw", F.when(F.col("_move"), F.col(base) * F.col("_free") / F.col("_weight")))
        .withColumn("_whole", F.when(F.col("_move"), F.greatest(F.lit(1).cast("long"), F.floor("_raw"))))
        .withColumn("_frac", F.col("_raw") - F.floor("_raw"))
        .withColumn("_left", F.col("_free") - F.sum("_whole").over(group))
        .withColumn("_n", F.sum(F.when(F.col("_move"), 1)).over(group))
    )
    up = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_move").desc(), F.col("_frac").desc(), "position"))
    able = F.col("_move") & (F.col("_whole") > 1)
    down = F.row_number().over(Window.partitionBy(*keys).orderBy(able.desc(), F.col("_frac").asc(), "position"))
    ranked = shared.withColumn("_up", up).withColumn("_down", down)
    gain = F.floor(F.col("_left") / F.col("_n")) + F.when(F.col("_up") <= F.pmod(F.col("_left"), F.col("_n")), 1).otherwise(0)
    bars = (
        F.when(~F.col("_move"), F.col(base))
        .when(F.col("_left") >= 0, F.col("_whole") + gain)
        .when(able & (F.col("_down") <= -F.col("_left")), F.col("_whole") - 1)
        .otherwise(F.col("_whole"))
    )
    return ranked.withColumn("bars", bars.cast("long")).select(*df.columns, "bars")
