"""Event timelines: sections, grids, events, documents, mixdown and integrity."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import BEATS_PER_BAR, STEPS_PER_BAR, col, pan_gains, round_to, stable_id
from .ordered import AUTO, ordinal, prefix_sum

# The section template (name, bars); intro and outro keep their length.
TEMPLATE = (("intro", 2), ("verse", 8), ("hook", 8), ("verse_variation", 6), ("outro", 2))
FIXED_SECTIONS = ("intro", "outro")

# Energy of each section per recipe kind.
SECTION_ENERGY = {
    "loop": {"intro": 0.30, "verse": 0.70, "hook": 0.85, "verse_variation": 0.55, "outro": 0.30},
    "chop": {"intro": 0.25, "verse": 0.65, "hook": 1.00, "verse_variation": 0.50, "outro": 0.25},
    "stem": {"intro": 0.45, "verse": 0.75, "hook": 0.90, "verse_variation": 0.60, "outro": 0.35},
}
DEFAULT_ENERGY = 0.7

# Placement style and density of each section of the chop kind.
CHOP_STYLES = {"intro": "long_tail", "verse": "phrase_2bar", "hook": "syncopated",
               "verse_variation": "breath", "outro": "long_tail"}

# Drum classes.
DRUM_CLASSES = ("kick", "snare", "hat", "oh", "perc")


def literal_map(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def section_energy(kind: Column, section: Column) -> Column:
    """Energy of a (kind, section) pair; 0.7 for pairs without a rule."""
    flat = {f"{k}/{s}": e for k, sections in SECTION_ENERGY.items() for s, e in sections.items()}
    return F.coalesce(literal_map(flat)[F.concat(kind, F.lit("/"), section)], F.lit(DEFAULT_ENERGY))


def section_dropout(kind: Column, section: Column, k: Column) -> Column:
    """True for bars in which the lead is silent."""
    odd = (kind == "loop") & (section == "verse_variation") & (F.pmod(k, F.lit(2)) == 1)
    return odd | ((kind == "stem") & (section == "verse_variation"))


def with_offsets(sections: DataFrame, keys: list[str], order: str, bars: str, parts: int | None = AUTO) -> DataFrame:
    """Start beat of every section: the beats of all earlier ones."""
    return prefix_sum(sections, keys, [order], F.col(bars) * float(BEATS_PER_BAR), "start_beat", parts=parts)


def avoid_steps(steps: DataFrame, taken: DataFrame, keys: list[str], step: str = "step") -> DataFrame:
    """Drop steps next to a taken one; a group that would lose every step keeps all of them.

    Neighbours are spelled out (at most three per taken step), so this is an equi join on a
    handful of rows per group, and it is not circular: 15 is no neighbour of 0.
    """
    blocked = (
        taken.select(*keys, F.explode(F.array(*[F.col(step) + d for d in (-1, 0, 1)])).alias(step))
        .where(F.col(step).between(0, STEPS_PER_BAR - 1)).distinct().withColumn("_hit", F.lit(True))
    )
    marked = steps.join(blocked, [*keys, step], "left").withColumn("_free", F.col("_hit").isNull())
    groups = marked.groupBy(*keys).agg(F.max("_free").alias("_any"))
    kept = marked.join(groups, keys)
    return kept.where(F.col("_free") | ~F.col("_any")).select(*steps.columns)


def cyclic_assign(rows: DataFrame, pool: DataFrame, keys: list[str], order: list[str], parts: int | None = AUTO) -> DataFrame:
    """Give the rows of every key the pool's items in turn. ``pool`` has columns ``slot`` (from 0)
    and ``slots`` (its size) besides the item."""
    counted = ordinal(rows, keys, order, "_n", parts)
    size = pool.select(F.max("slots")).scalar()
    placed = counted.withColumn("slot", F.pmod(F.col("_n") - 1, size)).drop("_n")
    return placed.join(pool.drop("slots"), "slot", "left")


# --- documents ---------------------------------------------------------------------------

def events_to_doc(events: DataFrame, keys: list[str], fields: list[str], page_rows: int = 10_000,
                  parts: int | None = AUTO) -> DataFrame:
    """Events as nested documents: one row per key and page with a sorted array of events.

    Events are numbered in the order of ``fields`` by a two-level scan, and pages take ``page_rows`` of them in turn: pages
    put behind each other are the sorted events, at every size, and no array grows without bound.
    """
    placed = ordinal(events.select(*keys, *[c for c in fields if c not in keys]), keys, fields, "_n", parts)
    page = F.floor((F.col("_n") - 1) / page_rows)
    return placed.withColumn("page", page).groupBy(*keys, "page").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("events"))


def doc_to_events(docs: DataFrame, keys: list[str]) -> DataFrame:
    return docs.select(*keys, F.explode("events").alias("_e")).select(*keys, "_e.*")


def pattern_rows(docs: DataFrame, keys: list[str], pattern: str) -> DataFrame:
    """Nested ``bar -> class -> step -> hit`` maps as rows with numeric bar and step."""
    bars = docs.select(*keys, F.explode(pattern).alias("_bar", "_tracks"))
    tracks = bars.select(*keys, "_bar", F.explode("_tracks").alias("track", "_steps"))
    steps = tracks.select(*keys, "_bar", "track", F.explode("_steps").alias("_step", "hit"))
    return steps.select(*keys, F.col("_bar").cast("int").alias("bar"), "track", F.col("_step").cast("double").alias("step"), "hit.*")


def merged_assets(parts: list[DataFrame], key: str, version: str) -> DataFrame:
    """All assets of several lists by key; the last list wins."""
    from .ordered import newest_per
    numbered = [p.withColumn(version, F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), numbered)
    return newest_per(every, [key], [version]).drop(version)


def ordered_ids(*ids: Column) -> Column:
    """Distinct ids in order of first appearance; arrays are flattened in place."""
    return F.array_distinct(F.array_compact(F.concat(*ids)))


# --- mixdown -----------------------------------------------------------------------------

def mixdown(events: DataFrame, keys: list[str], start: Column, length: Column, gain: Column, pan: Column,
            bin_width: float) -> DataFrame:
    """Left and right sums per layer and time bin, and over all layers.

    An event contributes its panned gain to every bin it touches. The sums combine on the map
    side; the total over layers is one more level of the same aggregate (rollup order key, bin).
    """
    left, right = pan_gains(pan)
    first = F.floor(start / bin_width)
    last = F.greatest(first, F.ceil((start + length) / bin_width) - 1)
    spread = events.withColumn("bin", F.explode(F.sequence(first, last))).withColumn("_l", gain * left).withColumn("_r", gain * right)
    return spread.groupBy(*keys, "bin").agg(F.sum("_l").alias("left"), F.sum("_r").alias("right"))


def master(mix: DataFrame, keys: list[str], peak_db: float = -1.0) -> DataFrame:
    """Soft limit, then scale so that the loudest bin of a key reaches the target."""
    target = 10 ** (peak_db / 20)
    soft = mix.withColumn("left", F.tanh("left")).withColumn("right", F.tanh("right"))
    loudest = F.max(F.greatest(F.abs("left"), F.abs("right"))) + 1e-12
    peaks = soft.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(loudest.alias("_peak"))
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return soft.join(peaks, on).select(
        *keys, "bin", (F.col("left") * target / F.col("_peak")).alias("left"), (F.col("right") * target / F.col("_peak")).alias("right"))


# --- integrity ---------------------------------------------------------------------------

def duplicate_keys(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Keys that are empty or occur more than once."""
    empty = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.where((F.col("n") > 1) | empty).select(
        F.lit(rule).alias("rule"), F.concat_ws("/", *keys).alias("key"), "n")


def unknown_keys(df: DataFrame, key: str, known: DataFrame, known_key: str, rule: str) -> DataFrame:
    """References without a target, with the number of rows that hold them. References are
    counted before the join, so a reference held by very many rows is one row."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    missing = counts.join(known.select(F.col(known_key).alias("_k")).distinct(), "_k", "left_anti")
    return missing.select(F.lit(rule).alias("rule"), F.col("_k").cast("string").alias("key"), "n")


def failing_rows(df: DataFrame, key: str, bad: Column, rule: str) -> DataFrame:
    return df.where(bad).groupBy(F.col(key).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(rule).alias("rule"), "key", "n")


def report(*checks: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def pending(requested: DataFrame, artifacts: DataFrame, key: str, artifact: str, needed: int, done: Column) -> DataFrame:
    """Requested rows that are not complete: complete means done and all artifacts present."""
    have = artifacts.groupBy(key).agg(F.count_distinct(artifact).alias("_have")).where(F.col("_have") >= needed)
    complete = requested.where(done).select(key).join(have, key, "left_semi")
    return requested.join(complete, key, "left_anti")


# --- lookups and summaries ---------------------------------------------------------------

def kit_for(classes: DataFrame, hits: DataFrame, key: str, order: list[Column], fallback: Column, k: int = 2) -> DataFrame:
    """The best ``k`` hits of every class; a class without hits gets its fallback."""
    from .ordered import top_per
    picked = top_per(hits, [key], order, k)
    return classes.join(picked, key, "left").withColumn("rank", F.coalesce(F.col("rank"), F.lit(1))).withColumn(
        "item", F.coalesce("item", fallback))


def lineage(runs: DataFrame, run: str, assets: DataFrame, asset: str, rights: DataFrame, pieces: DataFrame,
            fields: list[str], page_rows: int = 10_000) -> DataFrame:
    """Lineage rows: a run with its asset's attributes, its rights and its list of pieces (in pages)."""
    known = runs.join(assets, asset, "left").join(rights, run, "left")
    return known.join(events_to_doc(pieces, [run], fields, page_rows).withColumnRenamed("events", "pieces"), run, "left")


def usage_summary(uses: DataFrame, key: str, start: str, end: str, n: int = 10) -> DataFrame:
    """Uses, first start and last end of the first ``n`` keys in key order (a report's top list)."""
    return uses.groupBy(key).agg(F.count(F.lit(1)).alias("uses"), F.min(start).alias("first_start"),
                                 F.max(end).alias("last_end")).orderBy(key).limit(n)


def label_values(df: DataFrame, key: str, labels: dict[str, str], n: int = 12) -> DataFrame:
    """Wide rows as ordered (label, value) rows; empty values skipped, at most ``n`` per key.
    Positions are counted in the row's own array, so this is no aggregate and no shuffle."""
    pairs = [F.when(F.col(c).isNotNull(), F.struct(F.lit(l).alias("label"), F.col(c).cast("string").alias("value"))) for c, l in labels.items()]
    rows = F.slice(F.array_compact(F.array(*pairs)), 1, n)
    return df.select(key, F.posexplode(rows).alias("position", "_r")).select(
        key, (F.col("position") + 1).alias("position"), "_r.label", "_r.value")


def reproducible(first: DataFrame, second: DataFrame, volatile: list[str]) -> DataFrame:
    """Rows that differ between two results once volatile columns are left out."""
    a, b = first.drop(*volatile), second.drop(*volatile)
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))
