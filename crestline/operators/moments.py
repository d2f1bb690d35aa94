"""Classification, scoring, ranking and selection of windows."""
from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import (PRIMARY_WORDS, SUPPORTING_WORDS, clamp, explain_quality,
                                round_to, type_matches)
from .ordered import top_per

# Window types.
TYPES = ("melody", "melody_no_drums", "vocal_phrase", "drum_break", "bass_phrase", "texture", "transition")

# Thresholds of the classification.
THRESHOLDS = {
    "texture_centroid": 1800.0, "texture_density": 3.0,
    "drum_break": 0.35, "drum_break_vocal": 0.20,
    "vocal_phrase": 0.30,
    "bass_phrase": 0.30, "bass_phrase_drum": 0.30,
    "plain_drum": 0.12, "plain_harmonicity": 0.15,
}

# Weights of the eight dimensions.
WEIGHTS = {
    "loopability": 0.25, "memorability": 0.20, "key_stability": 0.15,
    "drum_state": 0.10, "vocal_state": 0.10, "timbre_uniqueness": 0.10,
    "structure_position": 0.05, "space": 0.05,
}

# Rubric weights, its gates and its pass mark.
RUBRIC = {
    "drums_presence": 20, "vocal_free": 15, "structure_hit": 15,
    "key_bpm_conf": 10, "loopability": 10, "timbre_uniqueness": 15,
    "harmonicity": 5, "dynamics_space": 5, "source_prior": 5,
}
GATES = ("drums_presence", "vocal_free", "structure_hit")
PASS_MARK = 60

# Channel kept for each type that has one of its own.
TYPE_CHANNEL = {"drum_break": "drums", "vocal_phrase": "vocal", "bass_phrase": "bass"}


def classify(bound: Column, centroid: Column, density: Column, silent: Column, has_channels: Column,
             drum: Column, vocal: Column, bass: Column, harmonicity: Column,
             limits: dict[str, float] = THRESHOLDS) -> Column:
    """Type of a window; the first rule that holds decides. ``drum`` is the channel share, or its
    estimate when the series has no channels."""
    x = limits
    return (
        F.when(bound.isNotNull(), "transition")
        .when((centroid >= x["texture_centroid"]) & (density <= x["texture_density"]), "texture")
        .when(silent, "melody")
        .when(has_channels & (drum >= x["drum_break"]) & (vocal <= x["drum_break_vocal"]), "drum_break")
        .when(has_channels & (vocal >= x["vocal_phrase"]), "vocal_phrase")
        .when(has_channels & (bass >= x["bass_phrase"]) & (drum <= x["bass_phrase_drum"]), "bass_phrase")
        .when((drum <= x["plain_drum"]) & (harmonicity >= x["plain_harmonicity"]), "melody_no_drums")
        .otherwise("melody"))


def basis(type_: Column, bound: Column, centroid: Column, density: Column, drum: Column, vocal: Column, bass: Column) -> Column:
    """The measures a type was decided on."""
    def m(**values):
        return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("double"))])
    d, v, b = (round_to(c, 3) for c in (drum, vocal, bass))
    return (
        F.when(type_ == "transition", m(bound=bound))
        .when(type_ == "texture", m(centroid=round_to(centroid, 0), density=round_to(density, 2)))
        .when(type_ == "drum_break", m(drum=d, vocal=v))
        .when(type_ == "vocal_phrase", m(vocal=v))
        .when(type_ == "bass_phrase", m(bass=b, drum=d))
        .otherwise(m(drum=d)))


def structure_position(start: Column, end: Column, nearest: Column, bounds: Column, type_: Column) -> Column:
    """Closeness of the window's center to a boundary for transitions, its complement for the
    other types; 0.5 with fewer than two boundaries."""
    center = (start + end) / 2.0
    scale = F.greatest((end - start) / 2.0, F.lit(1.0))
    close = clamp(1.0 - F.abs(center - nearest) / scale, 0.0, 1.0)
    known = F.when(type_ == "transition", close).otherwise(1.0 - close)
    return F.when(F.coalesce(bounds, F.lit(0)) < 2, F.lit(0.5)).otherwise(round_to(known, 4))


def channel_of(type_: Column, has_channels: Column) -> Column:
    pairs = [F.lit(x) for item in TYPE_CHANNEL.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[type_], F.when(has_channels, "other").otherwise("source"))


def score_map(**scores: Column) -> Column:
    return F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), v.cast("double"))])


def weighted_total(scores: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    return round_to(reduce(add, [F.coalesce(scores[k], F.lit(0.0)) * w for k, w in weights.items()]), 4)


def raw_total(scores: Column) -> Column:
    return F.aggregate(F.map_values(scores), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def gated_rubric(features: dict[str, Column], weights: dict[str, int] = RUBRIC, gates=GATES) -> Column:
    """Weighted sum, halved unless every gate is above 0."""
    raw = reduce(add, [features[k] * float(w) for k, w in weights.items()])
    open_ = reduce(lambda a, b: a & b, [features[g] > 0 for g in gates])
    return round_to(F.when(open_, raw).otherwise(raw * 0.5), 1)


def diversity_topk(df: DataFrame, keys: list[str], total: str, start: str, k: int = 2) -> DataFrame:
    """The best ``k`` rows per series and type."""
    return top_per(df, keys, [F.col(total).desc(), F.col(start), F.col("end")], k)


def rank_capped(df: DataFrame, type_: str, order: list[Column], cap: int, n: int) -> DataFrame:
    """Top ``n`` with at most ``cap`` rows per type. The cap keeps each type's first rows in the
    same order a greedy walk would, so capping first and cutting then gives the same list."""
    capped = top_per(df, [type_], order, cap, "_in_type").drop("_in_type")
    return capped.orderBy(*order).limit(n)


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("_quality", explain_quality(F.col("explain"), F.col("risks"))).withColumn(
        "_primary", type_matches(F.col("type"), PRIMARY_WORDS))


def select_hero(df: DataFrame, keys: list[str], total: str, ident: str) -> DataFrame:
    """One row per key: the best explained primary type among the first three, else among the
    first ten, else the first. Only the first ten rows per key are looked at."""
    order = [F.col(total).desc(), F.col("_quality").desc(), F.col(ident)]
    ten = top_per(_ranked(df), keys, order, 10, "_rank")
    tier = F.when(F.col("_primary") & (F.col("_rank") <= 3), 0).when(F.col("_primary"), 1).otherwise(2)
    quality = F.when(tier == 2, F.lit(0.0)).otherwise(F.col("_quality"))
    ordered = ten.withColumn("_tier", tier).withColumn("_q", quality)
    first = top_per(ordered, keys, [F.col("_tier"), F.col("_q").desc(), F.col("_rank")], 1, "_first")
    return first.select(*df.columns)


def select_supporting(df: DataFrame, hero: DataFrame, keys: list[str], total: str, ident: str,
                      asset: str, n: int = 2) -> DataFrame:
    """Up to ``n`` rows per key next to the hero: supporting types, other assets and other types
    first, then total and explanation."""
    known = hero.select(*keys, F.col(ident).alias("_hero"), F.col(asset).alias("_asset"), F.col("type").alias("_type"))
    rest = _ranked(df).join(known, keys).where(F.col(ident) != F.col("_hero"))
    order = [type_matches(F.col("type"), SUPPORTING_WORDS).desc(), (F.col(asset) != F.col("_asset")).desc(),
             (F.col("type") != F.col("_type")).desc(), F.col(total).desc(), F.col("_quality").desc(), F.col(ident)]
    return top_per(rest, keys, order, n).select(*df.columns, "rank")


def second_of_asset(df: DataFrame, chosen: DataFrame, asset: str, ident: str, total: str) -> DataFrame:
    """For each chosen row the best other row of the same asset."""
    known = chosen.select(asset, F.col(ident).alias("chosen"))
    others = df.join(known, asset).where(F.col(ident) != F.col("chosen"))
    return top_per(others, [asset], [F.col(total).desc(), F.col(ident)], 1).drop("rank")


def type_coverage(df: DataFrame, key: str, type_: str, types=TYPES) -> DataFrame:
    """Count per type, number of types and the missing ones."""
    counts = [F.count(F.when(F.col(type_) == t, 1)).alias(t) for t in types]
    out = df.groupBy(key).agg(*counts)
    found = reduce(add, [F.when(F.col(t) > 0, 1).otherwise(0) for t in types])
    missing = F.array_compact(F.array(*[F.when(F.col(t) == 0, F.lit(t)) for t in types]))
    return out.withColumn("found", found.cast("long")).withColumn("missing", missing)


def missing_reasons(coverage: Column, bounds: Column, has_channels: Column, windows: Column, skipped: Column) -> Column:
    """Why types are missing, from the array of missing types and the window counts."""
    lacks = lambda t: F.array_contains(coverage, t)
    flags = F.array_compact(F.array(
        F.when(lacks("transition"), F.when(bounds < 3, "few_segments").otherwise("no_window_on_bound")),
        F.when(lacks("texture"), "no_bright_sparse_part"),
        F.when(~has_channels, "no_channels"),
        F.when(lacks("melody_no_drums") & ~lacks("melody"), "drums_throughout"),
        F.when(windows == 0, "too_short").when(skipped > 0, "silent_windows"),
    ))
    return F.when(F.size(flags) == 0, F.array(F.lit("uniform"))).otherwise(flags)
