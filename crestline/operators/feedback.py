"""Feedback validation, attribution and the weights derived from it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, round_to

# Dimensions, reason codes and verdicts.
DIMENSIONS = ("sample", "chop", "drums", "bass", "structure", "overall")
REASONS = ("sample_meh", "chop_fragmented", "too_similar", "drums_off", "too_rigid", "no_space", "worth_keeping")
VERDICTS = ("keep", "reject", "regenerate", "export", "rated")
KEEP_VERDICTS = ("kept", "keep", "liked", "retained")
REJECT_VERDICTS = ("rejected", "reject", "disliked", "regenerate")

# Change of a kind's prior per reject reason.
REASON_DELTA = {
    "chop_fragmented": ("chop", -0.10),
    "too_similar": ("loop", -0.10),
    "too_rigid": ("chop", -0.05),
    "no_space": ("stem", -0.05),
}

# Base priors, and multipliers of the global prior per reason code.
SOURCE_PRIOR = {"loop": 0.34, "chop": 0.33, "stem": 0.33}
GLOBAL_PRIOR = {"loop": 0.33, "chop": 0.34, "stem": 0.33}
REASON_FACTOR = {
    "chop_fragmented": (("chop", 0.85),),
    "too_similar": (("loop", 0.85), ("loop", 0.9)),
    "no_space": (("stem", 0.9),),
    "drums_off": (("stem", 1.05),),
}
LOW_DIMENSION = {"chop": "chop", "sample": "loop"}
LOW_FACTOR = 0.9


def normalise_dims(dims: Column) -> Column:
    """Known dimensions with a whole part of 1..5."""
    whole = F.transform_values(dims, lambda k, v: F.floor(v).cast("int"))
    return F.map_filter(whole, lambda k, v: k.isin(*DIMENSIONS) & v.between(1, 5))


def normalise_reasons(reasons: Column) -> Column:
    return F.filter(reasons, lambda r: r.isin(*REASONS))


def verdict_of(verdict: Column) -> Column:
    """The verdict as stored: without one (null, empty, white space) a candidate is only rated."""
    return F.coalesce(F.nullif(F.trim(verdict), F.lit("")), F.lit("rated"))


def rejects(run: Column, candidate: Column, verdict: Column) -> dict[str, Column]:
    """Rules of a feedback row, for ``catalog.quarantine``."""
    empty = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return {"missing_id": empty(run) | empty(candidate),
            "bad_verdict": ~verdict_of(verdict).isin(*VERDICTS)}


def source_of(hero: dict[str, Column], manifest: dict[str, Column], samples: Column) -> Column:
    """Source of a candidate's hero by a fixed order of fallbacks."""
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(*[filled(hero[k]) for k in ("source_id", "source", "asset_id") if k in hero],
                      *[filled(manifest[k]) for k in ("source_id", "hero_source_id") if k in manifest],
                      F.try_element_at(samples, F.lit(1)))


def attribute(rows: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Feedback rows with the source of their candidate (NULL when the candidate is gone)."""
    return rows.join(candidates, keys, "left")


def source_penalties(attributed: DataFrame, source: str, verdict: str) -> DataFrame:
    """Minus one per rejected candidate of a source."""
    rejected = attributed.where((F.col(verdict) == "reject") & F.col(source).isNotNull())
    return rejected.groupBy(source).agg((-F.count(F.lit(1))).alias("penalty"))


def kind_deltas(rows: DataFrame, verdict: str, reasons: str) -> DataFrame:
    """Sum of the prior changes of all reject reasons per kind; unmapped reasons are ignored."""
    kinds = F.create_map(*[x for r, (k, _) in REASON_DELTA.items() for x in (F.lit(r), F.lit(k))])
    deltas = F.create_map(*[x for r, (_, d) in REASON_DELTA.items() for x in (F.lit(r), F.lit(d))])
    each = rows.where(F.col(verdict) == "reject").select(F.explode(reasons).alias("reason"))
    mapped = each.select(kinds[F.col("reason")].alias("kind"), deltas[F.col("reason")].alias("delta")).where("kind is not null")
    return mapped.groupBy("kind").agg(round_to(F.sum("delta"), 2).alias("delta"), F.count(F.lit(1)).alias("n"))


def source_priors(rows: DataFrame, source: str, kind: str, verdict: str, base: dict[str, float] = SOURCE_PRIOR,
                  up: float = 0.15, down: float = 0.25) -> DataFrame:
    """Prior per source and kind: up with keeps, down with rejects, within 0.05..0.9."""
    known = rows.where(F.lower(kind).isin(*base))
    counts = []
    for k in base:
        mine = F.lower(kind) == k
        counts += [F.count(F.when(mine & F.lower(verdict).isin(*KEEP_VERDICTS), 1)).alias(f"{k}_kept"),
                   F.count(F.when(mine & F.lower(verdict).isin(*REJECT_VERDICTS), 1)).alias(f"{k}_rejected")]
    grouped = known.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias(source)).agg(*counts)
    priors = [round_to(clamp(p * (1.0 + up * F.col(f"{k}_kept")) * (1.0 - down * F.col(f"{k}_rejected")), 0.05, 0.9), 4).alias(k)
              for k, p in base.items()]
    return grouped.select(source, *priors)


def feedback_scores(df: DataFrame, total: str, source: str, kind: str, penalties: DataFrame, priors: DataFrame,
                    base: dict[str, float] = SOURCE_PRIOR, step: float = 0.1, name: str = "adjusted") -> DataFrame:
    """Candidates with a score that feedback has changed: ``total``, times the prior of the source for the candidate's kind
    over the base prior of that kind, divided by 1 + ``step`` for each rejected candidate of the source.

    ``penalties`` and ``priors`` are what :func:`source_penalties` and :func:`source_priors` return, one row per source. A
    source without feedback, and a kind outside of ``base``, change nothing; a null source is the source ``unknown``. A
    score never turns negative or zero by feedback, so equal ones keep their order among themselves.
    """
    both = penalties.select(F.col(source).alias("_source"), F.col("penalty").alias("_penalty")).join(
        priors.select(F.col(source).alias("_source"), *[F.col(k).alias(f"_{k}") for k in base]), "_source", "full")
    rows = df.join(both, F.coalesce(F.col(source), F.lit("unknown")) == F.col("_source"), "left")
    ratio = F.lit(1.0)
    for k, p in base.items():
        ratio = F.when(F.lower(kind) == k, F.coalesce(F.col(f"_{k}"), F.lit(p)) / p).otherwise(ratio)
    less = 1.0 - step * F.coalesce(F.col("_penalty"), F.lit(0))
    return rows.select(*[F.col(c) for c in df.columns], round_to(F.col(total) * ratio / less, 6).alias(name))


def global_prior(rows: DataFrame, reasons: str, dims: str, base: dict[str, float] = GLOBAL_PRIOR) -> DataFrame:
    """One row per kind: the base prior times all factors, normalised to 1; the rounding rest goes
    to the largest. The product is a sum of logs, so it is one aggregate with map-side combine."""
    logs = {k: F.lit(0.0) for k in base}
    for reason, factors in REASON_FACTOR.items():
        hits = F.size(F.filter(reasons, lambda r: r == reason))
        for kind, factor in factors:
            logs[kind] = logs[kind] + F.ln(F.lit(factor)) * F.coalesce(hits, F.lit(0))
    for dim, kind in LOW_DIMENSION.items():
        low = F.coalesce((F.col(dims)[dim] > 0) & (F.col(dims)[dim] < 3), F.lit(False))
        logs[kind] = logs[kind] + F.when(low, F.ln(F.lit(LOW_FACTOR))).otherwise(0.0)
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(k) for k, c in logs.items()])
    raw = {k: p * F.exp(F.col(k)) for k, p in base.items()}
    total = sum(raw.values(), F.lit(0.0))
    shares = sums.select(*[round_to(v / total, 4).alias(k) for k, v in raw.items()])
    rest = F.lit(1.0) - sum((F.col(k) for k in base), F.lit(0.0))
    largest = F.array_max(F.array(*[F.struct(F.col(k).alias("v"), F.lit(-i).alias("i")) for i, k in enumerate(base)]))["i"]
    rows_ = F.array(*[F.struct(F.lit(k).alias("kind"), round_to(F.col(k) + F.when(largest == -i, rest).otherwise(0.0), 4).alias("prior"))
                      for i, k in enumerate(base)])
    return shares.select(F.explode(rows_).alias("_r")).select("_r.kind", "_r.prior")


def kind_order(priors: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Kinds by falling prior, equal ones in their own order (three rows)."""
    from pyspark.sql import Window
    position = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    rank = F.row_number().over(Window.orderBy(F.col("prior").desc(), position))
    return priors.where(F.col("kind").isin(*kinds)).withColumn("position", rank)


def kept_rate(rows: DataFrame, groups: list[str], run: str, kept: Column) -> DataFrame:
    """Runs, runs with a kept candidate and their share, per group and in total."""
    runs = rows.groupBy(*groups, run).agg(F.max(F.when(kept, 1).otherwise(0)).alias("_kept"))
    return runs.rollup(*groups).agg(F.count(F.lit(1)).alias("runs"), F.sum("_kept").alias("kept_runs"),
                                    round_to(F.avg("_kept"), 6).alias("rate"))


def regeneration_requests(rows: DataFrame, verdict: str) -> DataFrame:
    return rows.where(F.col(verdict) == "regenerate")
