"""Windows, their features, types, scores and rankings over the event series."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import frames as FR
from ..operators import grid as G
from ..operators import moments as M
from ..operators import ordered as O
from ..operators.ranged import persisted
from .base import (BOUNDS, CHANNELS, CLASSIFIED, DIMENSIONS, EV, FEATURES, HOURLY, MOMENTS, SPANS, TOP2,
                   WINDOWS, classified, features, moments, points, query, r, scored, silence_bounds, spans, windows)


@query(f"""WITH {EV}, {SPANS}, {WINDOWS} SELECT series_id, size, index, start, "end" FROM windows""")
def windows_multires(spark, sf):
    return windows(spark, sf).select("series_id", "size", "index", "start", "end")


@query(f"""WITH {EV}, {SPANS}, {HOURLY}, {WINDOWS}, {FEATURES} SELECT series_id, size, index, points, frames,
  {r("rms", 4)} AS rms, {r("stability", 4)} AS stability, {r("crest", 4)} AS crest, {r("headroom", 4)} AS headroom,
  {r("points / (\"end\" - start)", 4)} AS density FROM features""")
def window_features(spark, sf):
    f = features(spark, sf)
    density = F.col("points") / (F.col("end") - F.col("start"))
    return f.select("series_id", "size", "index", "points", "frames",
                    *[S.round_to(F.col(c), 4).alias(c) for c in ("rms", "stability", "crest", "headroom")],
                    S.round_to(density, 4).alias("density"))


@query(f"WITH {EV}, {BOUNDS} SELECT series_id, bound FROM bounds")
def window_boundaries(spark, sf):
    return silence_bounds(spark, sf)


@query(f"""WITH {EV}, {SPANS}, {HOURLY}, {WINDOWS}, {FEATURES}, {BOUNDS}, {CLASSIFIED}
SELECT series_id, size, index, nearest, bound AS first_inside FROM classified""")
def nearest_boundary(spark, sf):
    bounds = silence_bounds(spark, sf)
    rows = features(spark, sf).select("series_id", "size", "index", "start", "end",
                                      ((F.col("start") + F.col("end")) / 2.0).alias("center"))
    found = O.first_inside(rows, bounds, ["series_id"], "bound", "first_inside", parts=None)
    near = O.nearest(found, bounds, ["series_id"], "center", "bound", "nearest", parts=None)
    return near.select("series_id", "size", "index", "nearest", "first_inside")


@query(f"""WITH {EV}, {SPANS}, {HOURLY}, {WINDOWS}, {FEATURES}, {BOUNDS}, {CLASSIFIED}
SELECT series_id, size, index, type, CASE type WHEN 'drum_break' THEN 'drums' WHEN 'vocal_phrase' THEN 'vocal'
  WHEN 'bass_phrase' THEN 'bass' ELSE 'other' END AS channel, drum, vocal, bass,
  CASE type WHEN 'transition' THEN 'bound' WHEN 'texture' THEN 'centroid,density' WHEN 'drum_break' THEN 'drum,vocal'
  WHEN 'vocal_phrase' THEN 'vocal' WHEN 'bass_phrase' THEN 'bass,drum' ELSE 'drum' END AS basis FROM classified""")
def classify_windows(spark, sf):
    df = classified(spark, sf)
    basis = M.basis(F.col("type"), F.col("bound"), F.col("centroid"), F.col("density"), F.col("drum"), F.col("vocal"), F.col("bass"))
    return df.select("series_id", "size", "index", "type", M.channel_of(F.col("type"), F.lit(True)).alias("channel"),
                     "drum", "vocal", "bass", F.array_join(F.array_sort(F.map_keys(basis)), ",").alias("basis"))


@query(f"WITH {MOMENTS} SELECT series_id, size, index, {', '.join(DIMENSIONS)} FROM scored")
def score_windows(spark, sf):
    return scored(spark, sf).select("series_id", "size", "index", *[F.col("scores")[d].alias(d) for d in DIMENSIONS])


@query(f"WITH {MOMENTS} SELECT series_id, size, index, type, total_score FROM scored")
def moment_total(spark, sf):
    return scored(spark, sf).select("series_id", "size", "index", "type", "total_score")


@query(f"""WITH {MOMENTS}, {TOP2} SELECT moment_id, series_id, type, start, "end", total_score FROM top2""")
def diversity_topk(spark, sf):
    return moments(spark, sf).select("moment_id", "series_id", "type", "start", "end", "total_score")


@query(f"""WITH {MOMENTS}, {TOP2}, capped AS (SELECT * FROM top2
  QUALIFY row_number() OVER (PARTITION BY type ORDER BY total_score DESC, series_id, type, start, "end") <= 2)
SELECT moment_id, type, total_score FROM capped ORDER BY total_score DESC, series_id, type, start, "end" LIMIT 10""")
def rank_capped(spark, sf):
    order = [F.col("total_score").desc(), F.col("series_id"), F.col("type"), F.col("start"), F.col("end")]
    return M.rank_capped(moments(spark, sf), "type", order, 2, 10).select("moment_id", "type", "total_score")


@query(f"""WITH {MOMENTS}, {TOP2} SELECT moment_id, {r("raw_score", 4)} AS raw_score,
  row_number() OVER (PARTITION BY series_id ORDER BY {r("raw_score", 4)} DESC, moment_id) AS rank FROM top2
  QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY {r("raw_score", 4)} DESC, moment_id) <= 3""")
def raw_sum_rank(spark, sf):
    df = moments(spark, sf).withColumn("raw_score", S.round_to(M.raw_total(F.col("scores")), 4))
    top = O.top_per(df, ["series_id"], [F.col("raw_score").desc(), F.col("moment_id")], 3)
    return top.select("moment_id", "raw_score", F.col("rank").cast("long").alias("rank"))


HERO = f"""said AS (SELECT *, series_id % 10 AS collection, {r("raw_score", 4)} AS raw4,
    contains(replace(type, '_', ' '), 'melod') OR contains(type, 'vocal') OR contains(type, 'bass') AS is_primary,
    1 + least(length('type ' || type || ' window ' || printf('%.1f-%.1f', start, "end") || ' best ' || (
      SELECT string_agg(k || '=' || printf('%.2f', v), ',' ORDER BY v DESC, k) FROM (
        SELECT k, v FROM (VALUES {', '.join(f"('{d}', {d})" for d in DIMENSIONS)}) x(k, v) ORDER BY v DESC, k LIMIT 3)))
      / 200.0, 1) + 0.5 AS quality FROM top2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY raw4 DESC, quality DESC, moment_id) AS rank FROM said),
hero AS (SELECT * FROM ranked WHERE rank <= 10 QUALIFY row_number() OVER (PARTITION BY collection ORDER BY
    CASE WHEN is_primary AND rank <= 3 THEN 0 WHEN is_primary THEN 1 ELSE 2 END,
    CASE WHEN is_primary THEN quality ELSE 0 END DESC, rank) = 1)"""


def _hero_pool(spark, sf):
    """Moments are a catalog table that is read several times; here a checkpoint stands for it."""
    return persisted(moments(spark, sf)).withColumn("collection", F.col("series_id") % 10).withColumn(
        "raw_score", S.round_to(M.raw_total(F.col("scores")), 4))


@query(f"WITH {MOMENTS}, {TOP2}, {HERO} SELECT collection, moment_id, type, raw4 AS raw_score FROM hero")
def select_hero(spark, sf):
    return M.select_hero(_hero_pool(spark, sf), ["collection"], "raw_score", "moment_id").select(
        "collection", "moment_id", "type", "raw_score")


@query(f"""WITH {MOMENTS}, {TOP2}, {HERO}, rest AS (SELECT s.*, row_number() OVER (PARTITION BY s.collection ORDER BY
    s.type IN ('texture', 'transition', 'drum_break') DESC, (s.series_id <> h.series_id) DESC, (s.type <> h.type) DESC,
    s.raw4 DESC, s.quality DESC, s.moment_id) AS place
  FROM said s JOIN hero h ON h.collection = s.collection AND h.moment_id <> s.moment_id)
SELECT collection, moment_id, type, place AS rank FROM rest WHERE place <= 2""")
def select_supporting(spark, sf):
    pool = _hero_pool(spark, sf)
    hero = M.select_hero(pool, ["collection"], "raw_score", "moment_id")
    picked = M.select_supporting(pool, hero, ["collection"], "raw_score", "moment_id", "series_id")
    return picked.select("collection", "moment_id", "type", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {MOMENTS}, {TOP2}, {HERO}, others AS (SELECT t.series_id, h.moment_id AS chosen, t.moment_id, t.total_score
  FROM top2 t JOIN hero h ON h.series_id = t.series_id AND h.moment_id <> t.moment_id)
SELECT series_id, chosen, moment_id FROM others
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY total_score DESC, moment_id) = 1""")
def second_moment(spark, sf):
    pool = _hero_pool(spark, sf)
    hero = M.select_hero(pool, ["collection"], "raw_score", "moment_id")
    second = M.second_of_asset(pool, hero, "series_id", "moment_id", "total_score")
    return second.select("series_id", "chosen", "moment_id")


@query(f"""WITH {MOMENTS}, flags AS (SELECT series_id, size, index, list_filter([
    CASE WHEN vocal_state > 0.15 THEN 'vocal' END, CASE WHEN key_stability < 0.4 THEN 'unstable_key' END,
    CASE WHEN drum_state > 0.5 AND type IN ('melody', 'melody_no_drums') THEN 'strong_drums' END,
    CASE WHEN start < 0.5 OR "end" > duration - 0.5 THEN 'edge' END, 'no_tempo',
    CASE WHEN 20 * log10(rms / 500.0 + 1e-9) < -30 THEN 'low_level' END], lambda x: x IS NOT NULL) AS f FROM scored)
SELECT series_id, size, index, array_to_string(f, ',') AS risks FROM flags""")
def risk_flags(spark, sf):
    df = scored(spark, sf)
    flags = S.risks(F.col("type"), F.col("start"), F.col("end"), F.col("scores"), F.lit(True), F.lit(None).cast("double"),
                    F.col("duration"), S.decibels(F.col("rms") / 500.0))
    return df.select("series_id", "size", "index", F.array_join(flags, ",").alias("risks"))


@query(f"""WITH {MOMENTS}, {TOP2} SELECT moment_id, 'type ' || type AS type_line,
  printf('window %.1f-%.1f', start, "end") AS window_line,
  'best ' || (SELECT string_agg(k || '=' || printf('%.2f', {r("v", 2)}), ',' ORDER BY v DESC, k) FROM (
    SELECT k, v FROM (VALUES {', '.join(f"('{d}', {d})" for d in DIMENSIONS)}) x(k, v) ORDER BY v DESC, k LIMIT 3)) AS best_line
FROM top2""")
def explain_lines(spark, sf):
    e = F.col("explain")
    return moments(spark, sf).select("moment_id", e[0].alias("type_line"), e[1].alias("window_line"), e[2].alias("best_line"))


@query(f"""WITH {MOMENTS}, {TOP2}, counts AS (SELECT series_id, {', '.join(f"count(*) FILTER (type = '{t}') AS {t}" for t in M.TYPES)} FROM top2 GROUP BY 1)
SELECT *, ({' + '.join(f'({t} > 0)::INT' for t in M.TYPES)})::BIGINT AS found,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {t} = 0 THEN '{t}' END" for t in M.TYPES)}], lambda x: x IS NOT NULL), ',') AS missing FROM counts""")
def type_coverage(spark, sf):
    df = M.type_coverage(moments(spark, sf), "series_id", "type")
    return df.withColumn("missing", F.array_join("missing", ","))


@query(f"""WITH {MOMENTS}, {TOP2}, found AS (SELECT series_id, list(DISTINCT type) AS f FROM top2 GROUP BY 1),
w AS (SELECT series_id, any_value(n_bounds) AS n_bounds, count(*) AS n FROM scored GROUP BY 1),
x AS (SELECT w.series_id, list_filter([CASE WHEN NOT list_contains(f, 'transition') THEN CASE WHEN coalesce(n_bounds, 0) < 3 THEN 'few_segments' ELSE 'no_window_on_bound' END END,
  CASE WHEN NOT list_contains(f, 'texture') THEN 'no_bright_sparse_part' END,
  CASE WHEN NOT list_contains(f, 'melody_no_drums') AND list_contains(f, 'melody') THEN 'drums_throughout' END], lambda y: y IS NOT NULL) AS why FROM w JOIN found ON found.series_id = w.series_id)
SELECT series_id, CASE WHEN len(why) = 0 THEN 'uniform' ELSE array_to_string(why, ',') END AS reasons FROM x""")
def missing_type_reasons(spark, sf):
    rows = scored(spark, sf)
    best = M.diversity_topk(rows, ["series_id", "type"], "total_score", "start")
    found = M.type_coverage(best, "series_id", "type").select("series_id", "missing")
    counts = rows.groupBy("series_id").agg(F.first("n_bounds").alias("bounds"), F.count(F.lit(1)).alias("windows"))
    why = M.missing_reasons(F.col("missing"), F.coalesce("bounds", F.lit(0)), F.lit(True), F.col("windows"), F.lit(0))
    return counts.join(found, "series_id").select("series_id", F.array_join(why, ",").alias("reasons"))


@query(f"""WITH {EV}, {SPANS}, tempo AS (SELECT *, 60.0 + (series_id % 5) * 40 AS tempo, duration / 20.0 AS seconds FROM spans),
sized AS (SELECT *, least(greatest(1, least(6, 2 * 240.0 / least(240.0, greatest(40.0, tempo)))), 6) AS size FROM tempo WHERE seconds >= 0.5),
cells AS (SELECT *, unnest(generate_series(0, greatest(0, floor((seconds - size + 1e-6) / (size / 2.0)))::BIGINT)) AS index FROM sized)
SELECT series_id, index, {r("index * (size / 2.0)", 4)} AS start, {r("least(index * (size / 2.0) + size, seconds)", 4)} AS "end" FROM cells""")
def phrase_windows(spark, sf):
    s = spans(spark, sf).withColumn("seconds", F.col("duration") / 20.0)
    tempo = 60.0 + (F.col("series_id") % 5) * 40
    out = G.phrase_windows(s, "series_id", "seconds", tempo)
    return out.select("series_id", "index", *[S.round_to(F.col(c), 4).alias(c) for c in ("start", "end")])


@query(f"""WITH {EV}, {SPANS}, tempo AS (SELECT series_id, duration / 20.0 AS seconds, CASE series_id % 4 WHEN 0 THEN NULL ELSE 30.0 + (series_id % 4) * 60 END AS tempo FROM spans),
sizes AS (SELECT *, CASE WHEN tempo IS NULL THEN p ELSE least(16.0, 240.0 / greatest(40.0, least(240.0, tempo)) * b) END AS s
  FROM tempo, (VALUES (1.0::DOUBLE, 2.0::DOUBLE), (2, 4), (4, 8), (8, 16)) v(b, p)),
sized AS (SELECT DISTINCT series_id, seconds, tempo, least(s, seconds) AS size FROM sizes WHERE least(s, seconds) >= 2 - 1e-6 AND seconds >= 2),
cells AS (SELECT *, unnest(generate_series(0, floor((seconds - size + 1e-6) / (size / 2.0))::BIGINT)) AS index FROM sized),
w AS (SELECT series_id, tempo, {r("index * (size / 2.0)", 3)} AS start, {r("least(index * (size / 2.0) + size, seconds)", 3)} AS "end" FROM cells)
SELECT series_id, start, "end", {r('("end" - start) / (240.0 / greatest(40.0, least(240.0, tempo)))', 2)} AS bars FROM w""")
def windows_by_tempo(spark, sf):
    s = spans(spark, sf).withColumn("seconds", F.col("duration") / 20.0).withColumn(
        "tempo", F.when(F.col("series_id") % 4 != 0, 30.0 + (F.col("series_id") % 4) * 60))
    sized = s.withColumn("_sizes", G.tempo_sizes(F.col("tempo")))
    keyed = G.multires_windows(sized, "series_id", "seconds", F.col("_sizes"))
    out = keyed.join(s.select("series_id", "tempo"), "series_id")
    bars = S.round_to((F.col("end") - F.col("start")) / G.bar_seconds(F.col("tempo")), 2)
    return out.select("series_id", "start", "end", bars.alias("bars"))


@query(f"""WITH {EV}, {SPANS}, {HOURLY}, {WINDOWS}, {FEATURES}
SELECT size, count(*) AS windows, count(*) FILTER (20 * log10(rms + 1e-9) < 32) AS skipped FROM features GROUP BY 1""")
def silence_skipped(spark, sf):
    quiet = S.decibels(F.col("rms")) < 32.0
    return features(spark, sf).groupBy("size").agg(F.count(F.lit(1)).alias("windows"), F.count(F.when(quiet, 1)).alias("skipped"))


@query(f"""WITH {EV}, {SPANS}, {HOURLY}, {WINDOWS}, {FEATURES}
SELECT series_id, size, index, {r("20 * log10(rms + 1e-9)", 4)} AS level_db,
  CASE WHEN peak > 1e-6 THEN {r("greatest(-30, least(30, -6 - 20 * log10(peak / 500)))", 1)} ELSE 0 END AS gain_hint FROM features""")
def loudness_db(spark, sf):
    return features(spark, sf).select("series_id", "size", "index", S.round_to(S.decibels(F.col("rms")), 4).alias("level_db"),
                                      S.gain_hint(F.col("peak") / 500.0).alias("gain_hint"))


@query(f"""WITH {EV}, {SPANS}, {HOURLY}, {WINDOWS}, {FEATURES}
SELECT series_id, size, index, {r("greatest(0, least(1, 0.6 * headroom + 0.4 * crest))", 4)} AS space,
  {r("0.7 * crest + 0.3 * least(1, sqrt(view_s2) / (sqrt(click_s2) + 1e-9))", 4)} AS dynamics FROM features""")
def space_dynamics(spark, sf):
    width = S.clamp(F.sqrt("view_s2") / (F.sqrt("click_s2") + 1e-9), 0.0, 1.0)
    return features(spark, sf).select("series_id", "size", "index", S.round_to(FR.space(F.col("headroom"), F.col("crest")), 4).alias("space"),
                                      S.round_to(FR.dynamics(F.col("crest"), width), 4).alias("dynamics"))
