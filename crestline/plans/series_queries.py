"""Series queries: ordered folds, envelopes, channels and vectors."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import folds as D
from ..operators import frames as FR
from ..operators import grid as G
from ..operators import ordered as O
from ..operators import vector_features as VF
from .base import BOUNDS, DIMS, EV, FILLED, HOURLY, PEAKS, SPANS, hourly, hourly_filled, peak_rows, points, query, r, silence_bounds, spans, table

HOUR = 3_600_000_000


def _with_spans(spark, sf):
    """Points with the duration of their series; the points of one series may be very many."""
    return points(spark, sf).join(spans(spark, sf), "series_id")


# --- ordered rows ------------------------------------------------------------------------

@query(f"""WITH {EV}, {SPANS}, n AS (SELECT e.*, duration, lead(t) OVER (PARTITION BY e.series_id ORDER BY us, event_id) AS nxt FROM ev e JOIN spans s ON s.series_id = e.series_id)
SELECT series_id, event_id, {r("greatest(least(coalesce(nxt, t + 24), t + 24, duration), t + 0.5)", 6)} AS "end" FROM n""")
def segments(spark, sf):
    both = _with_spans(spark, sf)
    cut = O.segments(both, ["series_id"], ["t", "event_id"], 24.0, 0.5, "duration")
    return cut.select("series_id", "event_id", S.round_to(F.col("end"), 6).alias("end"))


@query(f"""WITH {EV}, {SPANS}, m AS (SELECT series_id, t FROM ev UNION SELECT series_id, 0 FROM spans UNION SELECT series_id, duration FROM spans),
n AS (SELECT *, lead(t) OVER (PARTITION BY series_id ORDER BY t) AS nxt FROM m)
SELECT series_id, {r("t", 6)} AS start, {r("nxt", 6)} AS "end" FROM n WHERE nxt - t >= 6""")
def segments_min(spark, sf):
    cut = O.pieces(points(spark, sf), spans(spark, sf), ["series_id"], "t", "duration", 6.0)
    return cut.select("series_id", *[S.round_to(F.col(c), 6).alias(c) for c in ("start", "end")])


@query(f"""WITH {EV}, s AS (SELECT series_id, event_id, us // 60000000 AS tick, 1 AS kind FROM ev
  UNION ALL SELECT series_id, event_id, us // 60000000 + greatest(1, floor(value)::BIGINT), 0 FROM ev)
SELECT series_id, event_id, tick, kind, tick - coalesce(lag(tick) OVER (PARTITION BY series_id ORDER BY tick, kind, event_id), 0) AS delta FROM s""")
def delta_encode(spark, sf):
    notes = points(spark, sf).select("series_id", "event_id", F.floor(F.col("us") / 60_000_000).alias("tick"), F.floor("value").alias("length"))
    return O.delta_encode(notes, ["series_id"], "tick", "length", "event_id")


@query(f"""WITH RECURSIVE {EV}, nx AS (SELECT a.series_id, a.event_id, a.us, b.event_id AS next_id, b.us AS next_us FROM ev a LEFT JOIN ev b ON b.series_id = a.series_id
    AND b.us - a.us >= {12 * HOUR} QUALIFY row_number() OVER (PARTITION BY a.event_id ORDER BY b.us, b.event_id) = 1),
k AS (SELECT series_id, min_by(event_id, (us, event_id)) AS event_id FROM ev GROUP BY 1
  UNION ALL SELECT k.series_id, nx.next_id FROM k JOIN nx ON nx.event_id = k.event_id WHERE nx.next_id IS NOT NULL)
SELECT series_id, event_id FROM k""")
def thin_greedy(spark, sf):
    return D.thin(points(spark, sf), "series_id", "us", "event_id", 12.0 * HOUR).select("series_id", "event_id")


@query(f"""WITH RECURSIVE {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY us, event_id) AS k FROM ev),
f AS (SELECT series_id, k, us AS at, event_id AS id, value AS s, NULL::BIGINT AS closed FROM n WHERE k = 1
  UNION ALL SELECT n.series_id, n.k, CASE WHEN n.us - f.at >= {6 * HOUR} OR n.value > f.s THEN n.us ELSE f.at END,
    CASE WHEN n.us - f.at >= {6 * HOUR} OR n.value > f.s THEN n.event_id ELSE f.id END,
    CASE WHEN n.us - f.at >= {6 * HOUR} OR n.value > f.s THEN n.value ELSE f.s END,
    CASE WHEN n.us - f.at >= {6 * HOUR} THEN f.id END FROM f JOIN n ON n.series_id = f.series_id AND n.k = f.k + 1),
done AS (SELECT series_id, closed AS event_id FROM f WHERE closed IS NOT NULL
  UNION ALL SELECT series_id, max_by(id, k) FROM f GROUP BY 1)
SELECT d.series_id, d.event_id, e.value FROM done d JOIN ev e ON e.event_id = d.event_id""")
def merge_stronger(spark, sf):
    return D.merge_stronger(points(spark, sf), "series_id", "us", "event_id", "value", 6.0 * HOUR).select("series_id", "event_id", "value")


@query(f"""WITH RECURSIVE {EV}, {SPANS}, {BOUNDS}, b AS (SELECT series_id, bound, row_number() OVER (PARTITION BY series_id ORDER BY bound) AS k FROM (SELECT DISTINCT series_id, bound FROM bounds)),
f AS (SELECT series_id, k, bound AS kept, true AS is_kept FROM b WHERE k = 1
  UNION ALL SELECT b.series_id, b.k, CASE WHEN b.bound - f.kept >= 48 THEN b.bound ELSE f.kept END, b.bound - f.kept >= 48 FROM f JOIN b ON b.series_id = f.series_id AND b.k = f.k + 1),
kept AS (SELECT series_id, kept AS bound FROM f WHERE is_kept)
SELECT series_id, bound FROM kept UNION ALL SELECT s.series_id, s.duration FROM spans s LEFT JOIN (SELECT series_id, max(bound) AS last FROM kept GROUP BY 1) m ON m.series_id = s.series_id
WHERE m.last IS NULL OR s.duration - m.last > 48""")
def structure_bounds(spark, sf):
    """Silence boundaries, at least 48 hours apart, closed by the end of the series."""
    marks = silence_bounds(spark, sf).distinct().withColumn("id", F.col("bound").cast("long"))
    kept = D.thin(marks, "series_id", "bound", "id", 48.0, max_rows=None)
    return D.with_span_end(kept, spans(spark, sf), "series_id", "bound", "duration", 48.0)


# --- envelopes ---------------------------------------------------------------------------

@query(f"""WITH {EV}, {HOURLY}, {FILLED} SELECT series_id, bin, {r("avg(s1) OVER (PARTITION BY series_id ORDER BY bin ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)", 4)} AS smooth FROM filled""")
def moving_avg(spark, sf):
    soft = FR.moving_average(hourly_filled(spark, sf), "series_id", "s1", 12, "smooth")
    return soft.select("series_id", "bin", S.round_to(F.col("smooth"), 4).alias("smooth"))


@query(f"WITH RECURSIVE {EV}, {HOURLY}, {FILLED}, {PEAKS} SELECT series_id, bin, {r('s1', 4)} AS strength FROM picks")
def peaks(spark, sf):
    return peak_rows(hourly_filled(spark, sf)).select("series_id", "bin", S.round_to(F.col("s1"), 4).alias("strength"))


@query(f"""WITH RECURSIVE {EV}, {HOURLY}, {FILLED}, {PEAKS}, w AS (SELECT series_id, max(s1) AS top, count(*) AS len FROM filled GROUP BY 1),
p AS (SELECT series_id, count(*) AS n, avg(s1) AS mean FROM picks GROUP BY 1)
SELECT w.series_id, coalesce(n, 0) AS peaks, {r("CASE WHEN top >= 1e-4 AND len >= 10 THEN greatest(0, least(1, 0.5 * coalesce(n, 0) / 200.0 + 0.5 * coalesce(mean / top, 0))) ELSE 0 END", 4)} AS memorability
FROM w LEFT JOIN p ON p.series_id = w.series_id""")
def memorability(spark, sf):
    frames = hourly_filled(spark, sf)
    out = FR.memorability(frames, peak_rows(frames), "series_id", "s1", full=200.0)
    return out.withColumn("memorability", S.round_to(F.col("memorability"), 4))


@query(f"""WITH {EV}, {HOURLY}, {FILLED}, m AS (SELECT series_id, max(s1) AS top, min(bin) AS lo, max(bin) AS hi FROM filled GROUP BY 1),
a AS (SELECT f.series_id, min(bin) AS loudest, any_value(top) AS top, any_value(lo) AS lo, any_value(hi) AS hi FROM filled f JOIN m ON m.series_id = f.series_id AND f.s1 = m.top GROUP BY 1),
b AS (SELECT a.series_id, min(f.bin) AS below FROM a JOIN filled f ON f.series_id = a.series_id AND f.bin > a.loudest AND f.s1 < 0.1 * a.top GROUP BY 1)
SELECT a.series_id, loudest, coalesce(below - loudest, hi - lo + 1) AS decay FROM a LEFT JOIN b ON b.series_id = a.series_id""")
def decay(spark, sf):
    return FR.decay(hourly_filled(spark, sf), "series_id", "s1")


@query(f"""WITH {EV}, {HOURLY}, {FILLED}, soft AS (SELECT series_id, s1, avg(s1) OVER (PARTITION BY series_id ORDER BY bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS soft,
  max(s1) OVER (PARTITION BY series_id) AS top FROM filled),
st AS (SELECT series_id, avg(s1) AS mean, stddev_pop(s1) AS dev, avg(soft) AS sm, stddev_pop(soft) AS sd, avg(CASE WHEN s1 > 0.2 * top THEN 1.0 ELSE 0 END) AS active FROM soft GROUP BY 1),
p AS (SELECT series_id, mean, dev / mean AS raw, greatest(0, least(1, (sd / sm) / (dev / mean))) AS kept, greatest(0, least(1, sd / sm / 0.3)) AS depth, greatest(0, least(1, (active + 0.4 - 0.25) / 0.55)) AS duty0,
  greatest(0, least(1, (active - 0.25) / 0.55)) AS duty FROM st)
SELECT series_id, {r("kept", 4)} AS kept, {r("depth", 4)} AS depth, {r("duty", 4)} AS duty, {r("CASE WHEN mean < 1e-6 OR raw < 0.05 THEN 0 ELSE kept * depth * duty END", 4)} AS likelihood FROM p""")
def smoothness(spark, sf):
    out = FR.smoothness(hourly_filled(spark, sf), "series_id", "s1", 2)
    return out.select("series_id", *[S.round_to(F.col(c), 4).alias(c) for c in ("kept", "depth", "duty", "likelihood")])


_LAGS = (1, 2, 3, 6, 12, 24)
_LAGGED = ", ".join(f"lag(n, {k}) OVER (PARTITION BY series_id ORDER BY bin) AS l{k}" for k in _LAGS)
_CORRS = ", ".join(f"({k}, {r(f'coalesce(greatest(0, least(1, c{k})), 0)', 6)})" for k in _LAGS)


@query(f"""WITH {EV}, {HOURLY}, {FILLED}, l AS (SELECT series_id, n, {_LAGGED} FROM filled),
c AS (SELECT series_id, {', '.join(f'corr(n, l{k}) AS c{k}' for k in _LAGS)} FROM l GROUP BY 1),
v AS (SELECT series_id, k, s FROM c, LATERAL (VALUES {_CORRS}) x(k, s))
SELECT series_id, k::BIGINT AS lag, s AS strength FROM v QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY s DESC, k) = 1""")
def periodicity(spark, sf):
    return FR.periodicity(hourly_filled(spark, sf), "series_id", "n", list(_LAGS))


@query(f"""WITH {EV}, d AS (SELECT series_id, floor(t / 96)::BIGINT AS seg, count(*) / 96.0 AS onset, sqrt(sum(value * value) / count(*)) AS energy FROM ev GROUP BY 1, 2),
s AS (SELECT series_id, count(*) AS n, greatest(stddev_pop(onset) / (avg(onset) + 1e-9), stddev_pop(energy) / (avg(energy) + 1e-9)) AS spread,
  max(onset) > 1.5 * median(onset) OR max(energy) > 1.5 * median(energy) OR least(min_by(energy, seg), max_by(energy, seg)) < 0.6 * avg(energy) AS hit FROM d GROUP BY 1)
SELECT series_id, n, {r("spread", 4)} AS spread, CASE WHEN n < 2 OR spread <= 0.25 THEN 0.0 WHEN hit THEN 1.0 ELSE 0.5 END::DOUBLE AS structure_hit FROM s""")
def structure_hit(spark, sf):
    days = FR.frames(points(spark, sf), ["series_id"], "t", "value", 96.0)
    segs = days.select("series_id", "bin", (F.col("n") / 96.0).alias("onset"), FR.rms(F.col("s2"), F.col("n")).alias("energy"))
    out = FR.structure_hit(segs, "series_id", "bin", "onset", "energy")
    return out.withColumn("spread", S.round_to(F.col("spread"), 4))


@query(f"""WITH {EV}, {HOURLY}, m AS (SELECT *, max(s2) OVER (PARTITION BY series_id) AS top FROM hourly)
SELECT series_id, count(*) AS active, {r("CASE WHEN count(*) < 3 THEN 0 ELSE quantile_cont(click_s2 / s2, 0.75) END", 4)} AS ratio FROM m WHERE s2 > 0.1 * top GROUP BY 1""")
def percentile_ratio(spark, sf):
    out = FR.percentile_ratio(hourly(spark, sf), "series_id", "click_s2", "s2")
    return out.withColumn("ratio", S.round_to(F.col("ratio"), 4))


@query(f"""WITH {EV}, c AS (SELECT series_id, sqrt(avg(value * value)) AS whole, sqrt(avg(value * value) FILTER (channel = 'click')) AS click, sqrt(avg(value * value) FILTER (channel = 'view')) AS view,
  sqrt(sum(value * value) FILTER (channel = 'click')) AS ce, sqrt(sum(value * value) FILTER (channel = 'view')) AS ve FROM ev GROUP BY 1)
SELECT series_id, {r("CASE WHEN whole < 1e-6 THEN 0 ELSE greatest(0, least(1, coalesce(click, 0) / whole)) END", 4)} AS drum,
  {r("1 - CASE WHEN whole < 1e-6 THEN 0 ELSE greatest(0, least(1, coalesce(view, 0) / whole)) END", 4)} AS vocal_free,
  {r("greatest(0, least(1, coalesce(ve, 0) / (coalesce(ce, 0) + 1e-9)))", 4)} AS width FROM c""")
def energy_share(spark, sf):
    sums = FR.channel_sums(points(spark, sf), ["series_id"], "channel", "value", ["click", "view"])
    whole = FR.rms(F.col("s2"), F.col("n"))
    part = lambda c: FR.energy_share(FR.rms(F.col(f"{c}_s2"), F.col(f"{c}_n")), whole)
    width = S.clamp(F.sqrt("view_s2") / (F.sqrt("click_s2") + 1e-9), 0.0, 1.0)
    return sums.select("series_id", S.round_to(part("click"), 4).alias("drum"), S.round_to(1.0 - part("view"), 4).alias("vocal_free"),
                       S.round_to(width, 4).alias("width"))


@query(f"""WITH {EV}, {SPANS}, b AS (SELECT e.series_id, least(15, floor(t / (duration / 16.0)))::BIGINT AS bin, sqrt(avg(value * value)) AS level FROM ev e JOIN spans s ON s.series_id = e.series_id GROUP BY 1, 2)
SELECT series_id, bin, {r("level", 4)} AS level, {r("level / max(level) OVER (PARTITION BY series_id)", 4)} AS share FROM b""")
def downsample_bins(spark, sf):
    both = _with_spans(spark, sf)
    out = FR.downsample(both, "series_id", "t", "value", F.col("duration"), 16)
    return out.select("series_id", "bin", *[S.round_to(F.col(c), 4).alias(c) for c in ("level", "share")])


@query(f"""WITH {EV}, f AS (SELECT series_id, channel, floor(t)::BIGINT AS bin, count(*) AS n FROM ev GROUP BY 1, 2, 3),
e AS (SELECT series_id, min(last) AS stop FROM (SELECT series_id, channel, max(bin) AS last FROM f GROUP BY 1, 2) GROUP BY 1)
SELECT f.series_id, f.channel, f.bin, f.n FROM f JOIN e ON e.series_id = f.series_id WHERE f.bin <= e.stop""")
def align_channels(spark, sf):
    frames = FR.frames(points(spark, sf), ["series_id", "channel"], "t", "value", 1.0)
    return FR.align_channels(frames, ["series_id"], "channel").select("series_id", "channel", "bin", "n")


@query(f"""WITH {EV}, {HOURLY}, {FILLED}, m AS (SELECT series_id, max(s1) + 1e-12 AS top FROM filled GROUP BY 1),
e AS (SELECT f.series_id, min(bin) AS lo, max(bin) AS hi FROM filled f JOIN m ON m.series_id = f.series_id WHERE s1 > top * 0.2 GROUP BY 1)
SELECT f.series_id, f.bin FROM filled f LEFT JOIN e ON e.series_id = f.series_id WHERE e.lo IS NULL OR f.bin BETWEEN e.lo AND e.hi""")
def trim_edges(spark, sf):
    return FR.trim_edges(hourly_filled(spark, sf), "series_id", "s1", 0.2).select("series_id", "bin")


_RUBRIC = {"drums_presence": ("click_s2", 20), "vocal_free": ("view_s2", 15)}


@query(f"""WITH {EV}, u AS (SELECT series_id, count(*) AS n, max(value) AS top, avg(value) AS mean, sqrt(avg(value * value)) AS rms,
  count(*) FILTER (channel = 'click' AND value > 200) AS loud, count(*) FILTER (channel = 'view') AS views, min(value) AS low FROM ev GROUP BY 1),
f AS (SELECT series_id, least(1, loud / 2.0) AS drums_presence, greatest(0, 1 - views / 20.0) AS vocal_free, CASE WHEN top > 3 * mean THEN 1.0 ELSE 0.5 END AS structure_hit, least(1, n / 100.0) AS key_bpm_conf,
  coalesce(mean / nullif(rms, 0), 0) AS loopability, least(1, top / 500) AS timbre_uniqueness, 1 - coalesce(mean / nullif(top, 0), 0) AS harmonicity, coalesce(rms / nullif(top, 0), 0) AS dynamics_space, least(1, low) AS source_prior FROM u),
t AS (SELECT series_id, drums_presence > 0 AND vocal_free > 0 AND structure_hit > 0 AS open, drums_presence * 20 + vocal_free * 15 + structure_hit * 15 + key_bpm_conf * 10 + loopability * 10
  + timbre_uniqueness * 15 + harmonicity * 5 + dynamics_space * 5 + source_prior * 5 AS raw FROM f)
SELECT series_id, {r("CASE WHEN open THEN raw ELSE raw * 0.5 END", 1)} AS total, {r("CASE WHEN open THEN raw ELSE raw * 0.5 END", 1)} >= 60 AS passed FROM t""")
def gated_rubric(spark, sf):
    from ..operators.moments import PASS_MARK, gated_rubric as total
    v, click = F.col("value"), F.col("channel") == "click"
    u = points(spark, sf).groupBy("series_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(v).alias("top"), F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"),
        F.count(F.when(click & (v > 200), 1)).alias("loud"), F.count(F.when(F.col("channel") == "view", 1)).alias("views"), F.min(v).alias("low"))
    one = F.lit(1.0)
    features = {
        "drums_presence": F.least(one, F.col("loud") / 2.0), "vocal_free": F.greatest(F.lit(0.0), 1.0 - F.col("views") / 20.0),
        "structure_hit": F.when(F.col("top") > 3 * F.col("mean"), 1.0).otherwise(0.5), "key_bpm_conf": F.least(one, F.col("n") / 100.0),
        "loopability": F.coalesce(F.try_divide(F.col("mean"), F.col("rms")), F.lit(0.0)), "timbre_uniqueness": F.least(one, F.col("top") / 500),
        "harmonicity": 1.0 - F.coalesce(F.try_divide(F.col("mean"), F.col("top")), F.lit(0.0)), "dynamics_space": F.coalesce(F.try_divide(F.col("rms"), F.col("top")), F.lit(0.0)), "source_prior": F.least(one, F.col("low"))}
    scored = u.withColumn("total", total(features))
    return scored.select("series_id", "total", (F.col("total") >= PASS_MARK).alias("passed"))


@query(f"""WITH {EV}, {SPANS}, c AS (SELECT series_id, i, {r("duration * i / 16.0", 6)} AS point FROM spans, generate_series(0, 16) g(i)),
n AS (SELECT c.series_id, c.i, min_by(e.t, (abs(e.t - c.point), e.t)) AS snap FROM c JOIN ev e ON e.series_id = c.series_id WHERE i BETWEEN 1 AND 15 GROUP BY 1, 2),
k AS (SELECT series_id, count(DISTINCT snap) + 1 AS pieces FROM n GROUP BY 1)
SELECT c.series_id, c.i, {r("CASE WHEN k.pieces >= 14 AND n.snap IS NOT NULL THEN n.snap ELSE c.point END", 6)} AS point, k.pieces
FROM c JOIN k ON k.series_id = c.series_id LEFT JOIN n ON n.series_id = c.series_id AND n.i = c.i""")
def split_snap(spark, sf):
    """Sixteen even cuts, each moved to the nearest event when that leaves enough pieces."""
    even = G.split_even(spans(spark, sf).withColumn("zero", F.lit(0.0)), "zero", "duration", 16)
    snapped = O.nearest(even.select("series_id", "i", "point"), points(spark, sf), ["series_id"], "point", "t", "snap")
    inner = F.col("i").between(1, 15)
    counts = snapped.where(inner).groupBy("series_id").agg((F.count_distinct("snap") + 1).alias("pieces"))
    use = (F.col("pieces") >= 14) & inner
    return snapped.join(counts, "series_id").select(
        "series_id", "i", S.round_to(F.when(use, F.col("snap")).otherwise(F.col("point")), 6).alias("point"), "pieces")


@query(f"""WITH {EV}, {HOURLY}, {FILLED}, p AS (SELECT series_id, bin, row_number() OVER (PARTITION BY series_id ORDER BY bin) - 1 AS k, count(*) OVER (PARTITION BY series_id) AS n FROM filled)
SELECT series_id, bin, {r("least(1, k / 23.0, (n - 1 - k) / 23.0)", 6)} AS weight FROM p WHERE n >= 48
UNION ALL SELECT series_id, bin, {r("CASE WHEN n // 2 <= 1 THEN 0 ELSE least(1, k / (n // 2 - 1), (n - 1 - k) / (n // 2 - 1)) END", 6)} FROM p WHERE n < 48""")
def edge_fades(spark, sf):
    out = FR.edge_fades(hourly_filled(spark, sf), "series_id", 24, "weight")
    return out.select("series_id", "bin", S.round_to(F.col("weight"), 6).alias("weight"))


@query(f"""WITH {EV}, {HOURLY}, {FILLED}, d AS (SELECT series_id, bin, s1 - 20 AS v FROM filled),
c AS (SELECT series_id, bin AS own, CASE WHEN abs(v) <= abs(lead(v) OVER w) THEN bin ELSE bin + 1 END AS cross, (v < 0) <> (lead(v) OVER w < 0) AS hit FROM d WINDOW w AS (PARTITION BY series_id ORDER BY bin)),
q AS (SELECT series_id, bin FROM hourly),
x AS (SELECT q.series_id, q.bin, min_by(c.cross, (abs(c.cross - q.bin), c.cross)) AS at FROM q JOIN c ON c.series_id = q.series_id AND c.hit AND c.own BETWEEN q.bin - 3 AND q.bin + 2 GROUP BY 1, 2),
y AS (SELECT q.series_id, q.bin, min_by(d.bin, (abs(d.v), d.bin)) AS at FROM q JOIN d ON d.series_id = q.series_id AND d.bin BETWEEN q.bin - 3 AND q.bin + 3 GROUP BY 1, 2)
SELECT y.series_id, y.bin, coalesce(x.at, y.at) AS snapped FROM y LEFT JOIN x ON x.series_id = y.series_id AND x.bin = y.bin""")
def snap_zero(spark, sf):
    """Hours with events, moved to where the hourly sum crosses 20 within three hours."""
    frames = hourly_filled(spark, sf).withColumn("v", F.col("s1") - 20)
    asked = hourly(spark, sf).select("series_id", "bin")
    return FR.snap_zero(frames, asked, "series_id", "bin", "v", 3, "snapped")


# --- vectors -----------------------------------------------------------------------------

def _vectors(spark, sf):
    return table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>"))


VEC = """v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings),
lens AS (SELECT vec_id, label, sqrt(sum(x * x)) AS len FROM v GROUP BY 1, 2),
means AS (SELECT label, d, avg(x) AS m FROM v GROUP BY 1, 2)"""


@query(f"""WITH {VEC}, ml AS (SELECT label, sqrt(sum(m * m)) AS mlen FROM means GROUP BY 1),
c AS (SELECT v.label, v.vec_id, sum(v.x * m.m) / any_value(l.len) / any_value(ml.mlen) AS cos FROM v JOIN means m ON m.label = v.label AND m.d = v.d JOIN lens l ON l.vec_id = v.vec_id
  JOIN ml ON ml.label = v.label GROUP BY 1, 2)
SELECT label, {r("avg(cos)", 6)} AS cosine, {r("greatest(0, least(1, 1 - (1 - avg(cos)) / 0.4))", 4)} AS stability FROM c GROUP BY 1""")
def vector_stability(spark, sf):
    out = VF.stability(_vectors(spark, sf), "label", "embedding", DIMS)
    return out.select("label", S.round_to(F.col("cosine"), 6).alias("cosine"), S.round_to(F.col("stability"), 4).alias("stability"))


@query(f"""WITH {VEC}, c AS (SELECT label, vec_id, sum(abs(x) * (d - 1)) / sum(abs(x)) AS c FROM v GROUP BY 1, 2),
cs AS (SELECT label, avg(c) AS cm, stddev_pop(c) AS cd FROM c GROUP BY 1),
ds AS (SELECT label, avg(dev) AS spread FROM (SELECT label, d, stddev_pop(x) AS dev FROM v GROUP BY 1, 2) GROUP BY 1)
SELECT ds.label, {r("spread", 6)} AS spread, {r("cm", 4)} AS centroid, {r("0.5 * least(1, spread / 0.5) + 0.5 * least(1, cd / cm)", 4)} AS timbre FROM ds JOIN cs ON cs.label = ds.label""")
def vector_timbre(spark, sf):
    out = VF.timbre(_vectors(spark, sf), "label", "embedding", DIMS, full=0.5)
    return out.select("label", S.round_to(F.col("spread"), 6).alias("spread"), S.round_to(F.col("centroid"), 4).alias("centroid"), S.round_to(F.col("timbre"), 4).alias("timbre"))


@query(f"""WITH {VEC}, o AS (SELECT label, list(m ORDER BY m DESC) AS l FROM means GROUP BY 1)
SELECT label, {r("greatest(0, least(1, (l[1] - l[2]) / (l[1] + 1e-9)))", 4)} AS purity FROM o""")
def peak_purity(spark, sf):
    return VF.peak_purity(_vectors(spark, sf), "label", "embedding", DIMS).withColumn("purity", S.round_to(F.col("purity"), 4))


@query(f"""WITH {VEC}, f AS (SELECT label, vec_id, sqrt(sum(x * x)) AS len, exp(avg(ln(greatest(x * x, 1e-10)))) / avg(greatest(x * x, 1e-10)) AS flat FROM v GROUP BY 1, 2),
t AS (SELECT label, max(len) AS top FROM f GROUP BY 1)
SELECT f.label, count(*) AS active, {r("1 - avg(flat)", 4)} AS harmonicity FROM f JOIN t ON t.label = f.label WHERE len > 0.95 * top GROUP BY 1""")
def vector_harmonicity(spark, sf):
    out = VF.harmonicity(_vectors(spark, sf), "label", "embedding", active=0.95)
    return out.withColumn("harmonicity", S.round_to(F.col("harmonicity"), 4))


@query(f"""WITH {VEC}, p AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM lens),
e AS (SELECT v.label, v.d, any_value(p.n) AS n, avg(x) FILTER (k <= n // 4) AS h, avg(x) FILTER (k > n - n // 4) AS t FROM v JOIN p ON p.vec_id = v.vec_id GROUP BY 1, 2)
SELECT label, max(n) AS frames, {r("greatest(0, least(1, (corr(h, t) + 1) / 2))", 4)} AS continuity FROM e GROUP BY 1""")
def head_tail_continuity(spark, sf):
    out = VF.continuity(_vectors(spark, sf), "label", "vec_id", "embedding", DIMS)
    return out.withColumn("continuity", S.round_to(F.col("continuity"), 4))


_NOVELTY = f"""w AS (SELECT vec_id, label, lag(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS prev FROM lens),
nov AS (SELECT w.label, w.vec_id, {r("1 - sum(a.x * b.x) / any_value(la.len) / any_value(lb.len)", 6)} AS novelty FROM w JOIN v a ON a.vec_id = w.vec_id JOIN v b ON b.vec_id = w.prev AND b.d = a.d
  JOIN lens la ON la.vec_id = w.vec_id JOIN lens lb ON lb.vec_id = w.prev GROUP BY 1, 2),
cut AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY novelty DESC, vec_id) AS rank FROM nov),
novel AS (SELECT c.label, c.vec_id, c.novelty, c.rank FROM cut c JOIN (SELECT label, greatest(2, least(8, count(*) // 2)) AS segs FROM lens GROUP BY 1) s ON s.label = c.label WHERE rank <= segs - 1)"""


@query(f"WITH {VEC}, {_NOVELTY} SELECT * FROM novel")
def novelty_bounds(spark, sf):
    return VF.novelty_bounds(_vectors(spark, sf), "label", "vec_id", "embedding")


@query(f"""WITH RECURSIVE {VEC}, {_NOVELTY}, b AS (SELECT label, vec_id::DOUBLE AS bound FROM novel UNION SELECT label, min(vec_id)::DOUBLE FROM embeddings GROUP BY 1
  UNION SELECT label, (max(vec_id) + 1)::DOUBLE FROM embeddings GROUP BY 1),
f AS (SELECT label, list(bound ORDER BY bound) AS m FROM b GROUP BY 1
  UNION ALL SELECT label, list_concat(m[1:cut - 1], m[cut + 1:]) FROM (
    SELECT label, m, CASE WHEN i = 1 OR (i < len(w) AND w[i - 1] < w[i + 1]) THEN i + 1 ELSE i END AS cut FROM (
      SELECT label, m, w, list_position(w, list_min(w)) AS i FROM (
        SELECT label, m, list_transform(range(1, len(m)), lambda k: m[k + 1] - m[k]) AS w FROM f) WHERE len(m) > 3 AND list_min(w) < 40)))
SELECT label, unnest(arg_min(m, len(m))) AS bound FROM f GROUP BY 1""")
def absorb_short(spark, sf):
    """Novelty boundaries plus both ends, short segments absorbed."""
    vectors = _vectors(spark, sf)
    inner = VF.novelty_bounds(vectors, "label", "vec_id", "embedding").select("label", F.col("vec_id").cast("double").alias("bound"))
    ends = vectors.groupBy("label").agg(F.min("vec_id").alias("a"), (F.max("vec_id") + 1).alias("b"))
    ends = ends.select("label", F.explode(F.array("a", "b")).alias("bound")).withColumn("bound", F.col("bound").cast("double"))
    return D.absorb_short(inner.unionByName(ends).distinct(), "label", "bound", 40.0)


@query(f"""WITH {VEC}, pairs AS (SELECT a.label, a.vec_id, b.vec_id AS other, {r("list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / la.len / lb.len", 6)} AS cosine
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id JOIN lens la ON la.vec_id = a.vec_id JOIN lens lb ON lb.vec_id = b.vec_id)
SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other) AS rank FROM pairs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other) <= 5""")
def recurrence_topk(spark, sf):
    return VF.recurrence_topk(_vectors(spark, sf), "label", "vec_id", "embedding", 5)


_BIN = 150
_BAND = lambda lo, hi: f"sum(CASE WHEN d - 1 BETWEEN {lo} AND {hi} THEN x * x ELSE 0 END) / (sum(x * x) + 1e-12)"


@query(f"""WITH {VEC}, f AS (SELECT vec_id, {_BAND(1, 0)} AS low, {_BAND(1, 3)} AS mid, sum(abs(x) * (d - 1)) / sum(abs(x)) * {_BIN} AS center FROM v GROUP BY 1),
g AS (SELECT f.*, (vec_id % 150) / 100.0 AS duration FROM f)
SELECT vec_id, {r("center", 2)} AS centroid, CASE WHEN duration > 1.2 OR duration < 0.015 THEN NULL WHEN center < 2000 AND low > 0.25 AND duration < 0.6 THEN 'kick'
  WHEN mid > 0.18 AND center > 1200 AND center < 6000 AND duration < 0.5 AND low < 0.3 THEN 'snare' WHEN center > 6000 AND duration < 0.15 THEN 'hat'
  WHEN center > 5000 AND duration >= 0.15 THEN 'oh' ELSE 'perc' END AS class FROM g""")
def spectrum_class(spark, sf):
    from ..functions import vectors as V
    duration = (F.col("vec_id") % 150) / 100.0
    center = V.centroid(F.col("embedding")) * float(_BIN)
    return _vectors(spark, sf).select("vec_id", S.round_to(center, 2).alias("centroid"),
                                      VF.spectrum_class(F.col("embedding"), duration, float(_BIN), DIMS).alias("class"))
