"""Registry of queries and the series, frames, windows and moments the queries share."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import clamp, round_to
from ..operators import frames as FR
from ..operators import grid as G
from ..operators import moments as M
from ..operators import folds as D
from ..operators import ordered as O
from ..operators import prefix_vectors as PV
from ..operators.ranged import persisted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r(expr: str, digits: int) -> str:
    """SQL text of ``round_to``."""
    return f"(floor(({expr}) * 1e{digits} + 0.5000001) / 1e{digits})"


# Events as points of a series: hours since the start of 2024, channel = event type.
ORIGIN = "2024-01-01 00:00:00"
CHANNELS = ("click", "view", "purchase")
SIZES = (24.0, 48.0, 96.0)


def points(spark: SparkSession, sf: str) -> DataFrame:
    since = F.timestamp_diff("MICROSECOND", F.lit(ORIGIN).cast("timestamp_ntz"), F.col("ts"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("series_id"), "event_id", F.col("event_type").alias("channel"), "value",
        since.alias("us")).withColumn("t", F.col("us") / 3.6e9)


EV = """ev AS (SELECT user_id AS series_id, event_id, event_type AS channel, value,
  epoch_us(ts) - 1704067200000000 AS us, (epoch_us(ts) - 1704067200000000) / 3.6e9 AS t FROM events)"""


def spans(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).groupBy("series_id").agg((F.floor(F.max("t")) + 1).cast("double").alias("duration"))


SPANS = "spans AS (SELECT series_id, floor(max(t)) + 1 AS duration FROM ev GROUP BY 1)"


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return FR.frames(points(spark, sf), ["series_id"], "t", "value", 1.0, "channel", CHANNELS)


HOURLY = """hourly AS (SELECT series_id, floor(t)::BIGINT AS bin, count(*) AS n, sum(value) AS s1,
  sum(value * value) AS s2, max(abs(value)) AS peak,
  sum(CASE WHEN channel = 'click' THEN value * value ELSE 0 END) AS click_s2,
  sum(CASE WHEN channel = 'view' THEN value * value ELSE 0 END) AS view_s2,
  sum(CASE WHEN channel = 'purchase' THEN value * value ELSE 0 END) AS purchase_s2
  FROM ev GROUP BY 1, 2)"""


def hourly_filled(spark: SparkSession, sf: str) -> DataFrame:
    return FR.filled(hourly(spark, sf), "series_id", ["n", "s1", "s2"])


FILLED = """grid AS (SELECT series_id, unnest(generate_series(0, max(bin))) AS bin FROM hourly GROUP BY series_id),
filled AS (SELECT g.series_id, g.bin, coalesce(h.n, 0)::DOUBLE AS n, coalesce(h.s1, 0) AS s1, coalesce(h.s2, 0) AS s2
  FROM grid g LEFT JOIN hourly h ON h.series_id = g.series_id AND h.bin = g.bin)"""


def sizes():
    return F.array(*[F.lit(s) for s in SIZES])


def windows(spark: SparkSession, sf: str) -> DataFrame:
    return G.multires_windows(spans(spark, sf), "series_id", "duration", sizes())


WINDOWS = f"""sized AS (SELECT DISTINCT series_id, duration, least(s, duration) AS size
  FROM spans, (VALUES (24.0::DOUBLE), (48.0), (96.0)) v(s) WHERE duration >= 2),
cells AS (SELECT *, unnest(generate_series(0, floor((duration - size + 1e-6) / (size / 2.0))::BIGINT)) AS index FROM sized),
windows AS (SELECT series_id, duration, size, index, {r("index * (size / 2.0)", 3)} AS start,
  {r("least(index * (size / 2.0) + size, duration)", 3)} AS "end" FROM cells)"""


def features(spark: SparkSession, sf: str) -> DataFrame:
    return FR.window_features(hourly(spark, sf), "series_id", sizes(), sums=tuple(f"{c}_s2" for c in CHANNELS))


FEATURES = """inside AS (SELECT w.series_id, w.duration, w.size, w.index, w.start, w."end", h.*
    EXCLUDE (series_id), sqrt(h.s2 / h.n) AS level
  FROM windows w JOIN hourly h ON h.series_id = w.series_id AND h.bin >= w.start AND h.bin < w."end"),
tops AS (SELECT series_id, size, index, max(level) AS top FROM inside GROUP BY 1, 2, 3),
sums AS (SELECT i.series_id, i.duration, i.size, i.index, i.start, i."end", sum(n)::BIGINT AS points, count(*) AS frames, sum(s1) AS total,
    sum(s2) AS energy, max(peak) AS peak, max(s1) AS s1_top, sum(click_s2) AS click_s2, sum(view_s2) AS view_s2, sum(purchase_s2) AS purchase_s2,
    sum(level) AS l1, sum(level * level) AS l2, sum(CASE WHEN level > 0.4 * top THEN 1 ELSE 0 END) AS loud
  FROM inside i JOIN tops t ON t.series_id = i.series_id AND t.size = i.size AND t.index = i.index
  GROUP BY ALL),
levels AS (SELECT *, sqrt(energy / points) AS rms, l1 / size AS mean, l2 / size AS square FROM sums),
features AS (SELECT *, CASE WHEN mean > 0 THEN greatest(0, least(1, 1 - sqrt(greatest(0, square - mean * mean)) / mean / 1.5)) ELSE 0 END AS stability,
    greatest(0, least(1, log10(greatest(coalesce(peak / nullif(rms, 0), 0), 1.414)) / log10(20.0))) AS crest,
    1 - loud / size AS headroom
  FROM levels)"""


def silence_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Starts and ends of days without any event, in hours."""
    daily = FR.frames(points(spark, sf), ["series_id"], "t", "value", 24.0)
    grid = FR.filled(daily, "series_id", ["n"])
    at = grid.withColumn("at", F.col("bin") * 24.0)
    return O.state_changes(at, ["series_id"], ["at"], F.col("n") == 0, 24.0, parts=None)


BOUNDS = """daily AS (SELECT series_id, floor(t / 24)::BIGINT AS day, count(*) AS n FROM ev GROUP BY 1, 2),
days AS (SELECT series_id, unnest(generate_series(0, max(day))) AS day FROM daily GROUP BY series_id),
states AS (SELECT d.series_id, d.day, coalesce(e.n, 0) = 0 AS silent FROM days d LEFT JOIN daily e ON e.series_id = d.series_id AND e.day = d.day),
flips AS (SELECT *, coalesce(lag(silent) OVER (PARTITION BY series_id ORDER BY day), false) AS was FROM states),
bounds AS (SELECT series_id, day * 24.0::DOUBLE AS bound FROM flips WHERE silent <> was
  UNION ALL SELECT series_id, (max(day) + 1) * 24.0::DOUBLE FROM states GROUP BY series_id HAVING max_by(silent, day))"""

# Thresholds for event series: the values play the part of the centroid.
LIMITS = {
    "texture_centroid": 60.0, "texture_density": 0.09,
    "drum_break": 0.45, "drum_break_vocal": 0.30, "vocal_phrase": 0.55,
    "bass_phrase": 0.50, "bass_phrase_drum": 0.40,
    "plain_drum": 0.25, "plain_harmonicity": 0.05,
}


def classified(spark: SparkSession, sf: str) -> DataFrame:
    """Window features with the first boundary inside, the nearest one to the center, and type.

    Scans give far more rows than Spark expects of them, so tables of windows are merged and never broadcast.
    """
    near = O.span_bounds(windows(spark, sf), silence_bounds(spark, sf), ["series_id"], ["size", "index"], "bound")
    near = features(spark, sf).hint("merge").join(near, ["series_id", "size", "index"])
    level = F.col("rms")
    part = lambda c: round_to(FR.energy_share(FR.rms(F.col(f"{c}_s2"), F.col("points")), level), 4)
    shared = near.select("*", part("click").alias("drum"), part("view").alias("vocal"), part("purchase").alias("bass"),
                         round_to(F.col("total") / F.col("points"), 4).alias("centroid"),
                         round_to(F.col("points") / (F.col("end") - F.col("start")), 4).alias("density"))
    type_ = M.classify(F.col("bound"), F.col("centroid"), F.col("density"), level < 1e-6, F.lit(True),
                       F.col("drum"), F.col("vocal"), F.col("bass"), round_to(F.col("stability"), 4), LIMITS)
    return shared.withColumn("type", type_)


CLASSIFIED = f"""hits AS (SELECT w.series_id, w.size, w.index, min(b.bound) AS bound FROM windows w JOIN bounds b
    ON b.series_id = w.series_id AND b.bound > w.start + 1e-6 AND b.bound < w."end" - 1e-6 GROUP BY 1, 2, 3),
nears AS (SELECT w.series_id, w.size, w.index, min_by(b.bound, (abs((w.start + w."end") / 2.0 - b.bound), b.bound)) AS nearest, count(*) AS n_bounds
    FROM windows w JOIN bounds b ON b.series_id = w.series_id GROUP BY 1, 2, 3),
shares AS (SELECT f.*, h.bound, n.nearest, n.n_bounds,
    {r("CASE WHEN rms < 1e-6 THEN 0 ELSE least(1, sqrt(click_s2 / points) / rms) END", 4)} AS drum,
    {r("CASE WHEN rms < 1e-6 THEN 0 ELSE least(1, sqrt(view_s2 / points) / rms) END", 4)} AS vocal,
    {r("CASE WHEN rms < 1e-6 THEN 0 ELSE least(1, sqrt(purchase_s2 / points) / rms) END", 4)} AS bass,
    {r("total / points", 4)} AS centroid, {r('points / (f."end" - f.start)', 4)} AS density
  FROM features f LEFT JOIN hits h ON h.series_id = f.series_id AND h.size = f.size AND h.index = f.index
  LEFT JOIN nears n ON n.series_id = f.series_id AND n.size = f.size AND n.index = f.index),
classified AS (SELECT *, CASE WHEN bound IS NOT NULL THEN 'transition'
    WHEN centroid >= 60 AND density <= 0.09 THEN 'texture'
    WHEN rms < 1e-6 THEN 'melody'
    WHEN drum >= 0.45 AND vocal <= 0.30 THEN 'drum_break'
    WHEN vocal >= 0.55 THEN 'vocal_phrase'
    WHEN bass >= 0.50 AND drum <= 0.40 THEN 'bass_phrase'
    WHEN drum <= 0.25 AND {r("stability", 4)} >= 0.05 THEN 'melody_no_drums'
    ELSE 'melody' END AS type FROM shares)"""

DIMENSIONS = ("loopability", "memorability", "key_stability", "drum_state", "vocal_state",
              "timbre_uniqueness", "structure_position", "space")


DIMS = 64
VECTORS = 500  # the embedding of an event is number event_id % VECTORS
FULL_PEAKS = 24.0


def peak_rows(frames: DataFrame) -> DataFrame:
    """Picked peaks of hourly sums, at least four hours apart."""
    found = persisted(FR.peaks(frames, "series_id", "s1"))
    kept = D.thin(found.withColumn("bin_id", F.col("bin")), "series_id", "bin", "bin_id", 4.0, max_rows=None)
    return kept.select("series_id", F.col("bin").cast("long").alias("bin")).join(found.hint("merge"), ["series_id", "bin"])


def window_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of the events' vectors inside each window, and its peaks."""
    vectors = table(spark, sf, "embeddings").where(F.col("vec_id") < VECTORS).select("vec_id", "embedding")
    events = points(spark, sf).join(vectors, F.col("event_id") % VECTORS == F.col("vec_id")).select(
        "series_id", "t", PV.vector_stats(F.col("embedding"), F.lit(0.0), F.lit(0.0)).alias("stats"))
    none = F.lit(None).cast(vectors.schema["embedding"].dataType)
    tops = peak_rows(hourly_filled(spark, sf)).select("series_id", F.col("bin").cast("double").alias("t"), PV.vector_stats(none, F.lit(1.0), F.col("s1")).alias("stats"))
    return PV.window_scores(events.unionByName(tops), windows(spark, sf), "series_id", "t", "stats", DIMS, ["size", "index"], max(SIZES),
                            more=("n_peaks", "strength"), full=0.25)


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Classified windows with the eight scores as columns and as a map, and their total."""
    rows = classified(spark, sf).join(window_vectors(spark, sf).hint("merge"), ["series_id", "size", "index"])
    n_peaks, strength = F.round("n_peaks"), F.col("strength")
    catchy = 0.5 * n_peaks / FULL_PEAKS + 0.5 * F.coalesce(F.try_divide(strength, n_peaks * F.col("s1_top")), F.lit(0.0))
    usable = (F.col("s1_top") >= 1e-4) & (F.col("size") >= 10)
    values = {
        "loopability": round_to(0.5 * F.col("continuity") + 0.5 * F.col("stability"), 4),
        "memorability": round_to(F.when(usable, clamp(catchy, 0.0, 1.0)).otherwise(0.0), 4),
        "key_stability": round_to(F.col("key_stability"), 4),
        "drum_state": F.col("drum"),
        "vocal_state": F.col("vocal"),
        "timbre_uniqueness": round_to(F.col("timbre"), 4),
        "structure_position": M.structure_position(F.col("start"), F.col("end"), F.col("nearest"), F.col("n_bounds"), F.col("type")),
        "space": round_to(FR.space(F.col("headroom"), F.col("crest")), 4),
    }
    kept = [c for c in rows.columns if c not in ("continuity", "key_stability", "timbre", "n_peaks", "strength")]
    rows = rows.select(*kept, *[v.alias(k) for k, v in values.items()])
    scores = M.score_map(**{k: F.col(k) for k in DIMENSIONS})
    return rows.withColumn("scores", scores).withColumn("total_score", M.weighted_total(F.col("scores")))


PEAKS = """peaked AS (SELECT series_id, bin, s1, max(s1) OVER (PARTITION BY series_id ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING) AS top,
  avg(s1) OVER (PARTITION BY series_id ORDER BY bin ROWS BETWEEN 3 PRECEDING AND 4 FOLLOWING) AS near FROM filled),
cand AS (SELECT series_id, bin, s1, row_number() OVER (PARTITION BY series_id ORDER BY bin) AS k FROM peaked WHERE s1 = top AND s1 >= near + 0.05),
walk AS (SELECT series_id, k, bin AS last, true AS picked FROM cand WHERE k = 1
  UNION ALL SELECT c.series_id, c.k, CASE WHEN c.bin - w.last > 3 THEN c.bin ELSE w.last END, c.bin - w.last > 3 FROM walk w JOIN cand c ON c.series_id = w.series_id AND c.k = w.k + 1),
picks AS (SELECT c.series_id, c.bin, c.s1 FROM walk w JOIN cand c ON c.series_id = w.series_id AND c.k = w.k WHERE w.picked)"""

VECTORED = f"""vx AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings WHERE vec_id < {VECTORS}),
vl AS (SELECT vec_id, sqrt(sum(x * x)) AS len, sum(abs(x) * (d - 1)) / sum(abs(x)) AS c FROM vx GROUP BY 1),
per_dim AS (SELECT w.series_id, w.size, w.index, x.d, avg(x.x) AS m, stddev_pop(x.x) AS dev, avg(x.x / l.len) AS u, avg(l.c) AS cm, stddev_pop(l.c) AS cd,
    avg(x.x) FILTER (e.t < w.start + (w."end" - w.start) / 4.0) AS h, avg(x.x) FILTER (e.t >= w."end" - (w."end" - w.start) / 4.0) AS o
  FROM windows w JOIN ev e ON e.series_id = w.series_id AND e.t >= w.start AND e.t < w."end" JOIN vl l ON l.vec_id = e.event_id % {VECTORS} JOIN vx x ON x.vec_id = l.vec_id
  GROUP BY 1, 2, 3, 4),
vectored AS (SELECT series_id, size, index, sum(m * u) / sqrt(sum(m * m)) AS cosine, avg(dev) AS spread, any_value(cd) / any_value(cm) AS moved,
    coalesce(corr(h, o), 0) AS likeness FROM per_dim GROUP BY 1, 2, 3),
picked AS (SELECT w.series_id, w.size, w.index, count(*) AS n_peaks, sum(p.s1) AS strength FROM windows w JOIN picks p ON p.series_id = w.series_id AND p.bin >= w.start AND p.bin < w."end" GROUP BY 1, 2, 3)"""

SCORED = f"""dims AS (SELECT c.*, {r("0.5 * greatest(0, least(1, (likeness + 1) / 2)) + 0.5 * stability", 4)} AS loopability,
    CASE WHEN s1_top >= 1e-4 AND c.size >= 10 THEN {r(f"greatest(0, least(1, 0.5 * coalesce(n_peaks, 0) / {FULL_PEAKS} + 0.5 * coalesce(strength / (n_peaks * s1_top), 0)))", 4)} ELSE 0 END AS memorability,
    {r("greatest(0, least(1, 1 - (1 - cosine) / 0.4))", 4)} AS key_stability, drum AS drum_state, vocal AS vocal_state,
    {r("0.5 * least(1, spread / 0.25) + 0.5 * least(1, moved)", 4)} AS timbre_uniqueness,
    CASE WHEN coalesce(n_bounds, 0) < 2 THEN 0.5 ELSE {r('''CASE WHEN type = 'transition' THEN greatest(0, least(1, 1 - abs((start + "end") / 2.0 - nearest) / greatest(("end" - start) / 2.0, 1)))
      ELSE 1 - greatest(0, least(1, 1 - abs((start + "end") / 2.0 - nearest) / greatest(("end" - start) / 2.0, 1))) END''', 4)} END AS structure_position,
    {r("greatest(0, least(1, 0.6 * headroom + 0.4 * crest))", 4)} AS space
  FROM classified c JOIN vectored v ON v.series_id = c.series_id AND v.size = c.size AND v.index = c.index
  LEFT JOIN picked p ON p.series_id = c.series_id AND p.size = c.size AND p.index = c.index),
scored AS (SELECT *, {r("loopability * 0.25 + memorability * 0.20 + key_stability * 0.15 + drum_state * 0.10 + vocal_state * 0.10 + timbre_uniqueness * 0.10 + structure_position * 0.05 + space * 0.05", 4)} AS total_score,
    loopability + memorability + key_stability + drum_state + vocal_state + timbre_uniqueness + structure_position + space AS raw_score
  FROM dims)"""

MOMENTS = "RECURSIVE " + ", ".join([EV, SPANS, HOURLY, FILLED, PEAKS, WINDOWS, FEATURES, BOUNDS, CLASSIFIED, VECTORED, SCORED])


def moment_id(df_series="series_id"):
    from ..functions.scalar import moment_key
    return moment_key(F.col(df_series), F.col("type"), F.col("start"), F.col("end"))


MOMENT_ID = """printf('%d:%s:%07.3f-%07.3f', series_id, type, start, "end")"""


def moments(spark: SparkSession, sf: str) -> DataFrame:
    """Moments: scored windows, the best two per series and type, with key, reasons and risks."""
    from ..functions.scalar import decibels, reasons, risks
    best = M.diversity_topk(scored(spark, sf), ["series_id", "type"], "total_score", "start").drop("rank")
    always = F.lit(True)
    return best.select(
        moment_id().alias("moment_id"), "series_id", "type", "start", "end", "scores", "total_score",
        reasons(F.col("type"), F.col("start"), F.col("end"), F.col("scores"), always).alias("explain"),
        risks(F.col("type"), F.col("start"), F.col("end"), F.col("scores"), always, F.lit(None).cast("double"),
              F.col("duration"), decibels(F.col("rms") / 500.0)).alias("risks"))


TOP2 = """top2 AS (SELECT *, {id} AS moment_id FROM scored
  QUALIFY row_number() OVER (PARTITION BY series_id, type ORDER BY total_score DESC, start, "end") <= 2)""".format(id=MOMENT_ID)
