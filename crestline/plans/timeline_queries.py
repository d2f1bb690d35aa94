"""Timeline queries: sections, grids, documents, mixdown and assignments."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import grid as G
from ..operators import ordered as O
from ..operators import timeline as T
from .base import EV, points, query, r, table

_NAMES = [name for name, _ in T.TEMPLATE]


def _name_of(turn):
    return F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.pmod(turn, F.lit(5)) + 1).cast("int"))


def _kind_of(conv):
    return F.element_at(F.array(F.lit("loop"), F.lit("chop"), F.lit("stem")), (F.pmod(conv, F.lit(3)) + 1).cast("int"))


def _sections(spark, sf):
    """Turns of a conversation as sections; the length of the text gives the bars."""
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", _kind_of(F.col("conv_id")).alias("kind"), _name_of(F.col("turn")).alias("section"),
        (F.length("text") % 8 + 1).cast("long").alias("bars"))


_ENERGY = " ".join(f"WHEN kind = '{k}' AND section = '{s}' THEN {e}" for k, m in T.SECTION_ENERGY.items() for s, e in m.items())
SECTIONS = f"""raw AS (SELECT conv_id, turn, ['loop', 'chop', 'stem'][(conv_id % 3 + 1)::INT] AS kind, {_NAMES}[(turn % 5 + 1)::INT] AS section, (length(text) % 8 + 1)::BIGINT AS bars FROM conversations),
sections AS (SELECT *, (coalesce(sum(bars) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 4.0)::DOUBLE AS start_beat,
  (CASE {_ENERGY} ELSE 0.7 END)::DOUBLE AS energy FROM raw)"""


@query(f"""WITH {SECTIONS} SELECT conv_id, turn, section, bars, start_beat, energy, {r("start_beat * 60.0 / 92", 6)} AS start_sec,
  'section-' || left(sha256('["' || conv_id || '","' || turn || '","' || section || '"]'), 16) AS section_id FROM sections""")
def section_timeline(spark, sf):
    placed = T.with_offsets(_sections(spark, sf), ["conv_id"], "turn", "bars")
    return placed.select("conv_id", "turn", "section", "bars", "start_beat", T.section_energy(F.col("kind"), F.col("section")).alias("energy"),
                         S.round_to(F.col("start_beat") * 60.0 / 92, 6).alias("start_sec"),
                         S.stable_id("section", F.col("conv_id"), F.col("turn"), F.col("section")).alias("section_id"))


_STYLE = "CASE section WHEN 'verse' THEN CASE WHEN k % 2 = 0 THEN [0, 5, 8, 13] ELSE [3, 10] END WHEN 'hook' THEN [0, 4, 7, 9, 12, 15] WHEN 'verse_variation' THEN [0, 10] ELSE [0] END"


@query(f"""WITH {SECTIONS}, bars AS (SELECT *, unnest(generate_series(0, bars - 1)) AS k FROM sections),
steps AS (SELECT *, unnest({_STYLE})::BIGINT AS step FROM bars WHERE NOT (section = 'verse_variation' AND (kind = 'stem' OR (kind = 'loop' AND k % 2 = 1))))
SELECT conv_id, turn, k, step, {r("(start_beat + k * 4.0) + step / 4.0", 6)} AS beat, {r("CASE WHEN section = 'outro' THEN 1 - 0.35 * k / bars ELSE 1.0 END", 4)} AS fade,
  k % 3 AS piece, {r("0.5 + (k % 3) * (7.5 / 3)", 6)} AS "from" FROM steps""")
def section_grid(spark, sf):
    bars = G.bar_rows(T.with_offsets(_sections(spark, sf), ["conv_id"], "turn", "bars"))
    heard = bars.where(~T.section_dropout(F.col("kind"), F.col("section"), F.col("k")))
    style = T.literal_map(T.CHOP_STYLES)[F.col("section")]
    steps = heard.withColumn("step", F.explode(G.pattern_steps(style, F.col("k"))))
    chunk = G.chunk_of(F.lit(0.5), F.lit(8.0), F.col("k"), F.lit(60.0 / 92 * 4))
    fade = F.when(F.col("section") == "outro", S.fade_out(F.col("k"), F.col("bars"))).otherwise(F.lit(1.0))
    beat = S.beat_at(F.col("start_beat") / 4.0 + F.col("k"), F.col("step"), F.lit(0.0), F.lit(92.0))
    return steps.withColumn("chunk", chunk).select(
        "conv_id", "turn", "k", "step", beat.alias("beat"), S.round_to(fade, 4).alias("fade"), "chunk.piece", "chunk.from")


@query("""WITH o AS (SELECT o_orderkey, greatest(8, floor(75.0 * (40 + o_orderkey % 160) / 240 + 0.5))::BIGINT AS total FROM orders),
m AS (SELECT o_orderkey, total, i, name, base, base * (total - 4) / 22.0 AS raw FROM o, (VALUES (1, 'verse', 8), (2, 'hook', 8), (3, 'verse_variation', 6)) v(i, name, base)),
w AS (SELECT *, greatest(1, floor(raw))::BIGINT AS whole, raw - floor(raw) AS frac FROM m),
l AS (SELECT *, (total - 4) - sum(whole) OVER (PARTITION BY o_orderkey) AS rest FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY frac DESC, i) AS up, row_number() OVER (PARTITION BY o_orderkey ORDER BY (whole > 1) DESC, frac, i) AS down FROM l)
SELECT o_orderkey, name AS section, CASE WHEN rest >= 0 THEN whole + (up <= rest)::INT ELSE whole - (whole > 1 AND down <= -rest)::INT END::BIGINT AS bars FROM k
UNION ALL SELECT o_orderkey, s, 2::BIGINT FROM o, (VALUES ('intro'), ('outro')) v(s)""")
def largest_remainder(spark, sf):
    """Totals repeat, so each distinct total is allocated once and joined back."""
    total = F.greatest(F.lit(8), F.floor(75.0 * (40 + F.col("o_orderkey") % 160) / 240 + 0.5)).cast("long")
    runs = table(spark, sf, "orders").select("o_orderkey", total.alias("total"))
    template = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(n).alias("section"), F.lit(b).cast("long").alias("base")) for i, (n, b) in enumerate(T.TEMPLATE)])
    rows = runs.select("total").distinct().withColumn("_s", F.explode(template)).select("total", "_s.*")
    shared = G.allocate(rows, ["total"], "section", "base", "total", list(T.FIXED_SECTIONS))
    lists = shared.groupBy("total").agg(F.collect_list(F.struct("section", "bars")).alias("_rows"))
    return runs.join(lists, "total").select("o_orderkey", F.explode("_rows").alias("_r")).select("o_orderkey", "_r.section", "_r.bars")


_DAY = "floor(t / 24)::BIGINT AS day"


@query(f"""WITH {EV}, taken AS (SELECT DISTINCT series_id, {_DAY}, floor((t - floor(t / 24) * 24) / 1.5)::BIGINT AS step FROM ev),
steps AS (SELECT series_id, day, unnest([0, 4, 7, 9, 12, 15])::BIGINT AS step FROM (SELECT DISTINCT series_id, day FROM taken)),
m AS (SELECT s.*, NOT EXISTS (SELECT 1 FROM taken t WHERE t.series_id = s.series_id AND t.day = s.day AND abs(t.step - s.step) <= 1) AS free FROM steps s),
g AS (SELECT *, bool_or(free) OVER (PARTITION BY series_id, day) AS any_free FROM m)
SELECT series_id, day, step FROM g WHERE free OR NOT any_free""")
def step_avoidance(spark, sf):
    """A day of a series is a bar of sixteen steps; the events are the steps already taken."""
    day = F.floor(F.col("t") / 24)
    in_bar = F.col("t") - day * 24
    taken = points(spark, sf).select("series_id", day.alias("day"), G.step_of(in_bar, 10.0).alias("step")).distinct()
    steps = taken.select("series_id", "day").distinct().withColumn("step", F.explode(F.array(*[F.lit(s).cast("long") for s in G.STEP_PATTERNS["syncopated"]])))
    return T.avoid_steps(steps, taken, ["series_id", "day"])


@query("""WITH n AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ['kick', 'snare', 'hat', 'oh', 'perc'][(k % 5 + 1)::INT] AS item FROM n""")
def cyclic_assign(spark, sf):
    pool = F.array(*[F.struct(F.lit(i).cast("long").alias("slot"), F.lit(5).cast("long").alias("slots"), F.lit(c).alias("item")) for i, c in enumerate(T.DRUM_CLASSES)])
    items = spark.range(1).select(F.explode(pool).alias("_p")).select("_p.*")
    lines = table(spark, sf, "lineitem")
    out = T.cyclic_assign(lines, items, ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "item")


@query(f"""WITH t AS (SELECT *, max(l_extendedprice) OVER (PARTITION BY l_suppkey) AS top FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) <= 16)
SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS pad, l_orderkey, l_linenumber, {r("coalesce(l_extendedprice / nullif(top, 0), 0)", 3)} AS confidence FROM t""")
def numbered_topk(spark, sf):
    """Top sixteen by strength per supplier, numbered in time order."""
    from pyspark.sql import Window
    tie = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")]
    best = O.top_per(table(spark, sf, "lineitem"), ["l_suppkey"], [F.col("l_extendedprice").desc(), *tie], 16)
    pad = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_shipdate", *tie)).cast("long")
    top = F.max("l_extendedprice").over(Window.partitionBy("l_suppkey"))
    return best.select("l_suppkey", pad.alias("pad"), "l_orderkey", "l_linenumber", S.round_to(F.coalesce(F.try_divide(F.col("l_extendedprice"), top), F.lit(0.0)), 3).alias("confidence"))


@query("""SELECT l_orderkey, count(*) AS events, sum(l_linenumber)::BIGINT AS lines, sum(l_partkey)::BIGINT AS parts, max(l_shipdate) AS last FROM lineitem GROUP BY 1""")
def nest_unnest(spark, sf):
    """Lines to order documents and back; the totals must be those of the lines."""
    fields = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]
    docs = T.events_to_doc(table(spark, sf, "lineitem").select("l_orderkey", *fields), ["l_orderkey"], fields)
    rows = T.doc_to_events(docs, ["l_orderkey"])
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("events"), F.sum("l_linenumber").alias("lines"), F.sum("l_partkey").alias("parts"), F.max("l_shipdate").alias("last"))


@query("""SELECT event_id, (event_id % 12)::INT AS bar, event_type AS track, (event_id % 16)::DOUBLE AS step, floor(value)::INT AS velocity, value / 100 AS offset_ms FROM events""")
def pattern_events(spark, sf):
    """Each event as a nested bar/track/step pattern document, then exploded to event rows."""
    hit = F.struct(F.floor("value").cast("int").alias("velocity"), (F.col("value") / 100).alias("offset_ms"))
    steps = F.create_map((F.col("event_id") % 16).cast("string"), hit)
    pattern = F.create_map((F.col("event_id") % 12).cast("string"), F.create_map("event_type", steps))
    return T.pattern_rows(table(spark, sf, "events").select("event_id", pattern.alias("pattern")), ["event_id"], "pattern")


@query("""WITH u AS (SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem)
SELECT coalesce(p, s) AS asset_id, CASE WHEN s IS NOT NULL THEN 'supplier' ELSE 'part' END AS role, coalesce(ns, np) AS uses
FROM (SELECT l_partkey AS p, count(*) AS np FROM u GROUP BY 1) a FULL JOIN (SELECT l_suppkey AS s, count(*) AS ns FROM u GROUP BY 1) b ON a.p = b.s""")
def merged_assets(spark, sf):
    lines = table(spark, sf, "lineitem")
    def used(column, role):
        return lines.groupBy(F.col(column).alias("asset_id")).agg(F.count(F.lit(1)).alias("uses")).withColumn("role", F.lit(role))
    return T.merged_assets([used("l_partkey", "part"), used("l_suppkey", "supplier")], "asset_id", "version").select("asset_id", "role", "uses")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 100 = l_suppkey % 100 THEN (l_partkey % 100)::VARCHAR ELSE (l_partkey % 100) || ',' || (l_suppkey % 100) END AS ids FROM lineitem""")
def ordered_ids(spark, sf):
    ids = T.ordered_ids(F.array(F.col("l_partkey") % 100), F.array(F.col("l_suppkey") % 100, F.lit(None).cast("long")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


_PAN = " ".join(f"WHEN '{k}' THEN {v}" for k, v in {"view": 0.25, "click": 0.15, "error": -0.25}.items())
MIX = f"""c AS (SELECT channel, t, value / 100 AS len, CASE channel {_PAN} ELSE 0 END AS pan FROM ev),
x AS (SELECT *, unnest(generate_series(floor(t)::BIGINT, greatest(floor(t), ceil(t + len) - 1)::BIGINT)) AS bin FROM c),
mix AS (SELECT channel, bin, sum(0.5 * cos((pan + 1.0) * {3.141592653589793 / 4.0})) AS l, sum(0.5 * sin((pan + 1.0) * {3.141592653589793 / 4.0})) AS r FROM x GROUP BY 1, 2)"""


def _mix(spark, sf):
    pan = F.coalesce(T.literal_map({"view": 0.25, "click": 0.15, "error": -0.25})[F.col("channel")], F.lit(0.0))
    return T.mixdown(points(spark, sf), ["channel"], F.col("t"), F.col("value") / 100, F.lit(0.5), pan, 1.0)


@query(f"""WITH {EV}, {MIX} SELECT channel, bin, {r("l", 4)} AS "left", {r("r", 4)} AS "right" FROM mix
UNION ALL SELECT NULL, bin, {r("sum(l)", 4)}, {r("sum(r)", 4)} FROM mix GROUP BY bin""")
def mixdown(spark, sf):
    layers = _mix(spark, sf)
    total = layers.groupBy("bin").agg(F.sum("left").alias("left"), F.sum("right").alias("right")).withColumn("channel", F.lit(None).cast("string"))
    return layers.unionByName(total).select("channel", "bin", S.round_to(F.col("left"), 4).alias("left"), S.round_to(F.col("right"), 4).alias("right"))


@query(f"""WITH {EV}, {MIX}, s AS (SELECT channel, bin, tanh(l / 4) AS l, tanh(r / 4) AS r FROM mix),
p AS (SELECT channel, max(greatest(abs(l), abs(r))) + 1e-12 AS peak FROM s GROUP BY 1)
SELECT s.channel, bin, {r(f"l * {10 ** (-1 / 20)} / peak", 4)} AS "left", {r(f"r * {10 ** (-1 / 20)} / peak", 4)} AS "right" FROM s JOIN p ON p.channel = s.channel""")
def master_mix(spark, sf):
    layers = _mix(spark, sf).withColumns({"left": F.col("left") / 4, "right": F.col("right") / 4})
    out = T.master(layers, ["channel"])
    return out.select("channel", "bin", S.round_to(F.col("left"), 4).alias("left"), S.round_to(F.col("right"), 4).alias("right"))


@query("""WITH k AS (SELECT p_type AS class, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS rank, p_partkey::VARCHAR AS item FROM part)
SELECT c.class, coalesce(k.rank, 1)::INT AS rank, coalesce(k.item, 'synth/' || c.class) AS item FROM (SELECT DISTINCT p_type AS class FROM part UNION SELECT DISTINCT p_brand FROM part) c
LEFT JOIN k ON k.class = c.class AND k.rank <= 2""")
def kit_fill(spark, sf):
    """Two best parts per type; classes without any (the brands) get their fallback."""
    parts = table(spark, sf, "part")
    classes = parts.select(F.col("p_type").alias("class")).union(parts.select("p_brand")).distinct()
    hits = parts.select(F.col("p_type").alias("class"), F.col("p_partkey").cast("string").alias("item"), "p_retailprice", "p_partkey")
    out = T.kit_for(classes, hits, "class", [F.col("p_retailprice").desc(), F.col("p_partkey")], F.concat(F.lit("synth/"), F.col("class")))
    return out.select("class", "rank", "item")


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, {r("l_linenumber * 4.0 + (l_partkey % 16) / 4.0 + l_discount * 100 * 92 / 60000.0", 6)} AS beat,
  {r("l_quantity * 92 / 60.0", 6)} AS beats, least(1000000, floor(l_quantity * 44100 + 0.5))::BIGINT AS frame, floor(l_discount * 1000 * 92.0 * 96 / 60000.0 + 0.5)::BIGINT AS ticks FROM lineitem""")
def time_base(spark, sf):
    tempo = F.lit(92.0)
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
        S.beat_at(F.col("l_linenumber"), F.col("l_partkey") % 16, F.col("l_discount") * 100, tempo).alias("beat"),
        S.beats_of(F.col("l_quantity"), tempo).alias("beats"),
        S.frame_at(F.col("l_quantity"), 44100, F.lit(1_000_000).cast("long")).alias("frame"),
        S.ticks_of(F.col("l_discount") * 1000, tempo).alias("ticks"))
