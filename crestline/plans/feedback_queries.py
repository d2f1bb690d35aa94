"""Feedback queries over labels, documents and conversations."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import catalog as C
from ..operators import feedback as B
from ..operators import moments as M
from .base import query, r, table


def _feedback(spark, sf):
    """A label is a verdict on a document: quality 0 rejects it, toxic adds reasons."""
    reasons = F.when(F.col("toxic") == 1, F.array(F.lit("too_similar"), F.lit("drums_off"))).otherwise(F.array(F.lit("chop_fragmented"), F.lit("worth_keeping")))
    return table(spark, sf, "labels").select(
        "doc_id", F.when(F.col("quality") == 0, "reject").otherwise("keep").alias("verdict"), reasons.alias("reasons"),
        F.create_map(F.lit("chop"), F.col("quality") * 2 + 1, F.lit("sample"), F.col("toxic") + 2).alias("dims"))


FB = """fb AS (SELECT doc_id, CASE WHEN quality = 0 THEN 'reject' ELSE 'keep' END AS verdict, quality, toxic FROM labels)"""

_VERDICT = "CASE turn WHEN 0 THEN NULL WHEN 1 THEN 'keep' WHEN 2 THEN 'reject' WHEN 3 THEN 'regenerate' WHEN 4 THEN 'export' WHEN 5 THEN ' ' ELSE 'maybe' END"


@query(f"""WITH p AS (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN ' ' ELSE 'c' || turn END AS candidate, {_VERDICT} AS verdict, length(text) AS len FROM conversations)
SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'missing_id' WHEN verdict = 'maybe' THEN 'bad_verdict' END AS reason, coalesce(nullif(trim(verdict), ''), 'rated') AS verdict,
  concat_ws(',', CASE WHEN turn BETWEEN 1 AND 5 THEN 'chop=' || turn END, CASE WHEN len % 8 BETWEEN 1 AND 5 THEN 'drums=' || (len % 8) END) AS dims, 'no_space,too_rigid' AS reasons FROM p""")
def validate_feedback(spark, sf):
    t = F.col("turn")
    verdict = F.when(t == 0, F.lit(None)).when(t == 1, "keep").when(t == 2, "reject").when(t == 3, "regenerate").when(t == 4, "export").when(t == 5, " ").otherwise("maybe")
    dims = F.create_map(F.lit("chop"), t + 0.5, F.lit("color"), F.lit(3.0), F.lit("drums"), (F.length("text") % 8).cast("double"))
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(F.col("role") == "system", " ").otherwise(F.concat(F.lit("c"), t)).alias("candidate"), verdict.alias("verdict"),
        dims.alias("dims"), F.array(F.lit("no_space"), F.col("role"), F.lit("too_rigid")).alias("reasons"))
    split = C.quarantine(rows, B.rejects(F.col("conv_id").cast("string"), F.col("candidate"), F.col("verdict")))
    shown = F.transform(F.map_entries(B.normalise_dims(F.col("dims"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return split.select("conv_id", "turn", "reason", B.verdict_of(F.col("verdict")).alias("verdict"), F.array_join(shown, ",").alias("dims"),
                        F.array_join(B.normalise_reasons(F.col("reasons")), ",").alias("reasons"))


def _attributed(spark, sf):
    """Candidates are the documents of at least 400 characters; others are gone."""
    docs = table(spark, sf, "documents").where("n_chars >= 400").select("doc_id", "source", "lang")
    hero = {"source_id": F.when(F.col("lang") == "en", F.col("source")), "source": F.lit("")}
    source = B.source_of(hero, {"hero_source_id": F.when(F.col("lang") == "fr", F.concat(F.lit("hero-"), F.col("source")))}, F.array(F.concat(F.lit("sample-"), F.col("source"))))
    kind = F.when(F.col("lang") == "en", "loop").when(F.col("lang") == "fr", "chop").when(F.col("lang") == "de", "Stem").otherwise("other")
    return B.attribute(_feedback(spark, sf), docs.select("doc_id", source.alias("source"), kind.alias("kind")), ["doc_id"])


ATTRIBUTED = FB + """, cand AS (SELECT doc_id, CASE lang WHEN 'en' THEN source WHEN 'fr' THEN 'hero-' || source ELSE 'sample-' || source END AS source,
  CASE lang WHEN 'en' THEN 'loop' WHEN 'fr' THEN 'chop' WHEN 'de' THEN 'stem' ELSE 'other' END AS kind FROM documents WHERE n_chars >= 400),
att AS (SELECT fb.*, c.source, c.kind FROM fb LEFT JOIN cand c ON c.doc_id = fb.doc_id)"""


@query(f"WITH {ATTRIBUTED} SELECT coalesce(source, 'gone') AS source, CASE WHEN source IS NULL THEN 0 ELSE -count(*) END AS penalty, count(*) AS rejects FROM att WHERE verdict = 'reject' GROUP BY source")
def feedback_attribution(spark, sf):
    rows = _attributed(spark, sf)
    penalties = B.source_penalties(rows, "source", "verdict").withColumn("rejects", -F.col("penalty"))
    gone = rows.where((F.col("verdict") == "reject") & F.col("source").isNull()).groupBy(F.lit("gone").alias("source")).agg(
        F.lit(0).cast("long").alias("penalty"), F.count(F.lit(1)).alias("rejects"))
    return penalties.unionByName(gone)


@query(f"""WITH {FB}, e AS (SELECT unnest(CASE WHEN toxic = 1 THEN ['too_similar', 'drums_off'] ELSE ['chop_fragmented', 'worth_keeping'] END) AS reason FROM fb WHERE verdict = 'reject')
SELECT CASE reason WHEN 'too_similar' THEN 'loop' ELSE 'chop' END AS kind, {r("sum(-0.10::DOUBLE)", 2)} AS delta, count(*) AS n FROM e WHERE reason IN ('too_similar', 'chop_fragmented') GROUP BY 1""")
def reason_deltas(spark, sf):
    return B.kind_deltas(_feedback(spark, sf), "verdict", "reasons")


def _prior_sql(kind, base):
    k = f"count(*) FILTER (kind = '{kind}' AND verdict = 'keep')"
    x = f"count(*) FILTER (kind = '{kind}' AND verdict = 'reject')"
    return r(f"greatest(0.05::DOUBLE, least(0.9, {base} * (1.0 + 0.15 * {k}) * (1.0 - 0.25 * {x})))", 4) + f" AS {kind}"


@query(f"""WITH {ATTRIBUTED} SELECT coalesce(source, 'unknown') AS source, {', '.join(_prior_sql(k, b) for k, b in B.SOURCE_PRIOR.items())}
FROM att WHERE kind IN ('loop', 'chop', 'stem') GROUP BY 1""")
def source_priors(spark, sf):
    return B.source_priors(_attributed(spark, sf), "source", "kind", "verdict")


RESCORED = f"""pen AS (SELECT source, -count(*) AS penalty FROM att WHERE verdict = 'reject' AND source IS NOT NULL GROUP BY 1),
pri AS (SELECT coalesce(source, 'unknown') AS source, {', '.join(_prior_sql(k, b) for k, b in B.SOURCE_PRIOR.items())} FROM att WHERE kind IN ('loop', 'chop', 'stem') GROUP BY 1),
cands AS (SELECT doc_id, source, CASE lang WHEN 'en' THEN 'loop' WHEN 'fr' THEN 'chop' WHEN 'de' THEN 'stem' ELSE 'other' END AS kind, n_chars / (n_chars + 1000.0::DOUBLE) AS total FROM documents),
rescored AS (SELECT c.doc_id, c.source, c.kind, {r("""total * CASE c.kind WHEN 'loop' THEN coalesce(loop, 0.34) / 0.34 WHEN 'chop' THEN coalesce(chop, 0.33) / 0.33 WHEN 'stem' THEN coalesce(stem, 0.33) / 0.33 ELSE 1 END
    / (1.0 - 0.1 * coalesce(penalty, 0))""", 6)} AS adjusted
  FROM cands c LEFT JOIN pen ON pen.source = coalesce(c.source, 'unknown') LEFT JOIN pri ON pri.source = coalesce(c.source, 'unknown'))"""


def _rescored(spark, sf):
    """Documents as candidates, longer ones with a higher score, which the feedback on their sources changes."""
    rows = _attributed(spark, sf)
    kind = F.when(F.col("lang") == "en", "loop").when(F.col("lang") == "fr", "chop").when(F.col("lang") == "de", "stem").otherwise("other")
    candidates = table(spark, sf, "documents").select("doc_id", "source", kind.alias("kind"), (F.col("n_chars") / (F.col("n_chars") + 1000.0)).alias("total"))
    return B.feedback_scores(candidates, "total", "source", "kind", B.source_penalties(rows, "source", "verdict"), B.source_priors(rows, "source", "kind", "verdict"))


@query(f"WITH {ATTRIBUTED}, {RESCORED} SELECT doc_id, source, kind, adjusted FROM rescored")
def feedback_scores(spark, sf):
    return _rescored(spark, sf).drop("total")


@query(f"""WITH {ATTRIBUTED}, {RESCORED} SELECT doc_id, source, kind, adjusted FROM (
  SELECT * FROM rescored QUALIFY row_number() OVER (PARTITION BY kind ORDER BY adjusted DESC, doc_id) <= 8) ORDER BY adjusted DESC, doc_id LIMIT 20""")
def rank_with_feedback(spark, sf):
    """The best twenty candidates after feedback, at most eight of a kind."""
    return M.rank_capped(_rescored(spark, sf), "kind", [F.col("adjusted").desc(), F.col("doc_id")], 8, 20).drop("total")


GLOBAL = FB + f""", f AS (SELECT sum(CASE WHEN toxic = 1 THEN ln(0.85) + ln(0.9) ELSE 0 END + CASE WHEN toxic + 2 < 3 THEN ln(0.9) ELSE 0 END) AS loop,
  sum(CASE WHEN toxic = 0 THEN ln(0.85) ELSE 0 END + CASE WHEN quality * 2 + 1 < 3 THEN ln(0.9) ELSE 0 END) AS chop, sum(CASE WHEN toxic = 1 THEN ln(1.05) ELSE 0 END) AS stem FROM labels),
p AS (SELECT 0.33 * exp(loop) AS l, 0.34 * exp(chop) AS c, 0.33 * exp(stem) AS s FROM f),
q AS (SELECT {r("l / (l + c + s)", 4)} AS l, {r("c / (l + c + s)", 4)} AS c, {r("s / (l + c + s)", 4)} AS s FROM p),
prior AS (SELECT unnest(['loop', 'chop', 'stem']) AS kind, unnest([
  {r("l + CASE WHEN l >= c AND l >= s THEN 1 - l - c - s ELSE 0 END", 4)}, {r("c + CASE WHEN c > l AND c >= s THEN 1 - l - c - s ELSE 0 END", 4)},
  {r("s + CASE WHEN s > l AND s > c THEN 1 - l - c - s ELSE 0 END", 4)}]) AS prior FROM q)"""


@query(f"WITH {GLOBAL} SELECT kind, prior FROM prior")
def global_prior(spark, sf):
    return B.global_prior(_feedback(spark, sf), F.col("reasons"), "dims")


@query(f"WITH {GLOBAL} SELECT kind, prior, row_number() OVER (ORDER BY prior DESC, CASE kind WHEN 'loop' THEN 0 WHEN 'chop' THEN 1 ELSE 2 END)::INT AS position FROM prior")
def kind_order(spark, sf):
    return B.kind_order(B.global_prior(_feedback(spark, sf), F.col("reasons"), "dims"), C.RECIPE_KINDS)


@query(f"""SELECT source, lang, count(*) AS runs, sum(kept)::BIGINT AS kept_runs, {r("avg(kept)", 6)} AS rate FROM (
  SELECT d.source, d.lang, d.doc_id, max(l.quality) AS kept FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY 1, 2, 3) GROUP BY ROLLUP (source, lang)""")
def kept_rate(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "source", "lang"), "doc_id")
    return B.kept_rate(rows, ["source", "lang"], "doc_id", F.col("quality") == 1)
