"""Catalog queries: ingest, filters, upserts, lifecycle, integrity and lineage."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import catalog as C
from ..operators import ordered as O
from ..operators import timeline as T
from .base import query, r, table


def _assets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"), "source", "lang", "n_chars")


def _known(spark, sf):
    """Digests of the documents that are already labelled."""
    seen = _assets(spark, sf).join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    return seen.select("digest")


# --- ingest ------------------------------------------------------------------------------

@query("""SELECT doc_id, digest, source, n_chars FROM (
  SELECT doc_id, md5(text) AS digest, source, n_chars, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents)
WHERE k = 1 AND digest NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""")
def incremental_dedup(spark, sf):
    return C.incremental(_assets(spark, sf).drop("lang"), _known(spark, sf), "digest", ["doc_id"])


@query("""WITH good AS (SELECT doc_id, source, n_chars FROM documents WHERE n_chars >= 400)
SELECT doc_id, source, n_chars, (SELECT count(*) FROM good) > 50 AS truncated FROM good ORDER BY doc_id LIMIT 50""")
def scan_limit_truncated(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    split = C.quarantine(docs, {"too_short": F.col("n_chars") < 400})
    return C.admit(split.where("reason is null").drop("reason"), [F.col("doc_id")], 50)


@query("""WITH known AS (SELECT digest, min(doc_id) AS doc_id FROM (SELECT md5(text) AS digest, doc_id FROM documents) GROUP BY 1)
SELECT CASE WHEN n_chars < 400 THEN 'fail' WHEN k.doc_id <> d.doc_id THEN 'skip' ELSE 'ok' END AS status, count(*) AS n
FROM documents d JOIN known k ON k.digest = md5(d.text) GROUP BY 1""")
def batch_outcomes(spark, sf):
    assets = _assets(spark, sf)
    firsts = assets.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    marked = assets.join(firsts, "doc_id", "left")
    status = F.when(F.col("n_chars") < 400, "fail").when(F.col("first").isNull(), "skip").otherwise("ok")
    return C.outcomes(marked.withColumn("status", status), "status")


@query("""WITH old AS (SELECT source AS id, 'old' AS crawl_state, max(doc_id) AS last_cursor FROM documents
    WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1),
new AS (SELECT source AS id, 'ok' AS crawl_state, CASE WHEN sum(n_chars) % 2 = 1 THEN max(doc_id) END AS last_cursor
    FROM documents WHERE lang <> 'en' GROUP BY 1)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.crawl_state, o.crawl_state) AS crawl_state,
  coalesce(n.last_cursor, o.last_cursor) AS last_cursor FROM old o FULL JOIN new n ON n.id = o.id""")
def latest_source_registry(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    old = docs.join(table(spark, sf, "labels"), "doc_id", "left_semi").groupBy(F.col("source").alias("id")).agg(
        F.lit("old").alias("crawl_state"), F.max("doc_id").alias("last_cursor"))
    new = docs.where("lang <> 'en'").groupBy(F.col("source").alias("id")).agg(
        F.lit("ok").alias("crawl_state"), F.when(F.sum("n_chars") % 2 == 1, F.max("doc_id")).alias("last_cursor"))
    return C.registry(old, new, "id")


# --- attributes --------------------------------------------------------------------------

_SPEECH = " OR ".join(f"contains(lower(text), '{w}')" for w in S.SPEECH_WORDS)


@query(f"""SELECT 'part' AS kind, p_partkey AS id, CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear') THEN 'speech'
  WHEN p_size * 1.5 < 3 THEN 'one_shots' WHEN p_size * 1.5 < 20 THEN 'loops' WHEN p_size * 1.5 < 60 THEN 'fx' ELSE 'songs' END AS category FROM part
UNION ALL SELECT 'document', doc_id, CASE WHEN {_SPEECH} THEN 'speech' WHEN n_chars < 300 THEN 'unknown'
  WHEN n_chars / 400.0 < 3 THEN 'one_shots' WHEN n_chars / 400.0 < 20 THEN 'loops' WHEN n_chars / 400.0 < 60 THEN 'fx' ELSE 'songs' END FROM documents""")
def categorize(spark, sf):
    parts = table(spark, sf, "part").select(
        F.lit("part").alias("kind"), F.col("p_partkey").alias("id"),
        S.category(F.col("p_size") * 1.5, F.col("p_name"), ("ring", "gear")).alias("category"))
    seconds = F.when(F.col("n_chars") >= 300, F.col("n_chars") / 400.0)
    docs = table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), S.category(seconds, F.col("text")).alias("category"))
    return parts.unionByName(docs)


@query("""WITH tokens AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '[A-Za-z0-9一-鿿]+'))) AS tag,
    generate_subscripts(regexp_extract_all(text, '[A-Za-z0-9一-鿿]+'), 1) AS pos FROM documents),
every AS (SELECT doc_id, tag, pos FROM tokens WHERE length(tag) >= 2 UNION ALL SELECT doc_id, lang, 1000000000 FROM documents),
firsts AS (SELECT doc_id, tag, min(pos) AS pos FROM every GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) <= 20)
SELECT doc_id, string_agg(tag, '|' ORDER BY pos) AS tags FROM firsts GROUP BY 1""")
def extract_tags(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", F.array_join(S.tags(F.col("text"), F.col("lang")), "|").alias("tags"))


@query("""SELECT o_orderkey, 'order-' || left(sha256('["' || o_custkey || '","' || o_orderkey || '"]'), 16) AS id,
  ('0x' || left(sha256('run:' || o_orderkey), 8))::BIGINT AS seed,
  printf('%d:%s:%07.3f-%07.3f', o_custkey, o_orderstatus, o_orderkey / 8.0, o_orderkey / 8.0 + 2.5) AS moment_id FROM orders""")
def stable_ids(spark, sf):
    o = table(spark, sf, "orders")
    at = F.col("o_orderkey") / 8.0
    return o.select("o_orderkey", S.stable_id("order", F.col("o_custkey"), F.col("o_orderkey")).alias("id"),
                    S.seed(F.concat(F.lit("run:"), F.col("o_orderkey"))).alias("seed"),
                    S.moment_key(F.col("o_custkey"), F.col("o_orderstatus"), at, at + 2.5).alias("moment_id"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE json_extract_string(props, '$.k')::INTEGER END AS k,
  event_type <> 'error' AS valid FROM events""")
def json_props(spark, sf):
    """Every 'error' event gets a malformed document, which must come out as NULL."""
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    parsed = S.parse_json(broken, "map<string,int>")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), parsed.isNotNull().alias("valid"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'trim>highpass' || CASE WHEN l_returnflag = 'A' THEN '>lowpass' ELSE '' END
  || CASE WHEN l_linestatus = 'F' THEN '>reverse' ELSE '' END || CASE WHEN l_tax <> 0 THEN '>time_stretch' ELSE '' END || '>gain>pan' AS ops,
  (1 + (l_returnflag = 'A')::INT + (l_linestatus = 'F')::INT + (l_tax <> 0)::INT) AS baked, {r("0.5 + l_discount", 6)} AS gain FROM lineitem""")
def op_chain(spark, sf):
    lowpass = F.when(F.col("l_returnflag") == "A", F.col("l_quantity") * 100)
    chain = S.op_chain(lowpass, F.col("l_linestatus") == "F", F.col("l_tax"), 0.5 + F.col("l_discount"), F.lit(0.0))
    items = table(spark, sf, "lineitem").withColumn("chain", chain)
    baked = F.size(F.filter("chain", lambda o: o["capability"] == "baked"))
    gain = F.filter("chain", lambda o: o["op"] == "gain")[0]["value"]
    return items.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                        F.array_join(F.transform("chain", lambda o: o["op"]), ">").alias("ops"), baked.alias("baked"), gain.alias("gain"))


_WEIGHT = " + ".join(f"CASE WHEN contains(lower(text), '{w}') THEN {v} ELSE 0 END" for w, v in S.SOURCE_WORDS.items())


@query(f"SELECT doc_id, {r(f'least(1, ({_WEIGHT})::DOUBLE)', 4)} AS prior FROM documents")
def keyword_prior(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.source_weight(F.col("text")).alias("prior"))


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_extendedprice <> 0 AND abs(l_quantity * 1000 - l_extendedprice) > 0.5
  THEN {r("l_quantity * 1000 / l_extendedprice", 4)} ELSE 1.0::DOUBLE END AS stretch FROM lineitem""")
def stretch_ratio(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.stretch_ratio(F.col("l_quantity") * 1000.0, F.col("l_extendedprice")).alias("stretch"))


_NOTE = "CASE WHEN p_size % 5 = 0 THEN (p_size * 4)::VARCHAR WHEN p_size % 7 = 0 THEN 'H2' ELSE substr('CDEFGAB', (p_partkey % 7 + 1)::INT, 1) || CASE p_size % 3 WHEN 0 THEN '#' WHEN 1 THEN 'b' ELSE '' END || (p_size % 9) END"


@query(f"""WITH n AS (SELECT p_partkey, {_NOTE} AS note, p_size FROM part)
SELECT p_partkey, note, (CASE WHEN p_size % 5 = 0 THEN CASE WHEN p_size * 4 <= 127 THEN p_size * 4 END WHEN p_size % 7 = 0 THEN NULL
  ELSE (p_size % 9 + 1) * 12 + CASE left(note, 1) WHEN 'C' THEN 0 WHEN 'D' THEN 2 WHEN 'E' THEN 4 WHEN 'F' THEN 5 WHEN 'G' THEN 7 WHEN 'A' THEN 9 ELSE 11 END
    + CASE p_size % 3 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END END)::INT AS number FROM n""")
def note_number(spark, sf):
    letter = F.substring(F.lit("CDEFGAB"), (F.col("p_partkey") % 7 + 1).cast("int"), F.lit(1))
    sign = F.element_at(F.array(F.lit("#"), F.lit("b"), F.lit("")), F.col("p_size") % 3 + 1)
    note = (F.when(F.col("p_size") % 5 == 0, (F.col("p_size") * 4).cast("string")).when(F.col("p_size") % 7 == 0, "H2")
            .otherwise(F.concat(letter, sign, (F.col("p_size") % 9).cast("string"))))
    parts = table(spark, sf, "part").select("p_partkey", note.alias("note"))
    return parts.select("p_partkey", "note", S.note_number(F.col("note")).alias("number"))


@query("SELECT p_partkey, ('0x' || left(sha256('kit:' || p_partkey), 8))::BIGINT % 5 AS choice FROM part")
def hash_choice(spark, sf):
    key = F.concat(F.lit("kit:"), F.col("p_partkey"))
    return table(spark, sf, "part").select("p_partkey", S.hash_pick(key, 5).alias("choice"))


_H = lambda key: f"('0x' || left(sha256({key}), 8))::BIGINT"
_S = lambda i: f"{{'h': {_H(f"'kit:' || p_partkey || ':{i}'")}, 'x': {i}}}"


@query(f"""SELECT p_partkey, array_to_string(list_transform(list_sort([{', '.join(_S(i) for i in (2, 5, 7, 10, 14))}])[1:2], lambda d: d.x), ',') AS steps,
  {r(f"(2.0 + 6.0 * ({_H("'kit:' || p_partkey || ':ms'")} / 4294967296.0::DOUBLE)) * CASE WHEN {_H("'kit:' || p_partkey || ':side'")} % 2 = 0 THEN -1.0 ELSE 1.0 END", 2)} AS offset_ms,
  greatest(1, least(127, p_size * 3 + CASE WHEN {_H("'kit:' || p_partkey || ':up'")} % 2 = 0 THEN -1 ELSE 1 END * (5 + {_H("'kit:' || p_partkey || ':velocity'")} % 11)))::INT AS velocity FROM part""")
def hash_sample(spark, sf):
    key = F.concat(F.lit("kit:"), F.col("p_partkey"))
    steps = F.array(*[F.lit(i) for i in (2, 5, 7, 10, 14)])
    return table(spark, sf, "part").select(
        "p_partkey", F.array_join(S.hash_sample(key, steps, 2).cast("array<string>"), ",").alias("steps"),
        S.jitter_ms(key).alias("offset_ms"), S.jitter_velocity(key, F.col("p_size") * 3).alias("velocity"))


# --- filters -----------------------------------------------------------------------------

@query("SELECT d.doc_id, d.source, l.toxic FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality = 1")
def quality_pool(spark, sf):
    scores = table(spark, sf, "labels").select("doc_id", "toxic", (F.col("quality") == 1).alias("passed"))
    return C.quality_pool(table(spark, sf, "documents").select("doc_id", "source"), scores, "doc_id").drop("passed")


@query("""WITH s AS (SELECT d.doc_id, d.source, coalesce(CASE WHEN l.toxic = 1 THEN 'blocked' WHEN l.quality = 1 THEN 'allowed' WHEN l.quality = 0 THEN 'private_only' END, 'needs_review') AS rights_state
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT 'private' AS pool, doc_id, rights_state FROM s WHERE rights_state <> 'blocked'
UNION ALL SELECT 'public', doc_id, rights_state FROM s WHERE rights_state = 'allowed'""")
def rights_admission(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    both = [C.admitted(docs, _rights(spark, sf), "doc_id", private).select(F.lit(name).alias("pool"), "doc_id", "rights_state")
            for name, private in (("private", True), ("public", False))]
    return both[0].unionByName(both[1])


def _rights(spark, sf):
    state = F.when(F.col("toxic") == 1, "blocked").when(F.col("quality") == 1, "allowed").otherwise("private_only")
    return table(spark, sf, "labels").select("doc_id", state.alias("state"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, sf):
    return C.missing_ids(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_type = 'PROMO' AND p_brand IS NOT NULL ORDER BY p_retailprice, p_partkey")
def optional_filters(spark, sf):
    found = C.where_given(table(spark, sf, "part"), {"p_type": "PROMO", "p_size": None}, {"p_brand": True, "p_name": None})
    return found.orderBy("p_retailprice", "p_partkey").select("p_partkey", "p_brand", "p_size")


@query("""SELECT p_partkey, contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear') AS is_primary,
  contains(lower(p_type), 'promo') OR contains(lower(p_type), 'small') AS is_supporting FROM part
WHERE contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear') OR contains(lower(p_type), 'promo') OR contains(lower(p_type), 'small')""")
def typed_filter(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey", S.type_matches(F.col("p_name"), ("ring", "gear")).alias("is_primary"),
        S.type_matches(F.col("p_type"), ("promo", "small")).alias("is_supporting"))
    return parts.where("is_primary or is_supporting")


# --- upserts and lifecycle ---------------------------------------------------------------

@query("""WITH old AS (SELECT d.doc_id AS id, d.source AS title, 'analyzed' AS status, l.quality * 100.0::DOUBLE AS bpm, d.n_chars AS size_bytes
    FROM documents d JOIN labels l ON l.doc_id = d.doc_id),
new AS (SELECT doc_id AS id, lang AS title, 'ingested' AS status, NULL::DOUBLE AS bpm, n_chars + 1 AS size_bytes FROM documents WHERE n_chars >= 400)
SELECT coalesce(o.id, n.id) AS id, coalesce(n.title, o.title) AS title, coalesce(o.status, n.status) AS status, o.bpm AS bpm,
  coalesce(n.size_bytes, o.size_bytes) AS size_bytes FROM old o FULL JOIN new n ON n.id = o.id""")
def upsert_protected(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    old = docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.lit("analyzed").alias("status"),
        (F.col("quality") * 100.0).alias("bpm"), F.col("n_chars").alias("size_bytes"))
    new = docs.where("n_chars >= 400").select(
        F.col("doc_id").alias("id"), F.col("lang").alias("title"), F.lit("ingested").alias("status"),
        F.lit(None).cast("double").alias("bpm"), (F.col("n_chars") + 1).alias("size_bytes"))
    return C.merge_fields(old, new, "id", C.DOWNSTREAM, F.col("n.status") == "ingested")


@query("""WITH old AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'blocked' WHEN quality = 1 THEN 'allowed' ELSE 'private_only' END AS state, 'reviewed' AS basis FROM labels),
new AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'needs_review' ELSE 'allowed' END AS state, CASE WHEN lang = 'en' THEN 'unknown_license' ELSE 'cc_license' END AS basis FROM documents)
SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN n.doc_id IS NULL OR (o.doc_id IS NOT NULL AND n.basis = 'unknown_license') THEN o.state ELSE n.state END AS state,
  CASE WHEN n.doc_id IS NULL OR (o.doc_id IS NOT NULL AND n.basis = 'unknown_license') THEN o.basis ELSE n.basis END AS basis FROM old o FULL JOIN new n ON n.doc_id = o.doc_id""")
def upsert_rights(spark, sf):
    old = _rights(spark, sf).withColumn("basis", F.lit("reviewed"))
    english = F.col("lang") == "en"
    new = table(spark, sf, "documents").select(
        "doc_id", F.when(english, "needs_review").otherwise("allowed").alias("state"),
        F.when(english, "unknown_license").otherwise("cc_license").alias("basis"))
    return C.merge_rights(old, new, "doc_id")


@query("""SELECT user_id, event_type, event_id, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_wins(spark, sf):
    events = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return C.latest_by(events, ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'kept' ELSE 'exported' END AS state FROM orders""")
def migrate_absent(spark, sf):
    """Finished orders are already migrated as 'kept'; all legacy rows arrive as 'exported'."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    old = orders.where("o_orderstatus = 'F'").select("id", F.lit("kept").alias("state"))
    new = orders.select("id", F.lit("exported").alias("state"))
    return C.insert_absent(old, new, "id")


_STATE = "CASE o_orderpriority WHEN '1-URGENT' THEN 'discovered' WHEN '2-HIGH' THEN 'ingested' WHEN '3-MEDIUM' THEN 'analyzed' WHEN '4-NOT SPECIFIED' THEN 'generated' ELSE 'kept' END"
_ORDINAL = "CASE state WHEN 'discovered' THEN 0 WHEN 'ingested' THEN 3 WHEN 'analyzed' THEN 4 WHEN 'generated' THEN 8 ELSE 10 END"


@query(f"""WITH s AS (SELECT o_custkey, o_orderkey, {_STATE} AS state FROM orders),
p AS (SELECT state, {_ORDINAL} AS ordinal, lag({_ORDINAL}) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS was FROM s)
SELECT state, ordinal, count(*) AS n, count(*) FILTER (was > ordinal) AS regressions FROM p GROUP BY 1, 2""")
def state_funnel(spark, sf):
    names = T.literal_map({"1-URGENT": "discovered", "2-HIGH": "ingested", "3-MEDIUM": "analyzed", "4-NOT SPECIFIED": "generated"})
    jobs = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.coalesce(names[F.col("o_orderpriority")], F.lit("kept")).alias("state"))
    jobs = jobs.withColumn("ordinal", C.state_ordinal(F.col("state")))
    steps = O.neighbour(jobs, ["o_custkey"], ["o_orderkey"], {"was": "ordinal"})
    return steps.groupBy("state", "ordinal").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("was") > F.col("ordinal"), 1)).alias("regressions"))


@query("""WITH old AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'kept' ELSE 'analyzed' END AS state, 1 AS attempts FROM orders WHERE o_orderstatus <> 'P'),
new AS (SELECT l_orderkey AS id, CASE WHEN max(l_linenumber) >= 6 THEN 'ingested' ELSE 'generated' END AS state, count(*) FILTER (l_returnflag = 'R')::INT AS retries FROM lineitem GROUP BY 1)
SELECT coalesce(o.id, n.id) AS id, 'asset' AS type, CASE WHEN n.id IS NULL OR (o.id IS NOT NULL AND n.state = 'ingested') THEN o.state ELSE n.state END AS state,
  (coalesce(o.attempts, 0) + coalesce(n.retries, 0))::INT AS attempts FROM old o FULL JOIN new n ON n.id = o.id""")
def job_merge(spark, sf):
    old = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("id"), F.lit("asset").alias("type"),
        F.when(F.col("o_orderstatus") == "F", "kept").otherwise("analyzed").alias("state"), F.lit(1).alias("attempts"))
    new = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.lit("asset").alias("type"), F.when(F.max("l_linenumber") >= 6, "ingested").otherwise("generated").alias("state"),
        F.count(F.when(F.col("l_returnflag") == "R", 1)).cast("int").alias("retries"))
    return C.merge_jobs(old, new, "id")


@query("""WITH old AS (SELECT o_orderkey AS id, 'kept' AS state, o_orderdate AS started_at FROM orders WHERE o_orderstatus = 'F'),
new AS (SELECT o_orderkey AS id, 'generated' AS state, CASE WHEN o_totalprice > 100000 THEN o_orderdate + INTERVAL 1 DAY END AS started_at FROM orders WHERE o_orderpriority <> '5-LOW')
SELECT coalesce(o.id, n.id) AS id, coalesce(n.state, o.state) AS state, coalesce(n.started_at, o.started_at) AS started_at FROM old o FULL JOIN new n ON n.id = o.id""")
def run_merge(spark, sf):
    orders = table(spark, sf, "orders")
    old = orders.where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("id"), F.lit("kept").alias("state"), F.col("o_orderdate").alias("started_at"))
    later = F.col("o_orderdate") + F.expr("interval 1 day")
    new = orders.where("o_orderpriority <> '5-LOW'").select(
        F.col("o_orderkey").alias("id"), F.lit("generated").alias("status"),
        F.when(F.col("o_totalprice") > 100000, later).alias("created_at"))
    new = C.with_aliases(new, {"status": "state", "created_at": "started_at", "generated_at": "finished_at"})
    return C.merge_fields(old, new, "id", keep_known=["started_at"])


@query("""SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'c' || o_custkey WHEN '2-HIGH' THEN 'b' || o_custkey WHEN '3-MEDIUM' THEN 'i' || o_custkey
  ELSE 'r' || o_custkey END || ',second' AS ids FROM orders""")
def candidate_ids(spark, sf):
    """Candidate lists with different keys set; empty candidates leave no id."""
    given = lambda p, prefix: F.when(F.col("o_orderpriority") == p, F.concat(F.lit(prefix), F.col("o_custkey")))
    none = F.lit(None).cast("string")
    first = F.struct(given("1-URGENT", "c").alias("candidate_id"), given("2-HIGH", "b").alias("beat_id"), given("3-MEDIUM", "i").alias("id"),
                     F.concat(F.lit("r"), F.col("o_custkey")).alias("recipe_id"))
    blank = F.struct(none.alias("candidate_id"), none.alias("beat_id"), none.alias("id"), none.alias("recipe_id"))
    second = F.struct(none.alias("candidate_id"), none.alias("beat_id"), F.lit("second").alias("id"), none.alias("recipe_id"))
    ids = C.candidate_ids(F.array(first, blank, second))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(ids, ",").alias("ids"))


_KIND = "CASE l_returnflag WHEN 'A' THEN 'loop' WHEN 'N' THEN 'chop' ELSE 'other' END"


@query(f"""SELECT l_orderkey || ':' || l_linenumber AS recipe_id, l_orderkey AS run_id, {_KIND} AS kind, max(l_partkey) AS seed
FROM lineitem WHERE {_KIND} IN ('loop', 'chop', 'stem') AND l_linenumber <> 7 GROUP BY ALL""")
def run_candidates(spark, sf):
    """Runs hold pages of at most 10,000 candidates (an order's lines); each valid one is a recipe row."""
    kind = F.when(F.col("l_returnflag") == "A", "loop").when(F.col("l_returnflag") == "N", "chop").otherwise("other")
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("id"), kind.alias("kind"),
        F.when(F.col("l_linenumber") != 7, F.concat_ws(":", "l_orderkey", "l_linenumber")).alias("recipe_id"), F.col("l_partkey").alias("seed"))
    runs = T.events_to_doc(lines, ["id"], ["recipe_id", "kind", "seed"]).withColumn("hero_moment_id", F.lit(None).cast("string"))
    rows = C.candidate_rows(runs, "id", "events")
    return rows.groupBy("recipe_id", "run_id", "kind").agg(F.max("seed").alias("seed"))


_LINE_KIND = "CASE WHEN l_linenumber = 7 THEN 'other' WHEN l_returnflag = 'A' THEN 'loop' WHEN l_returnflag = 'N' THEN 'chop' END"


@query(f"""WITH g AS (SELECT l_partkey AS recipe_id, l_orderkey AS run_id, {_LINE_KIND} AS kind, CASE WHEN l_linenumber = 1 THEN 'o' || l_orderkey END AS hero,
  CASE WHEN l_linestatus = 'O' THEN l_suppkey END AS seed, CASE WHEN l_linenumber = 2 THEN 'v2' END AS ver, l_linenumber AS line,
  CASE WHEN l_returnflag = 'A' THEN l_quantity::INT END AS tempo, NULL AS brand,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS pos FROM lineitem),
o AS (SELECT p_partkey AS recipe_id, -1 AS run_id, CASE WHEN p_size % 4 = 0 THEN 'stem' END AS kind, 'h' || p_size AS hero, p_size AS seed, 'v1' AS ver,
  NULL AS line, p_size AS tempo, p_brand AS brand, 0 AS pos FROM part WHERE p_size % 2 = 0),
f AS (SELECT recipe_id, min(pos) AS first FROM (SELECT * FROM g UNION ALL SELECT * FROM o) WHERE kind IN ('loop', 'chop', 'stem') GROUP BY 1),
u AS (SELECT g.* FROM g JOIN f USING (recipe_id) WHERE pos >= first AND coalesce(kind, 'loop') <> 'other' UNION ALL SELECT * FROM o)
SELECT recipe_id, arg_max(run_id, pos) AS run_id, arg_max(kind, pos) AS kind, arg_max(hero, pos) AS hero_moment_id, arg_max(seed, pos)::BIGINT AS seed,
  arg_max(ver, pos) AS pipeline_ver, arg_max(line, pos)::INT AS line, arg_max(tempo, pos)::INT AS tempo, arg_max(brand, pos) AS brand FROM u GROUP BY 1""")
def recipe_merge(spark, sf):
    """Half of the parts are recipes already; the lines of all orders are candidates for the recipe of their part."""
    part = table(spark, sf, "part").where("p_size % 2 = 0")
    old = part.select(
        F.col("p_partkey").alias("recipe_id"), F.lit(-1).cast("long").alias("run_id"), F.when(F.col("p_size") % 4 == 0, "stem").alias("kind"),
        F.concat(F.lit("h"), F.col("p_size")).alias("hero_moment_id"), F.col("p_size").cast("long").alias("seed"), F.lit("v1").alias("pipeline_ver"),
        F.to_json(F.struct(F.col("p_size").alias("tempo"), F.col("p_brand").alias("brand"))).alias("manifest"))
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice"]
    line = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("recipe_id"), F.col("l_orderkey").alias("run_id"), F.expr(_LINE_KIND).alias("kind"),
        F.when(F.col("l_linenumber") == 1, F.concat(F.lit("o"), F.col("l_orderkey"))).alias("hero_moment_id"),
        F.when(F.col("l_linestatus") == "O", F.col("l_suppkey").cast("long")).alias("seed"), F.when(F.col("l_linenumber") == 2, "v2").alias("pipeline_ver"),
        F.to_json(F.struct(F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "A", F.col("l_quantity").cast("int")).alias("tempo"))).alias("manifest"),
        *order)
    entry = lambda name, kind: F.get_json_object("manifest", f"$.{name}").cast(kind).alias(name)
    return C.merge_recipes(old, line, order).select("recipe_id", "run_id", "kind", "hero_moment_id", "seed", "pipeline_ver",
                                                    entry("line", "int"), entry("tempo", "int"), entry("brand", "string"))


@query("""SELECT 'assets' AS target, count(*) FILTER (k = 1 AND n_chars % 2 = 1) AS inserted, count(*) FILTER (old) AS present,
  count(*) FILTER (NOT old AND k > 1) AS repeated, 0 AS without_key FROM (SELECT *, count(*) FILTER (n_chars % 2 = 0) OVER (PARTITION BY md5(text)) > 0 AS old,
  row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents)
UNION ALL SELECT 'jobs', count(DISTINCT o_custkey) FILTER (o_custkey % 3 = 1), count(*) FILTER (o_custkey % 3 = 0),
  count(*) FILTER (o_custkey % 3 = 1) - count(DISTINCT o_custkey) FILTER (o_custkey % 3 = 1), count(*) FILTER (o_custkey % 3 = 2) FROM orders""")
def migrate_counts(spark, sf):
    """Documents of even length are migrated by digest; of the orders, each third customer is there and each third has no key."""
    docs = table(spark, sf, "documents").select(F.md5("text").alias("digest"), "n_chars")
    customer = F.col("o_custkey")
    orders = table(spark, sf, "orders").select(F.when(customer % 3 != 2, customer).alias("id"))
    return C.migration_counts({"assets": (docs.where("n_chars % 2 = 0"), docs, "digest"),
                               "jobs": (table(spark, sf, "orders").select(customer.alias("id")).where("id % 3 = 0"), orders, "id")})


@query("""SELECT d.doc_id, CASE WHEN d.n_chars % 3 = 0 THEN 'opened' WHEN l.doc_id IS NULL THEN NULL ELSE 'kept' END AS outcome,
  CASE WHEN l.doc_id IS NULL THEN 'rated' WHEN l.quality = 1 THEN 'keep' ELSE 'reject' END AS verdict
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NOT NULL OR d.n_chars % 3 = 0""")
def set_outcome(spark, sf):
    old = table(spark, sf, "labels").select("doc_id", F.lit("kept").alias("outcome"), F.when(F.col("quality") == 1, "keep").otherwise("reject").alias("verdict"))
    value = F.when(F.col("n_chars") % 3 == 0, "  opened ").when(F.col("n_chars") % 3 == 1, F.repeat(F.lit("x"), 41)).otherwise("")
    changes = table(spark, sf, "documents").select("doc_id", value.alias("outcome"))
    return C.set_field(old, changes, "doc_id", "outcome", {"verdict": "rated"})


# --- integrity, resume and lineage -------------------------------------------------------

@query("""SELECT 'duplicate_line' AS rule, l_orderkey || '/' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1
UNION ALL SELECT 'unknown_order', l_orderkey::VARCHAR, count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey
UNION ALL SELECT 'unknown_customer', o_custkey::VARCHAR, count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
UNION ALL SELECT 'order_without_lines', o_orderkey::VARCHAR, count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderkey
UNION ALL SELECT 'open_return', l_orderkey::VARCHAR, count(*) FROM lineitem WHERE l_linestatus = 'O' AND l_returnflag = 'R' GROUP BY l_orderkey""")
def integrity_report(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    return T.report(
        T.duplicate_keys(lines, ["l_orderkey", "l_linenumber"], "duplicate_line"),
        T.unknown_keys(lines, "l_orderkey", orders, "o_orderkey", "unknown_order"),
        T.unknown_keys(orders, "o_custkey", table(spark, sf, "customer"), "c_custkey", "unknown_customer"),
        T.unknown_keys(orders, "o_orderkey", lines, "l_orderkey", "order_without_lines"),
        T.failing_rows(lines, "l_orderkey", (F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R"), "open_return"))


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderkey IN (
  SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) >= 3))""")
def resume_pending(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    return T.pending(orders, lines, "o_orderkey", "l_linenumber", 3, F.col("o_orderstatus") == "F")


@query("""SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, p.p_name AS title, coalesce(s.s_name, '') AS artist, n.n_name AS rights
FROM lineitem l LEFT JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey""")
def provenance(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("artist"), "s_nationkey")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("rights"))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("title"))
    known = suppliers.join(nations, "s_nationkey", "left").drop("s_nationkey")
    used = lines.join(parts, "l_partkey", "left")
    return used.join(known, "l_suppkey", "left").withColumn("artist", F.coalesce("artist", F.lit("")))


@query(f"""WITH p AS (SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, c.c_name, l.l_partkey, l.l_quantity FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey)
SELECT o_orderkey AS run_id, any_value(c_name) AS artist, CASE any_value(o_orderstatus) WHEN 'F' THEN 'allowed' ELSE 'needs_review' END AS rights_state,
  count(l_partkey) AS pieces, {r("coalesce(sum(l_quantity), 0)", 2)} AS seconds, min(l_partkey) AS first_piece FROM p GROUP BY 1""")
def lineage_documents(spark, sf):
    """One lineage row per run and page: asset, rights and the list of pieces; then totals per run."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("asset_id"), "o_orderstatus")
    rights = orders.select("run_id", F.when(F.col("o_orderstatus") == "F", "allowed").otherwise("needs_review").alias("rights_state"))
    assets = table(spark, sf, "customer").select(F.col("c_custkey").alias("asset_id"), F.col("c_name").alias("artist"))
    pieces = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_partkey").alias("piece"), F.col("l_quantity").alias("seconds"))
    docs = T.lineage(orders.drop("o_orderstatus"), "run_id", assets, "asset_id", rights, pieces, ["piece", "seconds"])
    n = F.coalesce(F.size("pieces"), F.lit(0))
    total = F.aggregate(F.coalesce("pieces", F.array().cast(docs.schema["pieces"].dataType)), F.lit(0.0), lambda a, p: a + p["seconds"])
    return docs.groupBy("run_id").agg(
        F.first("artist").alias("artist"), F.first("rights_state").alias("rights_state"), F.sum(n).cast("long").alias("pieces"),
        S.round_to(F.sum(total), 2).alias("seconds"), F.min(F.array_min(F.transform("pieces", lambda p: p["piece"]))).alias("first_piece"))


@query("""SELECT l_partkey, count(*) AS uses, min(l_shipdate) AS first_start, max(l_shipdate) AS last_end FROM lineitem GROUP BY 1 ORDER BY 1 LIMIT 10""")
def usage_summary(spark, sf):
    return T.usage_summary(table(spark, sf, "lineitem"), "l_partkey", "l_shipdate", "l_shipdate")


@query(f"""SELECT o.o_orderkey AS run_id, count(*) AS candidates, {r("sum(l_quantity * 240.0 / 92)", 2)} AS duration_s,
  count(*) FILTER (l_linestatus = 'F') AS rendered FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1""")
def run_summary(spark, sf):
    """Pages of candidate documents per run, then totals over the documents of a run."""
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), "l_linenumber", "l_partkey",
                                                (F.col("l_quantity") * 240.0 / 92).alias("duration"), (F.col("l_linestatus") == "F").alias("done"))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"))
    docs = T.events_to_doc(lines, ["run_id"], ["l_linenumber", "l_partkey", "duration", "done"]).join(runs, "run_id", "left_semi")
    seconds = F.aggregate("events", F.lit(0.0), lambda a, e: a + e["duration"])
    done = F.size(F.filter("events", lambda e: e["done"]))
    return docs.groupBy("run_id").agg(F.sum(F.size("events")).alias("candidates"), S.round_to(F.sum(seconds), 2).alias("duration_s"),
                                      F.sum(done).alias("rendered"))


@query("""WITH v AS (SELECT p_partkey, 1 AS o, 'Name' AS label, p_name AS value FROM part UNION ALL SELECT p_partkey, 2, 'Brand', CASE WHEN p_size % 4 <> 0 THEN p_brand END FROM part
UNION ALL SELECT p_partkey, 3, 'Type', p_type FROM part UNION ALL SELECT p_partkey, 4, 'Size', p_size::VARCHAR FROM part)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY o)::INT AS position, label, value FROM v WHERE value IS NOT NULL""")
def unpivot_summary(spark, sf):
    parts = table(spark, sf, "part").withColumn("p_brand", F.when(F.col("p_size") % 4 != 0, F.col("p_brand")))
    return T.label_values(parts, "p_partkey", {"p_name": "Name", "p_brand": "Brand", "p_type": "Type", "p_size": "Size"})


@query("SELECT count(*) AS n, 0::BIGINT AS differing FROM (SELECT o_orderpriority, o_orderstatus FROM orders GROUP BY 1, 2)")
def repro_diff(spark, sf):
    """Two independent runs of one summary, compared without their stamps."""
    def run(stamp):
        return table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(
            F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("last")).withColumn("created_at", F.lit(stamp))
    first = run("first")
    diff = T.reproducible(first, run("second"), ["created_at"]).agg(F.count(F.lit(1)).alias("differing"))
    return first.agg(F.count(F.lit(1)).alias("n")).withColumn("differing", diff.scalar())


_STATES = """SELECT CASE o_orderstatus WHEN 'F' THEN 'allowed' WHEN 'O' THEN 'needs_review' WHEN 'P' THEN 'pending' END AS rights,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE 'ingested' END AS job FROM orders"""


def _states(spark, sf):
    """Rights and job states from orders; pending rights, priorities and nulls are in no domain."""
    status, number = F.col("o_orderstatus"), F.col("o_orderkey")
    rights = F.when(status == "F", "allowed").when(status == "O", "needs_review").when(status == "P", "pending")
    job = F.when(number % 7 == 0, F.lit(None)).when(number % 5 == 0, F.col("o_orderpriority")).otherwise("ingested")
    return table(spark, sf, "orders").select("o_orderkey", rights.alias("rights"), job.alias("job"))


_DOMAINS = {"rights": C.RIGHTS_STATES, "job": C.JOB_STATES}


@query(f"""WITH s AS ({_STATES}) SELECT 'rights' AS "column", rights AS value, coalesce(rights IN {C.RIGHTS_STATES}, false) AS valid, count(*) AS n FROM s GROUP BY 2
UNION ALL SELECT 'job', job, coalesce(job IN {C.JOB_STATES}, false), count(*) FROM s GROUP BY job""")
def domain_report(spark, sf):
    return C.domain_report(_states(spark, sf), _DOMAINS)


@query(f"""WITH s AS (SELECT o_orderkey, {_STATES[7:]}) SELECT o_orderkey, rights, job FROM s WHERE rights IN {C.RIGHTS_STATES} AND job IN {C.JOB_STATES}""")
def in_domains(spark, sf):
    """Orders whose states are all known; strict mode then finds nothing to object to."""
    return C.in_domains(C.in_domains(_states(spark, sf), _DOMAINS), _DOMAINS, strict=True)
