"""Source, sink and streaming queries. Files are written from the tables into the shared folder."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import feedback as B
from ..session import workspace
from ..sources import readers as R
from ..sources import versions as V
from ..sources import writers as W
from ..streaming import streams as X
from .base import query, table


def _text_files(spark, sf, path, per_file=1):
    """Files of the documents' texts in the order of their numbers, each text with a line end, named by the file's number."""
    docs = table(spark, sf, "documents").select((F.col("doc_id") / per_file).cast("long").alias("file"), F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text")).alias("row"))
    lines = F.transform(F.array_sort(F.collect_list("row")), lambda r: r["text"])
    W.write_texts(docs.groupBy("file").agg(F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("text")), path, "file", "text")


def _file(path):
    return F.regexp_extract(path, r"file=(-?\d+)\.", 1).try_cast("long")


#: Documents a file in the queries that read every file's content.
PER_FILE = 8
_FILES = f"""f AS (SELECT doc_id // {PER_FILE} AS file, string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id) AS content FROM documents GROUP BY 1)"""


@query(f"""WITH {_FILES} SELECT file, md5(content) AS md5, strlen(content) AS size_bytes, NULL::VARCHAR AS error FROM f""")
def file_scan(spark, sf):
    """Documents written as text files among others, found again by content; those of another extension aren't opened."""
    path = workspace(spark, "scan")
    _text_files(spark, sf, f"{path}/texts", PER_FILE)
    table(spark, sf, "events").select("event_id").write.csv(f"{path}/others")
    return R.scan_content(spark, path, ("TXT", "json")).select(_file("path").alias("file"), "md5", "size_bytes", "error")


@query("""WITH f AS (SELECT md5(coalesce(text, '') || chr(10)) AS digest, doc_id % 3 = 0 AS old FROM documents),
g AS (SELECT digest, count(*) AS n, bool_or(old) AS known FROM f GROUP BY 1)
SELECT sum(n)::BIGINT AS scanned, count(*) FILTER (NOT known) AS added, count(*) FILTER (known) AS skipped_known, sum(n - 1)::BIGINT AS skipped_repeated, 0::BIGINT AS failed FROM g""")
def scan_report(spark, sf):
    """Counts of a scan of all documents' files where the contents of every third document are known from before."""
    path = workspace(spark, "report")
    _text_files(spark, sf, path)
    found = R.scan_content(spark, path, ("txt",))
    known = table(spark, sf, "documents").where("doc_id % 3 = 0").select(F.md5(F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary")).alias("md5"))
    return C.ingest_report(found, known, "md5", "error")


@query("SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY 1")
def adapter_events(spark, sf):
    """The same events through the CSV, ORC and Parquet adapters."""
    path = workspace(spark, "adapters")
    events = table(spark, sf, "events").select("event_id", "event_type")
    events.write.csv(f"{path}/csv", header=True)
    R.adapter("csv")(spark, f"{path}/csv", "event_id long, event_type string").write.orc(f"{path}/orc")
    R.adapter("orc")(spark, f"{path}/orc").write.parquet(f"{path}/parquet")
    found = R.adapter("parquet")(spark, f"{path}/parquet")
    return found.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""WITH e AS (SELECT user_id, event_id, 'k' AS entry, json_extract_string(props, '$.k') AS value FROM events WHERE event_type <> 'error'
  UNION ALL SELECT user_id, event_id, event_type, event_id::VARCHAR FROM events WHERE event_type <> 'error')
SELECT user_id, entry, max_by(value, event_id) AS value FROM e GROUP BY 1, 2""")
def json_docs(spark, sf):
    """Documents per user; those of 'error' events are malformed and skipped."""
    text = F.concat(F.regexp_replace("props", "}", ""), F.lit(', "'), F.col("event_type"), F.lit('": "'), F.col("event_id"), F.lit('"'))
    closed = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), text)).otherwise(F.concat(text, F.lit("}")))
    docs = table(spark, sf, "events").select("user_id", "event_id", closed.alias("text"))
    return R.merge_manifests(docs, ["user_id"], "event_id", "text")


@query("SELECT CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderkey, o_orderstatus FROM orders")
def write_roundtrip(spark, sf):
    """Orders by status; the partition F is replaced in a second write, the others stay."""
    path = workspace(spark, "roundtrip")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    W.write_partitioned(orders, path, ["o_orderstatus"])
    changed = orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    W.write_partitioned(changed, path, ["o_orderstatus"], replace_touched=True)
    return spark.read.parquet(path)


@query("""SELECT 'second' AS state, o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders
UNION ALL SELECT 'back', o_orderkey, o_totalprice FROM orders""")
def publish_versions(spark, sf):
    """Orders as a first version, a second one made of it, then the first one made current again."""
    path = workspace(spark, "published")
    V.publish(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), path, ["o_orderstatus"])
    raised = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    V.publish(V.current(spark, path).withColumn("o_totalprice", raised), path, ["o_orderstatus"])
    second = V.current(spark, path).withColumn("state", F.lit("second"))
    V.rollback(spark, path, 1)
    return second.unionByName(V.current(spark, path).withColumn("state", F.lit("back"))).drop("o_orderstatus")


@query(f"""WITH {_FILES} SELECT file, strlen(content) AS bytes, sha256(content) AS sha256, NULL::VARCHAR AS problem FROM f""")
def package_manifest(spark, sf):
    """Manifest of the documents' text files with its check against the files: no problem is expected."""
    path = workspace(spark, "package")
    _text_files(spark, sf, f"{path}/data", PER_FILE)
    W.package_manifest(spark, f"{path}/data").write.parquet(f"{path}/manifest")
    recorded = spark.read.parquet(f"{path}/manifest")
    problems = W.verify_manifest(recorded, W.package_manifest(spark, f"{path}/data"))
    return recorded.join(problems, "path", "left").select(_file("path").alias("file"), "bytes", "sha256", "problem")


@query("SELECT doc_id, 'regenerate' AS verdict, DATE '2024-01-01' + (doc_id % 7)::INT AS day FROM labels WHERE toxic = 1")
def regen_requests(spark, sf):
    """Two appends of requests, partitioned by day."""
    path = workspace(spark, "requests")
    rows = table(spark, sf, "labels").select(
        "doc_id", "quality", F.when(F.col("toxic") == 1, "regenerate").otherwise("keep").alias("verdict"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 7).cast("int")).cast("timestamp").alias("requested_at"))
    asked = B.regeneration_requests(rows, "verdict")
    for quality in (0, 1):
        W.append_daily(asked.where(F.col("quality") == quality).drop("quality"), path, "requested_at")
    return spark.read.schema("doc_id long, verdict string, day date").parquet(path)


# --- streams -----------------------------------------------------------------------------

def _events(spark, sf):
    return X.read_table_stream(spark, sf, "events")


@query("""SELECT event_id, user_id, event_type FROM events""")
def stream_dedup(spark, sf):
    """Events arrive twice; each id passes once."""
    stream = X.stamped(_events(spark, sf), "ts", "40 days").select("event_id", "user_id", "event_type", "ts")
    twice = stream.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    return X.run_to_table(X.arrivals(twice, "event_id", "ts"), workspace(spark, "dedup")).drop("ts")


@query("""WITH w AS (SELECT user_id, value, epoch_us(ts) // 43200000000 - k AS i FROM events, (VALUES (0), (1)) v(k))
SELECT user_id, make_timestamp(i * 43200000000) AS "start", make_timestamp((i + 2) * 43200000000) AS "end", count(*) AS n, floor(sum(value) * 100 + 0.5000001) / 100 AS total, max(value) AS peak
FROM w GROUP BY user_id, i HAVING (i + 2) * 43200000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000""")
def stream_sliding(spark, sf):
    from ..functions.scalar import round_to
    stream = X.stamped(_events(spark, sf), "ts", "1 hour")
    out = X.run_to_table(X.sliding(stream, "user_id", "ts", "value", "24 hours", "12 hours"), workspace(spark, "sliding"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"),
                      "n", round_to(F.col("total"), 2).alias("total"), "peak")


@query("""WITH g AS (SELECT user_id, ts, epoch_us(ts) AS us, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200000000, true)::INT AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS "start", make_timestamp(max(us) + 43200000000) AS "end", count(*) AS n FROM s GROUP BY user_id, k
HAVING max(us) + 43200000000 <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000""")
def stream_sessions(spark, sf):
    stream = X.stamped(_events(spark, sf), "ts", "1 hour")
    out = X.run_to_table(X.sessions(stream, "user_id", "ts", "12 hours"), workspace(spark, "sessions"))
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def stream_latest(spark, sf):
    stream = _events(spark, sf).select("user_id", "event_type", "ts", "event_id", "value")
    return X.latest_state(stream, ["user_id", "event_type"], ["ts", "event_id"], workspace(spark, "latest")).drop("ts")


@query("""SELECT doc_id, digest FROM (SELECT doc_id, md5(text) AS digest, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS k FROM documents)
WHERE k = 1 AND digest NOT IN (SELECT md5(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))""")
def stream_ingest(spark, sf):
    stream = X.read_table_stream(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    known = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select("digest")
    return X.ingest(stream, known, "digest", ["doc_id"], workspace(spark, "ingest"))
