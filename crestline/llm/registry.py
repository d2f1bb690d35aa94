"""Registered queries over documents and pages, with their SQL checks where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import alignment, decontaminate, jaccard_join, language_id, language_model, pieces, prefix_trie, quality, secrets, sentence_dedup, surrogates, token_files, warc
from .storage import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def keep(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function
    return keep


@query("op1_sentencepiece")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with source spans of every document, and their decoding, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_jaccard_join")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingles agree to three quarters."""
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op8_warc", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages through monolithic and normalised archives."""
    return warc.archive(table(spark, sf_dir, "pages"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through ORC token files."""
    return token_files.tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op3_surrogates")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents with surrogates for personal data."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.replace(docs, "crestline")


@query("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.report(decontaminate.match(docs, table(spark, sf_dir, "benchmark")))


@query("op5_language_model")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    return language_model.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op6_sentence_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of all documents without repeated runs of sentences."""
    return sentence_dedup.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op7_quality", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 7), ' ') AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
r AS (SELECT doc_id, count(DISTINCT p) AS n FROM (
        SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1)
      GROUP BY doc_id),
l AS (SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
             length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
j AS (SELECT *, n > 0 AND (
        (n > 10 AND NOT regexp_matches(line, '[.!?…。！？]'))
        OR len(regexp_extract_all(line, '[!?]{2,}')) * 3 > n
        OR len(regexp_extract_all(line, '[^\x20\x09-\x0D#*$%&<>|][#*$%&<>|]+')) * 3 > n
        OR (len(regexp_extract_all(line, '[|»›→•·]')) >= 3 AND len(regexp_extract_all(line, '[|»›→•·]')) * 4 >= n)
        OR (n <= 20 AND regexp_matches(line, '(?i)\b(all rights reserved|licensed under|released under the|copyright|cookie|javascript|privacy policy|terms of (use|service)|sign (in|up)|log in|subscribe|read more|click here|lorem ipsum)\b'))) AS fails
      FROM l),
s AS (SELECT doc_id, sum(chars) AS chars, coalesce(sum(chars) FILTER (fails), 0) AS lost,
             count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS dup FROM j GROUP BY doc_id),
b AS (SELECT w.doc_id, len(words)::BIGINT AS n_words, s.chars::BIGINT AS word_chars, s.lost::BIGINT AS lost_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             s.dup::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
      FROM w JOIN s USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars <= 0.5 * word_chars AS kept FROM b""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    q = quality.clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars"]
    return q.select("doc_id", *[F.col(f"quality.{n}").alias(n) for n in names])


@query("op10_secrets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, with those that only one owner has."""
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


@query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links between the byte-level and the piece tokens of every document."""
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_prefix_trie", r"""
WITH bits AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
              FROM (SELECT unnest(range(256))::BIGINT AS i)),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits),
marked AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT c, octet_length(encode(text)) AS bytes, md5(octet_length(encode(role)) || ':' || role || text) AS mark, turn,
                 row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || text)) AS pos FROM marked),
convs AS (SELECT c, c - c % 5 AS s, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                 lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 9 AS h FROM (SELECT DISTINCT c FROM marked), crc),
built AS (SELECT v.c, 0 AS half, t.pos, t.mark, t.bytes FROM convs v JOIN turns t ON t.c = v.s AND t.pos <= v.h
          UNION ALL SELECT v.c, 1, t.pos, t.mark, t.bytes FROM convs v JOIN turns t ON t.c = v.c AND t.pos > v.h),
paths AS (SELECT c, bytes, row_number() OVER w AS depth, string_agg(mark, '') OVER w AS path FROM built
          WINDOW w AS (PARTITION BY c ORDER BY half, pos ROWS UNBOUNDED PRECEDING)),
members AS (SELECT c, 0 AS depth, '' AS path, 0 AS bytes FROM convs UNION ALL SELECT c, depth, path, bytes FROM paths),
last AS (SELECT c, max_by(path, depth) AS path FROM members GROUP BY c),
ends AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM last GROUP BY path),
nodes AS (SELECT path, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM members GROUP BY path),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
up AS (SELECT n.path, (n.n_convs - 1) * n.bytes AS gain, (k.n_children IS NULL)::BIGINT AS leaf, unnest(range(n.depth + 1)) AS d
       FROM nodes n LEFT JOIN kids k USING (path)),
below AS (SELECT left(path, 32 * d) AS path, sum(gain)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves FROM up GROUP BY 1)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, b.n_leaves, b.saved_tokens,
       sha256(coalesce(e.ids, '')) AS ends_sha256
FROM nodes n JOIN below b USING (path) LEFT JOIN kids k USING (path) LEFT JOIN ends e USING (path)
LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (n.depth - 1))""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations, each behind the head of the first one of its group."""
    turns = written(prefix_trie.ordered_turns(table(spark, sf_dir, "conversations")), "trie-ordered", "lz4")
    return prefix_trie.trie(*prefix_trie.grafted(turns))


@query("op13_language_id")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    return language_id.identify(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
