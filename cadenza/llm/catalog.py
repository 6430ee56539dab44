"""The queries of this package over one folder of test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cadenza.llm import (chat, decontamination, fertility, hard_negatives,
                         language_id, line_dedup, minhash, packing, sharding,
                         slack_packing, url_filter, vectors, warc, whitening)
from cadenza.llm.common import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_sharding(spark, sf_dir):
    with Scratch(spark) as scratch:
        return sharding.shard(
            scratch, table(spark, sf_dir, "documents"), shards=40).select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"),
            "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "lang",
        language_id.held_out(F.col("doc_id")).alias("held_out"))
    model = language_id.fit(docs.where("not held_out"))
    return language_id.identify(
        docs.select("doc_id", "held_out", "text"), model, drop_text=True)


@query
def op3_chat_format(spark, sf_dir):
    control = "</s>[INST] ok [/INST]"
    extra = spark.sql(
        f"SELECT * FROM VALUES (-7L, 0L, 'user', '{control}'), "
        f"(-7L, 1L, 'assistant', '{control}') "
        "AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select(*extra.columns)
    return chat.digests(chat.format_conversations(turns.union(extra)))


SQL["op3_chat_format"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role,
         coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                   (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
u AS (
  SELECT *, lag(role, 1, 'start') OVER w AS before,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn DESC, role DESC, text DESC) AS back,
         length(regexp_replace(text,
           '([\[<])(\\*)(/?(?:SYS\]|INST\]|OUT\]|ROLE[ \]]|s>))',
           '\1\\\2\3', 'g')) + CASE role
           WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
           ELSE 16 + length(role) END AS n
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), ''
                         ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)
            AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(3 + sum(n) AS BIGINT) AS formatted_chars,
       bool_and((before || '>' || role) IN ('start>system', 'start>user',
         'system>user', 'user>assistant', 'assistant>user'))
       AND bool_or(back = 1 AND role = 'assistant') AS valid
FROM u GROUP BY conv_id"""


@query
def op4_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        return packing.pack(scratch, docs).select(
            "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
            "doc_tokens", "sequence_id", "offset")


URL_RULES = url_filter.rules("block net/, allow example.net/en/, "
                             "block example.com/de/, allow org/fr/")


@query
def op5_url_filter(spark, sf_dir):
    """Labelled urls: the last number of a path is the page's document.

    Blocked are low quality and toxic ones.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").select(
        "doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1))
        .cast("double").alias("label"))
    number = F.regexp_extract(
        url_filter.split_url(F.col("url"))[1], r"/([0-9]{1,18})[^/0-9]*/?$",
        1).try_cast("long")
    labelled = pages.withColumn("doc_id", number).join(labels, "doc_id")
    scratch = Scratch(spark)
    return url_filter.judge(pages, url_filter.fit(scratch, labelled),
                            URL_RULES)


@query
def op6_near_duplicates(spark, sf_dir):
    with Scratch(spark) as scratch:
        return scratch.keep(minhash.near_duplicates(
            scratch, table(spark, sf_dir, "documents"),
            minhash.Settings(words=2)), "near-duplicates")


SQL["op6_near_duplicates"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) < 2 THEN w
    ELSE [w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))] END) AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y
  FROM e AS a JOIN e AS b ON a.g = b.g AND a.doc_id <> b.doc_id
   AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id, doc_id AS r FROM w
  UNION SELECT reach.doc_id, link.y FROM reach JOIN link ON link.x = reach.r),
c AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id,
       s.doc_id = component_id AS kept
FROM s JOIN c ON c.doc_id = s.doc_id"""


@query
def op7_warc(spark, sf_dir):
    """The archives stay: the result is read from them when it is used."""
    scratch = Scratch(spark)
    records = warc.plan_records(scratch, table(spark, sf_dir, "pages"))
    return warc.read_archives(
        warc.write_archives(scratch, records), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type",
        "refers_to", "verified")


SQL["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes,
             sha1(body) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS full_id
      FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> full_id
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> full_id
            THEN full_id END AS refers_to,
       true AS verified
FROM g"""


@query
def op8_line_dedup(spark, sf_dir):
    with Scratch(spark) as scratch:
        docs = table(spark, sf_dir, "documents").select("doc_id", "text")
        return line_dedup.dedup_lines(scratch, docs).select(
            "doc_id", "n_lines", "n_removed",
            F.crc32("text").alias("text_crc32"),
            F.length("text").cast("long").alias("n_chars"))


@query
def op9_decontamination(spark, sf_dir):
    with Scratch(spark) as scratch:
        return decontamination.contaminated(
            scratch, table(spark, sf_dir, "documents"),
            table(spark, sf_dir, "benchmark"))


@query
def op10_fertility(spark, sf_dir):
    with Scratch(spark) as scratch:
        return fertility.judge(scratch, fertility.measure(
            table(spark, sf_dir, "documents")))


@query
def op11_hard_negatives(spark, sf_dir):
    """Labels of ids divisible by 7 move on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10)
    points = vectors.integer_vectors(
        table(spark, sf_dir, "embeddings"), "embedding", "x", 256, {
            "vec_id": F.col("vec_id"),
            "label": F.coalesce(moved, F.col("label")),
            "anchor": F.col("vec_id") % 100 == 0})
    with Scratch(spark) as scratch:
        return hard_negatives.mine(scratch, points)


SQL["op11_hard_negatives"] = """
WITH p AS (
  SELECT vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END
           AS label,
         [floor(256 * CAST(c AS DOUBLE)) FOR c IN embedding] AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND NOT list_contains([c IS NULL OR NOT isfinite(c)
                           FOR c IN embedding], true)),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM p AS a JOIN p AS b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
g AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s
  WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id
                             ORDER BY score DESC, id) <= 5)
SELECT g.anchor_id, positive_id, positive_score, id AS negative_id,
       score AS negative_score, CAST(row_number() OVER w AS INTEGER) AS rank
FROM g JOIN s ON s.anchor_id = g.anchor_id AND NOT same
 AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY g.anchor_id, positive_id ORDER BY score DESC, id)
QUALIFY row_number() OVER w <= 10
"""


@query
def op12_slack_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    with Scratch(spark) as scratch:
        return slack_packing.pack(scratch, docs).select(
            "doc_id", "piece", "start", "length",
            F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op13_whitening(spark, sf_dir):
    with Scratch(spark) as scratch:
        return whitening.whiten(
            scratch, table(spark, sf_dir, "embeddings")).select(
            "vec_id", "component", "n",
            F.col("deviation").cast("long").alias("deviation"), "whitened",
            "explained", "identity_error")
