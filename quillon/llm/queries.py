"""Queries that apply the corpus operators to their whole tables, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import remainder, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.suffix_dedup import repeats_removed

    return repeats_removed(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.ogg import read_back, stored

    return read_back(stored(table(spark, sf_dir, "documents")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.pii import detected

    found = detected(table(spark, sf_dir, "documents"))
    terms = F.array_join(F.transform("terms", lambda t: F.concat_ws(":", F.lit("term"), t["start"], t["end"])), ",")
    every = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.size("terms") > 0, terms))
    counts = ["n_email", "n_ip", "n_card", "n_phone"]
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), every.alias("spans"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.warc import archived

    found = archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.langid import identified

    return identified(table(spark, sf_dir, "documents"), remainder("doc_id", 4) == 2)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.mixing import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.sentencepiece_codec import coded

    return coded(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.quality import scored

    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder("doc_id", 5) == 0)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quillon.llm.exact_dedup import exact_groups

    found = exact_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_simhash": op2_simhash,
    "op3_ogg": op3_ogg,
    "op4_pii": op4_pii,
    "op5_warc": op5_warc,
    "op6_langid": op6_langid,
    "op7_mixing": op7_mixing,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality": op9_quality,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op5_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS keep FROM p
), d AS (
  SELECT p.page_id, string_agg(
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // 32768) % 32 AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // 1024) % 32 AS INT) + 1, 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v // 32) % 32 AS INT) + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v % 32 AS INT) + 1, 1), '' ORDER BY i) AS digest
  FROM (SELECT page_id, i, CAST('0x' || substr(hex, CAST(5 * i + 1 AS INT), 5) AS BIGINT) AS v FROM p, range(8) r(i)) p GROUP BY p.page_id
)
SELECT k.page_id, CAST(octet_length(encode(k.html)) AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN k.page_id = k.keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k.page_id <> k.keep THEN k.keep END AS refers_to
FROM k JOIN d ON k.page_id = d.page_id
""",
    "op7_mixing": r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM sized GROUP BY source
), room AS (
  SELECT *, CAST(source_size * 3 AS DOUBLE) / weight AS room,
         CAST((SELECT sum(source_size) FROM per)
           - coalesce(sum(source_size * 3) OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
         / ((SELECT sum(weight) FROM per)
           - coalesce(sum(weight) OVER (ORDER BY CAST(source_size * 3 AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate
  FROM per
), first_free AS (
  SELECT rate FROM room WHERE source_size * 3 > rate * weight ORDER BY room, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN source_size * 3 <= rate * weight THEN CAST(source_size * 3 AS DOUBLE) ELSE (SELECT rate FROM first_free) * weight END AS target
  FROM room
), copies AS (
  SELECT s.doc_id, s.size, t.source, t.source_size, t.target, p.pass,
         md5('mix:' || p.pass || ':' || coalesce(CAST(s.doc_id AS VARCHAR), '')) AS digest
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
  JOIN (SELECT unnest([0, 1, 2]) AS pass) p ON p.pass < least(3, floor(t.target / greatest(t.source_size, 1)) + 1)
  WHERE s.size > 0
), timed AS (
  SELECT *, CAST(pass * source_size + sum(size) OVER (PARTITION BY source, pass ORDER BY digest, doc_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) / target AS finish
  FROM copies
), cut AS (
  SELECT doc_id, greatest(0, least(size, (SELECT sum(source_size) FROM per)
           - coalesce(sum(size) OVER (ORDER BY finish, digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS part
  FROM timed
), taken AS (SELECT doc_id, sum(part) AS taken FROM cut GROUP BY doc_id)
SELECT s.doc_id, s.size, t.source_size, t.target, CAST(coalesce(k.taken, 0) AS BIGINT) AS taken
FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN taken k ON s.doc_id = k.doc_id
""",
    "op10_exact_dedup": r"""
WITH norm AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM norm
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM best
""",
}
