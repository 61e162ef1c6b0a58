"""The operators' queries over the driver's tables, and the SQL that says the same where SQL can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, fingerprints, lines, media, mixing, near_dedup, quality, secrets, toxicity
from .common import fold, read

#: Scores from here on predict label 1.
THRESHOLD = 0.3


def vocabulary() -> str:
    """Path of the byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out(modulus: int, rest: int) -> Column:
    """False for a row without doc_id, which has no label."""
    return F.coalesce(fold("doc_id", modulus) == rest, F.lit(False)).alias("held_out")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality.scored(documents, quality.fit(documents, quality.split(labels, "quality", 5, 0)))
    return scored.select("doc_id", held_out(5, 0), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), 85)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = toxicity.scored(documents, quality.split(labels, "toxic", 4, 2))
    return scored.select("doc_id", held_out(4, 2), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(read(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(read(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rendered(read(spark, sf_dir, "conversations"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(read(spark, sf_dir, "documents"), vocabulary())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(read(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"))


def op10_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_quality, op2_near_dedup, op3_toxicity, op4_secrets, op5_fingerprints, op6_chat, op7_bpe, op8_mixing, op9_media, op10_lines, pipeline)}

ORACLE_SQL = {
    "op2_near_dedup": r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN 'short ' || array_to_string(w, ' ') ELSE 'long ' || array_to_string(w[i:i + 4], ' ') END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0)),
sized AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sized x ON x.doc_id = a.doc_id JOIN sized y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))),
either AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN either e ON r.b = e.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, r.c AS component_id, r.c = d.doc_id AS kept
FROM documents d JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id LEFT JOIN sized s ON s.doc_id = d.doc_id""",
    "op6_chat": r"""
WITH t AS (
  SELECT conv_id, row_number() OVER w AS place, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    list(struct_pack(r := role, t := text)) OVER (w ROWS UNBOUNDED PRECEDING) AS so_far,
    '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) AS block
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role NULLS LAST, text NULLS LAST)),
whole AS (SELECT min(conv_id) AS conv_id, so_far FROM t WHERE place = n_turns GROUP BY so_far),
kept AS (SELECT conv_id FROM whole WHERE so_far NOT IN (SELECT so_far FROM t WHERE place < n_turns))
SELECT conv_id, n_turns, string_agg(block, '' ORDER BY place) AS chat FROM t JOIN kept USING (conv_id) GROUP BY conv_id, n_turns""",
    "op8_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 3 * source_size AS cap, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM per),
stepped AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY cap / weight, source)),
aimed AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * coalesce((SELECT level FROM stepped WHERE level * weight <= cap ORDER BY cap / weight, source LIMIT 1), 0)) AS target FROM weighed),
placed AS (
  SELECT s.doc_id, s.size, a.source_size, a.target, round(a.target)::BIGINT AS budget,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id, s.size ROWS UNBOUNDED PRECEDING)::BIGINT - s.size AS before
  FROM sized s JOIN aimed a ON s.source IS NOT DISTINCT FROM a.source)
SELECT doc_id, size, source_size, target,
  (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - before)) END)::BIGINT AS taken
FROM placed""",
}
