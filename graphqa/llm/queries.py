"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, htmltext, lines, mixing, quality, simhash, suffixes, tokenfile, toxicity
from .common import shared_dir, table


def op1_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",")
    return r.select("conv_id", "speaker", "part", "n_turns", "text", spans.alias("mask"))


OP1_SQL = """
WITH t AS (SELECT row_number() OVER () AS id, conv_id, coalesce(turn, -1) AS turn, role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role IS NOT NULL AND role <> 'system'),
p AS (
  SELECT id, t.conv_id, speaker, turn, role, text, role IS NOT DISTINCT FROM speaker AS own,
    '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN 'system' WHEN role IS NULL THEN 'user'
      ELSE 'user name=' || replace(role, '<|', '<' || chr(8203) || '|') END || chr(10) AS head,
    replace(text, '<|', '<' || chr(8203) || '|') || '<|im_end|>' AS body
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
q AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker ORDER BY turn, role NULLS FIRST, text, id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins FROM p)
SELECT conv_id, speaker, 0::BIGINT AS part, count(*) AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY turn, role NULLS FIRST, text, id) AS text,
  coalesce(string_agg(CASE WHEN own THEN CAST(begins AS BIGINT) || '-' || CAST(begins + length(body) AS BIGINT) END, ',' ORDER BY turn, role NULLS FIRST, text, id), '') AS mask
FROM q GROUP BY conv_id, speaker
"""


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op4_suffix_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.repeated_spans(table(spark, sf_dir, "documents")).drop("edges")


def op5_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "n_copies", "shuffle_key")


OP5_SQL = """
WITH n AS (SELECT source, count(*) AS n_docs, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
r AS (SELECT source, w / (SELECT sum(w) FROM n) * (SELECT sum(n_docs) FROM n)::DOUBLE / n_docs AS rate FROM n),
k AS (SELECT source, rate, unnest(range(0, CAST(rate + 12 * sqrt(rate) + 31 AS BIGINT))) AS k FROM r),
c AS (SELECT source, list(cdf ORDER BY k) AS cdf FROM (
  SELECT source, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY source ORDER BY k) AS cdf FROM k) GROUP BY source),
d AS (SELECT doc_id, source, ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0 AS u FROM documents),
m AS (SELECT doc_id, d.source, len(list_filter(cdf, lambda x: x <= u)) AS n_copies FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, source, copy, n_copies, md5('17/' || coalesce(doc_id::VARCHAR, 'null') || '/' || copy) AS shuffle_key
FROM (SELECT doc_id, source, n_copies, unnest(range(0, n_copies)) AS copy FROM m)
"""


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op7_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    tokenfile.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.digests(spark, path)


def op8_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_removed", F.array_join("removed", ",").alias("removed"))


def op9_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op10_toxicity_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_chat_rotation, op2_decontaminate, op3_quality_rules, op4_suffix_spans, op5_poisson_mix, op6_simhash_pigeonring, op7_token_blocks, op8_fuzzy_lines, op9_html_consensus, op10_toxicity_neighbours)}
ORACLE_SQL = {"op1_chat_rotation": OP1_SQL, "op5_poisson_mix": OP5_SQL}
