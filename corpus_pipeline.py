"""A training-corpus pipeline: quality rules, near-duplicates, decontamination, mixing, token ids."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphqa.llm import decontaminate, mixing, quality, simhash, tokenfile
from graphqa.llm.common import checkpoint, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.keep_good(docs).select(COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near copies."""
    return simhash.keep_one(docs).select(COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws, in random order."""
    return mixing.mix(docs).select(COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids written in coded blocks and read back: doc_id, start, n_tokens, ids_crc32."""
    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    tokenfile.write_ids(docs, path, public_tokenizers.path("word_bpe_49k.json"))
    return tokenfile.digests(spark, path)


STAGES = [
    ("quality rules", quality_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontaminate_stage),
    ("mixing sources to target weights", mix_stage),
    ("token-ID / binary output", token_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpoint(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "start", "n_tokens", F.col("ids_crc32"))


#: Tokenizing has no SQL; tests hold run() against a brute-force version that calls no operator.
ORACLE_SQL = None
