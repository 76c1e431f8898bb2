"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as vocab
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_tokens, bpe_chunks, decontaminate, pii, quality_mcd, repeats, secrets, shards, simhash, span_sql, toxicity
from .common import documents, scratch


def op1_quality_mcd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mcd.judge(documents(spark, sf_dir))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_arrow_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    manifest = arrow_tokens.write_token_files(documents(spark, sf_dir), out, vocab.path("byte_bpe_50k.json"), end_id=2)
    return arrow_tokens.read_documents(manifest)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir)))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(documents(spark, sf_dir)))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_chunks.encode_documents(documents(spark, sf_dir), vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arrivals (by id) into a store; the rows read back from its last version."""
    docs = documents(spark, sf_dir)
    arrival = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4))
    store = shards.ingest(docs, scratch(spark, "shards"), arrival=arrival, arrivals=4)
    return store.read(schema=docs.schema).select("doc_id", arrival.cast("int").alias("arrival"), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(documents(spark, sf_dir))


OP9_SQL = """
SELECT doc_id, CAST(((coalesce(doc_id, 0) % 4) + 4) % 4 AS INT) AS arrival, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS text_sha256
FROM documents"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_mcd": op1_quality_mcd,
        "op2_decontaminate": op2_decontaminate,
        "op3_simhash": op3_simhash,
        "op4_arrow_tokens": op4_arrow_tokens,
        "op5_secrets": op5_secrets,
        "op6_toxicity": op6_toxicity,
        "op7_bpe_chunks": op7_bpe_chunks,
        "op8_pii": op8_pii,
        "op9_shards": op9_shards,
        "op10_repeats": op10_repeats,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_secrets": span_sql.secrets_sql(),
        "op8_pii": span_sql.pii_sql(),
        "op9_shards": OP9_SQL,
    }
