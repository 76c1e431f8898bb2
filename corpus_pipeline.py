"""Five cleaning stages from documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. Between stages the rows are written as
Parquet in the shared folder and read again, which cuts lineage.
"""

from __future__ import annotations

import public_tokenizers as vocab
from pyspark.sql import DataFrame, SparkSession

from annealix.llm import bpe_chunks, decontaminate, secrets, simhash, toxicity
from annealix.llm.common import documents, materialise


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples call toxic go."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least id."""
    return simhash.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage like a benchmark item go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def cut_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets and linked credential parts are cut out of the texts."""
    return secrets.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the hashes of ids and of the decoded bytes."""
    return bpe_chunks.encode_documents(docs, vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN, keep_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", cut_secrets),
    ("encoding", encode),
]

#: Block-max search, fingerprints and BPE are not SQL; the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
