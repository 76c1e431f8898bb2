"""Search of FASTA files as they arrive in a folder.

The search keeps no state between files, so each micro-batch is an ordinary
search; its matches are appended as Parquet under the batch's number, which
makes a batch that is run again replace itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.bases import clean_sequence
from ..plans.config import SearchConfig
from ..plans.search import search


def watch(spark: SparkSession, folder: str, assays: DataFrame, out: str, checkpoint: str, cfg: SearchConfig = SearchConfig(), **trigger) -> StreamingQuery:
    """Start the query; ``trigger`` as for Spark's writer (availableNow=True by default)."""
    cfg.validate()
    lines = spark.readStream.option("lineSep", "\n>").text(folder)
    text = F.regexp_replace("value", r"^\s*>", "")
    rows = lines.select(F.trim(F.regexp_extract(text, r"^([^\n]*)", 1)).alias("defline"), clean_sequence(F.regexp_replace(text, r"^[^\n]*", "")).alias("seq"))

    def one(batch: DataFrame, number: int) -> None:
        targets = batch.where(F.length("seq") > 0).withColumn("target_id", F.xxhash64("defline", "seq"))
        search(assays, targets, cfg).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
