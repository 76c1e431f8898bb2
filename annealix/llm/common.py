"""Helpers shared by the operators: shared folder, input shaping, session limits."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract.
WORD = r"[^\x20\x09-\x0D]+"
_BITS = 27
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where the session names none (tests, notebooks) one is set beside the
    warehouse.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table or file set in the shared folder."""
    return f"{shared_folder(spark)}/annealix-{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, *, clean: bool = False) -> DataFrame:
    """Cut lineage with a written table in the shared folder and read it back.

    With ``clean`` Spark deletes the files of the shuffles behind it once it is
    written, as nothing reads them any more.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    if clean:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def file_system(uri: str):
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if uri.startswith(("/", "file:")):
        return fs.LocalFileSystem(use_mmap=True), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind the result of ``materialise``, once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_path(df.sparkSession, folder)


def bounded_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound Arrow batches by rows and bytes, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def pick(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the needed columns, under reserved names, so others can't clash.

    A null text becomes the empty text.
    """
    cols: list[Column] = [
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ]
    return docs.select(*cols, *[F.col(c) for c in more])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key_of(text: Column) -> Column:
    """Names a text: equal texts have equal keys."""
    return F.xxhash64(text, F.octet_length(text))


def with_texts(texts: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows of ``keyed`` (one per tk) beside their text, once each.

    A bitmap of 2**27 bits (at most 16 MB) of the keys keeps most other texts
    out of the shuffle; the join decides.
    """
    bit = lambda tk: F.pmod(tk, F.lit(1 << _BITS))
    maps = keyed.select(bit(F.col("tk")).alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bitmap"))
    at = F.bitmap_bit_position(bit(F.col("tk")))
    byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = texts.withColumn("bucket", F.bitmap_bucket_number(bit(F.col("tk")))).join(F.broadcast(maps), "bucket")
    held = marked.where(F.pmod(F.floor(byte / F.pow(F.lit(2.0), at % 8)), F.lit(2)) == 1).select("tk", "text")
    # Copies are combined before the shuffle, so that a text with many meets as one row a task.
    return held.groupBy("tk").agg(F.first("text").alias("text")).join(keyed, "tk")
