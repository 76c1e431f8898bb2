"""Sequences and assays derived from the star-schema tables, the same in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.bases import revcomp
from .functions.duplex import duplex
from .operators import assays as qa
from .operators import joins, seeds

HEX, DNA = "0123456789abcdef", "ACGTACGTACGTACGT"
MAX_LEN, K = 60, 6


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _table(spark, sf_dir, "part")
    text = F.concat(F.md5("p_name"), F.md5(F.concat("p_name", F.col("p_partkey").cast("string"))), F.md5("p_brand"))
    return p.select(F.col("p_partkey").alias("target_id"), F.col("p_name").alias("defline"), F.translate(text, HEX, DNA).alias("seq"))


def assays(spark: SparkSession, sf_dir: str, arms: bool = False) -> DataFrame:
    """One assay per brand, cut from the bases its targets share. ``arms``: the second oligo lies beside the first, on its strand."""
    b = _table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("b", F.translate(F.md5("p_brand"), HEX, DNA))
    number = F.row_number().over(Window.orderBy("p_brand")).cast("long") - 1
    return b.select(number.alias("assay_id"), F.col("p_brand").alias("name"), F.substring("b", 1, 6).alias("forward"), (F.substring("b", 7, 6) if arms else revcomp(F.substring("b", 27, 6))).alias("reverse"), F.substring("b", 13, 6).alias("probe"))


def bindings(spark: SparkSession, sf_dir: str, arms: bool = False) -> DataFrame:
    """Perfect sites of all oligos, with assay, role and length."""
    o = qa.oligos(qa.variants(assays(spark, sf_dir, arms))).select("assay_id", "degen_id", "role", "oligo")
    return o.join(seeds.exact_bindings(o, targets(spark, sf_dir), K), "oligo").withColumn("len", F.length("oligo"))


def amplicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.amplicons(joins.pcr_pairs(bindings(spark, sf_dir), MAX_LEN))


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amplicons with names, Tm values (rounded) and deflines."""
    a = assays(spark, sf_dir)
    tms = a.select("assay_id", "name", F.round(duplex(F.col("probe"))["tm"], 6).alias("probe_tm"))
    amp = amplicons(spark, sf_dir)
    f, r = (F.round(duplex(F.col(f"{x}_oligo"))["tm"], 6) for x in "fr")
    amp = amp.withColumn("min_tm", F.least(f, r)).withColumn("max_tm", F.greatest(f, r))
    amp = amp.join(tms, "assay_id").join(targets(spark, sf_dir).select("target_id", "defline"), "target_id")
    return amp.select("assay_id", "degen_id", "name", "target_id", "defline", "start", "stop", "length", F.col("f_len"), F.col("r_len"), "min_tm", "max_tm", "probe_tm")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals on orders as targets, from lineitem: one feature per line."""
    li = _table(spark, sf_dir, "lineitem")
    start = (F.col("l_partkey") % 5000).alias("f_start")
    return li.select(F.col("l_orderkey").alias("target_id"), F.col("l_linenumber").cast("long").alias("feature"), start, ((F.col("l_partkey") % 5000) + (F.col("l_suppkey") % 40) * 10).alias("f_stop"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches on the same targets, from orders."""
    o = _table(spark, sf_dir, "orders")
    start = (F.col("o_custkey") * 7) % 5000
    return o.select(F.col("o_orderkey").alias("target_id"), start.alias("start"), (start + 300).alias("stop"))
