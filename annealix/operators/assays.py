"""Rewriting of assays: degenerate variants, multiplexing, removal of repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import degeneracy, expand

ROLES = ("forward", "reverse", "probe")


def variants(assays: DataFrame) -> DataFrame:
    """One row per combination of expanded oligos, with degeneracies; ``degen_id`` numbers all variants."""
    out = assays
    for r in ROLES:
        some = F.when(F.col(r).isNotNull(), expand(F.col(r))).otherwise(F.array(F.lit(None).cast("string")))
        out = out.withColumn(f"{r}_degen", F.coalesce(degeneracy(F.col(r)), F.lit(1).cast("long"))).withColumn(r, F.explode(some))
    order = Window.orderBy("assay_id", *[F.col(r).asc_nulls_first() for r in ROLES])
    return out.withColumn("degen_id", F.row_number().over(order).cast("long") - 1)


def multiplex_padlock(assays: DataFrame) -> DataFrame:
    """All ordered pairs of a 5' oligo with a 3' oligo. Assays are a small table by nature."""
    a = assays.select(F.col("assay_id").alias("i"), F.col("name").alias("a"), "forward")
    b = assays.select(F.col("assay_id").alias("j"), F.col("name").alias("b"), "reverse")
    name = F.when(F.col("i") == F.col("j"), F.col("a")).otherwise(F.concat("a", F.lit("(5')/"), "b", F.lit("(3')")))
    return a.join(b, how="cross").select(name.alias("name"), "forward", "reverse", "i", "j")


def multiplex_pcr(assays: DataFrame) -> DataFrame:
    """Pairs F x R, F x F and R x R of all assays with primers (equal oligos skipped), times all probes if there are any."""
    with_primers = assays.where(F.col("forward").isNotNull() & F.col("reverse").isNotNull())
    parts = []
    for x, y in (("forward", "reverse"), ("forward", "forward"), ("reverse", "reverse")):
        a = with_primers.select(F.col("assay_id").alias("i"), F.col("name").alias("a"), F.col(x).alias("f"))
        b = with_primers.select(F.col("assay_id").alias("j"), F.col("name").alias("b"), F.col(y).alias("r"))
        tag = F.concat(F.col("a"), F.lit(f"({x[0].upper()})/"), F.col("b"), F.lit(f"({y[0].upper()})"))
        if x != y:
            parts.append(a.join(b, how="cross").select(F.when(F.col("i") == F.col("j"), F.col("a")).otherwise(tag).alias("name"), F.col("f").alias("forward"), F.col("r").alias("reverse"), "i", "j"))
        else:
            parts.append(a.join(b, (F.col("i") < F.col("j")) & (F.col("f") != F.col("r"))).select(tag.alias("name"), F.col("f").alias("forward"), F.col("r").alias("reverse"), "i", "j"))
    pairs = parts[0].unionByName(parts[1]).unionByName(parts[2])
    probes = assays.where(F.col("probe").isNotNull()).select(F.col("name").alias("p_name"), "probe").withColumn("k", F.lit(1))
    pairs = pairs.withColumn("k", F.lit(1)).join(probes, "k", "left")
    suffix = F.when(F.col("probe").isNotNull() & (F.col("p_name") != F.col("name")), F.concat(F.lit("+"), "p_name", F.lit("(P)"))).otherwise(F.lit(""))
    return pairs.select(F.concat("name", suffix).alias("name"), "forward", "reverse", "probe", "i", "j")


def distinct_assays(assays: DataFrame, order: str = "assay_id") -> DataFrame:
    """One assay per set of oligos (primers in either order); the one of the least ``order`` stays and ids are renumbered."""
    same = Window.partitionBy(F.least("forward", "reverse"), F.greatest("forward", "reverse"), "probe").orderBy(order, "name")
    kept = assays.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return kept.withColumn("new_id", F.row_number().over(Window.orderBy(order, "name")).cast("long") - 1)


def oligos(variants_: DataFrame) -> DataFrame:
    """assay_id, degen_id, role (F, R, P), oligo, degen: one row per oligo of every variant."""
    roles = F.array(*[F.struct(F.lit(r[0].upper()).alias("role"), F.col(r).alias("oligo"), F.col(f"{r}_degen").alias("degen")) for r in ROLES])
    return variants_.select("assay_id", "degen_id", F.explode(roles).alias("o")).select("assay_id", "degen_id", "o.*").where(F.col("oligo").isNotNull())
