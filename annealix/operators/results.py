"""Best matches, fragment de-duplication, ranks, statistics and set-based reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import mask_whitespace


def best_match(matches: DataFrame) -> DataFrame:
    """The best row of each assay and target: highest lesser primer Tm, then probe Tm, greater primer Tm, least start."""
    order = Window.partitionBy("assay_id", "target_id").orderBy(F.desc("min_tm"), F.desc_nulls_last("probe_tm"), F.desc("max_tm"), "start", "stop")
    return matches.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def best_probe(triples: DataFrame) -> DataFrame:
    """Of the probes of one amplicon the one of the highest Tm."""
    order = Window.partitionBy("assay_id", "degen_id", "target_id", "start", "stop").orderBy(F.desc("p_tm"), "p_loc_5", "p_loc_3")
    return triples.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def rank_results(matches: DataFrame) -> DataFrame:
    """Adds the place in each assay's report: Tm values falling (not under zero), then target."""
    floor = lambda c: F.greatest(F.col(c), F.lit(0.0)).desc()
    order = Window.partitionBy("assay_id").orderBy(floor("min_tm"), F.col("probe_tm").desc_nulls_last(), floor("max_tm"), "target_id", "start", "stop")
    return matches.withColumn("place", F.row_number().over(order).cast("long"))


def containment_dedup(amps: DataFrame, width: int = 2000) -> DataFrame:
    """Drop amplicons inside a longer one of the same variant and target whose ends differ by less than half a primer.

    Ends that close lie in the same or in neighbouring buckets of ``width``.
    """
    keys = ("assay_id", "degen_id", "target_id")
    big = amps.select(*keys, F.col("start").alias("s2"), F.col("stop").alias("e2")).distinct()
    big = big.withColumn("_b", F.explode(F.array(*[F.floor(F.col("s2") / width) + d for d in (0, 1)])))
    small = amps.withColumn("_b", F.floor(F.col("start") / width))
    s, e, s2, e2 = (F.col(f"{t}.{c}") for t, c in (("x", "start"), ("x", "stop"), ("y", "s2"), ("y", "e2")))
    half = lambda c: F.col(f"x.{c}") / 2
    near = (s - s2 < half("f_len")) & (e2 - e < half("r_len")) & (s - s2 < half("r_len")) & (e2 - e < half("f_len"))
    inside = (s2 <= s) & (e2 >= e) & ((s2 < s) | (e2 > e))
    on = [F.col(f"x.{k}") == F.col(f"y.{k}") for k in (*keys, "_b")]
    return small.alias("x").join(big.alias("y"), [*on, inside, near], "left_anti").drop("_b")


def owned(matches: DataFrame) -> DataFrame:
    """Matches of overlapping chunks, in target coordinates, each from the chunk that owns its start."""
    return matches.where(F.col("loc_5").between(F.col("chunk_start"), F.col("chunk_stop")) | (F.col("is_first") & (F.col("loc_5") < 0)))


def edge_filter(matches: DataFrame) -> DataFrame:
    """Drop matches that touch an inner edge of their chunk (chunk coordinates)."""
    return matches.where((F.col("is_first") | (F.col("start") > 0)) & (F.col("is_last") | (F.col("stop") < F.col("chunk_length") - 1)))


def range_stats(matches: DataFrame, *columns: str) -> DataFrame:
    """Least and greatest value of each column, in one aggregation."""
    return matches.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def distinct_targets(matches: DataFrame) -> DataFrame:
    """Targets per assay, by defline."""
    return matches.groupBy("assay_id").agg(F.count_distinct("defline").alias("n_targets"))


def assay_summary(assays: DataFrame, matches: DataFrame) -> DataFrame:
    """Every assay with the number of targets it matched."""
    return assays.join(distinct_targets(matches), "assay_id", "left").withColumn("n_targets", F.coalesce("n_targets", F.lit(0).cast("long")))


def unmatched_targets(targets: DataFrame, matches: DataFrame) -> DataFrame:
    return targets.select("defline").distinct().join(matches.select("defline"), "defline", "left_anti")


def unmatched_assays(assays: DataFrame, matches: DataFrame) -> DataFrame:
    return assays.select("name").distinct().join(matches.select("name"), "name", "left_anti")


def absent_ids(targets: DataFrame, ids: DataFrame) -> DataFrame:
    """The listed ids (column ``id``) that no target has as its accession or taxid."""
    there = targets.select(F.col("accession").alias("id")).unionByName(targets.select(F.col("taxid").cast("string").alias("id")))
    return ids.select("id").distinct().join(there, "id", "left_anti")


def select_targets(targets: DataFrame, include: DataFrame | None = None, exclude: DataFrame | None = None, *, strict: bool = False) -> DataFrame:
    """Targets whose accession or taxid is listed in ``include`` (all if none) and in no row of ``exclude``.

    A list has one string column ``id``; digits alone name a taxid. With
    ``strict`` an id that no target has is an error.
    """
    for ids in (include, exclude) if strict else ():
        lost = [] if ids is None else [r.id for r in absent_ids(targets, ids).orderBy("id").limit(5).collect()]
        if lost:
            raise ValueError(f"no target has the ids {', '.join(lost)}")

    def listed(ids: DataFrame, how: str, rows: DataFrame) -> DataFrame:
        digits = F.col("id").rlike("^[0-9]+$")
        tax = ids.where(digits).select(F.col("id").alias("_id")).distinct()
        acc = ids.where(~digits).select(F.col("id").alias("_id")).distinct()
        if how == "left_anti":
            return rows.join(tax, F.col("taxid").cast("string") == F.col("_id"), how).join(acc, F.col("accession") == F.col("_id"), how)
        a = rows.join(tax, F.col("taxid").cast("string") == F.col("_id"), "left_semi")
        return a.unionByName(rows.join(acc, F.col("accession") == F.col("_id"), "left_semi")).dropDuplicates(["target_id"])

    out = targets if include is None else listed(include, "left_semi", targets)
    return out if exclude is None else listed(exclude, "left_anti", out)


def network_edges(matches: DataFrame) -> DataFrame:
    return matches.select(mask_whitespace(F.col("name")).alias("assay"), mask_whitespace(F.col("defline")).alias("target")).distinct()


def network_nodes(assays: DataFrame, matches: DataFrame) -> DataFrame:
    """Assays are parents, matched targets children."""
    parents = assays.select(mask_whitespace(F.col("name")).alias("node"), F.lit("parent").alias("category"))
    return parents.unionByName(matches.select(mask_whitespace(F.col("defline")).alias("node"), F.lit("child").alias("category"))).distinct()
