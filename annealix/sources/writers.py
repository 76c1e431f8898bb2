"""Reports of matches: verbose text, FASTA, graph files, tables per assay, variant lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.results import network_edges, network_nodes


def fasta_text(*, with_assay: bool = False, hide_sequence: bool = False) -> Column:
    """'>defline[ assay]' and the matched bases."""
    head = F.concat(F.lit(">"), "defline", *([F.lit(" "), F.col("name")] if with_assay else []))
    return head if hide_sequence else F.concat_ws("\n", head, "sequence")


def fasta_lines(matches: DataFrame, **options) -> DataFrame:
    return matches.select(fasta_text(**options).alias("value"))


def _line(label: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{label} = "), value.cast("string")))


def report_lines(matches: DataFrame, *, prefix: str = "") -> DataFrame:
    return matches.select(report_text(set(matches.columns), prefix=prefix).alias("value"))


def report_text(have: set[str], *, prefix: str = "") -> Column:
    """A block of lines per match, in a fixed order of the fields it has; ``prefix`` begins alignment lines."""
    parts = [_line("name", F.col("name")), _line("target", F.col("defline"))]
    labels = (("oligo", "oligo"), ("tm", "tm"), ("dg", "delta G"), ("dh", "delta H"), ("ds", "delta S"), ("num_mm", "mismatches"), ("num_gap", "gaps"), ("anchor_5", "5' clamp"), ("anchor_3", "3' clamp"), ("hairpin_tm", "hairpin tm"), ("homodimer_tm", "homodimer tm"), ("gc", "GC"), ("rules", "heuristics"))
    for field, label in labels:
        for x, role in (("f", "forward"), ("r", "reverse"), ("p", "probe")):
            if f"{x}_{field}" in have:
                value = F.col(f"{x}_{field}")
                parts.append(_line(f"{role} {label}", F.round(100 * value, 4) if field == "gc" else value))
    parts += [_line("range", F.concat_ws(" .. ", "start", "stop")), _line("length", F.col("stop") - F.col("start") + 1)]
    for c, label in (("primer_strand", "forward primer strand"), ("p_strand", "probe strand"), ("gap", "gap"), ("dimer_tm", "heterodimer tm")):
        if c in have:
            parts.append(_line(label, F.col(c)))
    for x in "frp":
        if f"{x}_alignment" in have:
            a = F.col(f"{x}_alignment")
            parts.append(F.when(a.isNotNull(), F.concat(F.lit(prefix), F.replace(a, F.lit("\n"), F.lit("\n" + prefix)))))
    parts.append(_line("sequence", F.col("sequence")))
    return F.concat_ws("\n", *parts, F.lit(""))


def sif_lines(matches: DataFrame) -> DataFrame:
    """value: 'assay binds target' for every edge."""
    return network_edges(matches).select(F.concat_ws(" ", "assay", F.lit("binds"), "target").alias("value"))


def atr_lines(assays: DataFrame, matches: DataFrame) -> DataFrame:
    """value: header and 'node = category' lines; the header sorts first."""
    nodes = network_nodes(assays, matches).select(F.lit(1).alias("o"), F.concat_ws(" = ", "node", "category").alias("value"))
    head = matches.sparkSession.range(1).select(F.lit(0).alias("o"), F.lit("FunctionalCatagory").alias("value"))
    return head.unionByName(nodes).orderBy("o", "value").select("value")


def annotation_lines(overlaps: DataFrame) -> DataFrame:
    """value: label, ids, name, product and note of every feature a match touches."""
    name = F.coalesce("locus", "locus_tag")
    note = F.regexp_replace(F.coalesce(F.col("note"), F.lit("")), r"\s*\n\s*", " ")
    ids = F.array_join(F.coalesce("ids", F.array().cast("array<string>")), "|")
    place = F.concat(F.lit("["), F.col("f_start"), F.lit(" .. "), F.col("f_stop"), F.lit("] "), F.col("strand"))
    return overlaps.select(F.concat_ws("\t", "type", place, ids, name, "product", note).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def write_per_assay(matches: DataFrame, path: str) -> None:
    """One folder of Parquet files per assay name."""
    matches.write.partitionBy("name").parquet(path)


def write_variants(variants: DataFrame, path: str) -> None:
    """All expanded oligos as tab-separated text."""
    variants.select("name", "forward", "reverse", "probe").write.option("sep", "\t").csv(path)
