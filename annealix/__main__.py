"""Command line: search targets with assays and write a report.

    python -m annealix -i assays.txt -d 'genomes/*.fa' -o out -e 50 -E 55

``-o`` names a folder; every report is written by Spark.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import joins, results
from .plans.config import SearchConfig
from .plans.search import expand_assays, search
from .sources import readers, writers


def _yes(text: str) -> bool:
    if text.upper() not in ("T", "F"):
        raise argparse.ArgumentTypeError("T or F expected")
    return text.upper() == "T"


#: Flags and the option of the configuration each sets.
OPTIONS = {
    "-l": ("max_len", int), "-e": ("min_primer_tm", float), "-E": ("min_probe_tm", float), "-z": ("min_primer_dg", float), "-Z": ("min_probe_dg", float),
    "-x": ("max_primer_tm", float), "-X": ("max_probe_tm", float), "-g": ("max_primer_dg", float), "-G": ("max_probe_dg", float), "-s": ("salt", float),
    "-t": ("primer_ct", float), "-T": ("probe_ct", float), "-y": ("asymmetric_ratio", float), "-A": ("assay", str.upper), "-W": ("word_length", int),
    "-k": ("mask_primers", _yes), "-K": ("mask_probe", _yes), "-r": ("replace_primers", _yes), "-p": ("ignore_probe", _yes),
    "--primer-clamp": ("primer_clamp", int), "--min-max-primer-clamp": ("min_max_primer_clamp", int), "--probe-clamp5": ("probe_clamp_5", int), "--probe-clamp3": ("probe_clamp_3", int),
    "--plex": ("multiplex", _yes), "--single-primer-pcr": ("single_primer_pcr", _yes), "--target-strand": ("target_strand", str), "--temperature": ("temperature_k", float),
    "--max-target-len": ("max_target_len", int), "--dangle5": ("dangle5", _yes), "--dangle3": ("dangle3", _yes), "--dinkelbach": ("dinkelbach", _yes),
    "--max-gap": ("max_gap", int), "--max-mismatch": ("max_mismatch", int), "--max-poly-degen": ("max_poly_degen", int), "--rescale-ct": ("rescale_ct", _yes),
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="annealix", description="Search nucleic-acid sequences with assays.")
    p.add_argument("-i", required=True, help="assay file")
    p.add_argument("-d", required=True, help="files of target sequences")
    p.add_argument("-o", required=True, help="folder of results")
    p.add_argument("-m", type=int, choices=range(5), default=0, help="0 report, 1 FASTA, 2 graph files, 3 targets without match, 4 assays without match")
    p.add_argument("-a", type=_yes, default=True, help="alignments in the report")
    p.add_argument("-M", type=_yes, default=True, help="matched sequences in the output")
    p.add_argument("-n", type=_yes, default=False, help="a folder per assay")
    p.add_argument("-L", type=_yes, default=False, help="assay names behind deflines")
    p.add_argument("-S", type=_yes, default=False, help="summary by assay")
    p.add_argument("--dump-query", type=_yes, default=False, help="write the expanded assays")
    p.add_argument("--best-match", action="store_true")
    p.add_argument("--blast-include", action="append", metavar="ID", help="search only targets of this accession; may be repeated")
    p.add_argument("--blast-exclude", action="append", metavar="ID", help="leave out targets of this accession; may be repeated")
    for flag, (name, kind) in OPTIONS.items():
        p.add_argument(flag, dest=name, type=kind)
    return p


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    given = {name: getattr(args, name) for name, _ in OPTIONS.values() if getattr(args, name) is not None}
    if given.get("assay") == "AFFY":
        given["assay"] = "AFFYMETRIX"
    cfg = SearchConfig(**given, best_match=args.best_match, self_structure=args.m == 0).validate()
    spark = SparkSession.builder.appName("annealix").getOrCreate()
    assays = readers.read_assays(spark, args.i, ignore_probe=cfg.ignore_probe, force_probe=cfg.assay == "PROBE")
    there = assays.agg(*[F.coalesce(F.bool_or(F.col(c).isNotNull()), F.lit(False)) for c in ("forward", "probe")]).first()
    cfg = cfg.with_thresholds(*there)
    targets = readers.read_targets(spark, args.d)
    if args.blast_include or args.blast_exclude:
        listed = [spark.createDataFrame([(x,) for x in ids], "id string") if ids else None for ids in (args.blast_include, args.blast_exclude)]
        keyed = targets.withColumn("accession", F.coalesce("accession", F.regexp_extract("defline", r"^(\S+)", 1)) if "accession" in targets.columns else F.regexp_extract("defline", r"^(\S+)", 1))
        targets = results.select_targets(keyed.withColumn("taxid", F.lit(None).cast("long")), *listed, strict=True).drop("taxid")
    variants = expand_assays(assays, cfg)
    if args.dump_query:
        writers.write_variants(variants, f"{args.o}/assays")
    search(assays, targets, cfg).write.parquet(f"{args.o}/matches")
    matches = results.rank_results(spark.read.parquet(f"{args.o}/matches")).orderBy("assay_id", "place")
    if not args.a:
        matches = matches.drop(*[c for c in matches.columns if c.endswith("_alignment")])
    if not args.M:
        matches = matches.withColumn("sequence", F.lit(None).cast("string"))
    if args.m == 2:
        writers.write_lines(writers.sif_lines(matches), f"{args.o}/sif")
        writers.write_lines(writers.atr_lines(variants, matches), f"{args.o}/atr")
    elif args.m == 3:
        writers.write_lines(results.unmatched_targets(targets, matches).toDF("value"), f"{args.o}/targets")
    elif args.m == 4:
        writers.write_lines(results.unmatched_assays(variants, matches).toDF("value"), f"{args.o}/assays_without_match")
    else:
        text = writers.fasta_text(with_assay=args.L, hide_sequence=not args.M) if args.m == 1 else writers.report_text(set(matches.columns))
        lines = matches.select("name", text.alias("value"))
        if args.n:
            lines.write.partitionBy("name").text(f"{args.o}/text")
        else:
            writers.write_lines(lines.select("value"), f"{args.o}/text")
    if "features" in targets.columns:
        touched = joins.annotation_overlap(matches.select("target_id", "start", "stop"), readers.features_of(targets))
        writers.write_lines(writers.annotation_lines(touched), f"{args.o}/annotation")
    if args.S:
        results.assay_summary(variants.select("assay_id", "name").distinct(), matches).write.parquet(f"{args.o}/summary")


if __name__ == "__main__":
    main()
