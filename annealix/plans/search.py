"""Search of targets with assays: expansion, seeding, binding, assay geometry.

Targets are cut into chunks that overlap by an oligo and its flanks. A binding
belongs to the chunk that owns its least coordinate, so each is found once
whatever the size of chunks; pairs are then joined in target coordinates.

Seeds of primers that no seed of the other strand can make a pair with are left
out before anything is aligned. Bindings are computed once and written to the
shared folder, as several joins read them. Matched bases are taken from pieces
of the targets, so a long target is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import gc_fraction, primer_report, revcomp
from ..functions.binding import Conditions
from ..operators import assays as qa
from ..operators import bindings as bi
from ..operators import joins, masking, results, seeds
from .config import SearchConfig
from .scratch import written

LONGEST_OLIGO = 1024
CHUNK = 20_000


def conditions(cfg: SearchConfig) -> Conditions:
    return Conditions(cfg.salt, cfg.temperature_k, cfg.dangle5, cfg.dangle3)


def expand_assays(assays: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Multiplexed (if asked for) and degenerate variants of assays (assay_id, name, forward, reverse, probe)."""
    if cfg.ignore_probe:
        assays = assays.withColumn("probe", F.lit(None).cast("string"))
    if cfg.multiplex and cfg.assay in ("PADLOCK", "MIPS"):
        assays = qa.multiplex_padlock(assays).withColumn("probe", F.lit(None).cast("string")).withColumn("assay_id", F.col("i") * 1_000_000 + F.col("j")).select("assay_id", "name", "forward", "reverse", "probe")
    elif cfg.multiplex and cfg.assay == "PCR":
        pairs = qa.multiplex_pcr(assays).withColumn("assay_id", F.xxhash64("i", "j", "name"))
        assays = qa.distinct_assays(pairs, "assay_id").select(F.col("new_id").alias("assay_id"), "name", "forward", "reverse", "probe")
    return qa.variants(assays)


def _ct(cfg: SearchConfig) -> Column:
    """Strand concentration of an oligo by role, shared by its variants."""
    whole = F.when((F.col("role") == "P") & F.lit(cfg.assay not in ("PADLOCK", "MIPS")), F.lit(cfg.probe_ct)).when(F.col("role") == "F", F.lit(cfg.primer_ct * cfg.asymmetric_ratio)).otherwise(F.lit(cfg.primer_ct))
    return whole / F.col("degen") if cfg.rescale_ct else whole


def find_bindings(variants: DataFrame, targets: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Bindings of all oligos: assay_id, degen_id, role, oligo, strand, target_id, loc_5, loc_3, energies, clamps, alignment."""
    oligos = qa.oligos(variants).withColumn("ct", _ct(cfg))
    longest = oligos.agg(F.max(F.length("oligo"))).first()[0] or 0
    if longest > LONGEST_OLIGO:
        raise ValueError(f"oligos may have up to {LONGEST_OLIGO} bases")
    # Results don't depend on the cut, so chunks are kept small: windows are taken from them by position.
    chunks = seeds.fragments(targets, min(cfg.max_target_len, CHUNK), longest + 2 * seeds.FLANK + 8)
    rows = chunks.select(F.struct("target_id", "chunk_id").alias("target_id"), "chunk", "offset", F.col("start").alias("own_start"), F.col("stop").alias("own_stop"), "is_first", "is_last")
    hits = seeds.diagonals(seeds.seed_hits(oligos, rows, cfg.word_length, "chunk"))
    if cfg.assay == "PCR":
        hits = _paired_seeds(hits, rows, oligos, cfg.max_len, longest)
    win = seeds.windows(hits, rows, "chunk")
    if cfg.target_strand != "both":
        win = win.where(F.col("strand") == ("+" if cfg.target_strand == "plus" else "-"))
    used = oligos.select("oligo", "ct").distinct()
    bound = bi.bind(win.join(used, "oligo").select("oligo", "strand", "target_id", "start", "window", "ct"), conditions(cfg), iterate=cfg.dinkelbach)
    placed = bound.join(rows.drop("chunk"), "target_id")
    placed = placed.withColumns({c: F.col(c) + F.col("offset") for c in ("loc_5", "loc_3", "bound_5", "bound_3")})
    mine = (F.col("loc_5").between(F.col("own_start"), F.col("own_stop"))) | (F.col("is_first") & (F.col("loc_5") < F.col("own_start")))
    placed = placed.where(mine).withColumn("target_id", F.col("target_id.target_id")).drop("offset", "own_start", "own_stop", "is_first", "is_last", "start", "window")
    placed = bi.unique(placed, "oligo", "ct", "target_id")
    probe = F.col("role") == "P"
    whole = cfg.assay in ("PADLOCK", "MIPS")
    out = oligos.join(placed, ["oligo", "ct"])
    primers = dict(tm=(cfg.min_primer_tm, cfg.max_primer_tm), dg=(cfg.min_primer_dg, cfg.max_primer_dg), clamp_3=cfg.primer_clamp)
    probes = dict(tm=(cfg.min_probe_tm, cfg.max_probe_tm), dg=(cfg.min_probe_dg, cfg.max_probe_dg), clamp_5=cfg.probe_clamp_5, clamp_3=cfg.probe_clamp_3)
    common = dict(max_mismatch=cfg.max_mismatch, max_gap=cfg.max_gap, max_degen_run=cfg.max_poly_degen)
    if whole:  # the clamps stand at the ligated ends: 5' of the reverse, 3' of the forward oligo
        bounds = {k: probes[k] for k in ("tm", "dg")}
        f = bi.within(out.where(F.col("role") == "F"), **bounds, clamp_3=cfg.probe_clamp_3, **common)
        r = bi.within(out.where(F.col("role") == "R"), **bounds, clamp_5=cfg.probe_clamp_5, **common)
        return f.unionByName(r).unionByName(bi.within(out.where(probe), **probes, **common))
    return bi.within(out.where(~probe), **primers, **common).unionByName(bi.within(out.where(probe), **probes, **common))


def _paired_seeds(hits: DataFrame, rows: DataFrame, oligos: DataFrame, max_len: int, longest: int) -> DataFrame:
    """The diagonals of probes, and those of primers that can be part of a pair. Alignments may shift a site by the flanks."""
    room = longest + 4 * seeds.FLANK + 16
    uses = oligos.select("oligo", "assay_id", F.col("role")).distinct()
    placed = hits.join(rows.select("target_id", "offset"), "target_id").join(uses, "oligo")
    t = F.col("t") + F.col("offset") + F.when(F.col("strand") == "+", F.lit(room)).otherwise(F.lit(0))
    placed = placed.select("oligo", "strand", F.col("target_id").alias("chunk"), "diagonal", "assay_id", F.col("target_id.target_id").alias("target_id"), "role", t.alias("t"))
    primers = seeds.cull(placed, max_len + room, room)
    kept = primers.unionByName(placed.where("role = 'P'")).select("oligo", "strand", F.col("chunk").alias("target_id"), "diagonal").distinct()
    return hits.join(kept, ["oligo", "strand", "target_id", "diagonal"], "left_semi")


_PER_SITE = ("oligo", "tm", "dh", "ds", "dg", "num_mm", "num_gap", "anchor_5", "anchor_3", "bound_5", "bound_3", "alignment")


def search(assays: DataFrame, targets: DataFrame, cfg: SearchConfig = SearchConfig()) -> DataFrame:
    """Matches of assays (assay_id, name, forward, reverse, probe) in targets (target_id, defline, seq)."""
    cfg.validate()
    variants = expand_assays(assays, cfg)
    if cfg.assay in ("PROBE", "AFFYMETRIX"):
        variants = variants.where(F.col("forward").isNull())
    sites = written(find_bindings(variants, targets, cfg).drop("ct", "degen"), "sites")
    names = variants.select("degen_id", "name")
    deflines = targets.select("target_id", "defline")
    # A match is at most max_len long, or three oligos and a gap.
    pieces = seeds.pieces(targets, CHUNK, cfg.max_len + 3 * LONGEST_OLIGO)

    def finish(rows: DataFrame, forward: Column) -> DataFrame:
        piece = F.floor(F.greatest(F.col("start"), F.lit(0)) / CHUNK).cast("int")
        out = rows.join(names, "degen_id").join(deflines, "target_id").withColumn("piece", piece).join(pieces, ["target_id", "piece"])
        first = F.col("piece").cast("long") * CHUNK
        return out.withColumn("sequence", joins.site_text(F.col("text"), F.col("start") - first, F.col("stop") - first, forward)).drop("piece", "text")

    alone = variants.where(F.col("forward").isNull()).select("degen_id")
    probes = sites.where("role = 'P'").join(alone, "degen_id", "left_semi").withColumnsRenamed({c: f"p_{c}" for c in _PER_SITE}).withColumn("start", F.col("loc_5")).withColumn("stop", F.col("loc_3"))
    single = finish(probes, F.col("strand") == "+").withColumnRenamed("strand", "p_strand").drop("role", "loc_5", "loc_3")
    if cfg.assay in ("PROBE", "AFFYMETRIX"):
        return _scored(single)
    if cfg.assay in ("PADLOCK", "MIPS"):
        gap = 0 if cfg.assay == "PADLOCK" else cfg.max_len
        arms = joins.padlock_pairs(sites, gap)
        for x, role in (("f", "F"), ("r", "R")):
            own = sites.where(F.col("role") == role).select("degen_id", "target_id", "strand", F.col("loc_5").alias("_a"), F.col("loc_3").alias("_z"), *[F.col(c).alias(f"{x}_{c}") for c in _PER_SITE])
            first = (F.col("strand") == "-") if x == "f" else (F.col("strand") == "+")
            arms = arms.join(own, ["degen_id", "target_id", "strand"]).where(F.when(first, F.col("_a") == F.col("start")).otherwise(F.col("_z") == F.col("stop"))).drop("_a", "_z")
        pairs = finish(arms, F.col("strand") == "+").withColumnRenamed("strand", "p_strand")
        return _scored(pairs.unionByName(single, allowMissingColumns=True))
    amps = joins.amplicons(joins.pcr_pairs(sites, cfg.max_len, single_primer=cfg.single_primer_pcr, min_max_clamp=cfg.min_max_primer_clamp))
    probed = variants.where(F.col("probe").isNotNull()).select("degen_id")
    plain = amps.join(probed, "degen_id", "left_anti")
    triple = joins.with_probes(amps.join(probed, "degen_id", "left_semi"), sites, cfg.max_len)
    pairs = _by_role(_masked(finish(plain.unionByName(triple, allowMissingColumns=True), F.col("primer_strand") == "+"), cfg))
    out = _scored(pairs.unionByName(single, allowMissingColumns=True))
    out = results.best_match(out) if cfg.best_match else out
    return with_self_structure(out, cfg) if cfg.self_structure else out


def _masked(rows: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Bound primers and probes in lower case, or primers in place of what they bind, as the options say."""
    plus, s = F.col("primer_strand") == "+", F.col("sequence")

    def span(x: str) -> Column:
        lo, hi = F.col(f"{x}_bound_5"), F.col(f"{x}_bound_3")
        return F.struct(F.when(plus, lo - F.col("start")).otherwise(F.col("stop") - hi).alias("start"), F.when(plus, hi - F.col("start")).otherwise(F.col("stop") - lo).alias("stop"))

    if cfg.replace_primers:
        left, right = (F.when(plus, F.col(a)).otherwise(F.col(b)) for a, b in (("f_oligo", "r_oligo"), ("r_oligo", "f_oligo")))
        s = masking.replace_ends(s, left, revcomp(right))
    wanted = [span(x) for x, on in (("f", cfg.mask_primers), ("r", cfg.mask_primers), ("p", cfg.mask_probe and "p_bound_5" in rows.columns)) if on]
    if wanted:
        s = masking.mask_ranges(s, F.array(*wanted))
    return rows.withColumn("sequence", s)


def _by_role(rows: DataFrame) -> DataFrame:
    """Columns f_ hold the forward and r_ the reverse primer; where the reverse primer binds first they change places."""
    swap = (F.col("f_role") == "R") & (F.col("r_role") == "F")
    names = [c[2:] for c in rows.columns if c.startswith("f_") and f"r_{c[2:]}" in rows.columns]
    moved = {}
    for c in names:
        moved[f"f_{c}"] = F.when(swap, F.col(f"r_{c}")).otherwise(F.col(f"f_{c}"))
        moved[f"r_{c}"] = F.when(swap, F.col(f"f_{c}")).otherwise(F.col(f"r_{c}"))
    return rows.withColumns(moved)


def with_self_structure(rows: DataFrame, cfg: SearchConfig) -> DataFrame:
    """Adds hairpin and homodimer temperatures of every oligo and the primers' heterodimer; each oligo is computed once."""
    for x, ct in (("f", cfg.primer_ct * cfg.asymmetric_ratio), ("r", cfg.primer_ct), ("p", cfg.probe_ct)):
        if f"{x}_oligo" in rows.columns:
            own = bi.self_structure(rows.select(F.col(f"{x}_oligo").alias("oligo")), ct, conditions(cfg)).toDF(f"{x}_oligo", f"{x}_hairpin_tm", f"{x}_homodimer_tm")
            rows = rows.join(own, f"{x}_oligo", "left")
    if "f_oligo" in rows.columns:
        pairs = rows.select(F.col("f_oligo").alias("forward"), F.col("r_oligo").alias("reverse"))
        rows = rows.join(bi.heterodimers(pairs, cfg.primer_ct, conditions(cfg)).toDF("f_oligo", "r_oligo", "dimer_tm"), ["f_oligo", "r_oligo"], "left")
    return rows


def _scored(rows: DataFrame) -> DataFrame:
    """Adds the lesser and greater primer Tm, GC shares and violated primer rules."""
    if "f_tm" not in rows.columns:
        rows = rows.withColumns({"f_tm": F.lit(None).cast("double"), "r_tm": F.lit(None).cast("double")})
    out = rows.withColumns({"min_tm": F.least("f_tm", "r_tm"), "max_tm": F.greatest("f_tm", "r_tm")})
    out = out.withColumn("probe_tm", F.col("p_tm") if "p_tm" in rows.columns else F.lit(None).cast("double"))
    for x in "frp":
        if f"{x}_oligo" in rows.columns:
            out = out.withColumn(f"{x}_gc", gc_fraction(F.col(f"{x}_oligo")))
            if x != "p":
                out = out.withColumn(f"{x}_rules", primer_report(F.col(f"{x}_oligo")))
    return out
