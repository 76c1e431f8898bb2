"""Assay geometry as equi-joins on buckets with a range condition.

Two sites within ``max_len`` of each other lie in the same or in neighbouring
buckets of that width, so one side joins on its own bucket and the other is
placed in two; every pair meets exactly once. ``floor`` keeps this true for
sites that begin before the target. The keys hold assay, variant, target and
bucket, so a long target is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import revcomp

KEYS = ("assay_id", "degen_id", "target_id")


def _side(rows: DataFrame, tag: str, keys: tuple[str, ...]) -> DataFrame:
    return rows.select(*keys, *[F.col(c).alias(f"{tag}_{c}") for c in rows.columns if c not in keys])


def pcr_pairs(bindings: DataFrame, max_len: int, *, single_primer: bool = True, min_max_clamp: int = -1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Pairs of a '-' site (f_) before a '+' site (r_) of the roles F and R within ``max_len`` bases."""
    primers = bindings.where(F.col("role").isin("F", "R"))
    f = _side(primers.where("strand = '-'"), "f", keys).withColumn("_b", F.floor(F.col("f_loc_5") / max_len))
    r = _side(primers.where("strand = '+'"), "r", keys).withColumn("_b", F.explode(F.array(F.floor(F.col("r_loc_3") / max_len), F.floor(F.col("r_loc_3") / max_len) - 1)))
    out = f.join(r, [*keys, "_b"]).where((F.col("f_loc_3") < F.col("r_loc_5")) & (F.col("r_loc_3") - F.col("f_loc_5") + 1 <= max_len)).drop("_b")
    if not single_primer:
        out = out.where(F.col("f_role") != F.col("r_role"))
    if min_max_clamp >= 0:
        out = out.where(F.greatest("f_anchor_3", "r_anchor_3") > min_max_clamp)
    return out


def amplicons(pairs: DataFrame) -> DataFrame:
    """Adds start, stop, length, and the strand of the forward primer ('+': the '-' binding primer is F)."""
    return pairs.withColumns({"start": F.col("f_loc_5"), "stop": F.col("r_loc_3"), "length": F.col("r_loc_3") - F.col("f_loc_5") + 1, "primer_strand": F.when(F.col("f_role") == "F", "+").otherwise("-")})


def with_probes(amps: DataFrame, bindings: DataFrame, max_len: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """One row per probe site inside an amplicon that doesn't overlap the primer of its own strand."""
    p = _side(bindings.where("role = 'P'"), "p", keys).withColumn("_b", F.floor(F.col("p_loc_5") / max_len))
    a = amps.withColumn("_b", F.explode(F.array(F.floor(F.col("start") / max_len), F.floor(F.col("start") / max_len) + 1)))
    inside = (F.col("p_loc_5") >= F.col("start")) & (F.col("p_loc_3") <= F.col("stop"))
    free = F.when(F.col("p_strand") == "-", F.col("p_loc_5") > F.col("f_loc_3")).otherwise(F.col("p_loc_3") < F.col("r_loc_5"))
    return a.join(p, [*keys, "_b"]).where(inside & free).drop("_b")


def padlock_pairs(bindings: DataFrame, max_gap: int = 0, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Neighbouring sites of R and F on one strand, ``gap`` bases apart (0 to ``max_gap``).

    '-': R lies downstream of F's site; '+': the other way round.
    """
    width = max_gap + 1
    parts = []
    for strand, up, down in (("-", "F", "R"), ("+", "R", "F")):
        first = _side(bindings.where((F.col("strand") == strand) & (F.col("role") == up)), "up", keys)
        second = _side(bindings.where((F.col("strand") == strand) & (F.col("role") == down)), "down", keys)
        a = first.withColumn("_b", F.explode(F.array(*[F.floor((F.col("up_loc_3") + 1) / width) + s for s in ((0, 1) if max_gap else (0,))])))
        b = second.withColumn("_b", F.floor(F.col("down_loc_5") / width))
        gap = F.col("down_loc_5") - F.col("up_loc_3") - 1
        parts.append(a.join(b, [*keys, "_b"]).withColumn("gap", gap).where(F.col("gap").between(0, max_gap)).select(*keys, F.lit(strand).alias("strand"), F.col("up_loc_5").alias("start"), F.col("down_loc_3").alias("stop"), "gap"))
    return parts[0].unionByName(parts[1])


def site_text(seq: Column, start: Column, stop: Column, forward: Column) -> Column:
    """Bases start..stop of a target, '-' beyond its ends, reverse-complemented unless ``forward``."""
    n = F.length(seq)
    left = F.repeat(F.lit("-"), F.greatest(-start, F.lit(0)).cast("int"))
    right = F.repeat(F.lit("-"), F.greatest(stop - n + 1, F.lit(0)).cast("int"))
    a = F.greatest(start, F.lit(0))
    text = F.concat(left, F.substring(seq, (a + 1).cast("int"), (F.least(stop, n - 1) - a + 1).cast("int")), right)
    return F.when(forward, text).otherwise(revcomp(text))


def probe_hits(bindings: DataFrame, targets: DataFrame) -> DataFrame:
    """Sites of single probes with their bases: as they are for '+', reverse-complemented for '-'."""
    return bindings.join(targets.select("target_id", "seq"), "target_id").withColumn("sequence", site_text(F.col("seq"), F.col("loc_5"), F.col("loc_3"), F.col("strand") == "+")).drop("seq")


def annotation_overlap(matches: DataFrame, features: DataFrame, width: int = 2000) -> DataFrame:
    """Matches (target_id, start, stop) with every feature (target_id, f_start, f_stop) they touch.

    Both sides are placed in all buckets they reach; a pair is kept in the first
    bucket both have, so it appears once. A feature that starts behind its stop
    (one across the origin) is touched by matches that hold both its ends; such
    a match reaches the bucket of the start, where the feature is placed.
    """
    bucket = lambda c: F.floor(F.col(c) / width)
    plain = F.col("f_start") <= F.col("f_stop")
    m = matches.withColumn("_b", F.explode(F.sequence(bucket("start"), bucket("stop"))))
    f = features.withColumn("_b", F.explode(F.when(plain, F.sequence(bucket("f_start"), bucket("f_stop"))).otherwise(F.array(bucket("f_start")))))
    touch = (F.col("f_start") <= F.col("stop")) & (F.col("f_stop") >= F.col("start"))
    once = F.col("_b") == F.when(plain, F.greatest(bucket("start"), bucket("f_start"))).otherwise(bucket("f_start"))
    return m.join(f, ["target_id", "_b"]).where(touch & once).drop("_b")


def feature_gaps(features: DataFrame) -> DataFrame:
    """Stretches between features (target_id, f_start, f_stop) that none covers."""
    from pyspark.sql import Window

    before = Window.partitionBy("target_id").orderBy("f_start", "f_stop").rowsBetween(Window.unboundedPreceding, -1)
    ends = features.withColumn("reach", F.max("f_stop").over(before))
    return ends.where(F.col("f_start") > F.coalesce(F.col("reach"), F.lit(-1)) + 1).select("target_id", (F.coalesce(F.col("reach"), F.lit(-1)) + 1).alias("gap_start"), (F.col("f_start") - 1).alias("gap_stop"))
