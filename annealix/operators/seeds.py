"""Fragments of targets and the k-mer equi-join that proposes binding sites.

Targets are exploded to (chunk, position, k-mer) rows in place. The k-mers of
oligos are counted and broadcast up to ``BROADCAST_KMERS``, otherwise both sides
are shuffled; the targets' side, which grows with the data, is never broadcast.
Hits are reduced to diagonals at once, so low-complexity k-mers don't travel
further.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bases import revcomp

FLANK = 4
#: Most k-mers of oligos that are broadcast (about 100 bytes each).
BROADCAST_KMERS = 500_000


def fragments(targets: DataFrame, max_len: int, overlap: int = 0) -> DataFrame:
    """Chunks of near equal size up to ``max_len``. Each owns [start, stop] and carries ``overlap`` bases on both sides.

    A pattern cuts the sequence in one pass; taking substrings by position would
    read it from the start for every chunk.
    """
    n = F.length("seq").cast("long")
    pieces = F.greatest(F.ceil(n / max_len).cast("long"), F.lit(1).cast("long"))
    out = targets.withColumn("step", F.greatest(F.ceil(n / pieces).cast("long"), F.lit(1).cast("long")))
    cut = F.regexp_extract_all("seq", F.concat(F.lit("(?s).{1,"), F.col("step"), F.lit("}")), F.lit(0))
    out = out.withColumn("cut", F.when(n > 0, cut).otherwise(F.array(F.lit(""))))
    beside = F.ceil(F.lit(overlap) / F.col("step")).cast("int")

    def chunk(own: Column, i: Column) -> Column:
        first = F.greatest(i - beside, F.lit(0))
        left = F.array_join(F.slice("cut", first + 1, i - first), "")
        right = F.array_join(F.slice("cut", i + 2, beside), "")
        return F.struct(F.right(left, F.lit(overlap)).alias("left"), own.alias("own"), F.left(right, F.lit(overlap)).alias("right"))

    rows = out.select("target_id", n.alias("n"), "step", F.posexplode(F.transform("cut", chunk)).alias("chunk_id", "c"))
    start = F.col("chunk_id").cast("long") * F.col("step")
    stop = start + F.length("c.own") - 1
    return rows.select(
        "target_id", F.col("chunk_id").cast("long").alias("chunk_id"), start.alias("start"), stop.alias("stop"), (start - F.length("c.left")).alias("offset"),
        (F.col("chunk_id") == 0).alias("is_first"), (stop == F.col("n") - 1).alias("is_last"), F.concat("c.left", "c.own", "c.right").alias("chunk"),
    )


def kmers(rows: DataFrame, text: Column, k: int, pos: str, *keys: str) -> DataFrame:
    """Keys, position and k-mer of every run of k plain bases, found in one pass over the text."""
    every = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{k}}}))"), F.lit(1))
    out = rows.where(F.length(text) >= k).select(*keys, F.posexplode(every).alias(pos, "kmer"))
    return out.where(F.col("kmer").rlike("^[ACGT]+$")).select(*keys, F.col(pos).cast("long").alias(pos), "kmer")


def seed_hits(oligos: DataFrame, targets: DataFrame, k: int = 7, seq: str = "seq") -> DataFrame:
    """oligo, strand, target_id, q, t: equal k-mers. '-': the oligo reads like the target; '+': like its reverse complement."""
    both = F.array(F.struct(F.lit("-").alias("strand"), F.col("oligo").alias("read")), F.struct(F.lit("+").alias("strand"), revcomp(F.col("oligo")).alias("read")))
    reads = oligos.select("oligo").distinct().select("oligo", F.explode(both).alias("r")).select("oligo", "r.*")
    query = kmers(reads, F.col("read"), k, "q", "oligo", "strand")
    few = query.limit(BROADCAST_KMERS + 1).count() <= BROADCAST_KMERS
    query = F.broadcast(query) if few else query.hint("merge")
    return kmers(targets, F.col(seq), k, "t", "target_id").join(query, "kmer").select("oligo", "strand", "target_id", "q", "t")


def diagonals(hits: DataFrame) -> DataFrame:
    """One seed per diagonal: the least target position."""
    return hits.groupBy("oligo", "strand", "target_id", (F.col("t") - F.col("q")).alias("diagonal")).agg(F.min("t").alias("t"), F.count("*").alias("n_seeds"))


def windows(diags: DataFrame, targets: DataFrame, seq: str = "seq") -> DataFrame:
    """Window of oligo length and FLANK bases on each side of every diagonal."""
    start = F.greatest(F.col("diagonal") - FLANK, F.lit(0).cast("long"))
    stop = F.least(start + F.length("oligo") + 2 * FLANK, F.length(seq).cast("long"))
    joined = diags.join(targets.select("target_id", seq), "target_id")
    return joined.withColumn("start", start).withColumn("stop", stop).select("oligo", "strand", "target_id", "diagonal", "start", "stop", F.substring(F.col(seq), (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("window"))


def perfect_windows(oligos: DataFrame, targets: DataFrame, length: int, seq: str = "seq") -> DataFrame:
    """Windows, without flanks, of all places where oligos of ``length`` plain bases bind whole, without mismatch or gap.

    Such a place is one seed as long as the oligo, so none is lost, and the
    chance hits of shorter seeds, which grow with oligos times targets, are not
    made. The target reads there as the seed does. Targets are dealt out anew,
    as a small file may hold many.
    """
    whole = oligos.where(F.length("oligo") == length)
    hits = seed_hits(whole, targets.select("target_id", seq).repartition("target_id"), length, seq)
    window = F.when(F.col("strand") == "-", F.col("oligo")).otherwise(revcomp(F.col("oligo")))
    return hits.select("oligo", "strand", "target_id", F.col("t").alias("diagonal"), F.col("t").alias("start"), (F.col("t") + length).alias("stop"), window.alias("window"))


def pieces(targets: DataFrame, width: int, beyond: int) -> DataFrame:
    """target_id, piece, text: the bases from piece * width on, ``width`` and ``beyond`` more of them."""
    cut = targets.select("target_id", F.regexp_extract_all("seq", F.lit(f"(?s).{{1,{width}}}"), F.lit(0)).alias("cut"))
    more = -(-beyond // width)
    text = lambda own, i: F.concat(own, F.left(F.array_join(F.slice("cut", i + 2, more), ""), F.lit(beyond)))
    return cut.select("target_id", F.posexplode(F.transform("cut", text)).alias("piece", "text"))


def exact_bindings(oligos: DataFrame, targets: DataFrame, k: int = 7) -> DataFrame:
    """oligo, strand, target_id, loc_5, loc_3 of perfect sites, found by their seeds and verified."""
    win = diagonals(seed_hits(oligos, targets, k)).join(targets.select("target_id", "seq"), "target_id")
    read = F.when(F.col("strand") == "-", F.col("oligo")).otherwise(revcomp(F.col("oligo")))
    fits = (F.col("diagonal") >= 0) & (F.substring(F.col("seq"), (F.col("diagonal") + 1).cast("int"), F.length("oligo")) == read)
    return win.where(fits).select("oligo", "strand", "target_id", F.col("diagonal").alias("loc_5"), (F.col("diagonal") + F.length("oligo") - 1).alias("loc_3"))


def cull(seeds: DataFrame, max_len: int, slack: int = 50) -> DataFrame:
    """Seeds (assay_id, target_id, role, strand, t) that can be part of a pair: a '-' before a '+' within reach.

    A semi-join on buckets of the reach: a pair spans at most two of them.
    """
    reach = max_len + slack
    minus, plus = seeds.where("strand = '-' and role <> 'P'"), seeds.where("strand = '+' and role <> 'P'")
    b = F.floor(F.col("t") / reach)

    def near(a: DataFrame, other: DataFrame, shifts: tuple[int, int], sign: int) -> DataFrame:
        there = other.select("assay_id", "target_id", F.col("t").alias("t2"), F.explode(F.array(*[b + s for s in shifts])).alias("b"))
        on = [F.col("x.assay_id") == F.col("y.assay_id"), F.col("x.target_id") == F.col("y.target_id"), F.col("x.b") == F.col("y.b")]
        gap = (F.col("y.t2") - F.col("x.t")) * sign
        return a.withColumn("b", b).alias("x").join(there.alias("y"), [*on, (gap >= 0) & (gap <= reach)], "left_semi").drop("b")

    return near(minus, plus, (0, -1), 1).unionByName(near(plus, minus, (0, 1), -1))
