"""Quality rules and robust multivariate outliers (operator 1).

Counts of every text are turned into a vector of transformed statistics. For
each language and source the minimum covariance determinant estimate of centre
and scatter is found by concentration steps: the half of the rows nearest to
the current centre gives the next centre and scatter, until the determinants
settle. A reweighting step follows, and rows beyond ``cutoff`` in squared
Mahalanobis distance are rejected.

A step is one aggregation. Distances fall into narrow logarithmic bins; counts
and moments are summed per group and bin (combined before the shuffle, so a
group of any size is a few hundred rows), and the bins that hold the nearest
half are merged. No row is sampled and no group meets in one task. Groups of
fewer than ``least`` rows are pooled by language, then altogether; if even that
pool is too small its rows are judged by an estimate over all rows, be they
however few (``FLOOR`` then bounds the scatter).

Scatter is regularised: no direction is taken to vary less than ``FLOOR``, as
some counts are zero in nearly all clean texts.

Null text: no words (fails the base rules). Null language or source: a group
of its own. Repeated rows: one result each. Null ids stay. Empty table: empty
result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, pick

_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\x0b\x0c\r"
#: Names of the statistics and the least standard deviation each is taken to have.
FLOOR = {"log_words": 0.5, "log_word_length": 0.08, "symbols": 0.3, "dup_lines": 0.25, "repeats": 0.2}
P = len(FLOOR)
_BINS_PER_OCTAVE, _LOW, _HIGH = 16, -160, 400


def chi2(q: float, df: int) -> float:
    """Quantile of the chi-squared distribution (Wilson and Hilferty)."""
    from statistics import NormalDist

    a = 2 / (9 * df)
    return df * (1 - a + NormalDist().inv_cdf(q) * math.sqrt(a)) ** 3


def count_words(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    solid = text.translate(None, _SPACES)
    chars = len(solid.decode("utf-8", "surrogatepass")) if not solid.isascii() else len(solid)
    repeats, n = 0, len(words)
    if n > 3:
        number: dict[bytes, int] = {}
        ids = np.fromiter([number.setdefault(w, len(number)) for w in words], np.int64, n)
        v = len(number)
        pairs = ids[:-1] * v + ids[1:]
        if v > 1 << 20:  # three numbers would not fit in 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1]
        code = pairs[:-1] * v + ids[2:]
        order = np.argsort(code, kind="stable")
        ranked = code[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeats = int(covered.sum())
    return n, chars, len(text) - len(text.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def count_documents(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """doc_id, lang, source and the counts of each text."""
    bounded_batches(docs.sparkSession)
    base = pick(docs, id_col, text_col, lang_col, source_col).toDF("doc_id", "text", "lang", "source").withColumns({c: F.col(c).cast("string") for c in ("lang", "source")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [count_words(t.as_buffer().to_pybytes()) for t in b.column("text")]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), b.column("source"), *cols], ["doc_id", "lang", "source", *COUNTS])

    return base.mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def statistics() -> list[Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log(words),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.asinh(20 * F.col("n_symbols") / words),
        F.asinh(5 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.asinh(5 * F.col("n_repeat_words") / words),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance of x0.. by the estimate's centre (c) and precision (w, upper triangle row by row)."""
    d = [F.col(f"x{i}") - F.get("c", F.lit(i)) for i in range(P)]
    terms, at = F.lit(0.0), 0
    for i in range(P):
        for j in range(i, P):
            terms = terms + F.get("w", F.lit(at)) * d[i] * d[j] * (1 if i == j else 2)
            at += 1
    return F.greatest(terms, F.lit(0.0))


def _estimate(sums: DataFrame, factor: str) -> DataFrame:
    """Centre and precision per group from n, s (sums) and q (products, upper triangle). ``factor`` scales the scatter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = np.array(list(FLOOR.values()))
        for b in batches:
            out: list[list] = [[], [], []]
            for grp, n, s, q, f in zip(*(b.column(k).to_pylist() for k in ("grp", "n", "s", "q", "f"))):
                c = np.array(s) / n
                m = np.zeros((P, P))
                m[np.triu_indices(P)] = np.array(q) / n
                m = m + np.triu(m, 1).T - np.outer(c, c)
                # In units of the floor no direction may have a variance under one.
                val, vec = np.linalg.eigh(f * m / np.outer(floor, floor))
                w = (vec / np.maximum(val, 1.0)) @ vec.T / np.outer(floor, floor)
                for col, v in zip(out, (grp, c.tolist(), w[np.triu_indices(P)].tolist())):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(x, pa.list_(pa.float64())) for x in out[1:])], ["grp", "c", "w"])

    return sums.select("grp", "n", "s", "q", F.expr(factor).alias("f")).mapInArrow(run, "grp string, c array<double>, w array<double>")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    xs = [F.col(f"x{i}") for i in range(P)]
    s = F.array(*[F.sum(x) for x in xs]).alias("s")
    q = F.array(*[F.sum(xs[i] * xs[j]) for i in range(P) for j in range(i, P)]).alias("q")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), s, q)


def _add(binned: DataFrame) -> DataFrame:
    """Sums of bins added up per group."""
    plus = lambda name, size: F.array(*[F.sum(F.get(name, F.lit(i))) for i in range(size)]).alias(name)
    return binned.groupBy("grp").agg(F.sum("n").alias("n"), plus("s", P), plus("q", P * (P + 1) // 2), F.max("f").alias("f"))


def _with_estimates(rows: DataFrame, est: DataFrame, broadcast_rows: int) -> DataFrame:
    """Rows beside their group's estimate; the estimates are broadcast only if they are few."""
    return rows.join(_small(est, broadcast_rows), "grp")


def _small(df: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it has up to ``most`` rows."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    coverage: float = 0.5,
    steps: int = 5,
    least: int = 200,
    cutoff: float = 60.0,
    broadcast_rows: int = 20_000,
) -> DataFrame:
    """doc_id, the counts, base_failed, kept, distance (squared; null where the base rules fail)."""
    counts = count_documents(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, source_col=source_col)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    xs = {f"x{i}": s for i, s in enumerate(statistics())}
    rows = materialise(counts.withColumn("base_failed", failed).withColumns(xs), "quality-counts")

    # Which rows share an estimate: source and language, else language, else all.
    cells = rows.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    by_lang = Window.partitionBy("lang")
    own = F.col("n") >= least
    pooled = F.sum(F.when(~own, F.col("n"))).over(by_lang)
    name = lambda *c: F.to_json(F.array(*c))
    keyed = cells.withColumn("grp", F.when(own, name("lang", "source")).when(pooled >= least, name("lang")).otherwise(F.lit("[]"))).select(F.col("lang").alias("l"), F.col("source").alias("s"), "grp", "n")
    left = keyed.where("grp = '[]'").agg(F.sum("n")).first()[0] or 0
    same = F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s"))
    # The cells are joined as the estimates are: few, or else by a shuffle that AQE can split.
    rows = materialise(rows.join(_small(keyed.drop("n"), broadcast_rows), same, "left").drop("l", "s").withColumn("grp", F.when(F.col("base_failed"), F.lit(None)).otherwise(F.col("grp"))), "quality-groups")

    fit = rows.where(F.col("grp").isNotNull()).select("grp", *xs)
    if 0 < left < least:
        fit = fit.unionByName(fit.where("grp <> '[]'").withColumn("grp", F.lit("[]")))
    # First estimate: medians and median absolute deviations of each statistic.
    med = materialise(fit.groupBy("grp").agg(F.array(*[F.percentile_approx(x, 0.5, 2000) for x in xs]).alias("c")), "quality-start")
    away = _with_estimates(fit, med, broadcast_rows)
    mads = [F.percentile_approx(F.abs(F.col(x) - F.get("c", F.lit(i))), 0.5, 2000) for i, x in enumerate(xs)]
    floor = list(FLOOR.values())
    flat, at = [], 0
    for i in range(P):
        for j in range(i, P):
            flat.append(1 / F.pow(F.greatest(1.4826 * mads[i], F.lit(floor[i])), 2) if i == j else F.lit(0.0))
    est = materialise(away.groupBy("grp").agg(F.first("c").alias("c"), F.array(*flat).alias("w")), "quality-start")

    edge = F.least(F.greatest(F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-12))) * _BINS_PER_OCTAVE).cast("int"), F.lit(_LOW)), F.lit(_HIGH))
    upto = Window.partitionBy("grp").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    all_bins = Window.partitionBy("grp")
    middle = chi2(0.5, P)
    for step in range(steps + 1):
        last = step == steps
        binned = _sums(_with_estimates(fit, est, broadcast_rows).withColumn("d2", _distance()).withColumn("bin", edge), "grp", "bin")
        before = F.coalesce(F.sum("n").over(upto), F.lit(0))
        total = F.sum("n").over(all_bins)
        binned = binned.withColumn("before", before).withColumn("total", total)
        # Distances are scaled so that their median is that of the chi-squared distribution.
        half = F.max(F.when(F.col("before") < 0.5 * F.col("total"), F.pow(F.lit(2.0), (F.col("bin") + 1) / _BINS_PER_OCTAVE))).over(all_bins)
        binned = binned.withColumn("f", half / middle)
        if last:  # reweighting: all rows within the 97.5 % quantile
            near = F.pow(F.lit(2.0), F.col("bin") / _BINS_PER_OCTAVE) <= F.greatest(F.col("f"), F.lit(1.0)) * chi2(0.975, P)
        else:
            near = F.col("before") < coverage * F.col("total")
        est = materialise(_estimate(_add(binned.where(near | (F.col("before") == 0))), "1.0D" if not last else "1.1D"), "quality-estimate")

    judged = rows.join(_small(est, broadcast_rows), "grp", "left").withColumn("distance", F.when(F.col("c").isNotNull(), _distance()))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)
    return judged.select("doc_id", *COUNTS[:5], "base_failed", kept.alias("kept"), "distance", "n_lines")
