"""Binding of oligos to windows of targets, with thresholds, places and uniqueness."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import binding as kernel
from ..functions.bases import revcomp
from ..functions.binding import Conditions

_FIELDS = {"dh": "double", "ds": "double", "dg": "double", "tm": "double", "anchor_5": "int", "anchor_3": "int", "num_mm": "int", "num_gap": "int", "max_degen_run": "int", "i5": "int", "j5": "int", "i3": "int", "j3": "int", "alignment": "string"}


def _arrow(kind: str) -> pa.DataType:
    return {"double": pa.float64(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}[kind]


def bind(windows: DataFrame, cond: Conditions = Conditions(), *, iterate: bool = False) -> DataFrame:
    """Rows with oligo, strand, start, window and ct, joined by the energies and place of their best binding.

    Rows that don't bind are dropped. Within a batch equal (oligo, window, ct)
    are computed once. loc_5 and loc_3 are the least and greatest target
    coordinate, unbound oligo bases included; bound_5 and bound_3 leave them out.
    ``iterate``: align at each binding's own melting temperature.
    """
    held = windows.columns
    read = F.when(F.col("strand") == "-", revcomp(F.col("window"))).otherwise(F.col("window"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = list(zip(b.column("oligo").to_pylist(), b.column("_read").to_pylist(), b.column("ct").to_pylist()))
            unique = list(dict.fromkeys(keys))
            if iterate:
                found = {k: kernel.iterate(*k, cond) for k in unique}
            else:
                found = dict(zip(unique, kernel.bind_many([k[0] for k in unique], [k[1] for k in unique], [k[2] for k in unique], cond)))
            rows = {}
            for (oligo, target, _), x in ((k, found[k]) for k in unique):
                if x is not None:
                    rows[oligo, target, _] = (x.dh, x.ds, x.dg, x.tm, *kernel.clamps(x, oligo, target), *kernel.counts(x, oligo, target), *x.first, *x.last, kernel.picture(x, oligo, target))
            keep = pa.array([k in rows for k in keys], pa.bool_())
            got = [rows[k] for k in keys if k in rows]
            cols = [pa.array([g[n] for g in got], _arrow(kind)) for n, kind in enumerate(_FIELDS.values())]
            kept = b.filter(keep)
            yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in held), *cols], [*held, *_FIELDS])

    types = dict(windows.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in held] + [f"{c} {t}" for c, t in _FIELDS.items()])
    out = windows.withColumn("_read", read).select(*held, "_read").mapInArrow(run, schema)
    n, w = F.length("oligo"), F.length("window")
    minus = F.col("strand") == "-"
    low = F.when(minus, F.col("start") + F.col("j5") - F.col("i5")).otherwise(F.col("start") + (w - 1 - F.col("j3")) - (n - 1 - F.col("i3")))
    high = F.when(minus, F.col("start") + F.col("j3") + (n - 1 - F.col("i3"))).otherwise(F.col("start") + (w - 1 - F.col("j5")) + F.col("i5"))
    first = F.when(minus, F.col("start") + F.col("j5")).otherwise(F.col("start") + (w - 1 - F.col("j3")))
    last = F.when(minus, F.col("start") + F.col("j3")).otherwise(F.col("start") + (w - 1 - F.col("j5")))
    places = {"loc_5": low, "loc_3": high, "bound_5": first, "bound_3": last}
    return out.withColumns({c: v.cast("long") for c, v in places.items()}).drop("i5", "j5", "i3", "j3")


def within(b: DataFrame, *, tm: tuple[float, float] = (0.0, 9999.0), dg: tuple[float, float] = (-9999.0, 0.0), clamp_5: int = 0, clamp_3: int = 0, max_mismatch: int = 999, max_gap: int = 999, max_degen_run: int = 3) -> DataFrame:
    """Bindings inside all thresholds (bounds included)."""
    return b.where(
        F.col("tm").between(*tm) & F.col("dg").between(*dg) & (F.col("anchor_5") >= clamp_5) & (F.col("anchor_3") >= clamp_3) & (F.col("num_mm") <= max_mismatch) & (F.col("num_gap") <= max_gap) & (F.col("max_degen_run") <= max_degen_run)
    )


def unique(b: DataFrame, *keys: str) -> DataFrame:
    """One binding per place: highest Tm, then most mismatches, then longest alignment."""
    order = Window.partitionBy(*keys, "strand", "loc_5", "loc_3").orderBy(F.desc("tm"), F.desc("num_mm"), F.desc(F.length("alignment")), "alignment")
    return b.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def self_structure(oligos: DataFrame, ct: float, cond: Conditions = Conditions()) -> DataFrame:
    """oligo, hairpin_tm, homodimer_tm: computed once for each distinct oligo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seqs = b.column("oligo").to_pylist()
            pins = [kernel.hairpin(s, cond) for s in seqs]
            twins = kernel.bind_many(seqs, seqs, [ct / 2] * len(seqs), cond, symmetric=True)
            yield pa.RecordBatch.from_arrays([b.column("oligo"), pa.array([p[2] if p else 0.0 for p in pins], pa.float64()), pa.array([x.tm if x else 0.0 for x in twins], pa.float64())], ["oligo", "hairpin_tm", "homodimer_tm"])

    return oligos.select("oligo").where(F.col("oligo").isNotNull()).distinct().mapInArrow(run, "oligo string, hairpin_tm double, homodimer_tm double")


def heterodimers(pairs: DataFrame, ct: float, cond: Conditions = Conditions()) -> DataFrame:
    """forward, reverse, dimer_tm for distinct pairs of primers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f, r = b.column("forward").to_pylist(), b.column("reverse").to_pylist()
            tms = [x.tm if x else 0.0 for x in kernel.bind_many(f, r, [ct] * len(f), cond)]
            yield pa.RecordBatch.from_arrays([b.column("forward"), b.column("reverse"), pa.array(tms, pa.float64())], ["forward", "reverse", "dimer_tm"])

    return pairs.select("forward", "reverse").dropna().distinct().mapInArrow(run, "forward string, reverse string, dimer_tm double")
