"""Nearest-neighbour thermodynamics of perfect duplexes as column expressions.

Sums are of integers (hundredths of kcal/mol), so they don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (kcal/mol): enthalpy and free energy at 37 C of each step of two bases, then the general terms.
STEPS = {
    "AA": (-7.9, -1.00), "AC": (-8.4, -1.44), "AG": (-7.8, -1.28), "AT": (-7.2, -0.88),
    "CA": (-8.5, -1.45), "CC": (-8.0, -1.84), "CG": (-10.6, -2.17), "CT": (-7.8, -1.28),
    "GA": (-8.2, -1.30), "GC": (-9.8, -2.24), "GG": (-8.0, -1.84), "GT": (-8.4, -1.44),
    "TA": (-7.2, -0.58), "TC": (-8.2, -1.30), "TG": (-8.5, -1.45), "TT": (-7.9, -1.00),
}
INIT_H, INIT_G = 0.2, 1.96
TERMINAL_AT_H, TERMINAL_AT_G = 2.2, 0.05
SALT = 0.368e-3
GAS = 1.9872e-3
ZERO_C, BODY = 273.15, 310.15
DEFAULT_SALT, DEFAULT_PRIMER_CT, DEFAULT_PROBE_CT = 0.05, 9e-7, 2.5e-7


def effective_concentration(a: Column, b: Column) -> Column:
    """Concentration that counts for two strands: the greater less half the lesser."""
    return F.greatest(a, b) - F.least(a, b) / 2


def step_sums(s: Column) -> tuple[Column, Column]:
    """Enthalpy and free energy of a perfect duplex, as integers of hundredths."""
    ends = F.length(F.regexp_replace(F.concat(F.substring(s, 1, 1), F.right(s, F.lit(1))), "[^AT]", ""))
    out = []
    for which, first, end in ((0, INIT_H, TERMINAL_AT_H), (1, INIT_G, TERMINAL_AT_G)):
        table = F.create_map(*[F.lit(x) for step, v in STEPS.items() for x in (step, round(100 * v[which]))])
        out.append(F.aggregate(_steps(s, table), F.lit(0), lambda a, x: a + x) + round(100 * first) + ends * round(100 * end))
    return out[0], out[1]


def _steps(s: Column, table: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.try_element_at(table, F.substring(s, i, F.lit(2))))


def duplex(s: Column, ct: float = DEFAULT_PRIMER_CT, salt: float = DEFAULT_SALT) -> dict[str, Column]:
    """dh, ds, dg (at 37 C) and tm (degrees C, not under zero) of a sequence bound to its complement; null for other bases."""
    import math

    h100, g100 = step_sums(s)
    dh = h100 / 100.0
    ds = (h100 - g100) / 100.0 / BODY + F.lit(SALT * math.log(salt)) * (F.length(s) - 1)
    tm = F.greatest(dh / (F.lit(GAS * math.log(ct)) + ds) - ZERO_C, F.lit(0.0))
    return {"dh": dh, "ds": ds, "dg": dh - BODY * ds, "tm": tm}
