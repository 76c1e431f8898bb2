"""Nearest-neighbour parameters and the tables made from them."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from .duplex import BODY, GAS, SALT

# Fixed values (published nearest-neighbour parameters). Each entry: top strand 5'-3' / bottom strand 3'-5', enthalpy, free energy at 37 C (kcal/mol).
# E: no base opposite (dangling end); I: inosine.
_STEPS = """
AA/TT -7.9 -1, AC/TG -8.4 -1.44, AG/TC -7.8 -1.28, AT/TA -7.2 -0.88, CA/GT -8.5 -1.45, CC/GG -8 -1.84
CG/GC -10.6 -2.17, GA/CT -8.2 -1.3, GC/CG -9.8 -2.24, TA/AT -7.2 -0.58, AA/ET 0.2 -0.51, AC/EG -6.3 -0.96
AG/EC -3.7 -0.58, AT/EA -2.9 -0.5, CA/ET 0.6 -0.42, CC/EG -4.4 -0.52, CG/EC -4 -0.34, CT/EA -4.1 -0.02
GA/ET -1.1 -0.62, GC/EG -5.1 -0.72, GG/EC -3.9 -0.56, GT/EA -4.2 0.48, TA/ET -6.9 -0.71, TC/EG -4 -0.58
TG/EC -4.9 -0.61, TT/EA -0.2 -0.1, EA/AT -0.7 -0.48, EC/AG -2.1 -0.92, EG/AC -5.9 -0.82, ET/AA -0.5 -0.12
EA/CT 4.4 -0.19, EC/CG -0.2 -0.23, EG/CC -2.6 -0.31, ET/CA 4.7 0.28, EA/GT -1.6 -0.5, EC/GG -3.9 -0.44
EG/GC -3.2 -0.01, ET/GA -4.1 -0.01, EA/TT 2.9 -0.29, EC/TG -4.4 -0.35, EG/TC -5.2 -0.52, ET/TA -3.8 0.13
AA/TG -0.6 0.14, AG/TA -0.7 0.02, CA/GG -0.7 0.03, CG/GA -4 0.11, GA/CG -0.6 -0.25, GG/CA 0.5 -0.52
TA/AG 0.7 0.42, TG/AA 3 0.74, AC/TT 0.7 0.64, AT/TC -1.2 0.73, CC/GT -0.8 0.62, CT/GC -1.5 0.4
GC/CT 2.3 0.62, GT/CC 5.2 0.98, TC/AT 1.2 0.97, TT/AC 1 0.75, AA/TC 2.3 0.88, AC/TA 5.3 0.77
CA/GC 1.9 0.75, CC/GA 0.6 0.79, GA/CC 5.2 0.81, GC/CA -0.7 0.47, TA/AC 3.4 0.92, TC/AA 7.6 1.33
AG/TT 1 0.71, AT/TG -2.5 0.07, CG/GT -4.1 -0.47, CT/GG -2.8 -0.32, GG/CT 3.3 0.08, GG/TT 5.8 0.74
GT/CG -4.4 -0.59, GT/TG 4.1 1.15, TG/AT -0.1 0.43, TG/GT -1.4 0.52, TT/AG -1.3 0.34, AA/TA 1.2 0.61
CA/GA -0.9 0.43, GA/CA -2.9 0.17, TA/AA 4.7 0.69, AC/TC 0 1.33, CC/GC -1.5 0.7, GC/CC 3.6 0.79
TC/AC 6.1 1.05, AG/TG -3.1 -0.13, CG/GG -4.9 -0.11, GG/CG -6 -1.11, TG/AG 1.6 0.44, AT/TT -2.7 0.69
CT/GT -5 -0.12, GT/CT -2.2 0.45, TT/AT 0.2 0.68, AI/TC -8.9 -0.96, TI/AC -5.9 -0.46, AC/TI -8.8 -0.89
TC/AI -4.9 -0.59, CI/GC -5.4 -1.14, GI/CC -6.8 -0.86, CC/GI -8.3 -0.88, GC/CI -5 -1.07, AI/TA -8.3 -0.51
TI/AA -3.4 0.09, AA/TI -0.7 0.12, TA/AI -1.3 0.12, CI/GA 2.6 -0.18, GI/CA -7.8 -1.24, CA/GI -7 -0.77
GA/CI -7.6 -1.33, AI/TT 0.49 0.71, TI/AT -6.5 0.36, AT/TI -5.6 0.22, TT/AI -0.8 0.54, CI/GT -1 -0.26
GI/CT -3.5 -0.19, CT/GI 0.1 0.41, GT/CI -4.3 -0.54, AI/TG -4.9 0.02, TI/AG -1.9 0.76, AG/TI 0.1 0.65
TG/AI 1 0.7, CI/GG 7.1 0.47, GI/CG -1.1 -0.1, CG/GI 5.8 0.54, GG/CI -7.6 -0.74, AI/TI -3.3 0.4
TI/AI 0.1 0.81, CI/GI 1.3 0.36, GI/CI -0.5 -0.09, II/CC -9.3 -0.64, II/AC -3.1 0.27, II/CA -8.7 0.44
II/AA -2.1 -0.27, II/TA 2.3 0.83, II/GA 4.2 0.3, II/CT -14.5 0.33, II/AT -17.8 0.19, II/TT -7 1.69
II/GT -19.4 0.13, II/TG 13.3 0.03, II/GG 0.3 -1.3, II/II -10.65 0.52, IC/CI -12.1 -0.85, CI/IC -1.8 0.06
IA/AI -13.9 -1.43, AI/IA -9.5 -0.56, IT/TI -7.6 2.03, TI/IT -14.7 0.61, IG/GI 3.2 1.18, GI/IG -4.2 1.12
"""

# Loops of three and four bases with their closing pair, enthalpy (kcal/mol), entropy (kcal/mol/K).
_SPECIAL = """
AAAAAT 0.5 -0.000644849, AAAACT 0.7 0.00161212, AAACAT 1 0.00161212, ACTTGT 0 0.00419152, AGAAAT -1.1 0.00161212
AGAAT -1.5 0, AGAGAT -1.1 0.00161212, AGATAT -1.5 0.00161212, AGCAAT -1.6 0.00161212, AGCAT -1.5 0
AGCGAT -1.1 0.00161212, AGCTTT 0.2 0.00161212, AGGAAT -1.1 0.00161212, AGGAT -1.5 0, AGGGAT -1.1 0.00161212
AGGGGT 0.5 0.000644849, AGTAAT -1.6 0.00161212, AGTAT -1.5 0, AGTGAT -1.1 0.00161212, AGTTCT 0.8 0.00161212
ATTCGT -0.2 0.00161212, ATTTGT 0 0.00161212, ATTTTT -0.5 0.00161212, CAAAAG 0.5 -0.0012897, CAAACG 0.7 0
CAACAG 1 0, CAACCG 0 0, CCTTGG 0 0.0025794, CGAAAG -1.1 0, CGAAG -2.0 0
CGAGAG -1.1 0, CGATAG -1.5 0, CGCAAG -1.6 0, CGCAG -2.0 0, CGCGAG -1.1 0
CGCTTG 0.2 0, CGGAAG -1.1 0, CGGAG -2.0 0, CGGGAG -1 0, CGGGGG 0.5 -0.000967274
CGTAAG -1.6 0, CGTAG -2.0 0, CGTGAG -1.1 0, CGTTCG 0.8 0, CTTCGG -0.2 0
CTTTGG 0 0, CTTTTG -0.5 0, GAAAAC 0.5 -0.00322425, GAAAAT 0.5 -0.00322425, GAAACC 0.7 0
GAAACT 1 0, GAACAC 1 0, GAACAT 1 0, GCTTGC 0 0.0025794, GCTTGT 0 0.00161212
GGAAAC -1.1 0, GGAAAT -1.1 0, GGAAC -2.0 0, GGAGAC -1.1 0, GGAGAT -1.1 0
GGATAC -1.6 0, GGATAT -1.6 0, GGCAAC -1.6 0, GGCAAT -1.6 0, GGCAC -2.0 0
GGCGAC -1.1 0, GGCGAT -1.1 0, GGCTTC 0.2 0, GGCTTT -0.1 0, GGGAAC -1.1 0
GGGAAT -1.1 0, GGGAC -2.0 0, GGGGAC -1.1 0, GGGGAT -1.1 0, GGGGGC 0.5 -0.000967274
GGGGGT 0.5 -0.000967274, GGTAAC -1.6 0, GGTAAT -1.6 0, GGTAC -2.0 0, GGTGAC -1.1 0
GGTGAT -1.1 0, GGTTCC 0.8 0, GTATAT -0.5 0, GTTCGC -0.2 0, GTTCGT -0.4 0
GTTTGC 0 0, GTTTGT -0.4 0, GTTTTC -0.5 0, GTTTTT -0.5 0, TAAAAA 0.5 0.000322425
TAAAAG 0.5 -0.00161212, TAAACA 0.7 0.00161212, TAAACG 1 0.00161212, TAACAA 1 0.00161212, TAACAG 1 0.00161212
TCTTGA 0 0.00419152, TCTTGG 0 0.00322425, TGAAA -1.5 0, TGAAAA -1.1 0.00161212, TGAAAG -1 0.00161212
TGAGAA -1.1 0.00161212, TGAGAG -1 0.00161212, TGATAA -1.6 0.00161212, TGATAG -1.5 0.00161212, TGCAA -1.5 0
TGCAAA -1.6 0.00161212, TGCAAG -1.5 0.00161212, TGCGAA -1.1 0.00161212, TGCGAG -1 0.00161212, TGCTTA 0.2 0.00161212
TGCTTG -0.1 0.00161212, TGGAA -1.5 0, TGGAAA -1.1 0.00161212, TGGAAG -1 0.00161212, TGGGAA -1.1 0.00161212
TGGGAG -1 0.00161212, TGGGGA 0.5 0.000644849, TGGGGG 0.5 0.000644849, TGTAA -1.5 0, TGTAAA -1.6 0.00161212
TGTAAG -1.5 0.00161212, TGTGAA -1.1 0.00161212, TGTGAG -1 0.00161212, TGTTCA 0.8 0.00161212, TTTCGA -0.2 0.00161212
TTTCGG -0.4 0.00161212, TTTTAG -1 0.00161212, TTTTGA 0 0.00161212, TTTTGG -0.4 0.00161212, TTTTTA -0.5 0.00161212
TTTTTG -0.5 0.00161212
"""

# Free energy at 37 C by size, for internal loops, bulges and hairpin loops; sizes between are interpolated.
_LOOP = {3: 3.2, 4: 3.6, 5: 4.0, 6: 4.4, 7: 4.6, 8: 4.8, 9: 4.9, 10: 4.9, 12: 5.2, 14: 5.4, 16: 5.6, 18: 5.8, 20: 5.9, 25: 6.3, 30: 6.6}
_BULGE = {1: 4.0, 2: 2.9, 3: 3.1, 4: 3.2, 5: 3.3, 6: 3.5, 7: 3.7, 8: 3.9, 9: 4.1, 10: 4.3, 12: 4.5, 14: 4.8, 16: 5.0, 18: 5.2, 20: 5.3, 25: 5.6, 30: 5.9}
_HAIRPIN = {3: 3.5, 4: 3.5, 5: 3.3, 6: 4.0, 7: 4.2, 8: 4.3, 9: 4.5, 10: 4.6, 12: 5.0, 14: 5.1, 16: 5.3, 18: 5.5, 20: 5.7, 25: 6.1, 30: 6.3}
# Symmetry, asymmetry per base and bulge beside A-T (free energies at 37 C), and the extrapolation factor of long loops.
SYMMETRY_G, ASYMMETRY_G, BULGE_AT_G, LONG_LOOP = 0.43, 0.3, 0.5, 2.44
# Terms that only rank alignments: enthalpy, entropy, share of the salt correction.
_RANK = {"loop": (-5.779, -2.330e-2, 3.08), "bulge": (0.5247, 3.318e-4, 0.69), "match_at": (-4.474, -2.091e-2, 0.56), "match_gc": (-3.000, -1.318e-2, 0.56), "mismatch": (-2.421, -1.180e-2, 1.31)}

CODES = "ACGTIE-"
GAP, NONE = 6, 5
N = len(CODES)
FORBIDDEN = 100.0


def pair(a: int, b: int) -> int:
    return N * a + b


def is_matched(a: int, b: int) -> bool:
    """Watson-Crick partners; inosine goes with every base."""
    return a < 5 and b < 5 and (a == 4 or b == 4 or a + b == 3)


MATCHED = np.array([is_matched(a, b) for a in range(N) for b in range(N)])
AT = np.array([{a, b} == {0, 3} for a in range(N) for b in range(N)])


def entropy(g: float, h: float = 0.0) -> float:
    return (h - g) / BODY


def by_size(points: dict[int, float], most: int = 1100) -> np.ndarray:
    """Entropy of a loop by size: linear between the points, logarithmic beyond the last."""
    first, last = min(points), max(points)
    sizes = np.arange(most)
    s = np.interp(sizes, list(points), [entropy(g) for g in points.values()])
    s[:first] = 0.0
    s[last + 1 :] = s[last] - LONG_LOOP * GAS * np.log(sizes[last + 1 :] / last)
    return s


LOOP, BULGE, HAIRPIN = by_size(_LOOP), by_size(_BULGE), by_size(_HAIRPIN)


@lru_cache(maxsize=1)
def stacks() -> tuple[np.ndarray, np.ndarray]:
    """Enthalpy and entropy of each pair followed by each pair."""
    h, s = np.zeros((N * N, N * N)), np.zeros((N * N, N * N))
    for a in range(5):
        for b in range(5):
            for x, y in ((pair(a, b), pair(GAP, GAP)), (pair(a, GAP), pair(GAP, b)), (pair(GAP, a), pair(b, GAP))):
                h[x, y] = h[y, x] = FORBIDDEN
    for entry in _STEPS.replace("\n", ",").split(","):
        if entry.strip():
            steps, dh, dg = entry.split()
            (a, b), (c, d) = ([CODES.index(x) for x in half] for half in steps.split("/"))
            for x, y in ((pair(a, c), pair(b, d)), (pair(d, b), pair(c, a))):
                h[x, y], s[x, y] = float(dh), entropy(float(dg), float(dh))
    return h, s


@lru_cache(maxsize=1)
def special_hairpins() -> dict[str, tuple[float, float]]:
    out = {}
    for entry in _SPECIAL.replace("\n", ",").split(","):
        if entry.strip():
            loop, h, s = entry.split()
            out[loop] = float(h), float(s)
    return out


@lru_cache(maxsize=16)
def ranking(temperature: float, salt: float) -> np.ndarray:
    """Cost (free energy times 10,000, truncated) of each pair followed by each pair, for choosing alignments."""
    h, s = stacks()
    per_base = SALT * math.log(salt)
    cost = np.trunc(10_000 * (h - temperature * (s + per_base))).astype(np.int64)

    def term(name: str) -> int:
        th, ts, share = _RANK[name]
        return max(0, math.trunc(10_000 * (th - temperature * (ts + share * per_base))))

    bases = range(5)
    for a in bases:
        for b in bases:
            x = pair(a, b)
            if not MATCHED[x]:
                open_cost = term("mismatch")
            elif {a, b} == {1, 2}:
                open_cost = term("match_gc")
            else:
                open_cost = term("match_at")
            for c in bases:
                for y in (pair(c, GAP), pair(GAP, c)):
                    cost[x, y] = cost[y, x] = open_cost
                for d in bases:
                    if not MATCHED[x] and not MATCHED[pair(c, d)]:
                        cost[pair(c, d), x] = term("loop")
            for x, y in ((pair(a, GAP), pair(b, GAP)), (pair(GAP, a), pair(GAP, b))):
                cost[y, x] = term("bulge")
    return cost
