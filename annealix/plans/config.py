"""Options of a search and their validation."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

ASSAY_KINDS = ("PCR", "PROBE", "PADLOCK", "MIPS", "AFFYMETRIX")
STRANDS = ("plus", "minus", "both")


@dataclass(frozen=True)
class SearchConfig:
    """All options with their defaults; concentrations in mol/l, temperatures in C unless named otherwise."""

    assay: str = "PCR"
    max_len: int = 2000
    min_primer_tm: float = 0.0
    max_primer_tm: float = 9999.0
    min_probe_tm: float = 0.0
    max_probe_tm: float = 9999.0
    min_primer_dg: float = -9999.0
    max_primer_dg: float = 0.0
    min_probe_dg: float = -9999.0
    max_probe_dg: float = 0.0
    primer_clamp: int = 0
    min_max_primer_clamp: int = -1
    probe_clamp_5: int = 0
    probe_clamp_3: int = 0
    salt: float = 0.05
    primer_ct: float = 9e-7
    probe_ct: float = 2.5e-7
    asymmetric_ratio: float = 1.0
    temperature_k: float = 310.15
    word_length: int = 7
    dangle5: bool = False
    dangle3: bool = False
    dinkelbach: bool = False
    max_target_len: int = 500_000
    max_gap: int = 999
    max_mismatch: int = 999
    max_poly_degen: int = 3
    rescale_ct: bool = True
    single_primer_pcr: bool = True
    target_strand: str = "both"
    multiplex: bool = False
    best_match: bool = False
    ignore_probe: bool = False
    mask_primers: bool = False
    mask_probe: bool = False
    replace_primers: bool = False
    self_structure: bool = False

    def validate(self) -> SearchConfig:
        """Self, or ValueError naming the first option out of range."""
        rules = {
            "assay": self.assay in ASSAY_KINDS,
            "target_strand": self.target_strand in STRANDS,
            "max_len": self.max_len > 0,
            "salt": 0 < self.salt < 1,
            "primer_ct": 0 < self.primer_ct <= 10,
            "probe_ct": 0 < self.probe_ct <= 10,
            "asymmetric_ratio": self.asymmetric_ratio > 0,
            "temperature_k": self.temperature_k >= 0,
            "word_length": 3 <= self.word_length <= 8,
            "min_primer_tm": 0 <= self.min_primer_tm <= min(self.max_primer_tm, 200),
            "min_probe_tm": 0 <= self.min_probe_tm <= min(self.max_probe_tm, 200),
            "min_primer_dg": self.min_primer_dg <= self.max_primer_dg,
            "min_probe_dg": self.min_probe_dg <= self.max_probe_dg,
            "primer_clamp": self.primer_clamp >= 0,
            "probe_clamp_5": self.probe_clamp_5 >= 0,
            "probe_clamp_3": self.probe_clamp_3 >= 0,
            "max_target_len": self.max_target_len > 0,
            "max_gap": self.max_gap >= 0,
            "max_mismatch": self.max_mismatch >= 0,
            "max_poly_degen": self.max_poly_degen >= 0,
        }
        for f in fields(self):
            if not rules.get(f.name, True):
                raise ValueError(f"{f.name} is out of range: {getattr(self, f.name)!r}")
        return self

    def with_thresholds(self, primers: bool, probes: bool) -> SearchConfig:
        """Self with the bounds its assays need, or ValueError if they are missing.

        PCR needs a bound on the Tm or free energy of primers, and of probes if
        there are any. The other formats take primer bounds for probes where
        probe bounds are missing.
        """
        names = {x: [f"{m}_{x}_{v}" for v in ("tm", "dg") for m in ("min", "max")] for x in ("primer", "probe")}
        plain = SearchConfig()
        given = {x: any(getattr(self, n) != getattr(plain, n) for n in ns) for x, ns in names.items()}
        if self.assay == "PCR":
            if primers and not given["primer"]:
                raise ValueError("bounds on the Tm or free energy of primers are missing")
            if probes and not given["probe"]:
                raise ValueError("bounds on the Tm or free energy of probes are missing")
            return self
        if given["probe"]:
            return self
        if not given["primer"]:
            raise ValueError("bounds on the Tm or free energy of probes are missing")
        return replace(self, **{p: getattr(self, f) for f, p in zip(names["primer"], names["probe"])})
