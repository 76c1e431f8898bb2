"""Sequences, degenerate codes and primer rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Degenerate codes with their bases in order of expansion, and complements.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "I": "I", "M": "AC", "R": "GA", "S": "GC", "V": "GCA", "W": "AT", "Y": "TC", "H": "ACT", "K": "GT", "D": "GAT", "B": "GTC", "N": "ATGC"}
COMPLEMENT_FROM, COMPLEMENT_TO = "ACGTIMRSVWYHKDBN", "TGCAIKYSBWRDMHVN"


def clean_sequence(s: Column) -> Column:
    """Upper case without white space, gaps and stops; U reads as T, anything unknown as N."""
    t = F.translate(F.upper(F.regexp_replace(s, r"[\s*\-]", "")), "U", "T")
    return F.regexp_replace(t, "[^ACGTIMRSVWYHKDBN]", "N")


def complement(s: Column) -> Column:
    return F.translate(s, COMPLEMENT_FROM, COMPLEMENT_TO)


def revcomp(s: Column) -> Column:
    return F.reverse(complement(s))


def gc_fraction(s: Column) -> Column:
    """Share of G and C; null for an empty sequence."""
    return F.length(F.regexp_replace(F.upper(s), "[^GC]", "")) / F.nullif(F.length(s), F.lit(0))


def mask_whitespace(s: Column) -> Column:
    return F.regexp_replace(s, r"\s", "_")


def _codes() -> Column:
    return F.create_map(*[F.lit(x) for code, bases in IUPAC.items() for x in (code, bases)])


def degeneracy(s: Column) -> Column:
    """Number of sequences a degenerate one stands for; null if it has an unknown code."""
    return F.aggregate(F.split(F.upper(s), ""), F.lit(1).cast("long"), lambda a, c: a * F.length(F.try_element_at(_codes(), c)))


def expand(s: Column) -> Column:
    """Array of all sequences a degenerate one stands for; the first position varies fastest."""
    start = F.array(F.lit(""))
    return F.aggregate(F.split(F.upper(s), ""), start, lambda a, c: F.flatten(F.transform(F.split(F.try_element_at(_codes(), c), ""), lambda b: F.transform(a, lambda p: F.concat(p, b)))))


def gi_number(defline: Column) -> Column:
    return F.nullif(F.regexp_extract(defline, r"gi\|(\d+)", 1), F.lit("")).cast("long")


# Rules of primer design: each expression is true where the primer violates the rule.

#: Rules checked by default, in order of report.
DEFAULT_RULES = ("POLY_3_GC", "MULTI_5_GC", "NO_POLY_RUNS", "NO_3_T")


def rule_violations(s: Column) -> dict[str, Column]:
    """Violated or not, by rule name, for an upper-case sequence of A, C, G and T."""
    head = F.substring(s, 1, 5)
    gc_head = F.length(F.regexp_replace(head, "[^GC]", ""))
    middle = F.substring(s, F.floor(F.length(s) * 0.25).cast("int") + 1, (F.floor(F.length(s) * 0.75) - F.floor(F.length(s) * 0.25)).cast("int"))
    return {
        "POLY_3_GC": s.rlike("(GGG|CCC)$"),
        "MULTI_5_GC": gc_head > F.when(head.rlike("[CT]{2}"), 2).otherwise(3),
        "NO_POLY_RUNS": s.rlike("[CT]{5}|[AG]{5}"),
        "NO_3_T": s.rlike("T$"),
        "GC_CONTENT": ~gc_fraction(s).between(0.4, 0.6),
        "NO_5_G": s.rlike("^G"),
        "NO_5_G_3_C": s.rlike("^G") | s.rlike("C$"),
        "NO_IDENTICAL_RUNS": s.rlike("A{5}|C{5}|G{5}|T{5}"),
        "NO_5_PENULTIMATE_G": s.rlike("^.G"),
        "NO_3_POLY_G": s.rlike("(GGG|GGAG)$"),
        "NO_MIDDLE_CC": middle.rlike("CC"),
    }


def primer_report(s: Column, rules: tuple[str, ...] = DEFAULT_RULES) -> Column:
    """Names of the violated rules, PCR_VALID if there are none, BAD_BASE for other bases."""
    known = rule_violations(s)
    unknown = [r for r in rules if r not in known]
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    names = F.array_compact(F.array(*[F.when(known[r], F.lit(r)) for r in rules]))
    return F.when(~s.rlike("^[ACGT]+$"), "BAD_BASE").when(F.size(names) == 0, "PCR_VALID").otherwise(F.array_join(names, ", "))
