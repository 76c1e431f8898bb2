"""Positions of regular-expression matches, with built-in functions only.

Spark extracts matches but not where they lie. The texts between the matches
come from ``split`` by the same pattern, so a match starts where the lengths
before it add up to. The running sum is taken in blocks, so that a text with
very many matches doesn't cost the square of their number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLOCK = 64


@dataclass(frozen=True)
class Kind:
    """One kind of span. ``keep`` takes a match and says whether it stands.

    ``trigger`` is a string without which no match can exist.
    """

    name: str
    order: int
    pattern: str
    keep: Callable[[Column], Column] | None = None
    trigger: str | None = None


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _starts(steps: Column, sums: Column, i: Column) -> Column:
    block = F.floor(i / _BLOCK).cast("int")
    return _total(F.slice(sums, F.lit(1), block)) + _total(F.slice(steps, block * _BLOCK + 1, i - block * _BLOCK))


def _steps(m: Column, g: Column) -> Column:
    return F.transform(m, lambda x, i: F.get(g, i) + F.length(x))


def _sums(s: Column) -> Column:
    last = F.floor((F.size(s) - 1) / _BLOCK).cast("int")
    sums = F.transform(F.sequence(F.lit(0), last), lambda b: _total(F.slice(s, b * _BLOCK + 1, F.lit(_BLOCK))))
    return F.when(F.size(s) > 0, sums).otherwise(F.array().cast("array<int>"))


def _placed(k: Kind, m: Column, s: Column, b: Column) -> Column:
    def span(x: Column, i: Column) -> Column:
        stop = _starts(s, b, i + 1)
        return F.struct((stop - F.length(x)).alias("start"), F.lit(k.order).alias("kind"), stop.alias("stop"), x.alias("match"))

    spans = F.transform(m, span)
    return F.filter(spans, lambda x: k.keep(x["match"])) if k.keep else spans


def add_spans(df: DataFrame, kinds: list[Kind], text: str = "text", out: str = "spans") -> DataFrame:
    """Add ``out``: array<struct<start, kind, stop, match>> of all standing matches, by start and kind."""
    held = df.columns
    for k in kinds:
        found = F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))
        if k.trigger:
            found = F.when(F.contains(text, F.lit(k.trigger)), found).otherwise(F.array().cast("array<string>"))
        df = df.withColumn(f"_m{k.order}", found)
    for k in kinds:
        m = F.col(f"_m{k.order}")
        df = df.withColumn(f"_g{k.order}", F.when(F.size(m) > 0, F.transform(F.split(text, k.pattern, -1), F.length)).otherwise(F.array().cast("array<int>")))
    for k in kinds:
        m, g = F.col(f"_m{k.order}"), F.col(f"_g{k.order}")
        df = df.withColumn(f"_s{k.order}", _steps(m, g))
    for k in kinds:
        s = F.col(f"_s{k.order}")
        df = df.withColumn(f"_b{k.order}", _sums(s))
    parts = [_placed(k, *(F.col(f"_{c}{k.order}") for c in "msb")) for k in kinds]
    return df.withColumn(out, F.array_sort(F.concat(*parts))).select(*held, out)


def written(spans: Column, names: list[str]) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    table = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(table, x["kind"]), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def counted(spans: Column, order: int) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == order)).cast("long")


def digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits of s pass the Luhn check."""
    rev = F.split(F.reverse(digits(s)), "")
    doubled = F.transform(rev, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.coalesce(_total(doubled) % 10 == 0, F.lit(False))


def mod97(s: Column) -> Column:
    """Whether an IBAN-like string passes mod-97 (letters count as 10 to 35)."""
    chars = F.split(F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4)), "")

    def step(a: Column, c: Column) -> Column:
        n = F.ascii(c)
        return F.when(n < 58, (a * 10 + n - 48) % 97).otherwise((a * 100 + n - 55) % 97)

    return F.aggregate(chars, F.lit(0), step) == 1


def cut_out(text: Column, spans: Column, mark: str) -> Column:
    """The text with each maximal run of overlapping spans replaced by ``mark``.

    ``spans`` are sorted by start.
    """
    state = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, F.greatest(x["start"] - a["at"], F.lit(0)))
        fresh = (x["start"] >= a["at"]) & (x["stop"] > x["start"])
        return F.struct(F.when(fresh, F.concat(a["out"], gap, F.lit(mark))).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["stop"]).alias("at"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, state, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))))
