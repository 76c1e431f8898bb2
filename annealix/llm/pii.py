"""Personal data: patterns propose, checksums confirm, context words weigh (operator 8).

Every kind has a pattern, an optional validator and a base score. A validator
that passes (Luhn for cards, mod-97 for IBANs, parts up to 255 for addresses)
raises the score; words of the kind's context within ``WINDOW`` code points
before or behind raise it further. The contract's four base kinds stand by
their validators alone; the kinds that are added (IBAN, local phone numbers,
national numbers) stand from ``THRESHOLD`` on.

Null text: empty, no spans. Repeated rows: one result each. Null ids stay.
Empty table: empty result. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick
from .spans import Kind, add_spans, counted, digits, luhn, mod97, written

WINDOW = 40
THRESHOLD = 0.6
#: Kinds in the order of listing, with the score a match has and that a context word adds.
SCORES = {"email": (0.9, 0.1), "ip": (0.6, 0.3), "card": (0.8, 0.2), "phone": (0.6, 0.3), "iban": (0.9, 0.1), "local_phone": (0.4, 0.3), "national_id": (0.3, 0.4)}
NAMES = list(SCORES)
#: Context words, lower case, by kind.
CONTEXT = {
    "email": "mail|contact|write",
    "ip": "ip|host|server|address|client",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|call|tel|fax|mobile|contact",
    "iban": "iban|bank|account|konto|cuenta|compte",
    "local_phone": "phone|call|tel|fax|mobile|contact",
    "national_id": "ssn|social security|national id|tax id",
}


_OCTET = r"0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"


def _octets(m: Column) -> Column:
    return m.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$")


def _between(m: Column, low: int, high: int) -> Column:
    return F.length(digits(m)).between(low, high)


# A run of digits too short for a card can't hold one, so only long runs are taken.
# Possessive repeats and look-behinds find the same matches as the plain patterns:
# what follows a repeat is never in its class, and a start inside a run of the
# first class can only succeed where the run's own start does.
KINDS = [
    Kind("email", 0, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", trigger="@"),
    Kind("ip", 1, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", _octets),
    Kind("card", 2, r"[0-9](?:[ -]?+[0-9]){13,}+", lambda m: _between(m, 14, 19) & luhn(m)),
    Kind("phone", 3, r"\+[0-9][ ().0-9-]+[0-9]", lambda m: _between(m, 10, 15), trigger="+"),
    Kind("iban", 4, r"[A-Z0-9]{15,}+", lambda m: m.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") & mod97(m)),
    Kind("local_phone", 5, r"[0-9-]{11,}+", lambda m: m.rlike(r"^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), trigger="-"),
    Kind("national_id", 6, r"[0-9-]{11,}+", lambda m: m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), trigger="-"),
]


def scored(spans: Column, text: Column) -> Column:
    """Each span with its score."""

    def score(x: Column) -> Column:
        start = F.greatest(x["start"] - WINDOW, F.lit(0))
        near = F.lower(F.concat(F.substring(text, start + 1, x["start"] - start), F.lit(" "), F.substring(text, x["stop"] + 1, F.lit(WINDOW))))
        value = F.lit(0.0)
        for n, (base, more) in reversed(list(enumerate(SCORES.values()))):
            hit = near.rlike(r"(^|[^a-z])(" + CONTEXT[NAMES[n]] + ")")
            value = F.when(x["kind"] == n, F.when(hit, F.lit(min(1.0, round(base + more, 6)))).otherwise(F.lit(base))).otherwise(value)
        return F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop"), x["match"].alias("match"), value.alias("score"))

    return F.transform(spans, score)


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, spans: array<struct<start, kind, stop, match, score>> by start and kind."""
    df = add_spans(pick(docs, id_col, text_col), KINDS, out="found")
    df = df.withColumn("spans", F.when(F.size("found") > 0, scored(F.col("found"), F.col("text"))).otherwise(F.array().cast("array<struct<start:int,kind:int,stop:int,match:string,score:double>>")))
    return df.select("doc_id", "text", F.filter("spans", lambda x: (x["kind"] < 4) | (x["score"] >= THRESHOLD)).alias("spans"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_pii``'s result."""
    s = F.col("spans")
    base = F.filter(s, lambda x: x["kind"] < 4)
    return found.select(
        "doc_id",
        *[counted(s, n).alias(f"n_{NAMES[n]}") for n in range(4)],
        F.sha2(written(base, NAMES).cast("binary"), 256).alias("base_sha256"),
        written(s, NAMES).alias("spans"),
        F.array_join(F.transform(s, lambda x: x["score"].cast("string")), ",").alias("scores"),
    )
