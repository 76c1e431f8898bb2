"""Secrets, and credentials whose parts lie apart (operator 5).

Strong parts stand alone: an assigned secret of 12 or more characters, an
access identifier of 18 or more, a hexadecimal run of 16 or more. Weak parts
say nothing by themselves: a short assigned secret, a short or assigned
identifier, a 40-character token of mixed case and digits, an endpoint. All
parts are put into one table of intervals; a weak part is reported only if the
interval join finds a complementary part within its scope (``SCOPE`` code
points on either side):

    weak identifier  needs a secret
    weak secret      needs an identifier or an endpoint
    endpoint         needs a secret

The join is on (text, bin of ``SCOPE`` code points) and a semi-join, so no
pairs are made. Only parts are shuffled, never texts.

Null text: empty, no spans. Repeated rows: one result each. Null ids stay.
Empty table: empty result. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import key_of, materialise, pick
from .spans import Kind, add_spans, counted, cut_out, written

SCOPE = 200
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def _value(m: Column) -> Column:
    return F.length(F.regexp_extract(m, _ASSIGN, 1))


def _mixed(m: Column) -> Column:
    return (F.length(m) == 40) & m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]")


KINDS = [
    Kind("assign", 0, _ASSIGN, lambda m: _value(m) >= 12),
    Kind("access", 1, r"AKIA[A-Z0-9]++", lambda m: F.length(m) >= 18, trigger="AKIA"),
    Kind("hex", 2, r"[0-9a-f]{16,}+"),
    Kind("short_secret", 3, _ASSIGN, lambda m: _value(m).between(4, 11)),
    Kind("short_access", 4, r"AKIA[A-Z0-9]++", lambda m: F.length(m).between(10, 17), trigger="AKIA"),
    Kind("identifier", 5, r"""(?i:access_?key_?id|client_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,}"""),
    Kind("token40", 6, r"[A-Za-z0-9+/]{32,}+", _mixed),
    Kind("endpoint", 7, r"[a-z][a-z0-9+]{1,12}://[A-Za-z0-9._:@-]+", trigger="://"),
]
NAMES = [k.name for k in KINDS]
#: Roles of kinds: what a part is, and what a weak part needs nearby.
IDENTIFIERS, SECRETS, ENDPOINTS = (1, 4, 5), (0, 2, 3, 6), (7,)
NEEDS = {3: IDENTIFIERS + ENDPOINTS, 4: SECRETS, 5: SECRETS, 6: IDENTIFIERS + ENDPOINTS, 7: SECRETS}


def link(parts: DataFrame) -> DataFrame:
    """The weak parts (rid, start, stop, kind) that have a complementary part in their scope."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / SCOPE), F.floor(b / SCOPE)))
    weak = parts.where(F.col("kind") >= 3).withColumn("bin", bins(F.col("start") - SCOPE, F.col("stop") + SCOPE)).alias("w")
    other = parts.where(F.col("kind").isNotNull()).withColumn("bin", bins(F.col("start"), F.col("stop"))).alias("o")
    w, o = lambda c: F.col(f"w.{c}"), lambda c: F.col(f"o.{c}")
    fits = F.lit(False)
    for kind, need in NEEDS.items():
        fits = fits | ((w("kind") == kind) & o("kind").isin(*need))
    near = (o("start") <= w("stop") + SCOPE) & (o("stop") >= w("start") - SCOPE)
    hit = weak.join(other, (w("rid") == o("rid")) & (w("bin") == o("bin")) & near & fits, "left_semi")
    return hit.select("rid", "start", "stop", "kind").distinct()


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, rid, spans: array<struct<start, kind, stop>> of strong and linked weak parts, one row per document."""
    rows = pick(docs, id_col, text_col).withColumn("rid", F.monotonically_increasing_id())
    spans = add_spans(rows, KINDS)
    parts = materialise(
        spans.select("rid", "doc_id", F.explode_outer(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["stop"].alias("stop")))).alias("p")).select("rid", "doc_id", "p.start", "p.kind", "p.stop"),
        "secret-parts",
    )
    strong = parts.where(F.col("kind").isNull() | (F.col("kind") < 3))
    reported = strong.select("rid", "start", "kind", "stop").unionByName(link(parts))
    grouped = reported.groupBy("rid").agg(F.array_sort(F.collect_list(F.when(F.col("kind").isNotNull(), F.struct("start", "kind", "stop")))).alias("spans"))
    every = parts.select("rid", "doc_id").distinct()
    none = F.array().cast("array<struct<start:int,kind:int,stop:int>>")
    return every.join(grouped, "rid", "left").select("doc_id", "rid", F.coalesce("spans", none).alias("spans"))


def redact(docs: DataFrame, *, mark: str = "[SECRET]", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The documents with every reported span cut out of the text; other columns stay.

    ``length_col`` names a column that holds the text's length and follows it.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # What is found depends on the text alone, so texts are matched by their hashes.
    named = docs.select(key_of(text).alias("doc_id"), text.alias("text"))
    found = find_secrets(named).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("_tk")).agg(F.first("spans").alias("_spans"))
    rows = docs.withColumn("_tk", key_of(text)).join(found, "_tk", "left")
    cut = F.when(F.col("_spans").isNotNull(), cut_out(text, F.col("_spans"), mark)).otherwise(F.col(text_col))
    out = rows.withColumn("_cut", cut)
    if length_col:
        out = out.withColumn(length_col, F.when(F.col("_spans").isNotNull(), F.length("_cut").cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.withColumn(text_col, F.col("_cut")).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns of ``find_secrets``'s result."""
    s = F.col("spans")
    base = F.filter(s, lambda x: x["kind"] < 3)
    return found.select(
        "doc_id",
        *[counted(s, n).alias(f"n_{NAMES[n]}") for n in range(3)],
        F.sha2(written(base, NAMES).cast("binary"), 256).alias("base_sha256"),
        written(s, NAMES).alias("spans"),
        F.size(F.filter(s, lambda x: x["kind"] >= 3)).cast("long").alias("n_linked"),
    )
