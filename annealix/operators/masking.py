"""Masking and replacement of bound oligos inside amplicons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_primers(s: Column, left: Column, right: Column) -> Column:
    """Lower case for the first ``left`` and the last ``right`` bases."""
    n = F.length(s)
    cut = F.greatest(n - right, left)
    return F.concat(F.lower(F.substring(s, F.lit(1), left)), F.substring(s, left + 1, cut - left), F.lower(F.substring(s, cut + 1, n)))


def replace_ends(s: Column, left: Column, right: Column) -> Column:
    """The oligos' own text in place of the bases they bind; '' leaves an end as it is."""
    return F.concat(left, F.substring(s, F.length(left) + 1, F.length(s) - F.length(left) - F.length(right)), right)


def mask_ranges(s: Column, ranges: Column) -> Column:
    """Lower case for every range of ``ranges`` (array of struct start, stop; offsets into s, inclusive)."""
    chars = F.transform(F.split(s, ""), lambda c, i: F.when(F.exists(ranges, lambda r: (r["start"] <= i) & (i <= r["stop"])), F.lower(c)).otherwise(c))
    return F.array_join(chars, "")
