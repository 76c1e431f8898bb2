"""Pairwise alignment by substitution scores: local, overlap and global, with affine gaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bases import IUPAC

MODES = ("local", "overlap", "global")
_LOW = -(10**9)


def nucleic_score(a: str, b: str, match: int = 2, mismatch: int = -3) -> int:
    """Match if the two codes have a base in common; inosine matches all."""
    if "I" in (a, b):
        return match
    return match if set(IUPAC[a]) & set(IUPAC[b]) else mismatch


def align(a: str, b: str, mode: str = "local", *, score=nucleic_score, gap_open: int = -5, gap_extend: int = -2) -> tuple[int, str, str]:
    """Score and the two aligned strings. A gap of n costs gap_open + (n - 1) * gap_extend.

    Overlap alignments may leave the ends of either sequence free.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    n, m = len(a), len(b)
    best = np.full((3, n + 1, m + 1), _LOW, np.int64)  # pair, gap in b, gap in a
    best[0, 0, 0] = 0
    if mode == "global":
        best[1, 1:, 0] = gap_open + gap_extend * np.arange(n)
        best[2, 0, 1:] = gap_open + gap_extend * np.arange(m)
    else:
        best[0, :, 0] = best[0, 0, :] = 0
    for i in range(1, n + 1):
        row = [score(a[i - 1], x) for x in b]
        for j in range(1, m + 1):
            start = best[:, i - 1, j - 1].max()
            best[0, i, j] = row[j - 1] + (max(start, 0) if mode == "local" else start)
            best[1, i, j] = max(best[0, i - 1, j] + gap_open, best[1, i - 1, j] + gap_extend, best[2, i - 1, j] + gap_open)
            best[2, i, j] = max(best[0, i, j - 1] + gap_open, best[2, i, j - 1] + gap_extend, best[1, i, j - 1] + gap_open)
    if mode == "global":
        state, i, j = int(best[:, n, m].argmax()), n, m
    elif mode == "local":
        i, j = np.unravel_index(int(best[0].argmax()), best[0].shape)
        state = 0
    else:
        ends = [(int(best[0, i, m]), i, m) for i in range(n + 1)] + [(int(best[0, n, j]), n, j) for j in range(m + 1)]
        _, i, j = max(ends, key=lambda x: x[0])
        state = 0
    total, top, bottom = int(best[state, i, j]), [], []
    while i > 0 or j > 0:
        if mode != "global" and (i == 0 or j == 0):
            break
        value = best[state, i, j]
        if state == 0:
            i, j = i - 1, j - 1
            top.append(a[i])
            bottom.append(b[j])
            left = value - score(a[i], b[j])
            if mode == "local" and left == 0 and best[:, i, j].max() <= 0:
                break
            state = int(best[:, i, j].argmax())
            continue
        step, other = (1, 0), 2
        if state == 2:
            step, other = (0, 1), 1
        top.append(a[i - 1] if state == 1 else "-")
        bottom.append("-" if state == 1 else b[j - 1])
        i, j = i - step[0], j - step[1]
        choices = {0: best[0, i, j] + gap_open, state: best[state, i, j] + gap_extend, other: best[other, i, j] + gap_open}
        if mode == "global" and (i == 0 or j == 0):
            state = (1 if i else 2) if i or j else 0
        else:
            state = max(choices, key=lambda s: choices[s])
    return total, "".join(reversed(top)), "".join(reversed(bottom))


def relative_score(value: int, a: str, b: str, *, match: int = 2, mismatch: int = -3) -> float:
    """Where a score lies between the worst and the best for the shorter sequence: 0 to 1."""
    n = min(len(a), len(b))
    return (value - n * mismatch) / (n * (match - mismatch)) if n else 0.0


def align_pairs(pairs: DataFrame, a: str, b: str, mode: str = "local") -> DataFrame:
    """All columns of pairs with score, aligned_a and aligned_b; null sequences give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [align(x, y, mode) if x is not None and y is not None else (None, None, None) for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist())]
            cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], [*batch.schema.names, "score", "aligned_a", "aligned_b"])

    schema = ", ".join([f"`{c}` {t}" for c, t in pairs.dtypes] + ["score long", "aligned_a string", "aligned_b string"])
    return pairs.mapInArrow(run, schema)
