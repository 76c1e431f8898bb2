"""Hashes of words and shingles, computed for whole batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and the number of words of each."""
    import xxhash

    split = pc.split_pattern_regex(pc.utf8_lower(texts), r"[^\pL\pN]+")
    counts = np.diff(split.offsets.to_numpy().astype(np.int64))
    coded = split.flatten().dictionary_encode()
    unique = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh64_intdigest(w) if w else 0 for w in unique), np.uint64, len(unique))
    index = coded.indices.to_numpy(zero_copy_only=False)
    flat = table[index] if len(index) else np.zeros(0, np.uint64)
    solid = np.fromiter((bool(w) for w in unique), bool, len(unique))[index] if len(index) else np.zeros(0, bool)
    before = np.concatenate(([0], np.cumsum(solid)))
    stops = np.cumsum(counts)
    return flat[solid], before[stops] - before[stops - counts]


def shingle(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; of the whole, if it has fewer."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - size + 1, np.uint64)
    for j in range(size):
        h = (h + words[j : j + len(h)]) * _ODD
    return mix(h + np.uint64(size))


def simhash(h: np.ndarray) -> int:
    ones = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(">u8")[0])
