"""Benchmark decontamination by SimHash of item-sized windows (operator 2).

Words are lower-cased runs of letters and digits; shingles are ``words`` words.
For every benchmark item each document is read in windows of the item's length
(the whole document, if it is shorter). A window's SimHash is looked up in a
multi-index of the items' fingerprints: a fingerprint is cut into eight blocks
of eight bits and an item is listed under all values within ``r`` bits of its
own, so every fingerprint within radius 8 r + 7 is found in at least one block.
Candidates are verified by the exact weighted Jaccard similarity of the
shingles (weights are their numbers), at ``threshold`` or more.

A shingle that is repeated weighs so much in a SimHash that a window may be
alike and yet beyond the radius. So items with a repeated shingle are candidates
of every window that passes the bound below, and all items of the length are
candidates of such a window with a repeated shingle.

Windows that share too few shingles with all items of their length together to
reach the threshold with any of them are passed over before they are hashed;
that bound is exact.

Items are taken in blocks of about ``block_bytes`` of text. Blocks are treated
one after another: a block's index is built, broadcast, used on all documents
and freed before the next one is built. Nothing else grows with either table.

Null or empty text on either side: no match. An item with fewer words than a
shingle is one shingle. Repeated items count once; repeated documents give one
result each; of windows equally alike the first is reported. Null ids stay. A
very long text is read whole by one task. Only the named columns are read
(``drop_leaks`` hands the others on), so other names can't clash. Empty tables:
empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, pick
from .hashing import shingle, simhash, word_hashes

_NEAR = {r: np.array([v for v in range(256) if v.bit_count() <= r]) for r in (2, 3)}
#: Items of fewer shingles are searched at radius 31, others at 23.
_FEW = 24


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[ia], cb[ib]).sum())
    return both / (len(a) + len(b) - both)


def next_repeat(h: np.ndarray) -> np.ndarray:
    """For each place the first one by which a shingle from there on has come twice; the length, if none does."""
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    again = np.full(len(h), len(h))
    again[order[:-1][same]] = order[1:][same]
    return np.minimum.accumulate(again[::-1])[::-1]


@dataclass
class ItemIndex:
    """Fingerprints and shingles of one block of items."""

    size: int
    threshold: float
    ids: list = field(default_factory=list)
    shingles: list[np.ndarray] = field(default_factory=list)
    fps: list[int] = field(default_factory=list)
    by_words: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    repeating: dict[int, set[int]] = field(default_factory=lambda: defaultdict(set))
    tables: dict[int, list[dict[int, list[int]]]] = field(default_factory=dict)

    def add(self, item_id, words: np.ndarray) -> None:
        k = len(self.ids)
        self.ids.append(item_id)
        self.shingles.append(shingle(words, self.size))
        self.fps.append(simhash(self.shingles[k]))
        self.by_words[len(words)].append(k)
        if len(np.unique(self.shingles[k])) < len(self.shingles[k]):
            self.repeating[len(words)].add(k)

    def seal(self) -> ItemIndex:
        self.by_words, self.repeating = dict(self.by_words), dict(self.repeating)
        for n, items in self.by_words.items():
            r = self.reach(n)
            blocks: list[dict[int, list[int]]] = [defaultdict(list) for _ in range(8)]
            for k in items:
                for j in range(8):
                    for v in (_NEAR[r] ^ (self.fps[k] >> 8 * j & 255)).tolist():
                        blocks[j][v].append(k)
            self.tables[n] = [dict(b) for b in blocks]
        # Shingles of short items have fewer words, so a document is shingled once for each size.
        self.sizes = {s: np.unique(np.concatenate([self.shingles[k] for n, items in self.by_words.items() if min(n, self.size) == s for k in items])) for s in {min(n, self.size) for n in self.by_words}}
        owners: dict[int, set[int]] = defaultdict(set)
        for n, items in self.by_words.items():
            for k in items:
                for value in self.shingles[k].tolist():
                    owners[value].add(n)
        self.owners = {value: tuple(sorted(ns)) for value, ns in owners.items()}
        self.seen = {}
        for s, values in self.sizes.items():
            self.seen[s] = np.zeros(1 << 20, bool)
            self.seen[s][values >> np.uint64(44)] = True
        return self

    def reach(self, n_words: int) -> int:
        return 3 if n_words - self.size + 1 < _FEW else 2

    def hits(self, h: np.ndarray, s: int) -> np.ndarray:
        """Which shingles belong to any item."""
        maybe = np.flatnonzero(self.seen[s][h >> np.uint64(44)])
        out = np.zeros(len(h), bool)
        values = self.sizes[s]
        at = np.minimum(np.searchsorted(values, h[maybe]), len(values) - 1)
        out[maybe[values[at] == h[maybe]]] = True
        return out

    def candidates(self, n_words: int, fp: int) -> set[int]:
        radius = 8 * self.reach(n_words) + 7
        found = {k for j, table in enumerate(self.tables[n_words]) for k in table.get(fp >> 8 * j & 255, ())}
        return {k for k in found if (self.fps[k] ^ fp).bit_count() <= radius}

    def search(self, words: np.ndarray, by_size: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict[int, tuple[float, int, int]]:
        """Best (similarity, first word, words) of each item found. ``by_size``: shingles and hits by shingle length."""
        best: dict[int, tuple[float, int, int]] = {}
        # Where shingles of items of each length lie.
        places: dict[int, list[int]] = defaultdict(list)
        for h, hit in by_size.values():
            at = np.flatnonzero(hit)
            for p, value in zip(at.tolist(), h[at].tolist()):
                for n_words in self.owners[value]:
                    places[n_words].append(p)
        for n_words, found in places.items():
            s = min(n_words, self.size)
            h, _ = by_size[s]
            width = min(n_words, len(words))
            n_item, n = n_words - s + 1, width - s + 1
            need = self.threshold * (n_item + n) / (1 + self.threshold) - 1e-9
            if len(found) < need or n < need:
                continue
            at = np.array(found)
            # Only windows from the first to the last such shingle can hold enough of them.
            lo, hi = max(int(at[0]) - n + 1, 0), min(int(at[-1]) + n, len(h))
            own = np.zeros(hi - lo + 1, np.int64)
            own[at - lo + 1] = 1
            sums = np.cumsum(own)
            starts = np.flatnonzero(sums[n:] - sums[:-n] >= need) + lo
            if not len(starts):
                continue
            bits = np.unpackbits(h[lo:hi].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits, axis=0, dtype=np.int32)))
            again = next_repeat(h[lo:hi])
            for start in starts.tolist():
                if again[start - lo] < start + n - lo:
                    near = self.by_words[n_words]
                else:
                    count = ones[start + n - lo] - ones[start - lo]
                    fp = int(np.packbits(2 * count > n).view(">u8")[0])
                    near = self.candidates(n_words, fp) | self.repeating.get(n_words, set())
                for k in near:
                    sim = similarity(self.shingles[k], h[start : start + n])
                    if sim >= self.threshold - 1e-12 and (k not in best or sim > best[k][0]):
                        best[k] = (sim, start, width)
        return best


def build_index(rows: list[tuple], size: int, threshold: float) -> ItemIndex:
    index = ItemIndex(size, threshold)
    if rows:
        words, counts = word_hashes(pa.array([t or "" for _, t in rows], pa.string()))
        at = 0
        for (item, _), n in zip(rows, counts.tolist()):
            if n:
                index.add(item, words[at : at + n])
            at += n
    return index.seal()


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words: the best window of each document and item."""
    base = pick(docs, id_col, text_col)
    schema = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    found = []
    for shared, last in _indexes(docs.sparkSession, benchmark, item_col, item_text_col, words, threshold, block_bytes):
        found.append(base.mapInArrow(_scan(shared), schema))
        if not last:
            found[-1] = materialise(found[-1], "leaks")
            shared.destroy()
    return reduce(DataFrame.unionByName, found)


def drop_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    block_bytes: int = 16 << 20,
) -> DataFrame:
    """The rows of docs, with all their columns, without any window like an item. Nothing is shuffled."""
    for shared, last in _indexes(docs.sparkSession, benchmark, item_col, item_text_col, words, threshold, block_bytes):
        docs = docs.mapInArrow(_keep(shared, text_col), docs.schema)
        if not last:
            docs = materialise(docs, "not-leaked")
            shared.destroy()
    return docs


def _indexes(spark, benchmark: DataFrame, item_col: str, item_text_col: str, words: int, threshold: float, block_bytes: int) -> Iterator[tuple]:
    """Broadcast indexes of blocks of items, each made when it is asked for, and whether it is the last."""
    bounded_batches(spark)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    total = int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield spark.sparkContext.broadcast(build_index(sorted(map(tuple, rows), key=str), words, threshold)), block == blocks - 1


def _found(index: ItemIndex, texts: pa.Array) -> Iterator[tuple[int, dict[int, tuple[float, int, int]]]]:
    """Places of texts with any shingle of an item, and the items found there."""
    flat, counts = word_hashes(texts)
    stops = np.cumsum(counts)
    marks = {}
    for s in index.sizes:
        if len(flat) >= s:
            h = shingle(flat, s)
            marks[s] = h, index.hits(h, s)
    any_hit = np.zeros(len(counts), bool)
    for _, hit in marks.values():
        any_hit[np.searchsorted(stops, np.flatnonzero(hit), side="right")] = True
    for k in np.flatnonzero(any_hit).tolist():
        lo, hi = int(stops[k] - counts[k]), int(stops[k])
        own = {s: (h[lo : hi - s + 1], hit[lo : hi - s + 1]) for s, (h, hit) in marks.items() if hi - lo >= s}
        yield k, index.search(flat[lo:hi], own)


def _keep(shared, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pc.fill_null(b.column(text_col).cast(pa.string()), "")
            stay = np.ones(b.num_rows, bool)
            for k, items in _found(shared.value, texts):
                stay[k] = not items
            yield b.filter(pa.array(stay))

    return run


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            ids = b.column("doc_id").to_pylist()
            for k, items in _found(index, b.column("text")):
                for item, (sim, start, n) in sorted(items.items()):
                    for col, v in zip(out, (ids[k], index.ids[item], sim, start, n)):
                        col.append(v)
            types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "item_id", "similarity", "first_word", "n_words"])

    return run
