"""Removal of long repeated byte strings by content-defined parsing (operator 10).

Every byte covered by a ``length``-byte string that also starts anywhere else
is removed. The texts are parsed by a rolling hash over ``seed`` bytes: the
trigger of a string is the place of the least hash among the first ``width`` ones
inside it (the leftmost, if several), so every string has one, equal strings have
theirs at the same place, and a trigger serves a run of consecutive strings, a
phrase. A phrase with its
context (all bytes of all strings it serves) is an entry of the dictionary, the
sequence of a text's phrases its parse.

1. Dictionary entries that occur more than once: all strings of their phrases
   are repeats. In highly repetitive text this settles nearly everything, at
   one row for about half of ``width`` bytes.
2. Entries that occur once, but whose core (the bytes that every string with
   their trigger holds) occurs elsewhere, lie at the ends of repeats. Their
   strings, and those of one phrase per repeated entry with the same core, are
   compared one by one by their hashes.
3. Entries whose core or trigger is unique hold no repeat.

Triggers also tell of passages too short to be removed: a passage of at least
``seed + width - 1`` bytes (300; about 50 words) that lies in two different texts
has a trigger that both share. ``n_shared`` counts such triggers of a text; each
is a string of ``seed`` bytes that another text has too.

Only equality of ``length``-byte prefixes is needed, so the order of suffixes
is never made: entries and strings fall into classes by 128-bit and 96-bit
hashes instead of ranks, which can be combined before the shuffle and split
however large a class is. Texts are read again only where a decision needs
them, found by a bitmap of fixed size; texts that stay or go as a whole are
never shuffled.

Null text: empty. Texts shorter than ``length`` stay. Repeated rows are copies
of each other; ``n_shared`` does not count them, as their text is the same. Ties
among hashes: the leftmost. A very long text is parsed in pieces. Null ids stay.
Only the named columns are read, so others can't clash. Empty table: empty
result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, key_of, pick, with_texts
from .common import materialise as written
from .hashing import mix

materialise = partial(written, clean=True)

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Window starts handled at once; longer texts are parsed in pieces.
_PIECE = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Hashes of any byte range of a buffer from running sums."""

    def __init__(self, room: int = 2 * _PIECE):
        self.up, self.down = _powers(_BASE, room + 1), _powers(_INVERSE, room + 1)
        self.table = mix(np.arange(1, 257, dtype=np.uint64))

    def load(self, data: np.ndarray) -> None:
        if len(data) >= len(self.up):
            self.__init__(2 * len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def runs(self, n: int) -> np.ndarray:
        """Hashes of all n-byte strings."""
        diff = self.sums[n:] - self.sums[:-n]
        return mix(diff * self.down[: len(diff)])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values (by prefix and suffix minima of blocks)."""
    n = len(values)
    pad = -n % width
    v = np.concatenate((values, np.full(pad, np.iinfo(values.dtype).max, values.dtype))).reshape(-1, width)
    before = np.minimum.accumulate(v, axis=1).ravel()
    after = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[: n - width + 1], before[width - 1 : n])


def phrases(hasher: Hasher, data: np.ndarray, spans: np.ndarray, length: int, seed: int, width: int) -> tuple[np.ndarray, ...]:
    """Phrases of pieces of a buffer: piece, first and last start of its strings, hashes of its trigger, context and core, whether it has strings.

    The core is what every string of ``length`` bytes with that trigger holds,
    whatever its place: ``length - width + 1`` bytes from the trigger on.

    ``spans`` has start and stop of each piece; pieces lie one behind another.
    The last starts of a piece have no string of ``length`` behind them; their
    triggers that no string has are phrases without strings.
    """
    sizes = np.maximum(spans[:, 1] - spans[:, 0] - length + 1, 0)
    reach = np.maximum(spans[:, 1] - spans[:, 0] - (seed + width - 1) + 1, 0)
    none = np.zeros(0, np.int64)
    if not reach.sum():
        return none, none, none, *[none.astype(np.uint64)] * 3, none.astype(bool)
    hasher.load(data)
    h = hasher.runs(seed)
    bits = np.uint64(max(len(data).bit_length(), 1))
    place = np.arange(len(h), dtype=np.uint64)
    least = _least((h >> bits << bits) | place, width)
    trigger = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    piece = np.repeat(np.arange(len(spans)), reach)
    within = np.arange(len(piece)) - np.repeat(np.cumsum(reach) - reach, reach)
    start = within + np.repeat(spans[:, 0], reach)
    has = within < sizes[piece]
    trigger = trigger[start]
    same = (trigger[1:] == trigger[:-1]) & (piece[1:] == piece[:-1])
    new = np.ones(len(piece), bool)
    new[1:] = ~same | (has[1:] != has[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(piece)) - 1
    again = np.concatenate(([False], same))[first] & ~has[first]  # the string before had this trigger
    first, last = first[~again], last[~again]
    lo, hi, at, has = start[first], start[last], trigger[first], has[first]
    context = hasher.of(lo, np.where(has, hi + length, lo)) ^ mix(((hi - lo) << 20 | (at - lo)).astype(np.uint64))
    core = hasher.of(at, np.where(has, at + length - width + 1, at))
    return piece[first], lo, hi, h[at], *(np.where(has, x, np.uint64(0)) for x in (context, core)), has


def _groups(offsets: np.ndarray, length: int, least: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of texts (text, start, stop) of ``least`` bytes or more, in groups of up to about ``most`` bytes, or of one piece."""
    text, start, stop, total = [], [], [], 0
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
        for at in range(a, max(b - least + 1, a), most):
            end = min(at + most + length - 1, b)
            if total + end - at > most and total:
                yield np.array(text), np.array(start), np.array(stop)
                text, start, stop, total = [], [], [], 0
            text.append(k)
            start.append(at)
            stop.append(end)
            total += end - at
    if text:
        yield np.array(text), np.array(start), np.array(stop)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text begins."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def parse(texts: DataFrame, length: int, seed: int, width: int, piece_bytes: int = _PIECE) -> DataFrame:
    """tk, lo, hi, seed, ctx, core: one row per phrase; lo and hi are -1 if it has no strings. ``texts`` has tk and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            tk = b.column("tk").to_numpy()
            data, offsets = _bytes_of(b.column("text"))
            for text, start, stop in _groups(offsets, length, seed + width - 1, piece_bytes):
                shift = np.cumsum(stop - start) - (stop - start)
                buffer = np.concatenate([data[a:z] for a, z in zip(start.tolist(), stop.tolist())])
                piece, lo, hi, s, c, k, has = phrases(hasher, buffer, np.stack((shift, shift + stop - start), axis=1), length, seed, width)
                if len(piece):
                    move = (start - shift - offsets[text])[piece]
                    lo, hi = (np.where(has, x + move, -1).astype(np.int32) for x in (lo, hi))
                    yield pa.RecordBatch.from_arrays([pa.array(tk[text[piece]]), pa.array(lo), pa.array(hi), *(pa.array(x.view(np.int64)) for x in (s, c, k))], ["tk", "lo", "hi", "seed", "ctx", "core"])

    return texts.select("tk", "text").mapInArrow(run, "tk long, lo int, hi int, seed long, ctx long, core long")


def _strings(units: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """tk, at, hash, tag (of the trigger), once: one row per string of the given phrases."""
    per_text = units.groupBy("tk").agg(F.collect_list(F.struct("lo", "hi", "seed", "once")).alias("units"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            for tk, text, us in zip(b.column("tk").to_pylist(), b.column("text"), b.column("units").to_pylist()):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                us.sort(key=lambda u: u["lo"])
                for u in us:
                    lo, hi = u["lo"], u["hi"]
                    hasher.load(data[lo : hi + length])
                    h = hasher.runs(length)
                    n = len(h)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, tk)), pa.array(np.arange(lo, hi + 1, dtype=np.int32)), pa.array(h.view(np.int64)), pa.array(np.full(n, u["seed"] >> 32, np.int32)), pa.array(np.full(n, u["once"], bool))], ["tk", "at", "hash", "tag", "once"]
                    )

    rows = with_texts(texts, per_text).select("tk", "text", "units")
    return rows.mapInArrow(run, "tk long, at int, hash long, tag int, once boolean")


def repeated_ranges(texts: DataFrame, *, length: int = 400, seed: int = 150, width: int = 151, piece_bytes: int = _PIECE) -> tuple[DataFrame, DataFrame]:
    """Of texts that have any: tk, ranges: array<struct<lo, hi, mask>>, starts of repeated strings; and tk, n_shared.

    With mask 0 all starts from lo to hi are meant, else lo plus the places of its bits.
    """
    units = materialise(parse(texts, length, seed, width, piece_bytes), "phrases")
    # Written first, so that the join reads both sides from a shuffle and AQE can split a frequent trigger.
    seeds = materialise(units.groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("seed"), "shared-triggers")
    # Entries are named by a hash of both, so that a frequent trigger's rows are combined before they meet.
    # Written, as two steps read them: all phrases are shuffled by trigger once.
    live = materialise(units.join(seeds, "seed", "left_semi").withColumn("entry", F.xxhash64("seed", "ctx")), "live-phrases")
    discard(units)
    entries = materialise(live.groupBy("entry", "ctx").agg(F.first("seed").alias("seed"), F.first("core").alias("core"), F.count("*").alias("n"), F.min(F.struct("tk", "lo")).alias("one"), F.max("tk").alias("last")), "entries")
    ends = materialise(entries.groupBy("seed").agg((F.min("one.tk") < F.max("last")).alias("across")), "triggers")
    # Strings can be equal only if their cores are: entries whose core no other one has need no comparison.
    met = materialise(entries.groupBy("seed", "core").agg(F.min("n").alias("fewest"), F.count("*").alias("m")).where((F.col("fewest") == 1) & (F.col("m") > 1)).select("seed", "core", F.lit(True).alias("open")), "open-cores")
    known = entries.join(ends, "seed").join(met, ["seed", "core"], "left").select("entry", "ctx", "n", "one", F.coalesce("open", F.lit(False)).alias("open"), "across")
    status = live.join(known, ["entry", "ctx"]).select("tk", "lo", "hi", "seed", (F.col("n") == 1).alias("once"), "open", (F.struct("tk", "lo") == F.col("one")).alias("first"), "across")
    status = materialise(status, "phrase-status")
    for table in (seeds, live, entries, ends, met):
        discard(table)
    shared = materialise(status.where("across").select("tk", "seed").distinct().groupBy("tk").agg(F.count("*").alias("n_shared")), "shared-passages")
    strung = status.where("lo >= 0")
    compared = strung.where(F.col("open") & (F.col("once") | F.col("first"))).select("tk", "lo", "hi", "seed", "once").distinct()
    strings = materialise(_strings(compared, texts, length), "strings")
    whole = materialise(strung.where(~F.col("once")).select("tk", "lo", "hi", F.lit(0).cast("long").alias("mask")).distinct(), "repeated-phrases")
    discard(status)
    twice = materialise(strings.groupBy("hash", "tag").agg(F.sum(F.when(F.col("once"), 1).otherwise(2)).alias("n")).where(F.col("n") > 1).select("hash", "tag"), "repeated-strings")
    # Starts are put together, 64 to a number, before a text's are gathered.
    block = (F.col("at") - F.col("at") % 64).alias("lo")
    marks = strings.where("once").join(twice, ["hash", "tag"], "left_semi").groupBy("tk", block).agg(F.bit_or(F.expr("shiftleft(1L, at % 64)")).alias("mask"))
    both = whole.unionByName(marks.select("tk", "lo", (F.col("lo") + 63).alias("hi"), "mask"))
    ranges = materialise(both.groupBy("tk").agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "mask"))).alias("ranges")), "ranges")
    for table in (strings, twice, whole):
        discard(table)
    return ranges, shared


def runs_of(ranges: list[dict]) -> list[tuple[int, int]]:
    """First and last start of every run in rows of ``repeated_ranges``, by first start; runs may overlap."""
    out = []
    for r in ranges:
        lo, mask = r["lo"], r["mask"] & (1 << 64) - 1
        if not mask:
            out.append((lo, r["hi"]))
        while mask:
            skip = (mask & -mask).bit_length() - 1
            mask >>= skip
            n = (~mask & mask + 1).bit_length() - 1
            out.append((lo + skip, lo + skip + n - 1))
            lo, mask = lo + skip + n, mask >> n
    return sorted(out)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, seed: int = 150, piece_bytes: int = _PIECE, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared and, with ``keep_text``, kept (binary)."""
    if not 0 < seed < length:
        raise ValueError("seed must lie between 0 and length")
    width = min(seed + 1, length - seed + 1)
    bounded_batches(docs.sparkSession)
    texts = pick(docs, id_col, text_col).withColumn("tk", key_of(F.col("text")))
    long = texts.where(F.octet_length("text") >= seed + width - 1)
    ranges, shared = repeated_ranges(long, length=length, seed=seed, width=width, piece_bytes=piece_bytes)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ranges of starts become spans of bytes, joined where they touch."""
        for b in batches:
            starts, stops, removed = [], [], []
            for rs in b.column("ranges").to_pylist():
                spans: list[list[int]] = []
                for lo, hi in runs_of(rs):
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi + length)
                    else:
                        spans.append([lo, hi + length])
                starts.append([s[0] for s in spans])
                stops.append([s[1] for s in spans])
                removed.append(sum(z - a for a, z in spans))
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("tk"), pa.array(starts, ints), pa.array(stops, ints), pa.array(removed, pa.int64())], ["tk", "starts", "stops", "n_removed"])

    spans = materialise(ranges.mapInArrow(merge, "tk long, starts array<int>, stops array<int>, n_removed long"), "spans")
    none = hashlib.sha256(b"").hexdigest()
    kept_type = ", kept binary" if keep_text else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shas, kepts = [], []
            for text, starts, stops in zip(b.column("text"), b.column("starts").to_pylist(), b.column("stops").to_pylist()):
                raw = text.as_buffer().to_pybytes()
                kept = b"".join(raw[a:z] for a, z in zip([0, *stops], [*starts, len(raw)]))
                shas.append(hashlib.sha256(kept).hexdigest())
                kepts.append(kept)
            cols, names = [b.column("tk"), pa.array(shas, pa.string())], ["tk", "sha"]
            if keep_text:
                cols, names = [*cols, pa.array(kepts, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    rows = texts.select("doc_id", "tk", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("own"), *([F.col("text").cast("binary").alias("own_text")] if keep_text else []))
    lengths = long.select("tk", F.octet_length("text").alias("n_bytes")).distinct()
    partial = spans.join(lengths, "tk").where(F.col("n_removed") < F.col("n_bytes")).select("tk", "starts", "stops")
    cuts = with_texts(long, partial).select("tk", "text", "starts", "stops").mapInArrow(cut, "tk long, sha string" + kept_type)
    # Written first, so that AQE can split a text with many copies in the join below.
    found = materialise(spans.select("tk", "n_removed", F.size("starts").cast("long").alias("n_spans")).join(cuts, "tk", "left").join(shared, "tk", "full"), "cut-texts")
    out = rows.join(found, "tk", "left")
    zero = F.lit(0).cast("long")
    sha = F.when(F.col("n_removed").isNull(), F.col("own")).otherwise(F.coalesce("sha", F.lit(none)))
    kept = [F.when(F.col("n_removed").isNull(), F.col("own_text")).otherwise(F.coalesce("kept", F.lit("").cast("binary"))).alias("kept")] if keep_text else []
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), sha.alias("kept_sha256"), F.coalesce("n_shared", zero).alias("n_shared"), *kept)
