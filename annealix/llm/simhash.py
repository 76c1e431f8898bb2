"""SimHash near-duplicates by anchor-point covering (operator 3).

Anchors are pairs of codewords of the binary Golay code of length 23, one for
each of two 23-bit blocks of a fingerprint. The code is perfect with covering
radius 3: every block lies within 3 bits of exactly one codeword, so a
fingerprint has one home anchor. If two fingerprints differ in d1 and d2 bits
of the two blocks, d1 + d2 <= threshold, then the second lies within 3 + d1
and 3 + d2 bits of the first one's home. Each fingerprint is therefore
replicated to all anchors within the covering radius plus a share of the
threshold, and a home meets every fingerprint within the threshold at its own
anchor: no link is lost and none is found twice.

Distinct fingerprints alone are compared, so copies cost nothing. With 2**24
anchors a home meets few strangers even among billions of fingerprints.

Words are split at ASCII white space and A-Z is lower-cased; shingles are
``words`` words (a shorter text is one shingle). A text without words has
fingerprint zero. Null text: empty. Repeated rows share a component. Null ids
stay and never name a component; a component of null ids alone has a null id.
Empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, key_of, materialise, pick, with_texts
from .components import connected_components
from .hashing import mix, shingle, word_hashes
from .hashing import simhash as _simhash

_LENGTH, _RADIUS = 23, 3
#: Generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
_GENERATOR = 0b110001110101


def _remainder(v: np.ndarray) -> np.ndarray:
    """Syndrome of 23-bit words: the remainder by the generator polynomial."""
    v = v.copy()
    for bit in range(_LENGTH - 1, 10, -1):
        v ^= np.where(v >> bit & 1, _GENERATOR << (bit - 11), 0)
    return v


@lru_cache(maxsize=4)
def cosets(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error words up to weight 3 + threshold, and their weight beyond 3 (large where padded)."""
    errors = [sum(1 << i for i in c) for w in range(_RADIUS + threshold + 1) for c in combinations(range(_LENGTH), w)]
    errors = np.array(errors, np.int64)
    over = np.maximum(np.array([bin(e).count("1") for e in errors]) - _RADIUS, 0)
    syndrome = _remainder(errors)
    order = np.lexsort((over, syndrome))
    errors, over, syndrome = errors[order], over[order], syndrome[order]
    count = np.bincount(syndrome, minlength=2048)
    column = np.arange(len(errors)) - np.repeat(np.cumsum(count) - count, count)
    table = np.zeros((2048, count.max()), np.int64)
    extra = np.full((2048, count.max()), 99, np.int8)
    table[syndrome, column], extra[syndrome, column] = errors, over
    return table, extra


def _blocks(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return fp & 0x7FFFFF, fp >> 23 & 0x7FFFFF


def home(fp: np.ndarray) -> np.ndarray:
    """The anchor nearest to each fingerprint."""
    table, _ = cosets(0)
    a, b = (x ^ table[_remainder(x), 0] for x in _blocks(fp))
    return a << 23 | b


def replicas(fp: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors of all anchors within reach."""
    table, extra = cosets(threshold)
    a, b = _blocks(fp)
    sa, sb = _remainder(a), _remainder(b)
    row, i, j = np.nonzero(extra[sa][:, :, None] + extra[sb][:, None, :] <= threshold)
    return row, (a[row] ^ table[sa[row], i]) << 23 | (b[row] ^ table[sb[row], j])


def fingerprint(texts: list[bytes], words: int = 3) -> np.ndarray:
    """64-bit SimHash of each text (UTF-8) as signed integers."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    out = np.zeros(len(texts), ">u8")
    for k, text in enumerate(texts):
        split = text.lower().split()
        if not split:
            continue
        if len(split) <= words:
            h = [digest(b" ".join(split), 42)]
        else:
            line = b" ".join(split)
            stops = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
            starts = np.concatenate(([0], stops[: -words] + 1)).tolist()
            h = [digest(line[a:b], 42) for a, b in zip(starts, stops[words - 1 :].tolist())]
        ones = np.zeros(64, np.int64)
        h = np.array(h, np.uint64).astype(">u8")
        for at in range(0, len(h), 1 << 15):
            ones += np.unpackbits(h[at : at + (1 << 15)].view(np.uint8).reshape(-1, 64 // 8), axis=1).sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(h)).view(">u8")[0]
    return out.astype(np.uint64).view(np.int64)


def fingerprints(rows: DataFrame, *, words: int = 3) -> DataFrame:
    """doc_id, fp (long), of rows with doc_id and text."""
    bounded_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = fingerprint([t.as_buffer().to_pybytes() for t in b.column("text")], words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return rows.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def links(fps: DataFrame, threshold: int = 2) -> DataFrame:
    """a, b: pairs of distinct fingerprints (a < b) that differ in up to ``threshold`` bits. ``fps`` has distinct ``fp``.

    Spark takes the replicas, about 60 for a fingerprint at two bits, to be as
    few as the fingerprints, and so would broadcast them; the hint forbids it.
    """

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("fp"), pa.array(home(b.column("fp").to_numpy()))], ["a", "anchor"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column("fp").to_numpy()
            row, anchor = replicas(fp, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(anchor)], ["b", "anchor"])

    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= threshold
    homes = fps.select("fp").mapInArrow(at_home, "a long, anchor long")
    spreads = fps.select("fp").mapInArrow(spread, "b long, anchor long")
    return homes.hint("merge").alias("h").join(spreads.alias("s"), (F.col("h.anchor") == F.col("s.anchor")) & (F.col("a") < F.col("b")) & near).select("a", "b")


def _components(rows: DataFrame, threshold: int) -> DataFrame:
    """fp, named (least doc_id of the component), n_links for the fingerprints of rows."""
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    pairs = materialise(links(distinct, threshold), "fingerprint-links")
    parts = connected_components(pairs)
    degree = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).groupBy("fp").agg(F.count("*").alias("n_links"))
    labelled = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = labelled.groupBy("component").agg(F.min("least").alias("named"))
    return labelled.join(named, "component").join(degree, "fp", "left").select("fp", "named", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, threshold: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable), n_links (fingerprints linked to it)."""
    rows = materialise(fingerprints(pick(docs, id_col, text_col), words=words), "fingerprints")
    by_fp = _components(rows, threshold)
    return rows.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("named").alias("component_id"), "n_links")


def _samples(texts: DataFrame, words: int, samples: int, size: int) -> DataFrame:
    """tk, k, fp: SimHash of the whole text (k = -1) and of ``samples`` min-wise samples of ``size`` shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, samples + 1, dtype=np.uint64))
        for b in batches:
            flat, counts = word_hashes(b.column("text"))
            out: list[list] = [[], [], []]
            at = 0
            for tk, n_words in zip(b.column("tk").to_pylist(), counts.tolist()):
                h = shingle(flat[at : at + n_words], words)
                at += n_words
                fps = [_simhash(h) if len(h) else 0]
                if len(h):
                    u = np.unique(h)
                    for salt in salts:
                        ranked = mix(u ^ salt)
                        fps.append(_simhash(ranked if len(u) <= size else np.partition(ranked, size - 1)[:size]))
                out[0] += [tk] * len(fps)
                out[1] += range(-1, len(fps) - 1)
                out[2] += fps
            types = [pa.int64(), pa.int32(), pa.uint64()]
            cols = [pa.array(c, t) for c, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays([*cols[:2], cols[2].view(pa.int64())], ["tk", "k", "fp"])

    return texts.select("tk", "text").mapInArrow(run, "tk long, k int, fp long")


def _alike(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of shingles; two empty sets are alike."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def similar_texts(texts: DataFrame, *, words: int = 5, similarity: float = 0.8, threshold: int = 2, samples: int = 20, size: int = 3, rare: int = 64) -> DataFrame:
    """a, b: verified links between texts (tk, text; equal texts have equal tk) of Jaccard ``similarity`` or more.

    Texts that are 80 % alike differ in a dozen bits of their SimHash, and the
    anchors within such a distance are too many to visit. So fingerprints are
    also taken of min-wise samples: two texts have the same sample with
    probability similarity ** size, and all of ``samples`` fail to agree with
    probability (1 - similarity ** size) ** samples, under 1e-6 at the least
    similarity. Fingerprints of whole texts are linked by anchors at
    ``threshold`` bits, those of samples where they are equal. In a group of
    equal fingerprints each text is compared with the first and the last of an
    order, so a group of any size has two candidates a text. A first round takes
    two orders, which join most of a group; a second takes another order for
    every sample, so that a text meets many of its like, and leaves out pairs
    that are in one component already. Groups that are still in several
    components then go to ``_across``, which is exact: of two like texts that
    share a sample none misses the other's component.
    """
    bounded_batches(texts.sparkSession)
    sigs = materialise(_samples(texts, words, samples, size), "samples")
    first = None
    for orders in (2, samples + 1):
        place = F.struct(F.xxhash64("tk", F.col("k") % orders).alias("h"), "tk")
        ends = materialise(sigs.groupBy("k", "fp").agg(F.min(place).alias("low"), F.max(place).alias("high")), "sample-ends")
        shared = ends.where(F.col("low.tk") != F.col("high.tk"))
        met = sigs.join(shared, ["k", "fp"])
        if first is None:
            # Only samples that another text has too are needed again.
            met = materialise(met, "shared-samples")
            sigs = met.select("tk", "k", "fp")
        pairs = met.select("tk", F.explode(F.array("low.tk", "high.tk")).alias("end"))
        if first is None:
            whole = ends.where("k = -1").select("fp", F.col("low.tk").alias("tk"))
            near = links(whole.select("fp"), threshold).join(whole.toDF("a", "tk"), "a").join(whole.toDF("b", "end"), "b").select("tk", "end")
            pairs = pairs.unionByName(near)
        pairs = pairs.where(F.col("tk") != F.col("end")).select(F.least("tk", "end").alias("a"), F.greatest("tk", "end").alias("b")).distinct()
        if first is not None:
            # Texts that are in one component already need no further link.
            parts = connected_components(first)
            pairs = pairs.join(parts.toDF("a", "part_a"), "a", "left").join(parts.toDF("b", "part_b"), "b", "left")
            pairs = pairs.where(F.coalesce(F.col("part_a") != F.col("part_b"), F.lit(True))).select("a", "b")
        good = materialise(_verified(materialise(pairs, "candidate-pairs"), texts, words, similarity), "similar-pairs")
        first = good if first is None else first.unionByName(good)
    parts = connected_components(first).toDF("tk", "part")
    placed = materialise(sigs.join(parts, "tk", "left").withColumn("part", F.coalesce("part", "tk")), "sample-parts")
    torn = placed.groupBy("k", "fp").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
    apart = materialise(placed.join(torn, ["k", "fp"], "left_semi").select("tk", "part").distinct(), "texts-apart")
    found, linked = _across(apart, texts, words, similarity, rare)
    more = materialise(_verified(materialise(found, "candidate-pairs"), texts, words, similarity), "similar-pairs")
    return first.unionByName(more).unionByName(materialise(linked, "class-links"))


def _shingles(texts: DataFrame, words: int) -> DataFrame:
    """tk, n (number of different shingles), h (each of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, counts = word_hashes(b.column("text"))
            at = 0
            for tk, n_words in zip(b.column("tk").to_pylist(), counts.tolist()):
                h = np.unique(shingle(flat[at : at + n_words], words)).view(np.int64)
                at += n_words
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), tk, np.int64)), pa.array(np.full(len(h), len(h), np.int64)), pa.array(h)], ["tk", "n", "h"])

    return texts.select("tk", "text").mapInArrow(run, "tk long, n long, h long")


def _across(apart: DataFrame, texts: DataFrame, words: int, similarity: float, rare: int) -> tuple[DataFrame, DataFrame]:
    """Two tables a, b, candidates and links, that join all components (part) of texts (tk) with a like pair between them. No list is cut.

    Shingles are ordered by the number of texts that have them, those of one
    component alone first. Two like texts of different components share one
    among the first n - ceil(similarity * n) + 1 of both (prefix filter); a text
    without a shared shingle there is left out. If the first shared one is
    rare (in up to ``rare`` texts), a join on it finds the pair. Else the two
    share frequent shingles only, such as those of a common passage. Texts of
    equal frequent shingles are a class; the fewer others a text has, the more
    like it is to each of its class or of another, so if two texts are alike,
    so are each of them and the text of the fewest others in the other's class.
    Only that text of a class need be a candidate, and the joins on frequent
    shingles are between classes; what the classes share is what the texts share,
    so links are told without reading texts again.
    """
    rows = with_texts(texts, apart.select("tk")).select("tk", "text")
    held = _shingles(rows, words).join(apart, "tk")
    need = F.ceil(similarity * F.col("n") - 1e-9)
    for _ in range(2):  # texts that go may leave others without a shared shingle
        held = materialise(held.select("tk", "part", "n", "h"), "shingles-apart")
        live = held.groupBy("h").agg(F.count("*").alias("df"), F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("h", "df")
        held = materialise(held.join(live, "h"), "shingles-shared")
        stay = held.groupBy("tk").agg(F.count("*").alias("n_live"), F.first("n").alias("n")).where(F.col("n_live") >= need).select("tk", "n_live")
        held = held.join(stay, "tk")
    by_text = Window.partitionBy("tk").orderBy("df", "h")
    frequent = F.col("df") > rare
    held = materialise(held.withColumn("place", F.row_number().over(by_text)), "shingles-shared")
    first = materialise(held.where(F.col("place") <= F.col("n_live") - need + 1), "shingle-prefixes")

    one = first.where(~frequent).select("h", "tk", "part", "n")
    like = (F.col("n_a") >= similarity * F.col("n_b") - 1e-9) & (F.col("n_b") >= similarity * F.col("n_a") - 1e-9)
    met = one.toDF("h", "a", "part_a", "n_a").join(one.toDF("h", "b", "part_b", "n_b"), "h").where((F.col("a") < F.col("b")) & (F.col("part_a") != F.col("part_b")) & like)
    found = met.select("a", "b").distinct()

    sets = held.where(frequent).groupBy("tk", "part", "n").agg(F.count("*").alias("f"), F.bit_xor(F.xxhash64("h")).alias("x"), F.bit_xor(F.xxhash64("h", F.lit(1))).alias("y"))
    sets = sets.where(F.col("f") >= need).select("tk", "part", "f", (F.col("n") - F.col("f")).alias("r"), F.xxhash64("f", "x", "y").alias("cls"))
    members = materialise(sets, "shingle-classes")
    classes = members.groupBy("cls").agg(F.first("f").alias("f"), F.min(F.struct("r", "tk", "part")).alias("best"), F.min("part").alias("low"), F.max("part").alias("high"))
    classes = materialise(classes.select("cls", "f", F.col("best.r").alias("r"), F.col("best.tk").alias("tk"), "best.part", "low", "high"), "shingle-classes")
    # Which classes meet, each with itself included; u is at least the greater f, what is shared at most the lesser.
    room = lambda r, q: F.least("f_a", "f_b") / similarity - F.greatest("f_a", "f_b") - F.col(r) - F.col(q) >= -1e-6
    # A pair is made at its first shared shingle alone, and only if what comes behind it on both sides is enough.
    heads = first.where(frequent).join(classes, "tk").withColumn("at", F.col("place") - (F.col("n_live") - F.col("f")))
    heads = heads.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("place", "h"))).alias("hs"), F.collect_list(F.struct("h", "at")).alias("each"), *[F.first(c).alias(c) for c in ("f", "r", "low", "high")])
    keyed = heads.select(F.transform("hs", lambda x: x["h"]).alias("hs"), F.explode("each").alias("e"), "cls", "f", "r", "low", "high").select("e.h", "e.at", "hs", "cls", "f", "r", "low", "high")
    sides = [keyed.toDF("h", *[f"{c}_{x}" for c in ("at", "hs", "cls", "f", "r", "low", "high")]) for x in "ab"]
    behind = 1 + F.least(F.col("f_a") - F.col("at_a"), F.col("f_b") - F.col("at_b")) >= similarity / (1 + similarity) * (F.col("f_a") + F.col("r_a") + F.col("f_b") + F.col("r_b")) - 1e-6
    once = F.get(F.array_intersect("hs_a", "hs_b"), F.lit(0)) == F.col("h")
    mixed = (F.least("low_a", "low_b") < F.greatest("high_a", "high_b")) & (F.col("cls_a") != F.col("cls_b"))
    meet = sides[0].join(sides[1], "h").where(mixed & room("r_a", "r_b") & behind & once).select("cls_a", "cls_b")
    meet = meet.unionByName(classes.where("low < high").select(F.col("cls").alias("cls_a"), F.col("cls").alias("cls_b")))
    # What two such texts share are the shingles their classes share, so the similarity follows without the texts.
    shared = materialise(held.where(frequent).join(classes.select("tk", "cls"), "tk").groupBy("cls").agg(F.collect_list("h").alias("fs")), "class-shingles")
    both = materialise(meet, "class-pairs").join(shared.toDF("cls_a", "fs_a"), "cls_a").join(shared.toDF("cls_b", "fs_b"), "cls_b")
    both = both.select("cls_a", "cls_b", F.size(F.array_intersect("fs_a", "fs_b")).alias("both"))
    best = classes.select(F.col("cls").alias("cls_b"), F.col("tk").alias("b"), F.col("part").alias("part_b"), (F.col("f") + F.col("r")).alias("n_b"))
    # A class pair is of use only if the texts of fewest others are alike.
    sizes = classes.select(F.col("cls").alias("cls_a"), (F.col("f") + F.col("r")).alias("n_a"))
    alike = F.col("both") / (F.col("n_a") + F.col("n_b") - F.col("both")) >= similarity
    both = both.join(sizes, "cls_a").join(best, "cls_b").where(alike).drop("n_a")
    each = members.select(F.col("cls").alias("cls_a"), F.col("tk").alias("a"), F.col("part").alias("part_a"), (F.col("f") + F.col("r")).alias("n_a"))
    led = each.join(materialise(both, "class-links"), "cls_a").where((F.col("part_a") != F.col("part_b")) & alike)
    return found, led.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The pairs whose texts are alike."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (fa, ca), (fb, cb) = word_hashes(b.column("text_a")), word_hashes(b.column("text_b"))
            ea, eb = np.cumsum(ca), np.cumsum(cb)
            good = [_alike(shingle(fa[za - na : za], words), shingle(fb[zb - nb : zb], words)) >= similarity for za, na, zb, nb in zip(ea.tolist(), ca.tolist(), eb.tolist(), cb.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    needed = pairs.select(F.explode(F.array("a", "b")).alias("tk")).distinct()
    one = materialise(with_texts(texts, needed).select("tk", "text"), "candidate-texts")
    both = pairs.join(one.toDF("a", "text_a"), "a").join(one.toDF("b", "text_b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(verify, "a long, b long")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, with all their columns, less all but one of each group of near copies.

    Groups are the components of ``similar_texts``; ``options`` are its own. The
    row of the least id stays (rows without id come last; of several rows with
    that id and text, any one).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    tk, number = key_of(text), F.col(id_col).cast("long")
    rows = docs.select(number.isNull().alias("none"), number.alias("id"), tk.alias("tk"))
    places = rows.groupBy("tk", "none", "id").agg(F.count("*").alias("n"))
    least = materialise(places.groupBy("tk").agg(F.min(F.struct("none", "id", "tk", "n")).alias("place")), "distinct-texts")
    pairs = similar_texts(docs.select(tk.alias("tk"), text.alias("text")), **options)
    parts = connected_components(pairs).withColumnRenamed("node", "tk")
    grouped = least.join(parts, "tk", "left").groupBy(F.coalesce("component", "tk").alias("component")).agg(F.min("place").alias("place"))
    stay = materialise(grouped.select(F.col("place.tk").alias("_stay_tk"), F.col("place.id").alias("_stay_id"), F.col("place.n").alias("_n")), "stay")
    keyed = docs.withColumns({"_tk": tk, "_id": number})
    here = (F.col("_tk") == F.col("_stay_tk")) & F.col("_id").eqNullSafe(F.col("_stay_id"))
    once = keyed.join(stay.where("_n = 1"), here, "left_semi")
    more = keyed.join(stay.where("_n > 1"), here, "left_semi").dropDuplicates(["_tk"])
    return once.unionByName(more).select(*docs.columns)
