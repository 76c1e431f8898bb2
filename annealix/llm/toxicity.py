"""Toxicity by nearest labelled examples under exact TF-IDF cosine (operator 6).

``fit`` takes a bounded sample of labelled rows (``max_examples``, the rows with
the least hash of their id) and makes a TF-IDF vector of every example. All
terms of the sample stay. Plain TF-IDF finds texts of like topic rather than
toxic ones (README), so the weight of a term is its TF-IDF times its relevance,
the likelihood-ratio statistic of term and label (``FLOOR`` at least), counted
over one example of each group of near copies. Examples of
equal vectors are one entry with their numbers. Entries are sorted by their
heaviest terms and cut into blocks; per term and block the index keeps the
largest weight.

``score`` looks up every whole text: the bounds of all blocks follow from the
block maxima, the blocks of highest bound are opened first, then all whose
bound reaches the k-th best similarity found, so the nearest examples are
exact (ties included). Votes weighted by similarity, with a weak prior, are
calibrated by an isotonic fit to the examples' own votes without themselves.

Held-out rows (crc32 of the id modulo 5 is 0) are never examples. Scores depend
on the text alone. Null and empty texts get the score of texts without known
terms. Null labels and labels of absent documents are ignored; repeated labels
of a document count as their largest. Repeated rows and ids: one result each.
A very long text is read whole, as one vector. Only the named columns are read
(``reject`` hands the others on), so other names can't clash. With no labels at
all every score is 0. Empty table: empty result.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, file_system, pick, scratch

_TERM = re.compile(r"[^\W\d_]+")
#: Least relevance of a term.
FLOOR = 0.0025
#: Terms in more than one entry of so many have a row of the matrix.
DENSE = 16


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _ranges(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after another."""
    size = stop - start
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)


@dataclass
class Index:
    """Block-max inverted index over example vectors; a few arrays, bounded by the sample.

    ``weights`` has the weight of each term. A vector is a pair of arrays, terms
    and their weights in a unit vector. The first terms (``terms`` are numbered by
    falling frequency) that lie in more than one entry of ``DENSE`` have their
    postings as rows of a matrix, the others as lists.
    """

    terms: dict[str, int]
    weights: np.ndarray
    prior: float
    k: int
    pull: float
    block: int = 256
    known: list[float] = field(default_factory=list)
    mapped: list[float] = field(default_factory=list)

    def vector(self, tf: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """Unit vector of the known terms of a text, their counts damped by the logarithm."""
        t = np.fromiter(map(self.terms.get, tf, repeat(-1)), np.int64, len(tf))
        c = np.fromiter(tf.values(), np.float64, len(tf))
        by_id = np.argsort(t)[int((t < 0).sum()) :]
        t = t[by_id]
        w = (1 + np.log(c[by_id])) * self.weights[t]
        return t, w / (math.sqrt(float(w @ w)) or 1.0)

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]], counts: list[int], toxic: list[int], ids: list[list[int]]) -> Index:
        def heaviest(i: int) -> tuple:
            t, w = vectors[i]
            top = np.lexsort((t, -w))[:4]
            return tuple(t[top].tolist()), len(t), t.tobytes(), w.tobytes()

        self.order = order = sorted(range(len(vectors)), key=heaviest)
        self.n = np.array([counts[i] for i in order], np.int64)
        self.toxic = np.array([toxic[i] for i in order], np.int64)
        self.ids = [ids[i] for i in order]
        self.n_blocks = -(-len(order) // self.block)
        sizes = np.array([len(vectors[i][0]) for i in order], np.int64)
        term = np.concatenate([np.zeros(0, np.int64), *(vectors[i][0] for i in order)])
        weight = np.concatenate([np.zeros(0), *(vectors[i][1] for i in order)])
        entry = np.repeat(np.arange(len(order)), sizes)
        df = np.bincount(term, minlength=len(self.weights))
        often = df * DENSE > len(order)
        self.often = len(df) if often.all() else int(np.argmin(often))
        self.dense = np.zeros((self.often, self.n_blocks * self.block))
        dense = term < self.often
        self.dense[term[dense], entry[dense]] = weight[dense]
        self.dense_max = self.dense.reshape(self.often, self.n_blocks, self.block).max(axis=2) if self.n_blocks else np.zeros((self.often, 0))
        term, entry, weight = term[~dense], entry[~dense], weight[~dense]
        by_term = np.lexsort((entry, term))
        term, self.entry, self.weight = term[by_term], entry[by_term], weight[by_term]
        # A cell is a term's part of one block.
        first = np.ones(len(term), bool)
        first[1:] = (term[1:] != term[:-1]) | (self.entry[1:] // self.block != self.entry[:-1] // self.block)
        at = np.flatnonzero(first)
        self.cells = np.append(at, len(term))
        self.cell_block = self.entry[at] // self.block
        self.cell_max = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.of_term = np.searchsorted(term[at], np.arange(len(self.weights) + 1))
        return self

    def starts(self, vectors: list[tuple[np.ndarray, np.ndarray]], at_once: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """What the matrix adds to each vector's similarities and bounds, for many vectors by one product."""
        for lo in range(0, len(vectors), at_once):
            part = vectors[lo : lo + at_once]
            q = np.zeros((len(part), self.often))
            for row, (t, w) in zip(q, part):
                many = int(np.searchsorted(t, self.often))
                row[t[:many]] = w[:many]
            yield from zip(q @ self.dense, q @ self.dense_max)

    def nearest(self, v: tuple[np.ndarray, np.ndarray], less: int = -1, begun: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Entries and similarities of the k nearest examples, ties included, best first.

        ``less`` is an entry with one example less, ``begun`` what ``starts`` gives.
        """
        t, q = v
        base, dense_bound = begun or next(self.starts([v]))
        many = int(np.searchsorted(t, self.often))
        start, stop = self.of_term[t[many:]], self.of_term[t[many:] + 1]
        cells, rest = _ranges(start, stop), np.repeat(q[many:], stop - start)
        block = self.cell_block[cells]
        bound = dense_bound + np.bincount(block, rest * self.cell_max[cells], self.n_blocks)
        rank = np.argsort(-bound, kind="stable")
        rank = rank[bound[rank] > 0]
        sims, kth, some = np.zeros(len(base)), 0.0, 1
        while len(rank):
            opened = np.zeros(self.n_blocks, bool)
            opened[rank[:some]] = True
            held = opened[block]
            own = cells[held]
            lo, hi = self.cells[own], self.cells[own + 1]
            at = _ranges(lo, hi)
            found = base + np.bincount(self.entry[at], np.repeat(rest[held], hi - lo) * self.weight[at], len(base))
            sims = np.where(np.repeat(opened, self.block), found, sims)
            top = np.argpartition(-sims[: len(self.n)], min(self.k, len(self.n) - 1))[: self.k + 1]
            top = top[np.argsort(-sims[top], kind="stable")]
            total = np.cumsum(self.n[top] - (top == less))
            kth = float(sims[top[int(np.searchsorted(total, self.k))]]) if total[-1] >= self.k else 0.0
            rank = rank[some:]
            rank = rank[bound[rank] >= kth - 1e-9]
            some = len(rank)
        e = np.flatnonzero((sims > 0) & (sims >= kth - 1e-9))
        e = e[np.argsort(-sims[e], kind="stable")]
        return e, sims[e]

    def vote(self, v: tuple[np.ndarray, np.ndarray], less: int = -1, label: int = 0, begun=None) -> float:
        return self.vote_of(*self.nearest(v, less, begun), less, label)

    def vote_of(self, e: np.ndarray, s: np.ndarray, less: int = -1, label: int = 0) -> float:
        own = e == less
        w = s * s
        return float((w @ (self.toxic[e] - own * label) + self.pull * self.prior) / (w @ (self.n[e] - own) + self.pull))

    def calibrate(self, vectors: list[tuple[np.ndarray, np.ndarray]], most: int = 4000) -> None:
        """Isotonic regression (pool adjacent violators) of labels on votes without the example itself.

        Of the entries ``most`` at even steps take part.
        """
        points: Counter = Counter()
        good: Counter = Counter()
        taken = range(0, len(vectors), -(-len(vectors) // most) or 1)
        for e, begun in zip(taken, self.starts([vectors[self.order[e]] for e in taken])):
            i = self.order[e]
            for label, many in ((1, int(self.toxic[e])), (0, int(self.n[e] - self.toxic[e]))):
                if many:
                    p = round(self.vote(vectors[i], e, label, begun), 9)
                    points[p] += many
                    good[p] += many * label
        pools: list[list[float]] = []
        for p in sorted(points):
            pools.append([p, p, good[p], points[p]])
            while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
                last = pools.pop()
                pools[-1] = [pools[-1][0], last[1], pools[-1][2] + last[2], pools[-1][3] + last[3]]
        for low, high, g, m in pools:
            rate = (g + self.prior) / (m + 1)
            self.known += [low, high]
            self.mapped += [rate, rate]
        self.mapped = np.maximum.accumulate(np.array(self.mapped)).tolist() if self.mapped else []

    def score(self, raw: float) -> float:
        """The calibrated vote; a trace of the vote itself keeps votes of one level apart."""
        level = float(np.interp(raw, self.known, self.mapped)) if self.known else raw
        return min(max(0.98 * level + 0.02 * raw, 0.0), 1.0)


def _terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


def _signature(terms: list[str]) -> int:
    """Least hash of the runs of three terms; near copies mostly share it."""
    import xxhash

    return min((xxhash.xxh32_intdigest(" ".join(x)) for x in zip(terms, terms[1:], terms[2:])), default=-1 - xxhash.xxh32_intdigest(" ".join(terms)))


def relevance(n: int, pos: int, df: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Likelihood-ratio statistic of terms (in df texts of n, a of the pos labelled ones) and label; ``FLOOR`` at least and where a term is rarer with the label."""
    total = np.zeros(len(df))
    for seen, row, col in ((a, df, pos), (df - a, df, n - pos), (pos - a, n - df, pos), (n - df - pos + a, n - df, n - pos)):
        expected = row * (col / max(n, 1))
        some = (seen > 0) & (expected > 0)
        total[some] += seen[some] * np.log(seen[some] / expected[some])
    return np.where(a * n > df * pos, np.maximum(2 * total, FLOOR), FLOOR)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str, text_col: str, label_col: str, max_examples: int, k: int, pull: float) -> str:
    """Makes the index of a bounded sample of labelled rows; the path it is written to."""
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    usable = named.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    hashed = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    last = hashed.select("h").orderBy("h").limit(max_examples).agg(F.max("h")).first()[0]
    sample = hashed.where(F.col("h") <= last).select("doc_id", "toxic") if last is not None else hashed.select("doc_id", "toxic").limit(0)
    texts = pick(docs, id_col, text_col).join(F.broadcast(sample), "doc_id")  # at most max_examples ids

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, tfs, signs = [], [], []
            for t in b.column("text").to_pylist():
                terms = _terms(t)
                tf = sorted(Counter(terms).items())
                names.append([x for x, _ in tf])
                tfs.append([c for _, c in tf])
                signs.append(_signature(terms))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), pa.array(signs, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(tfs, pa.list_(pa.int32()))], ["doc_id", "toxic", "sign", "terms", "tf"])

    counted = texts.select("doc_id", "toxic", "text").mapInArrow(count, "doc_id long, toxic int, sign long, terms array<string>, tf array<int>")
    # Copies are one entry; a repeated id counts as often as it has rows.
    entries = counted.groupBy("terms", "tf").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"), F.min_by("toxic", "doc_id").alias("one"), F.first("sign").alias("sign"), F.slice(F.array_sort(F.collect_list("doc_id")), 1, 3).alias("ids"))
    path = scratch(docs.sparkSession, "toxicity-index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            save_index(_index_of(pa.Table.from_batches(held), k, pull), path)
            yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    # One task makes the index of the sample and leaves it in the shared folder; the driver never holds it.
    if not entries.repartition(1).mapInArrow(run, "path string").collect():
        save_index(Index({}, np.zeros(0), 0.0, k, pull).build([], [], [], []), path)
    return path


def save_index(index: Index, path: str) -> None:
    """Write the index beside its place and move it there, so that a task that runs again leaves the same file."""
    fs, p = file_system(path)
    fs.create_dir(p.rsplit("/", 1)[0], recursive=True)
    tmp = f"{p}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(tmp) as out:
        pickle.dump(index, out, 5)
    fs.move(tmp, p)


@lru_cache(maxsize=1)
def load_index(path: str) -> Index:
    fs, p = file_system(path)
    with fs.open_input_stream(p) as f:
        return pickle.load(f)


def _index_of(held: pa.Table, k: int, pull: float) -> Index:
    """The index of counted entries: terms, tf, n, toxic, one, sign, ids."""
    held = held.append_column("first", pc.list_element(held["ids"], 0)).append_column("size", pc.list_value_length(held["terms"]))
    held = held.take(pc.sort_indices(held, [(c, "ascending") for c in ("first", "sign", "size", "toxic")]))
    n, toxic, one, sign, sizes = (held[c].to_numpy().astype(np.int64) for c in ("n", "toxic", "one", "sign", "size"))
    coded = pc.dictionary_encode(pc.list_flatten(held["terms"])).combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    code, tf = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), pc.list_flatten(held["tf"]).to_numpy().astype(np.float64)
    total = len(coded.dictionary)
    # Near copies would make any word of theirs look telling, so terms are judged on one example of each group.
    single = np.zeros(len(n), bool)
    single[np.unique(sign, return_index=True)[1]] = True
    df = np.bincount(code[np.repeat(single, sizes)], minlength=total).astype(np.float64)
    found = np.bincount(code[np.repeat(single & (one > 0), sizes)], minlength=total).astype(np.float64)
    many = np.bincount(code, minlength=total)
    by_name = pc.sort_indices(coded.dictionary).to_numpy().astype(np.int64)
    by_number = by_name[np.argsort(-many[by_name], kind="stable")]
    number = np.empty(total, np.int64)
    number[by_number] = np.arange(total)
    terms = {t: i for i, t in enumerate(coded.dictionary.take(pa.array(by_number)).to_pylist())}
    df, found = np.maximum(df, 1)[by_number], found[by_number]
    texts_n, pos = int(single.sum()), int((single & (one > 0)).sum())
    weights = (np.log((1 + texts_n) / (1 + df)) + 1) * relevance(texts_n, pos, df, found)
    examples = int(n.sum())
    index = Index(terms, weights, int(toxic.sum()) / examples if examples else 0.0, k, pull)
    code = number[code]
    vectors, ends = [], np.cumsum(sizes)
    for lo, hi in zip((ends - sizes).tolist(), ends.tolist()):
        by_id = np.argsort(code[lo:hi])
        t = code[lo:hi][by_id]
        w = (1 + np.log(tf[lo:hi][by_id])) * weights[t]
        vectors.append((t, w / (math.sqrt(float(w @ w)) or 1.0)))
    index.build(vectors, n.tolist(), toxic.tolist(), held["ids"].to_pylist())
    index.calibrate(vectors)
    return index


class Judge:
    """Score, evidence and heaviest terms of a text; remembers a bounded number of texts by their hash."""

    def __init__(self, index: Index):
        self.index, self.seen = index, {}
        self.names = list(index.terms)

    def __call__(self, texts: list[str | None]) -> list[tuple[float, str, str]]:
        import xxhash

        ix, texts = self.index, [t or "" for t in texts]
        keys = [xxhash.xxh3_128_digest(t) for t in texts]
        if len(self.seen) > 20_000:
            self.seen.clear()
        new = {k: t for k, t in zip(keys, texts) if k not in self.seen}
        vectors = [ix.vector(Counter(_terms(t))) for t in new.values()]
        for key, v, begun in zip(new, vectors, ix.starts(vectors)):
            e, s = ix.nearest(v, begun=begun)
            evidence = ";".join(f"{i}:{x:.3f}" for j, x in zip(e[:5].tolist(), s[:5].tolist()) for i in ix.ids[j][:1])
            heavy = v[0][np.argsort(-v[1], kind="stable")[:5]].tolist()
            self.seen[key] = ix.score(ix.vote_of(e, s)), evidence, ",".join(self.names[t] for t in heavy)
        return [self.seen[k] for k in keys]


#: Of the labelled sample at most ``max_examples`` rows are used; ``k`` is the
#: number of nearest examples and ``pull`` the weight of the prior among their votes.
DEFAULTS = {"max_examples": 4_000, "k": 25, "pull": 0.5}


def score(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    **fitting,
) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (nearest examples with similarity), terms (the heaviest). ``fitting``: see DEFAULTS."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **(DEFAULTS | fitting))
    rows = pick(docs, id_col, text_col).withColumn("held_out", held_out(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(load_index(path))
        for b in batches:
            found = judge(b.column("text").to_pylist())
            scores = [p for p, _, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(p >= 0.5) for p in scores], pa.int32()), *(pa.array([x[i] for x in found], pa.string()) for i in (1, 2))],
                ["doc_id", "held_out", "score", "predicted", "evidence", "terms"],
            )

    return rows.select("doc_id", "text", "held_out").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, evidence string, terms string")


def reject(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, **fitting) -> DataFrame:
    """The rows of docs, with all their columns, whose score is under ``threshold``. Nothing is shuffled."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = fit(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col, **(DEFAULTS | fitting))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(load_index(path))
        for b in batches:
            yield b.filter(pa.array([p < threshold for p, _, _ in judge(b.column(text_col).to_pylist())], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
