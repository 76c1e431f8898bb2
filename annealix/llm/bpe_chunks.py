"""Byte-level BPE by overlapping chunks (operator 7).

A text of up to ``chunk`` code points is one piece. A longer text is cut into
chunks that overlap by ``overlap``. Each chunk is pre-tokenised on its own; a
chunk may begin inside a pre-token, so its first boundaries can be wrong. Where
chunk i and chunk i+1 report the same boundary inside their overlap the two
have resynchronised: the pattern looks behind nowhere, so from one common
boundary on both split alike. The text between two such cuts is a piece, whose
encoding is independent of all others. If no boundary is common (one pre-token
longer than the overlap) the chunks are joined and the piece goes on.

A cut is only taken after a character that is not white space, because the
pattern looks ahead past white space.

Null text: encoded as empty (no ids). Repeated rows: one result each. Null
ids are kept. Empty table: empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, pick


@lru_cache(maxsize=4)
def load_encoding(path: str, pattern: str):
    """A tiktoken encoding from a rank file; one per worker process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def boundaries(text: str, pattern: str) -> list[int]:
    """Starts of pre-tokens that follow a character other than white space."""
    import regex

    return [m.start() for m in regex.compile(pattern).finditer(text) if m.start() and not text[m.start() - 1].isspace()]


def encode_documents(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = 32768,
    overlap: int = 2048,
    keep_ids: bool = False,
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep_ids``, ids (binary, uint32)."""
    if not 0 < overlap < chunk:
        raise ValueError("overlap must lie between 0 and chunk")
    bounded_batches(docs.sparkSession)
    base = pick(docs, id_col, text_col)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if keep_ids else "")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(ranks_path, pattern)
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text in b.column("text").to_pylist():
                ids = enc.encode_ordinary(text)
                raw = np.array(ids, "<u4").tobytes()
                for col, v in zip(out, (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(enc.decode_bytes(ids)).hexdigest(), raw)):
                    col.append(v)
            cols = [b.column("doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                cols, names = [*cols, pa.array(out[3], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    short = base.where(F.length("text") <= chunk).mapInArrow(whole, schema)

    # Longer texts: (row, chunk) rows, spread over tasks by both.
    # A pattern cuts a text in one pass; a substring by position would read it from the start for every chunk.
    cut_up = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    long = base.where(F.length("text") > chunk).select("doc_id", F.monotonically_increasing_id().alias("rid"), cut_up.alias("cut"))
    behind = lambda i: F.left(F.coalesce(F.get("cut", i + 1), F.lit("")), F.lit(overlap))
    chunks = long.select(
        "doc_id", "rid", F.posexplode(F.transform("cut", lambda own, i: F.concat(own, behind(i)))).alias("i", "text")
    ).repartition("rid", "i")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            head, tail = [], []
            for text, i in zip(b.column("text").to_pylist(), b.column("i").to_pylist()):
                cuts = boundaries(text, pattern)
                head.append([i * chunk + p for p in cuts if p < overlap])
                tail.append([i * chunk + p for p in cuts if p >= chunk])
            cuts_type = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(head, cuts_type), pa.array(tail, cuts_type)], [*b.schema.names, "head", "tail"])

    marked = chunks.mapInArrow(split, "doc_id long, rid long, i int, text string, head array<long>, tail array<long>")
    by_row = Window.partitionBy("rid").orderBy("i")
    cut = F.array_min(F.array_intersect("tail", F.lead("head").over(by_row)))
    # A chunk's own part runs from the cut before it (or its start) to the cut behind it (or its end).
    start = F.coalesce(F.lag("cut").over(by_row), F.col("i") * F.lit(chunk).cast("long"))
    stop = F.coalesce(F.col("cut"), (F.col("i") + 1) * F.lit(chunk).cast("long"))
    parts = (
        marked.withColumn("cut", cut)
        .withColumn("start", start)
        .withColumn("stop", stop)
        .withColumn("piece", F.count("cut").over(by_row.rowsBetween(Window.unboundedPreceding, -1)))
        .select("doc_id", "rid", "i", "piece", F.substring("text", (F.col("start") - F.col("i") * chunk + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("part"))
    )
    pieces = parts.groupBy("rid", "piece").agg(F.first("doc_id").alias("doc_id"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "part"))), lambda x: x["part"]), "").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load_encoding(ranks_path, pattern)
        for b in batches:
            ids = [np.array(enc.encode_ordinary(t), "<u4").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("piece"), b.column("doc_id"), pa.array(ids, pa.binary())], ["rid", "piece", "doc_id", "ids"])

    coded = pieces.mapInArrow(encode, "rid long, piece long, doc_id long, ids binary")

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows arrive by text and piece; only hashes (and ids, if asked for) are held."""
        enc = load_encoding(ranks_path, pattern)
        cur, doc, count, ids_h, dec_h, held = None, None, 0, hashlib.sha256(), hashlib.sha256(), []

        def row() -> pa.RecordBatch:
            vals = {"doc_id": doc, "n_tokens": count, "ids_sha256": ids_h.hexdigest(), "decoded_sha256": dec_h.hexdigest()}
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            if keep_ids:
                vals["ids"] = b"".join(held)
                types.append(pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(vals.values(), types)], list(vals))

        for b in batches:
            for rid, did, raw in zip(b.column("rid").to_pylist(), b.column("doc_id").to_pylist(), b.column("ids").to_pylist()):
                if cur is not None and rid != cur:
                    yield row()
                if rid != cur:
                    cur, doc, count, ids_h, dec_h, held = rid, did, 0, hashlib.sha256(), hashlib.sha256(), []
                ids = np.frombuffer(raw, "<u4")
                count += len(ids)
                ids_h.update(raw)
                dec_h.update(enc.decode_bytes(ids.tolist()))
                if keep_ids:
                    held.append(raw)
        if cur is not None:
            yield row()

    joined = coded.repartition("rid").sortWithinPartitions("rid", "piece").mapInArrow(combine, schema)
    return short.unionByName(joined)
