"""Token ids in Arrow IPC files of equal-length sequences (operator 4).

``write_token_files`` range-partitions documents by id, encodes them in order
and writes one file per partition. A file holds record batches of ``ids``
(fixed-size list of uint16 or uint32, by the size of the vocabulary) and
``mask`` (fixed-size list of bool: true where a token is). Every batch but the
last has the same number of rows, so row r lies in batch r // rows at r % rows
and a reader that maps the file reaches any sequence without copying. A second
file has doc_id, offset in the file's token stream and token count.

Files are written under another name and moved into place, so a task that is
run again leaves the same file. The manifest is a table; its commit is the
commit of the whole set.

Ids are those of the library's own call on the whole text. Special tokens that
a text spells out (``<|endoftext|>``) become their own id, as that call does.

Null text: empty (the end id alone). Null ids sort first; rows with one id are
ordered by their text's hash, which also spreads an often repeated id over
files. Repeated rows are written each. A very long text lies in one file and is
encoded at once. Other columns, whatever their names, are not read. Empty table:
no files, empty result.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, file_system, pick

_MAX_CACHE, _MAX_WORD = 200_000, 40


class PieceEncoder:
    """Encodes texts with the tokenizers library, remembering short pieces.

    A single space between two characters that are not white space starts a
    pre-token in any context, so a text can be cut there and its pieces encoded
    apart. ``words`` maps what follows such a space to its ids (with the space).
    A batch is cut and its distinct pieces found by Arrow; the library is called
    for pieces not yet known, and the ids of all texts are gathered by NumPy. A
    text with other white space beside a space, or with the spelling of an added
    token in it, is encoded whole; so are texts with pieces that can't be told
    apart (a vocabulary with tokens that have a space inside).

    Memory is bounded: pieces not seen since ``words`` was last full are dropped.
    """

    def __init__(self, path: str, dtype: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype(dtype)
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        space = self.tok.pre_tokenizer.pre_tokenize_str(" ")[0][0]
        vocab = self.tok.get_vocab()
        added = sorted({t.content for t in self.tok.get_added_tokens_decoder().values() if t.content}, key=len, reverse=True)
        self.special = "|".join(map(re.escape, added))
        self.is_special = re.compile(self.special or r"(?!)").search
        self.leads = np.zeros(max(vocab.values()) + 1, bool)
        self.leads[[i for t, i in vocab.items() if t.startswith(space)]] = True

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> list[bytes | None]:
        """Ids of pieces without spaces, each with a space before it; None where they can't be told apart.

        Many are encoded as one text and told apart by the tokens that begin
        with a space, which only a piece's first token does.
        """
        out: list[bytes | None] = []
        parts = [pieces[at : at + 256] for at in range(0, len(pieces), 256)]
        for part, raw in zip(parts, self._library([" " + " ".join(p) for p in parts])):
            starts = np.flatnonzero(self.leads[np.frombuffer(raw, self.dtype)]) * self.dtype.itemsize
            if len(starts) != len(part):
                out += [None] * len(part)
                continue
            stops = [*starts[1:].tolist(), len(raw)]
            out += [raw[a:b] for a, b in zip(starts.tolist(), stops)]
        return out

    def _known(self, pieces: list[str]) -> tuple[list[bytes], list[int]]:
        """Ids of distinct pieces, and the places of those that are not safe to cut at."""
        if len(self.words) > _MAX_CACHE:
            self.old, self.words = self.words, {}
        words, old = self.words, self.old
        out = [words.get(w) for w in pieces]
        for k in [k for k, raw in enumerate(out) if raw is None]:
            raw = old.get(pieces[k])
            if raw is not None:
                out[k] = words[pieces[k]] = raw
        missing = [k for k, raw in enumerate(out) if raw is None]
        unsafe = [k for k in missing if not pieces[k] or pieces[k].strip() != pieces[k] or self.is_special(pieces[k])]
        for k in unsafe:
            out[k] = b""
        missing = [k for k in missing if out[k] is None]
        for k, raw in zip(missing, self._learn([pieces[k] for k in missing])):
            out[k] = raw
            if raw is None:
                out[k] = b""
                unsafe.append(k)
            elif len(pieces[k]) <= _MAX_WORD:
                words[pieces[k]] = raw
        return out, unsafe

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and the number of each text's (``end`` included)."""
        size = self.dtype.itemsize
        n = len(texts)
        if not n:
            return np.zeros(0, self.dtype), np.zeros(0, np.int64)
        split = pc.split_pattern(texts, " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        coded = split.flatten().dictionary_encode()
        index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pieces = coded.dictionary.to_pylist()
        entries, unsafe = self._known(pieces)
        starts, counts = offsets[:-1], np.diff(offsets)
        whole = np.zeros(n, bool)
        if unsafe:
            odd = np.zeros(len(pieces), bool)
            odd[unsafe] = True
            whole = np.add.reduceat(odd[index], starts) > 0
        if self.special:  # one with a space inside lies across pieces
            whole |= pc.match_substring_regex(texts, self.special).to_numpy(zero_copy_only=False)
        # A text's first piece has no space before it; an odd text is one piece.
        first = [texts[k].as_py() if w else pieces[index[s]] for k, (w, s) in enumerate(zip(whole.tolist(), starts.tolist()))]
        entries += self._library(first)
        index[starts] = len(pieces) + np.arange(n)
        keep = ~np.repeat(whole, counts)
        keep[starts] = True
        index, counts = index[keep], np.where(whole, 1, counts)
        if end is not None:
            index = np.insert(index, np.cumsum(counts), len(entries))
            entries.append(np.array([end], self.dtype).tobytes())
            counts = counts + 1
        sizes = np.fromiter(map(len, entries), np.int64, len(entries)) // size
        at = np.cumsum(sizes) - sizes
        pool = np.frombuffer(b"".join(entries), self.dtype)
        lens = sizes[index]
        stops = np.cumsum(lens)
        ids = pool[np.repeat(at[index] - (stops - lens), lens) + np.arange(stops[-1])]
        return ids, np.add.reduceat(lens, np.cumsum(counts) - counts)


@lru_cache(maxsize=2)
def load_encoder(path: str, dtype: str) -> PieceEncoder:
    return PieceEncoder(path, dtype)


def vocabulary_dtype(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


class _SequenceFile:
    """Writes one partition's ids as equal-length rows, holding one batch at most."""

    def __init__(self, fs, path: str, dtype: str, length: int, rows: int):
        self.fs, self.path, self.tmp = fs, path, f"{path}.{uuid.uuid4().hex}.tmp"
        self.dtype, self.length, self.rows = dtype, length, rows
        self.value = pa.uint16() if dtype == "<u2" else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(self.value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.sink = fs.open_output_stream(self.tmp)
        self.out = pa.ipc.new_file(self.sink, self.schema)
        self.buffer, self.n_rows, self.n_tokens = bytearray(), 0, 0

    def add(self, raw: bytes) -> None:
        self.buffer += raw
        size = self.length * self.rows * np.dtype(self.dtype).itemsize
        while len(self.buffer) >= size:
            self._write(bytes(self.buffer[:size]))
            del self.buffer[:size]

    def _write(self, raw: bytes) -> None:
        ids = np.frombuffer(raw, self.dtype)
        n = -(-len(ids) // self.length)
        mask = np.zeros(n * self.length, bool)
        mask[: len(ids)] = True
        full = np.zeros(n * self.length, self.dtype)
        full[: len(ids)] = ids
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(full, self.value), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))
        self.n_rows += n
        self.n_tokens += len(ids)

    def close(self) -> None:
        if self.buffer:
            self._write(bytes(self.buffer))
        self.out.close()
        self.sink.close()
        self.fs.move(self.tmp, self.path)


def write_token_files(
    docs: DataFrame,
    out_dir: str,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int | None = 2,
    seq_len: int = 2048,
    rows_per_batch: int = 64,
    bytes_per_file: int = 64 << 20,
) -> DataFrame:
    """Write the files and return their manifest: part, path, n_docs, n_tokens, n_rows, first (tokens before the file)."""
    spark = docs.sparkSession
    bounded_batches(spark, 4096)  # the larger a batch, the fewer distinct pieces it has for its size
    base = pick(docs, id_col, text_col)
    total = base.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // bytes_per_file))
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    ordered = base.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dtype = vocabulary_dtype(tokenizer_path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        enc = load_encoder(tokenizer_path, dtype)
        fs, folder = file_system(out_dir)
        out, index, offset, n_docs = None, None, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                fs.create_dir(folder, recursive=True)
                path = f"{folder}/part-{part:06d}"
                out = _SequenceFile(fs, f"{path}.arrow", dtype, seq_len, rows_per_batch)
                index_tmp = f"{path}.docs.{uuid.uuid4().hex}.tmp"
                index_sink = fs.open_output_stream(index_tmp)
                index_schema = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])
                index = pa.ipc.new_file(index_sink, index_schema)
            ids, counts = enc.encode(b.column("text"), end_id)
            out.add(ids.tobytes())
            starts = offset + np.cumsum(counts) - counts
            index.write_batch(pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(starts), pa.array(counts)], schema=index_schema))
            offset += int(counts.sum())
            n_docs += len(counts)
        if out is not None:
            out.close()
            index.close()
            index_sink.close()
            fs.move(index_tmp, f"{path}.docs")
            cols = [pa.array([part], pa.int32()), pa.array([f"{out_dir}/part-{part:06d}"]), *(pa.array([v], pa.int64()) for v in (n_docs, out.n_tokens, out.n_rows))]
            yield pa.RecordBatch.from_arrays(cols, ["part", "path", "n_docs", "n_tokens", "n_rows"])

    written = ordered.mapInArrow(write, "part int, path string, n_docs long, n_tokens long, n_rows long")
    written.write.parquet(f"{out_dir}/manifest")
    return read_manifest(spark, out_dir)


def read_manifest(spark: SparkSession, out_dir: str) -> DataFrame:
    """One row per file, with the tokens of all files before it."""
    m = spark.read.schema("part int, path string, n_docs long, n_tokens long, n_rows long").parquet(f"{out_dir}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return m.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long")))


class TokenFile:
    """Random access to one file: ``sequence(r)`` and ``tokens(start, n)`` read only the batches they need."""

    def __init__(self, path: str):
        fs, p = file_system(path)
        self.reader = pa.ipc.open_file(fs.open_input_file(f"{p}.arrow"))
        self.docs = pa.ipc.open_file(fs.open_input_file(f"{p}.docs"))
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = self.reader.get_batch(0).num_rows

    def _batch(self, k: int) -> np.ndarray:
        return self.reader.get_batch(k).column("ids").values.to_numpy(zero_copy_only=True)

    def sequence(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        b = self.reader.get_batch(r // self.rows)
        i = (r % self.rows) * self.length
        mask = b.column("mask").values.slice(i, self.length).to_numpy(zero_copy_only=False)
        return b.column("ids").values.to_numpy(zero_copy_only=True)[i : i + self.length], mask

    def tokens(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids from ``start`` on, as views of the batches they lie in."""
        size = self.rows * self.length
        while n > 0:
            k, i = divmod(start, size)
            view = self._batch(k)[i : i + n]
            yield view
            start, n = start + len(view), n - len(view)


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, read from the files of a manifest."""
    files = manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(b.column("path").to_pylist(), b.column("first").to_pylist()):
                f = TokenFile(path)
                for k in range(f.docs.num_record_batches):
                    d = f.docs.get_batch(k)
                    crcs = []
                    for offset, n in zip(d.column("offset").to_pylist(), d.column("n_tokens").to_pylist()):
                        crc = 0
                        for view in f.tokens(offset, n):
                            crc = zlib.crc32(view.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    start = pa.array(d.column("offset").to_numpy() + first, pa.int64())
                    yield pa.RecordBatch.from_arrays([d.column("doc_id"), start, d.column("n_tokens"), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("path", "first").repartition(int(files), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
