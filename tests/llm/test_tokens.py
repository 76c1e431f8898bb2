import hashlib
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as vocab
import pytest
from texts import ODD, frame

from annealix.llm import arrow_tokens, bpe_chunks
from annealix.llm.common import scratch

RANKS = vocab.path("byte_bpe_multi_50k.tiktoken")
JSON = vocab.path("byte_bpe_50k.json")


@pytest.mark.parametrize(("chunk", "overlap"), [(32768, 2048), (40, 12), (7, 3)])
def test_chunked_encoding_equals_whole(spark, chunk, overlap):
    texts = [*ODD, "word " * 300 + "y" * 200 + " tail  \n\n of it"]
    enc = bpe_chunks.load_encoding(RANKS, vocab.PATTERN)
    got = {r.doc_id: r for r in bpe_chunks.encode_documents(frame(spark, texts), RANKS, vocab.PATTERN, chunk=chunk, overlap=overlap, keep_ids=True).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        raw = np.array(ids, "<u4").tobytes()
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(raw).hexdigest()), t
        assert bytes(got[i].ids) == raw
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_repeated_and_null_ids(spark):
    long = "some words " * 30
    df = frame(spark, [long, long, "x", None], [5, 5, None, None])
    rows = bpe_chunks.encode_documents(df, RANKS, vocab.PATTERN, chunk=64, overlap=16).collect()
    n = len(bpe_chunks.load_encoding(RANKS, vocab.PATTERN).encode_ordinary(long))
    assert sorted((r.doc_id is None, r.n_tokens) for r in rows) == [(False, n), (False, n), (True, 0), (True, 1)]
    assert bpe_chunks.encode_documents(df.limit(0), RANKS, vocab.PATTERN).count() == 0


def test_piece_encoder_equals_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    enc = arrow_tokens.PieceEncoder(JSON, "<u2")
    texts = [t or "" for t in ODD] * 2 + ["a ", " a", "a\n b", "a \nb", "  ", "x Ġy  Ġ", "it 's 'll", "a <|endoftext|> b<|endoftext|>c", "<|endoftext|><|endoftext|> x y", "<|end of text|>", "end end. end, éé. x1. 2. a.. b.\nc .d. e; ñ! q? 's. 漢字, ²."]
    for some in (texts, texts[5:], [texts[-1]]):
        ids, counts = enc.encode(pa.array(some), 2)
        for t, got in zip(some, np.split(ids, np.cumsum(counts)[:-1])):
            assert got.tolist() == [*tok.encode(t, add_special_tokens=False).ids, 2], t


def test_token_files(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    ids = [100 - i for i in range(len(ODD))]
    out = scratch(spark, "t")
    manifest = arrow_tokens.write_token_files(frame(spark, ODD, ids), out, JSON, seq_len=16, rows_per_batch=4)
    got = arrow_tokens.read_documents(manifest).collect()
    at = 0
    for i, t in sorted(zip(ids, ODD)):
        want = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        (r,) = [r for r in got if r.doc_id == i]
        assert (r.start, r.n_tokens) == (at, len(want))
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    seen = 0
    for m in manifest.collect():
        f = arrow_tokens.TokenFile(m.path)
        assert pa.types.is_fixed_size_list(f.reader.schema.field("ids").type)
        assert all(f.reader.get_batch(k).num_rows == 4 for k in range(f.reader.num_record_batches - 1))
        for r in range(m.n_rows):
            seq, mask = f.sequence(r)
            assert len(seq) == len(mask) == 16
            seen += int(mask.sum())
    assert seen == at


def test_special_tokens_repeated_and_null_ids_and_long_texts(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(JSON)
    texts = ["a <|endoftext|> b", None, "the same", "the same", "one more", "word and word, " * 20_000, "x" * 100_000]
    ids = [7, None, None, None, 7, 7, 3]
    assert tok.token_to_id("<|endoftext|>") in tok.encode(texts[0], add_special_tokens=False).ids
    out = scratch(spark, "t")
    manifest = arrow_tokens.write_token_files(frame(spark, texts, ids), out, JSON, seq_len=16, rows_per_batch=4, bytes_per_file=1000)
    got = arrow_tokens.read_documents(manifest).collect()
    want = sorted((i is not None, i or 0, len(raw := [*tok.encode(t or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(raw, "<u4").tobytes())) for i, t in zip(ids, texts))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_token_files_of_nothing(spark):
    out = scratch(spark, "t")
    manifest = arrow_tokens.write_token_files(frame(spark, ["x"]).limit(0), out, JSON)
    assert arrow_tokens.read_documents(manifest).count() == 0
