import hashlib
import random
import re

import numpy as np
import public_tokenizers as vocab
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from annealix.llm import bpe_chunks, queries


def fixture(spark, folder):
    """Documents whose fate is plain: clean, toxic, copies, leaks, secrets."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghijkl") for _ in range(6)) for _ in range(900)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    items = [" ".join(text(30)) for _ in range(4)]
    docs, want, toxic = [], {}, {}
    for i in range(600):
        w, kind = text(r.randint(70, 120)), i % 10
        if kind in (1, 2):
            for bad in ("rudeword", "vileword", "meanword"):
                w.insert(r.randrange(len(w)), bad)
        if kind == 3:
            w[20:20] = items[i % 4].split()
        if kind == 4:
            w[10:10] = ["password:", "hunter2hunter2hunter2"]
        if kind == 5 and docs:
            w = docs[i - 5].split()
            w[7] = "changed"
        docs.append(" ".join(w))
        toxic[i] = int(kind in (1, 2))
        if kind in (0, 4, 6, 7, 8, 9):
            want[i] = docs[i]
    for i, t in want.items():
        want[i] = re.sub(r"password: \S+", "[SECRET]", t)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(docs)] + [(700, None, "en", "s", 0), (701, "", "en", None, 0)]
    want[700] = ""
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(toxic.items()), "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return want


def test_every_stage_takes_effect(spark, tmp_path):
    want = fixture(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = corpus_pipeline.materialise(out, "test")
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] == counts[3]
    assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    got = {x.doc_id: x for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(want)
    enc = bpe_chunks.load_encoding(vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN)
    for i, t in want.items():
        raw = np.array(enc.encode_ordinary(t), "<u4").tobytes()
        assert bytes(got[i].ids) == raw and got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_empty_tables(spark, tmp_path):
    fixture(spark, str(tmp_path / "full"))
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/full/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_registered():
    assert set(queries.queries()) <= set(__spark_entry__.queries()) and "pipeline" in __spark_entry__.queries()
    assert {int(k[2:].split("_")[0]) for k in queries.queries()} == set(range(1, 11))
    assert set(queries.oracle_sql()) <= set(queries.queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "encoding"]
