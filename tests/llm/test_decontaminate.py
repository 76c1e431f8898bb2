import random
import re
from collections import Counter

import numpy as np
import pytest
from texts import ODD, frame

from annealix.llm import decontaminate as dc

W = [f"w{i}" for i in range(60)]


def words(t):
    return [w for w in re.findall(r"[^\W_]+", (t or "").lower())]


def shingles(w, size):
    s = min(size, len(w))
    return Counter(tuple(w[i : i + s]) for i in range(len(w) - s + 1)) if s else Counter()


def brute(texts, items, threshold=0.8):
    out = {}
    for i, t in enumerate(texts):
        w = words(t)
        for k, item in items:
            v = words(item)
            s = min(5, len(v))
            if not v or len(w) < s:
                continue
            n = min(len(v), len(w))
            b = shingles(v, s)
            best = 0.0
            for at in range(len(w) - n + 1):
                a = Counter(tuple(w[at + j : at + j + s]) for j in range(n - s + 1))
                both = sum((a & b).values())
                best = max(best, both / (a.total() + b.total() - both))
            if best >= threshold:
                out[i, k] = round(best, 9)
    return out


@pytest.mark.parametrize("block_bytes", [16 << 20, 400])
def test_equals_brute_force(spark, block_bytes):
    r = random.Random(8)
    passage = lambda n: [r.choice(W) for _ in range(n)]
    items = [(k, " ".join(passage(n))) for k, n in enumerate([60, 60, 41, 30, 20, 12, 7, 5, 4, 3])] + [(20, None), (21, ""), (3, "w1 w2"), (22, "?!")]
    texts = list(ODD)
    for k, item in items[:10]:
        for edits in (0, 1, 2, 3, 5):
            p = item.split()
            for _ in range(edits):
                p[r.randrange(len(p))] = r.choice(W)
            texts.append(" ".join(passage(30)) + " " + ", ".join(p).title() + ". " + " ".join(passage(25)))
            texts.append(" ".join(p[: max(4, len(p) - edits)]))
    items += items[:2]
    bench = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, doc_id string")
    rows = dc.find_leaks(frame(spark, texts), bench, block_bytes=block_bytes).collect()
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in rows}
    want = brute(texts, items)
    assert len(rows) == len(got)
    assert got == want
    assert len(want) > 20


def test_multi_index_finds_all_within_radius():
    r = np.random.default_rng(1)
    for n_words in (10, 60):
        index = dc.ItemIndex(5, 0.8)
        for k in range(50):
            index.add(k, r.integers(0, 2**63, n_words).astype(np.uint64))
        index.seal()
        radius = 8 * index.reach(n_words) + 7
        for _ in range(200):
            k = int(r.integers(50))
            fp = index.fps[k]
            for bit in r.choice(64, int(r.integers(0, radius + 1)), replace=False).tolist():
                fp ^= 1 << bit
            want = {j for j in range(50) if (index.fps[j] ^ fp).bit_count() <= radius}
            assert index.candidates(n_words, fp) == want and k in want


def test_empty(spark):
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    df = frame(spark, ["a b c d e f", None], [None, 1])
    assert [(x.doc_id, x.item_id) for x in dc.find_leaks(df, bench).collect()] == [(None, 1)]
    assert dc.find_leaks(df.limit(0), bench).count() == 0
    assert dc.find_leaks(df, bench.limit(0)).count() == 0


def test_runs_of_one_word_on_either_side(spark):
    r = random.Random(4)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    items, texts = [], []
    for k in range(24):
        head, tail = text(116), text(116)
        run, plain = ([f"la{k}"] * 24, text(24))[:: 1 if k % 2 else -1]
        items.append((k, " ".join(head + run + tail)))
        texts.append(" ".join(text(9) + head + plain + tail + text(9)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): round(x.similarity, 9) for x in dc.find_leaks(frame(spark, texts), bench).collect()}
    assert got == {(k, k): 0.8 for k in range(24)}


def test_next_repeat():
    assert dc.next_repeat(np.array([5, 7, 5, 8, 7, 9], np.uint64)).tolist() == [2, 4, 6, 6, 6, 6]
