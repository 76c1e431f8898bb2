import hashlib
import random
from collections import Counter

import pytest
from texts import ODD, frame

from annealix.llm import repeats


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(g and not p for g, p in zip(gone, b"\0" + gone))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return out


@pytest.mark.parametrize(("length", "seed", "piece"), [(40, 20, 1 << 20), (40, 33, 1 << 20), (40, 15, 100), (12, 3, 1 << 20)])
def test_equals_brute_force(spark, length, seed, piece):
    r = random.Random(length + seed)
    noise = lambda n: "".join(r.choice("abcdeé 🙂") for _ in range(n))
    passages = [noise(n) for n in (10, 39, 40, 41, 60, 150)]
    texts = list(ODD)
    for k in range(60):
        parts = [noise(r.randint(0, 80)) for _ in range(r.randint(1, 3))]
        for _ in range(r.randint(0, 2)):
            p = r.choice(passages)
            a = r.randint(0, len(p) // 2)
            parts.insert(r.randint(0, len(parts)), p[a : a + r.randint(5, 150)])
        texts.append("".join(parts))
    texts += [texts[20], texts[21], texts[20], "ab" * 100, "x" * 300, "abc" * 50 + "d", noise(500) * 2]
    got = {x.doc_id: x for x in repeats.remove_repeats(frame(spark, texts), length=length, seed=seed, piece_bytes=piece, keep_text=True).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts, length)):
        x = got[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256, bytes(x.kept)) == want, texts[i]


def test_default_length(spark):
    r = random.Random(0)
    p = "".join(r.choice("abcdefgh ") for _ in range(900))
    q = "".join(r.choice("abcdefgh ") for _ in range(500))
    texts = [q[:90] + p[100:600] + q[90:], p[:650], p[500:899], p[500:900] + "!", "x" * 399, "x" * 399, q, None]
    got = {x.doc_id: x for x in repeats.remove_repeats(frame(spark, texts)).collect()}
    for i, want in enumerate(brute(texts, 400)):
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == want[:4], i
    assert repeats.remove_repeats(frame(spark, texts).limit(0)).count() == 0


def test_shared_passages_too_short_to_remove(spark):
    r = random.Random(3)
    noise = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passages = [noise(n) for n in (300, 320, 390, 1000, 140)]
    texts, want = [], []
    for p in passages:
        texts += [p + noise(r.randint(0, 900)), noise(r.randint(0, 900)) + p, noise(300) + p + noise(300)]
        want += [len(p) >= 300] * 3
    alone = noise(350)
    texts += [noise(2000), alone + noise(10) + alone, "x" * 299, noise(1500), None]
    want += [False] * 5
    got = {x.doc_id: x for x in repeats.remove_repeats(frame(spark, texts)).collect()}
    assert [got[i].n_shared > 0 for i in range(len(texts))] == want
    assert [got[i].n_removed > 0 for i in range(len(texts))] == [i // 3 == 3 for i in range(len(texts))]


def test_null_ids_and_copies(spark):
    t = "some text that is long enough " * 20
    rows = repeats.remove_repeats(frame(spark, [t, t, "short"], [None, None, 3])).collect()
    assert sorted((x.doc_id is None, x.n_removed, x.n_bytes) for x in rows) == [(False, 0, 5), (True, 600, 600), (True, 600, 600)]


def test_runs_of_masks():
    r = random.Random(4)
    for _ in range(300):
        rows, want = [], set()
        for _ in range(r.randint(1, 4)):
            lo = 64 * r.randint(0, 5)
            mask = r.choice([0, 1, -1, 1 << 63, r.getrandbits(64), r.getrandbits(64) & r.getrandbits(64)])
            hi = lo + (63 if mask else r.randint(0, 200))
            rows.append({"lo": lo, "hi": hi, "mask": mask if mask < 1 << 63 else mask - (1 << 64)})
            want |= {x for x in range(lo, hi + 1) if not mask or mask >> (x - lo) & 1}
        runs = repeats.runs_of(rows)
        assert runs == sorted(runs)
        assert {x for a, z in runs for x in range(a, z + 1)} == want
