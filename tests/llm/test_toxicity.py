import math
import random
import zlib
from collections import Counter

import numpy as np
from texts import ODD, frame

from annealix.llm import toxicity


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def corpus(n=900, seed=2):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(800)]
    bad = ["rudeword", "vileword", "meanword", "foulword"]
    texts, toxic = [], []
    for _ in range(n):
        t = [r.choice(vocab) for _ in range(r.randint(10, 80))]
        y = r.random() < 0.2
        for _ in range(r.randint(1, 4) if y else 0):
            t.insert(r.randrange(len(t)), r.choice(bad))
        texts.append(" ".join(t))
        toxic.append(int(y))
    return texts, toxic


def test_held_out_accuracy_and_odd_rows(spark):
    texts, toxic = corpus()
    labels = spark.createDataFrame([*enumerate(toxic), (3, None), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    df = frame(spark, [*texts, *ODD, texts[0]], [*range(len(texts)), *[5000 + i for i in range(len(ODD))], None])
    rows = toxicity.score(df, labels).collect()
    assert len(rows) == len(texts) + len(ODD) + 1
    got = {r.doc_id: r for r in rows}
    out = [i for i in range(len(texts)) if held(i)]
    assert all(got[i].held_out == held(i) for i in range(len(texts)))
    assert sum(got[i].predicted == toxic[i] for i in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert got[None].score == got[0].score and not got[None].held_out
    assert got[5000].score == got[5001].score < 0.5
    # Held-out labels and columns other than the text change nothing.
    flipped = spark.createDataFrame([(i, 1 - y if held(i) else y) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score(df, flipped).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(frame(spark, ["a b", None]), none).collect()] == [0.0, 0.0]
    assert toxicity.score(frame(spark, ["a"]).limit(0), none).count() == 0


def test_block_max_search_is_exact():
    r = random.Random(4)
    tfs = {tuple(sorted({f"t{int(r.paretovariate(0.7)) % 40}": r.randint(1, 5) for _ in range(r.randint(1, 6))}.items())) for _ in range(300)}
    df = Counter(t for x in tfs for t, _ in x)
    terms = {t: i for i, (t, _) in enumerate(df.most_common())}
    ix = toxicity.Index(terms, np.array([1 + r.random() for _ in terms]), 0.2, 7, 0.5, block=4)
    vectors = [ix.vector(dict(t)) for t in sorted(tfs)]
    counts = [r.randint(1, 3) for _ in vectors]
    ix.build(vectors, counts, [r.randint(0, c) for c in counts], [[i] for i in range(len(vectors))])
    order = ix.order
    assert 0 < ix.often < len(terms) and ix.n_blocks > 20
    plain = [dict(zip(t.tolist(), w.tolist())) for t, w in vectors]
    size = np.array([counts[i] for i in order])
    for k, q in enumerate(plain[:120]):
        sims = np.array([sum(w * plain[i].get(t, 0.0) for t, w in q.items()) for i in order])
        less = order.index(k) if k % 2 else -1
        rank = np.argsort(-sims, kind="stable")
        at = min(int(np.searchsorted(np.cumsum(size[rank] - (rank == less)), 7)), len(rank) - 1)
        want = {i for i in range(len(sims)) if sims[i] > 0 and sims[i] >= sims[rank[at]] - 1e-9}
        e, s = ix.nearest(vectors[k], less)
        assert set(e.tolist()) == want
        assert np.allclose(s, sims[e])


def plain_scores(texts, toxic, ids, k=25, pull=0.5):
    """Scores by the docstring's words alone: all pairs, dictionaries, no index."""
    import re

    count = lambda t: Counter(re.findall(r"[^\W\d_]+", (t or "").lower()))
    tfs, used = [count(t) for t in texts], [i for i in ids if not held(i)]
    n, pos = len(used), sum(toxic[i] for i in used)
    df, a = Counter(), Counter()
    for i in used:
        df.update(tfs[i].keys())
        a.update(tfs[i].keys() if toxic[i] else ())

    def weight(t):
        g = 0.0
        for seen, row, col in ((a[t], df[t], pos), (df[t] - a[t], df[t], n - pos), (pos - a[t], n - df[t], pos), (n - df[t] - pos + a[t], n - df[t], n - pos)):
            g += seen * math.log(seen * n / (row * col)) if seen else 0.0
        return (math.log((1 + n) / (1 + df[t])) + 1) * (max(2 * g, toxicity.FLOOR) if a[t] * n > df[t] * pos else toxicity.FLOOR)

    weights = {t: weight(t) for t in df}

    def unit(tf):
        v = {t: (1 + math.log(c)) * weights[t] for t, c in tf.items() if t in weights}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    vectors, prior = [unit(tf) for tf in tfs], pos / n

    def vote(i):
        sims = sorted(((sum(x * vectors[j].get(t, 0.0) for t, x in vectors[i].items()), toxic[j]) for j in used if j != i), reverse=True)
        edge = sims[k - 1][0] - 1e-9
        near = [(s * s, y) for s, y in sims if s > 0 and s >= edge]
        return (sum(s * y for s, y in near) + pull * prior) / (sum(s for s, _ in near) + pull)

    return [vote(i) for i in range(len(texts))]


def test_votes_equal_a_plain_version(spark):
    texts, toxic = corpus(300, 5)
    labels = spark.createDataFrame(list(enumerate(toxic)), "doc_id long, toxic int")
    ix = toxicity.load_index(toxicity.fit(frame(spark, texts), labels, id_col="doc_id", text_col="text", label_col="toxic", **toxicity.DEFAULTS))
    want = plain_scores(texts, toxic, range(len(texts)))
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, texts), labels).collect()}
    points = sorted(ix.vote(ix.vector(Counter(toxicity._terms(t))), e, toxic[i]) for e, i in ((e, ix.ids[e][0]) for e in range(len(ix.ids))) for t in [texts[i]])
    assert np.allclose(points, sorted(want[i] for i in range(len(texts)) if not held(i)))
    for i in [i for i in range(len(texts)) if held(i)]:
        assert math.isclose(got[i], ix.score(want[i]), abs_tol=1e-6), i
    # The calibration is the isotonic fit of labels to votes: monotone, and right on average.
    mapped = [float(np.interp(p, ix.known, ix.mapped)) for p in points]
    assert mapped == sorted(mapped)
    assert abs(np.mean(mapped) - ix.prior) < 0.02


def test_calibration_is_monotone():
    ix = toxicity.Index({}, np.zeros(0), 0.3, 5, 0.5)
    ix.known, ix.mapped = [0.1, 0.4, 0.6], [0.05, 0.05, 0.9]
    xs = [ix.score(x / 100) for x in range(101)]
    assert xs == sorted(xs) and math.isclose(ix.score(0.6), 0.98 * 0.9 + 0.012)
