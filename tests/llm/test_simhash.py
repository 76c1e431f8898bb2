import random

import numpy as np
import xxhash
from texts import ODD, frame

from annealix.llm import simhash
from annealix.llm.components import connected_components


def test_anchors_cover_all_pairs():
    r = np.random.default_rng(5)
    x = r.integers(-(2**63), 2**63 - 1, 400, np.int64)
    y = x.copy()
    for k in range(len(y)):
        for bit in r.choice(64, 2, replace=False)[: k % 3]:
            y[k] ^= np.int64(np.uint64(1) << np.uint64(bit)) if bit < 63 else np.int64(-(2**63))
    row, anchor = simhash.replicas(y, 2)
    reach = set(zip(row.tolist(), anchor.tolist()))
    assert all((k, a) in reach for k, a in enumerate(simhash.home(x).tolist()))
    assert len(reach) == len(row)


def brute(texts):
    fps = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0)
    return fps


def test_components_equal_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(50)]
    texts = list(ODD)
    for _ in range(12):
        base = [r.choice(words) for _ in range(60)]
        for _ in range(8):
            base = list(base)
            base[r.randrange(60)] = r.choice(words)
            texts.append(" ".join(base))
    texts += texts[-5:]
    fps = brute(texts)
    comp = list(range(len(texts)))
    for _ in comp:
        new = [min(comp[j] for j in range(len(texts)) if (fps[i] ^ fps[j]).bit_count() <= 2) for i in range(len(texts))]
        if new == comp:
            break
        comp = new
    got = {x.doc_id: x for x in simhash.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(texts))] == comp
    assert len(set(comp)) < len(texts) - 10


def test_replicas_are_not_broadcast(spark, tmp_path):
    r = np.random.default_rng(7)
    x = r.integers(-(2**62), 2**62, 500, np.int64)
    fps = np.unique(np.concatenate((x, x[:50] ^ 5, x[:20] ^ 7))).tolist()
    spark.createDataFrame([(f,) for f in fps], "fp long").write.parquet(f"file://{tmp_path}/fps")
    pairs = simhash.links(spark.read.parquet(f"file://{tmp_path}/fps"))
    assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(p) for p in pairs.collect())
    assert got == [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2]
    assert len(got) >= 70


def test_chain_and_empty(spark):
    n = 200
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([*zip(ids, ids[1:]), (1000, 1001), (5, 5)], "a long, b long")
    got = {x.node: x.component for x in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(n)} | {1000: 1000, 1001: 1000}
    assert connected_components(edges.limit(0)).count() == 0
    assert simhash.near_duplicates(frame(spark, ["x"]).limit(0)).count() == 0


def test_null_ids(spark):
    rows = simhash.near_duplicates(frame(spark, ["same text here", "same text here", None], [None, 7, None])).collect()
    assert sorted((r.doc_id is None, r.component_id is None) for r in rows) == [(False, False), (True, False), (True, True)]


def test_deduplicate_equals_brute_force(spark):
    r = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    texts = ["", None, "one two", "one two", "one two three"]
    for _ in range(15):
        base = [r.choice(words) for _ in range(r.randint(60, 200))]
        texts.append(" ".join(base))
        for edits in (1, 1, 2, 3, 8):
            new = list(base)
            for _ in range(edits):
                new[r.randrange(len(new))] = r.choice(words)
            texts.append(" ".join(new))
    texts += [texts[9]] * 3
    r.shuffle(texts)
    sets = []
    for t in texts:
        w = (t or "").split()
        s = min(5, len(w))
        sets.append({tuple(w[i : i + s]) for i in range(len(w) - s + 1)} if s else set())
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.8 if a | b else True
    comp = list(range(len(texts)))
    for _ in comp:
        new = [min(comp[j] for j in range(len(texts)) if alike(sets[i], sets[j])) for i in range(len(texts))]
        if new == comp:
            break
        comp = new
    df = frame(spark, texts).repartition(3)
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(x.doc_id for x in got.collect()) == sorted(set(comp))
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_deduplicate_null_and_repeated_ids(spark):
    t = "a b c d e f g h i j k l m n o p"
    df = frame(spark, [t, t, t + " q", "other words stay here as they are"], [None, 4, 4, None])
    assert sorted(map(str, ((x.doc_id, x.text) for x in simhash.deduplicate(df).collect()))) == sorted(map(str, [(4, t), (None, "other words stay here as they are")]))


def parts_by_brute_force(texts, similarity=0.8):
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    comp = list(range(len(texts)))
    alike = [[j for j in range(len(texts)) if len(a & sets[j]) >= similarity * len(a | sets[j])] for a in sets]
    while (new := [min(comp[j] for j in near) for near in alike]) != comp:
        comp = new
    return comp


def test_pairs_inside_a_family_with_a_shared_passage(spark):
    r = random.Random(17)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    passage, texts = text(170), []
    for _ in range(250):
        own = text(9)
        texts += [" ".join(passage + own + text(21)) for _ in range(2)]
    got = {x.doc_id for x in simhash.deduplicate(frame(spark, texts)).collect()}
    assert got == set(range(0, 500, 2))


def test_texts_made_of_shared_blocks(spark):
    r = random.Random(23)
    text = lambda n: ["".join(r.choice("abcdefghij") for _ in range(7)) for _ in range(n)]
    blocks, texts = [text(20) for _ in range(12)], []
    for _ in range(150):
        picked = sorted(r.sample(range(12), 9))
        texts.append(" ".join([w for b in picked for w in blocks[b]] + text(r.randint(0, 20))))
    comp = parts_by_brute_force(texts)
    assert 20 < len(set(comp)) < 140
    for rare in (3, 64):
        got = {x.doc_id for x in simhash.deduplicate(frame(spark, texts), rare=rare).collect()}
        assert got == set(comp)
