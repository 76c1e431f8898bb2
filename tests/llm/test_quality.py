import random
import re
from collections import Counter

from texts import ODD, frame

from annealix.llm import quality_mcd


def brute(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    tri = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i in range(len(words) - 2):
        if tri[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)


def test_counts(spark):
    r = random.Random(0)
    texts = [*ODD, "a\n b\na\n\n\na", "a b c a b c d a b c", "x y z", "a a a a", *["".join(r.choice("ab \n#|é") for _ in range(200)) for _ in range(30)]]
    got = {x.doc_id: x for x in quality_mcd.judge(frame(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert tuple(got[i][c] for c in quality_mcd.COUNTS[:5]) == want, t
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert got[i].base_failed == failed
        assert not (failed and got[i].kept)
    assert quality_mcd.judge(frame(spark, texts).limit(0)).count() == 0


def test_outliers_go_and_clean_stays(spark):
    r = random.Random(1)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    clean = [" ".join(r.choice(vocab) for _ in range(r.randint(60, 400))) for _ in range(500)]
    junk = [" ".join(r.choice(vocab) + r.choice(["###", "$$$", "|"]) for _ in range(100)) for _ in range(60)]
    df = frame(spark, clean + junk)
    df = df.selectExpr("doc_id", "text", "if(doc_id % 5 = 0, null, lang) as lang", "if(doc_id % 3 = 0, null, source) as source", "true as kept", "1 as x0", "2 as grp", "3 as c")
    got = {x.doc_id: x.kept for x in quality_mcd.judge(df, least=50).collect()}
    assert all(got[i] for i in range(500))
    assert not any(got[i] for i in range(500, 560))


def test_large_share_of_junk_goes(spark):
    r = random.Random(2)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    clean = [" ".join(r.choice(vocab) for _ in range(r.randint(60, 400))) for _ in range(300)]
    junk = [" ".join(r.choice(vocab) + r.choice(["###", "$$$", "|"]) for _ in range(r.randint(60, 400))) for _ in range(200)]
    df = frame(spark, clean + junk).selectExpr("doc_id", "text", "'en' as lang", "'web' as source")
    got = {x.doc_id: x.kept for x in quality_mcd.judge(df).collect()}
    assert all(got[i] for i in range(300))
    assert not any(got[i] for i in range(300, 500))


def test_rows_of_small_pools_are_judged(spark):
    r = random.Random(3)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    clean = lambda: " ".join(r.choice(vocab) for _ in range(r.randint(60, 400)))
    junk = lambda: " ".join(r.choice(vocab) + "###" for _ in range(100))
    texts = [clean() for _ in range(230)] + [junk() for _ in range(10)] + [clean() for _ in range(20)] + [junk() for _ in range(3)]
    df = frame(spark, texts).selectExpr("doc_id", "text", "if(doc_id < 240, 'en', 'xx') as lang", "'web' as source")
    bad = {*range(230, 240), *range(260, 263)}
    assert {x.doc_id for x in quality_mcd.judge(df).where("not kept").collect()} == bad
    few = df.where("doc_id >= 200 and doc_id < 240")
    assert {x.doc_id for x in quality_mcd.judge(few).where("not kept").collect()} == set(range(230, 240))
    assert quality_mcd.judge(df.where("doc_id = 7")).where("kept").count() == 1


def test_copied_lines_alone_can_decide(spark):
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(150, 250))) for _ in range(220)]
    texts.append("\n".join(r.choice(vocab[:40]) for _ in range(200)))
    df = frame(spark, texts).selectExpr("doc_id", "text", "'en' as lang", "'web' as source")
    assert [(x.doc_id, x.base_failed) for x in quality_mcd.judge(df).where("not kept").collect()] == [(220, False)]


def test_chi2():
    for q, df, want in ((0.5, 5, 4.351), (0.975, 5, 12.833), (0.95, 1, 3.841)):
        assert abs(quality_mcd.chi2(q, df) - want) < 0.12
