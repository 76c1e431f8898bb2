import itertools
import random

import pytest

from annealix.functions.aligner import align, align_pairs, nucleic_score, relative_score


def worth(top, bottom):
    total, gap = 0, None
    for x, y in zip(top, bottom):
        if "-" in (x, y):
            side = 0 if x == "-" else 1
            total += -2 if gap == side else -5
            gap = side
        else:
            total += nucleic_score(x, y)
            gap = None
    return total


def all_global(a, b):
    if not a or not b:
        yield a + "-" * len(b), "-" * len(a) + b
        return
    for x, y, dx, dy in ((a[0], b[0], 1, 1), (a[0], "-", 1, 0), ("-", b[0], 0, 1)):
        for t, u in all_global(a[dx:], b[dy:]):
            yield x + t, y + u


@pytest.mark.parametrize("seed", range(6))
def test_scores_equal_enumeration(seed):
    r = random.Random(seed)
    a, b = ("".join(r.choice("ACGT") for _ in range(r.randint(2, 5))) for _ in range(2))
    best = max(worth(*x) for x in all_global(a, b))
    total, top, bottom = align(a, b, "global")
    assert total == best == worth(top, bottom)
    assert top.replace("-", "") == a and bottom.replace("-", "") == b
    subs = lambda s: [s[i:j] for i, j in itertools.combinations(range(len(s) + 1), 2)]
    local = max(max(worth(*x) for x in all_global(x_, y_)) for x_ in subs(a) for y_ in subs(b))
    total, top, bottom = align(a, b, "local")
    assert total == max(local, 0)  # nothing aligned scores nothing
    if total > 0:
        assert worth(top, bottom) == total and top.replace("-", "") in a and bottom.replace("-", "") in b


def test_overlap_and_relative_score():
    total, top, bottom = align("TTTACGTACG", "ACGTACGGGG", "overlap")
    assert (total, top, bottom) == (14, "ACGTACG", "ACGTACG")
    assert relative_score(8, "ACGT", "ACGT") == 1.0 and relative_score(-12, "ACGT", "TGCA") == 0.0
    assert align("ANR", "ACG")[0] == 6
    with pytest.raises(ValueError):
        align("A", "A", "x")


def test_pairs(spark):
    df = spark.createDataFrame([("ACGTT", "CGT", 1), (None, "A", 2)], "a string, b string, id int")
    rows = {x.id: x for x in align_pairs(df, "a", "b").collect()}
    assert (rows[1].score, rows[1].aligned_a) == (6, "CGT") and rows[2].score is None
