import itertools
import random

from folioquery.operators.chain import coverage, heaviest_chain, page_chains


def brute(left, right, weight):
    best = 0
    for n in range(len(left) + 1):
        for some in itertools.combinations(sorted(range(len(left)), key=lambda k: left[k]), n):
            if all(left[a] < left[b] and right[a] < right[b] for a, b in itertools.pairwise(some)):
                best = max(best, sum(weight[k] for k in some))
    return best


def test_against_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        n = rng.randrange(9)
        left, right, weight = ([rng.randrange(6) for _ in range(n)] for _ in range(3))
        chain = heaviest_chain(left, right, [w + 1 for w in weight])
        assert all(left[a] < left[b] and right[a] < right[b] for a, b in itertools.pairwise(chain))
        assert sum(weight[k] + 1 for k in chain) == brute(left, right, [w + 1 for w in weight])


def test_pages(spark):
    rows = [("p", 1, 1, 5.0), ("p", 2, 9, 1.0), ("p", 3, 2, 5.0), ("q", 1, 2, 1.0), ("q", 2, 1, 1.0)]
    df = spark.createDataFrame(rows, "page string, left long, right long, weight double")
    got = page_chains(df, ["page"])
    assert sorted((r.page, r.left) for r in got.collect()) == [("p", 1), ("p", 3), ("q", 1)]
    assert {r.page: r.enough for r in coverage(df, got, ["page"]).collect()} == {"p": True, "q": False}
