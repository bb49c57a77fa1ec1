import math
import random

from lurewatch.llm import topk


def brute(rows, asked, k=10):
    def whole(v):
        return None if v is None or any(x is None or not math.isfinite(x) for x in v) else [
            math.floor(1024 * x) for x in v]

    ok = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    out = []
    for q in sorted({i for i, _ in asked}):
        own = [whole(v) for i, v in asked if i == q and whole(v) is not None]
        if not own:
            continue
        best = sorted((-sum(a * b for a, b in zip(min(own), w)), i) for i, w in ok if i != q)[:k]
        out += [(q, r + 1, i, max(-2**63, min(2**63 - 1, -s))) for r, (s, i) in enumerate(best)]
    return out


def test_brute_force(spark, table):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 0.125, rng.random()]) for _ in range(8)])
            for i in range(700)]
    same = [0.25] * 8
    rows += [(1000 + i, same) for i in range(300)]
    rows += [(5000, None), (5100, [1.0, None]), (5200, [float("nan")] * 8), (5300, []),
             (5400, [1.0] * 3), (5401, [2.0] * 12), (None, same), (5500, [float("inf")] * 8),
             (700, same), (701, same), (701, same)]
    df = table([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, id int", 4)
    asked = [(i, v) for i, v in rows if i is not None and i % 100 == 0]
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 100 = 0")).collect()))
    assert got == brute(rows, asked)
    # Many small shards: lists are merged in more than one round.
    got = sorted(map(tuple, topk.search(df, df.where("vec_id % 100 = 0"), most_values=200).collect()))
    assert got == brute(rows, asked)


def test_large_values_and_few_rows(spark, table):
    rows = [(0, [1e12, 3.0]), (1, [1e13, 1.0]), (2, [-1e300, 2.0]), (3, [1.0, 1.0])]
    df = table(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.search(df, df.where("vec_id = 0")).collect()))
    assert got == brute(rows, rows[:1])
    assert topk.search(df.where("false"), df.where("false")).count() == 0
