import hashlib
import math
import random

import numpy as np
import pytest

from lurewatch.llm import vector_codes as vc


def brute(rows, parts=16, entries=64, rounds=2):
    ok = [(i, v, label) for i, v, label in rows
          if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in ok), default=0) // parts)) * parts
    whole = [[max(-vc.FAR, min(vc.FAR, math.floor(256 * x) if abs(x) < 1e300 else int(x) * 256)) for x in v]
             + [0] * (width - len(v)) for _, v, _ in ok]
    step = width // parts
    first = {}
    for (i, v, _), w in zip(ok, whole):
        if i is not None and (i not in first or list(v) < first[i][0]):
            first[i] = list(v), w
    start = [first[i][1] for i in sorted(first)[:entries]] or [[0] * width]
    books = [[w[p * step:(p + 1) * step] for w in start] for p in range(parts)]

    def nearest(p, x):
        far = [sum((a - b) ** 2 for a, b in zip(x, c)) for c in books[p]]
        return far.index(min(far)), min(far)

    def cut(w, p):
        return w[p * step:(p + 1) * step]

    for _ in range(rounds):
        new = []
        for p in range(parts):
            mine = {}
            for w in whole:
                mine.setdefault(nearest(p, cut(w, p))[0], []).append(cut(w, p))
            new.append([[sum(c) // len(c) for c in zip(*mine[e])] if e in mine else old
                        for e, old in enumerate(books[p])])
        books = new
    out, per_label = [], {}
    for (i, _, label), w in zip(ok, whole):
        found = [nearest(p, cut(w, p)) for p in range(parts)]
        error = min(vc.LONG, sum(f[1] for f in found))
        per_label[label] = per_label.get(label, 0) + error
        out.append((i, "".join(f"{f[0]:02x}" for f in found), error, label))
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return [(i, c, e, min(vc.LONG, per_label[label]), digest) for i, c, e, label in out]


def check(df, rows, **how):
    got = vc.compress(df, **how).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, **how), key=key)


@pytest.mark.parametrize("kind", ["spread", "few values", "clusters", "equal"])
@pytest.mark.parametrize("n, k", [(1, 1), (40, 3), (700, 64), (3000, 37)])
def test_dual_tree_is_exact(kind, n, k):
    rng = np.random.default_rng(len(kind) * n)
    draw = {"spread": lambda m: rng.integers(-3000, 3000, (5, m, 4)), "few values": lambda m: rng.integers(0, 3, (5, m, 4)),
            "clusters": lambda m: rng.integers(0, 6, (5, m, 1)) * 900 + rng.integers(0, 9, (5, m, 4)),
            "equal": lambda m: np.full((5, m, 4), 7)}[kind]
    points, books = draw(n), draw(k)
    nearest, counts, sums = vc.assign(points, books)
    far = ((points[:, :, None] - books[:, None]) ** 2).sum(-1)
    assert (nearest == far.argmin(-1)).all()
    for g in range(5):
        assert (counts[g] == np.bincount(nearest[g], minlength=k)).all()
        for e in range(k):
            assert (sums[g, e] == points[g][nearest[g] == e].sum(0)).all()


def test_whole_nodes_are_assigned(monkeypatch):
    rng = np.random.default_rng(1)
    at = rng.integers(0, 8, (4, 4000, 1)) * 100_000
    points, books = at + rng.integers(0, 50, (4, 4000, 4)), np.arange(8)[None, :, None].repeat(4, 0) * 100_000 + np.zeros((4, 8, 4), int)
    seen = []
    add = vc._bounds
    monkeypatch.setattr(vc, "_bounds", lambda a, b, x, y: seen.append(len(x)) or add(a, b, x, y))
    nearest, _, _ = vc.assign(points, books)
    assert (nearest == at[:, :, 0] // 100_000).all() and sum(seen) < 4 * 4000 * 8 / 20


def test_brute_force(spark, table):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.5, rng.gauss(0, 0.2)]) for _ in range(32)], rng.choice([None, 1, 2, 3]))
            for i in range(300)]
    same = [0.25] * 32
    rows += [(2000 + i, same, 9) for i in range(250)]
    rows += [(7, [-2.0] * 32, 1), (7, [-2.0] * 32, 1), (None, same, 9), (5000, None, 1), (5001, [1.0, None], 1),
             (5002, [float("nan")] * 32, None), (5003, [], 2), (-4, [1.0] * 5, None), (5005, [2.0] * 35, 4),
             (5006, [float("inf")] * 32, 2)]
    df = table([(i, v, label, 1, "c") for i, v, label in rows],
               "vec_id long, embedding array<double>, label int, v int, code string", 4)
    check(df, rows)
    check(df, rows, parts=4, entries=5, rounds=3)


def test_extremes(spark, table):
    rows = [(i, [x, 1.0, -x, 3.0], i % 2) for i, x in enumerate([1e12, 1e13, -1e300, 1.7e308, 0.0, 5e-324, 2.5])]
    check(table(rows, "vec_id long, embedding array<double>, label int"), rows, parts=2, entries=3)
    rows = [(None, [1.0, 2.0], None), (None, [3.0, 5.0], "b")]
    check(table(rows, "vec_id long, embedding array<double>, label string"), rows, parts=2)
    none = table(rows, "vec_id long, embedding array<double>, label string").where("false")
    assert vc.compress(none).count() == 0
