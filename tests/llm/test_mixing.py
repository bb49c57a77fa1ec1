import random
import re
from collections import Counter, defaultdict

import pytest

from lurewatch.llm import mixing


def water(sizes, weights=(5, 2, 1)):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] >= 3 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= target[s]
            free.remove(s)


def corpus():
    rng = random.Random(6)
    rows = []
    for i in range(3000):
        source = rng.choice(["a"] * 30 + ["b", "c", "d", "é", "Z", None, "zz"])
        rows.append((i, " \n".join(["word"] * int(rng.expovariate(1 / 120))), source))
    rows += [(9000, "x" * 50 + " y", "tiny"), (9001, None, "none"), (9002, "", "none"),
             (9003, "again and again", "b"), (9003, "again and again", "b")]
    return rows


@pytest.fixture
def docs(table):
    return table([(*r, 1) for r in corpus()],
                 "doc_id long, text string, source string, words int")


def test_targets_and_taken(spark, docs):
    rows = corpus()
    size = {}
    by_source = Counter()
    for i, text, source in rows:
        size[i] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        by_source[source] += size[i]
    want = water(by_source)
    source_of = {i: s for i, _, s in rows}
    got = mixing.mix(docs, ["doc_id", "words", "source"], shard_words=6400).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _, _ in rows)
    taken = Counter()
    for r in got:
        s = source_of[r.doc_id]
        assert r.source == s and r.words == 1
        assert r.mix_size == size[r.doc_id] and r.mix_source_size == by_source[s]
        assert r.mix_target == pytest.approx(want[s])
        assert r.mix_taken == r.mix_size * len(r.mix_shards) <= 3 * r.mix_size
        taken[s] += r.mix_taken
    for s in by_source:
        assert abs(taken[s] - want[s]) <= max(3, 0.002 * want[s]), (s, taken[s], want[s])
    again = mixing.mix(docs.repartition(7), ["doc_id", "words", "source"], shard_words=6400).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_long_documents_do_not_shut_others_out(table):
    for long, small in ((30000, 400), (60000, 300)):
        rows = [(0, "w " * long, "s")] + [(k, "w " * 50, "s") for k in range(1, small + 1)]
        rows += [(10000 + k, "w " * 40, "t") for k in range(500)]
        for shift in (0, 100000):
            docs = table([(i + shift, x, s) for i, x, s in rows], "doc_id long, text string, source string")
            got = mixing.mix(docs, ["doc_id", "source"]).collect()
            target = {r.source: r.mix_target for r in got}
            for s in target:
                left = target[s] - sum(r.mix_taken for r in got if r.source == s)
                turns = min(len(r.mix_shards) for r in got if r.source == s)
                fits = [r.mix_size for r in got if r.source == s and len(r.mix_shards) == turns]
                assert abs(left) <= 1 or left < min(fits), (s, long, shift, left)


def test_goes_on_with_the_next_blocks(table):
    rows = [(k, "w " * (900 if k % 3 else 1 + k % 7), "s") for k in range(300)]
    rows += [(1000 + k, "w " * 700, "t") for k in range(100)]
    docs = table(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, ["doc_id", "source"], shard_words=64 * 1000).collect()
    for s in ("s", "t"):
        mine = [r for r in got if r.source == s]
        left = mine[0].mix_target - sum(r.mix_taken for r in mine)
        turns = min(len(r.mix_shards) for r in mine)
        fits = [r.mix_size for r in mine if len(r.mix_shards) == turns]
        assert abs(left) <= 1 or 0 < left < min(fits)


def test_tree_is_exact_and_hypergeometric(spark):
    units = {0: 400, 1: 90, 2: 7, 3: 3}
    df = spark.createDataFrame(list(units.items()), "sid long, n long")
    shards, total = 10, sum(units.values())
    got = mixing.quotas(df, shards, total).collect()
    per_shard, runs = Counter(), defaultdict(list)
    for r in got:
        per_shard[r.shard] += r.n
        runs[r.sid].append((r.start, r.n))
    assert all(v == 50 for v in per_shard.values()) and len(per_shard) == shards
    for sid, n in units.items():
        at = 0
        for start, k in sorted(runs[sid]):
            assert start == at
            at += k
        assert at == n
    # Means and spread over many trees: shift the source numbers to get other draws.
    counts = []
    for shift in range(0, 400, 10):
        moved = spark.createDataFrame([(s + shift, n) for s, n in units.items()], "sid long, n long")
        counts += [r.n for r in mixing.quotas(moved, 2, total).where(
            f"sid = {1 + shift} AND shard = 0").collect()]
    mean = sum(counts) / len(counts)
    spread = sum((c - mean) ** 2 for c in counts) / len(counts)
    exact = 250 * 90 / 500 * (410 / 500) * (250 / 499)
    assert abs(mean - 45) < 3 and 0.4 * exact < spread < 2 * exact


def test_first_nodes_have_the_same_law(spark, monkeypatch):
    monkeypatch.setattr(mixing, "STEP", 64)
    units = {0: 3000, 1: 1000, 2: 993, 3: 7}
    df = spark.createDataFrame([*units.items(), (4, 0)], "sid long, n long")
    # Nodes of one shard each, of two or three, and one node: the root.
    for node_units in (50, 120, 5000):
        got = mixing.quotas(df, 100, 5000, node_units).collect()
        per_shard, runs = Counter(), defaultdict(list)
        for r in got:
            per_shard[r.shard] += r.n
            runs[r.sid].append((r.start, r.n, r.shard))
        assert all(v == 50 for v in per_shard.values()) and len(per_shard) == 100
        for sid, n in units.items():
            line = sorted(runs[sid])
            assert [at for at, _, _ in line] == [sum(k for _, k, _ in line[:i]) for i in range(len(line))]
            assert sum(k for _, k, _ in line) == n
        held = {s: k for _, k, s in runs[1]}
        spread = sum((held.get(s, 0) - 10) ** 2 for s in range(100)) / 100
        exact = 50 * 0.2 * 0.8 * (4950 / 4999)
        assert 0.6 * exact < spread < 1.6 * exact
        again = mixing.quotas(df.repartition(3), 100, 5000, node_units).collect()
        assert sorted(got) == sorted(again)


def test_copies_and_shards(spark, docs, tmp_path):
    mixed = mixing.mix(docs, docs.columns, shard_words=50000)
    out = mixing.copies(mixed, docs.columns)
    want = Counter({r.doc_id: 0 for r in docs.collect()})
    words = Counter()
    for r in mixed.collect():
        want[r.doc_id] += len(r.mix_shards)
        for s in r.mix_shards:
            words[s] += r.mix_size
    # A shard's 64 units come near its even share of the words.
    assert len(words) > 5 and max(words.values()) < 1.5 * min(words.values())
    assert Counter(r.doc_id for r in out.collect()) == +want
    mixing.write_shards(mixed, docs.columns, str(tmp_path / "mix"))
    assert spark.read.parquet(str(tmp_path / "mix")).count() == sum(want.values())


def test_empty(spark, docs):
    assert mixing.mix(docs.where("false"), ["doc_id"]).count() == 0
    none = mixing.mix(docs.where("source = 'none'"), ["doc_id"]).collect()
    assert {(r.mix_target, r.mix_taken) for r in none} == {(0.0, 0)}
