import hashlib
import random
import re

import pytest
import xxhash

from lurewatch.llm import simhash

BREAK = re.compile("[\x20\x09-\x0d]+|(?<=[฀-໿ក-៿⺀-鿿가-힯豈-﫿])")


def _long(x):
    return (x & (2 ** 64 - 1)).to_bytes(8, "little")


def brute(text):
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in BREAK.split(text.lower()) if w]
    terms = [(h, simhash.WORD) for h in hashes]
    for a, b in zip(hashes, hashes[1:]):
        terms.append((xxhash.xxh64_intdigest(_long(b), xxhash.xxh64_intdigest(_long(a), 42)), simhash.PAIR))
    total, out = sum(w for _, w in terms), 0
    for j in range(64):
        if 2 * sum(w for h, w in terms if h >> j & 1) > total:
            out |= 1 << j
    return out


def expected(rows):
    """Rows in order of descending id, then descending hash of the text, each with the next one."""
    def place(row):
        h = xxhash.xxh64_intdigest((row[1] or "").encode(), 42)
        return (-(2 ** 63) if row[0] is None else row[0]), h - 2 ** 64 if h >> 63 else h

    line = sorted(rows, key=place, reverse=True)
    out = []
    for (i, t), (_, after) in zip(line, [*line[1:], *line[:1]]):
        t, after = t or "", after or ""
        k = len(t) // 3
        e = t[:len(t) - k] + after[:k]
        a, b, c = brute(t), brute(e), brute(after)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{a:016x}", f"{b:016x}",
                    1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64))
    return out


def result(df):
    from pyspark.sql import functions as F
    f = F.col
    got = simhash.compare(df).select(
        "doc_id", "n_chars", "edited_sha256", simhash.as_text(f("fingerprint")).alias("a"),
        simhash.as_text(f("edited_fingerprint")).alias("b"),
        simhash.likeness(f("fingerprint"), f("edited_fingerprint")).alias("near_edited"),
        simhash.likeness(f("fingerprint"), f("next_fingerprint")).alias("near_next"))
    return sorted(map(tuple, got.collect()), key=key)


def key(row):
    return tuple((x is None, x) for x in row)


def some(rng, n):
    pool = ["the", "of", "Straße", "élan", "\U0001f600", "漢字", "かな", "ไทย", "x", "word", "Word", "ab\tcd", "\n", "  "]
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.mark.parametrize("chars", [simhash.BUCKET_CHARS, 900])
def test_brute_force(spark, table, monkeypatch, chars):
    monkeypatch.setattr(simhash, "BUCKET_CHARS", chars)
    monkeypatch.setattr(simhash, "HOT_ROWS", 20)
    rng = random.Random(4)
    rows = [(rng.randrange(-50, 400), some(rng, rng.randrange(40))) for _ in range(300)]
    rows += [(None, some(rng, 12)) for _ in range(30)] + [(None, "hot text here")] * 60
    rows += [(77, "the same row")] * 90 + [(77, some(rng, 5)) for _ in range(60)]
    rows += [(5, None), (6, ""), (6, None), (8, " \n "), (9, "one"), (10, "long " * 30_000), (2 ** 40, "far")]
    df = table([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, k int, bucket string", 5)
    assert result(df) == sorted(expected(rows), key=key)


def test_small_tables(spark, table):
    schema = "doc_id long, text string"
    for rows in ([(3, "a b c d e f")], [(None, None)], [(1, "a b"), (1, "a b")], [(1, "x y z"), (2, "p q r")]):
        assert result(table(rows, schema)) == sorted(expected(rows), key=key)
    assert simhash.compare(table([], schema)).count() == 0


def test_search_finds_all(spark, table):
    rng = random.Random(9)
    signed = lambda x: x - 2 ** 64 if x >> 63 else x
    base = [rng.getrandbits(64) for _ in range(60)]
    every = {*base, 0, 2 ** 64 - 1}
    for x in base:
        for _ in range(25):
            y = x
            for bit in rng.sample(range(64), rng.randrange(1, 7)):
                y ^= 1 << bit
            every.add(y)
    every = sorted(every)
    df = table([(signed(x),) for x in every for _ in range(2)] + [(None,)], "fingerprint long", 4)
    asked = every[::7]
    queries = table([(signed(x),) for x in asked], "fingerprint long", 2)
    for radius, blocks in ((3, 6), (0, 1), (1, 2), (4, 7)):
        got = sorted(map(tuple, simhash.within(df, queries, radius, blocks).collect()))
        want = sorted((signed(q), signed(x), (q ^ x).bit_count()) for q in asked for x in every
                      if (q ^ x).bit_count() <= radius)
        assert got == want
    assert simhash.within(df.where("false"), queries).count() == 0


def test_near_counts(spark, table):
    from pyspark.sql import functions as F
    rows = [(0, 5), (1, 5), (2, 4), (3, 3), (100, 255), (None, 5), (200, 7)]
    df = table(rows, "doc_id long, fingerprint long")
    got = {(r.doc_id, r.near_found) for r in simhash.near_counts(df, F.pmod("doc_id", F.lit(100)) == 0).collect()}
    want = {(i, sum((f ^ g).bit_count() <= 3 for _, g in rows) - 1 if i is not None and i % 100 == 0 else None)
            for i, f in rows}
    assert got == want
    assert simhash.near_counts(df, F.lit(True)).count() == len(rows)


def test_fingerprints(spark, table):
    rows = [(1, "a b c"), (1, "a b c"), (1, "d"), (2, None), (None, "a b c")]
    got = sorted(map(tuple, simhash.fingerprints(table(rows, "doc_id long, text string")).collect()), key=key)
    signed = lambda x: x - 2 ** 64 if x >> 63 else x
    assert got == sorted({(i, signed(brute(t or ""))) for i, t in rows}, key=key)
