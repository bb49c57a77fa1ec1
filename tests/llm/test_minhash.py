import random
import re

from lurewatch.llm import minhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, words, percent=80):
    sets, ids = {}, [r[0] for r in rows]
    for i, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in ids:
        for j in ids:
            if i < j and sets[i] and sets[j]:
                if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                    a, b = find(i), find(j)
                    top[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed=5):
    rng = random.Random(seed)
    rows, n = [], 0

    def words(k):
        return [f"w{rng.randrange(4000)}" for _ in range(k)]

    for _ in range(25):
        base = words(rng.choice([3, 4, 20, 60, 120, 300]))
        for _ in range(rng.randrange(1, 9)):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 25) + 1)):
                copy[rng.randrange(len(copy))] = words(1)[0]
            rows.append((n, rng.choice([" ", "\n", " \t "]).join(copy).upper()))
            n += 1
    # A chain: every text links with the next only.
    line = words(200)
    for k in range(12):
        rows.append((n, " ".join(line[k * 15:] + words(k * 15))))
        n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "One two"), (n + 4, "one TWO"),
             (n + 5, "É one two three four"), (n + 6, "é one two three four"), (n + 7, "x " * 5000)]
    rng.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark, table):
    rows = corpus()
    docs = table([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    for words in (4, 5):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
               for r in minhash.classes(docs, words).collect()}
        assert got == brute(rows, words)


def test_one_large_family(spark, table):
    """Copies around the threshold, copies of copies, and shortened ones, all of one text."""
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(100000)}" for _ in range(n)]
    base, rows = words(150), []
    for family in range(60):
        copy = list(base)
        for _ in range(rng.randrange(0, 9)):
            copy[rng.randrange(150)] = words(1)[0]
        if family % 3 == 0:
            copy = copy[:rng.randrange(100, 150)]
        for _ in range(rng.randrange(1, 6)):
            again = list(copy)
            for _ in range(rng.randrange(0, 4)):
                again[rng.randrange(len(again))] = words(1)[0]
            rows.append((len(rows), " ".join(again)))
    rng.shuffle(rows)
    docs = table([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept)
           for r in minhash.classes(docs, 4).collect()}
    assert got == brute(rows, 4)
    assert len({c for _, c, _ in got.values()}) > 3


def test_edge_rows(spark, table):
    docs = table([(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "y"),
                  (None, "a b c d e f", "z"), (3, None, "z"), (4, "", "z")],
                 "doc_id long, text string, component_id string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id, r.kept)
                 for r in minhash.classes(docs, 4).collect())
    assert got == [(-1, 3, None, True), (1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False),
                   (3, 0, 3, True), (4, 0, 4, True)]
    stay = sorted((r.doc_id or -1, r.text) for r in minhash.one_of_each(docs, 4).collect())
    assert stay == [(-1, "a b c d e f"), (1, "a b c d e f"), (3, None), (4, "")]
    empty = docs.where("false")
    assert minhash.classes(empty).count() == 0 and minhash.one_of_each(empty).count() == 0


def test_components_of_a_path(spark):
    n = 60
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    got = {r.id: r.component for r in minhash.components(edges).collect()}
    assert got == {i: 0 for i in range(1, n + 1)}


def test_repeated_ids_keep_their_links(spark, table):
    rng = random.Random(2)
    text = lambda: [f"w{rng.randrange(10 ** 6)}" for _ in range(60)]
    one, two, three = text(), text(), text()
    near = lambda w: " ".join([*w[:-1], "other"])
    # Ids 7 and 3 stand for two texts each; every one of these has a near copy under another id.
    rows = [(7, " ".join(one)), (7, " ".join(two)), (3, " ".join(three)), (3, near(one)), (9, near(two)),
            (5, near(three)), (1, "alone in the table"), (None, " ".join(one)), (7, ""), (8, near(three))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.classes(
        table(rows, "doc_id long, text string")).collect()), key=lambda r: tuple((x is None, x) for x in r))
    want = [(7, 56, 3, False), (7, 56, 7, True), (3, 56, 3, True), (3, 56, 3, True), (9, 56, 7, False),
            (5, 56, 3, False), (1, 1, 1, True), (None, 56, None, True), (7, 0, 7, True), (8, 56, 3, False)]
    assert got == sorted(want, key=lambda r: tuple((x is None, x) for x in r))
