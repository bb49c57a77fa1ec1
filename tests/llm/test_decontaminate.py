import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lurewatch.llm import decontaminate as dc


def brute(item, part):
    """Fewest edits between item and any substring of part."""
    row = [0] * (len(part) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(part, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def line(text):
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=6, max_size=14), st.text("ab ", max_size=25), st.integers(0, 4))
def test_alignment(item, part, budget):
    got = dc.aligned(line(item), line(part), -len(item), len(part), budget)
    want = brute(item, part)
    if want > budget:
        assert got is None
    else:
        edits, begin, end = got
        assert edits == want and brute(item, part[begin:end]) == want


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioumnrst") for _ in range(rng.randrange(2, 8)))
                    for _ in range(n))


def edited(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        k = rng.randrange(len(text))
        text[k:k + 1] = rng.choice([[], ["x"], [text[k], "y"]])
    return "".join(text)


def test_finds_all_within_the_budget(spark, table):
    rng = random.Random(8)
    items = [(i, prose(rng, rng.randrange(12, 40))) for i in range(40)]
    items += [(100, items[0][1]), (101, "too short"), (102, None)]
    rows, planted, far = [], {}, set()
    for d in range(160):
        i, text = items[rng.randrange(40)]
        size = len(dc.normalized(text)[0])
        edits = rng.choice([0, 0, 1, int(dc.RATE * size), int(0.25 * size)])
        body = edited(rng, text, edits)
        if edits <= dc.RATE * size:
            planted[d] = (i, text)
        else:
            far.add(d)
        rows.append((d, prose(rng, rng.randrange(0, 200)) + " " + body.upper().replace(" ", ",\n ")
                     + " " + prose(rng, rng.randrange(0, 200))))
    rows += [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1]),
             (903, "be " * 40000 + items[4][1] + " be" * 40000), (None, items[5][1]),
             (904, prose(rng, 3000))]
    docs = table([(*r, 1) for r in rows], "doc_id long, text string, item_id int")
    bench = table([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    found = dc.find(docs, bench).collect()
    pairs = {(r.doc_id, r.item_id) for r in found}
    texts = dict(rows)
    for d, (i, text) in planted.items():
        assert (d, i) in pairs, d
    norm = {i: "".join(map(chr, dc.normalized(t)[0])) for i, t in items if t}
    for r in found:
        part = "".join(map(chr, dc.normalized(texts[r.doc_id][r.begin:r.end])[0]))
        assert brute(norm[r.item_id], part) <= r.edits <= dc.RATE * len(norm[r.item_id])
    assert (902, 3) in pairs and (903, 4) in pairs and (None, 5) in pairs
    assert not {900, 901, 904} & {r.doc_id for r in found}
    assert sum(r.doc_id == 902 for r in found) == 1
    assert {i for d, i in pairs if i == 100} <= {100}
    assert all((d, 100) in pairs for d, i in pairs if i == 0)
    assert {r.item_id for r in dc.unsearched(bench.where("text IS NOT NULL")).collect()} == {101}
    clean = dc.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {r.doc_id for r in found}
    # Several passes over the documents give the same hits.
    small, dc.INDEX_CHARS = dc.INDEX_CHARS, 2000
    try:
        assert {(r.doc_id, r.item_id) for r in dc.find(docs, bench).collect()} == pairs
    finally:
        dc.INDEX_CHARS = small
    assert dc.find(docs, bench.where("false")).count() == 0
    assert dc.find(docs.where("false"), bench).count() == 0


def test_short_passages_and_null_item_ids(spark, table):
    bench = table([(1, "What is the capital of Australia?"), (2, "\u6cd5\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc"),
                   (3, "forty two"), (4, "Ohm"), (5, "!?"), (None, "Null ids are passages of their own as well, says this one."),
                   (None, "another without id")], "item_id long, text string")
    docs = table([(1, "They ask: what is  the capital of Australia? It is."), (2, "what is the capitel of australia"),
                  (3, "somewhat is the capital of Australians"), (4, "\u95ee\u9898\uff1a\u6cd5\u56fd\u7684\u9996\u90fd\u662f\u54ea\u91cc\uff1f"),
                  (5, "forty-two!"), (6, "one ohm."), (7, "ohms forty twos"),
                  (8, "null ids are passages of their own as well says this one"), (9, "another, without id"),
                  (10, "x " * 70000 + "forty two"), (11, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.begin, r.end, r.edits) for r in dc.find(docs, bench).collect()), key=str)
    pairs = {(d, i) for d, i, *_ in got}
    assert pairs == {(1, 1), (2, 1), (4, 2), (5, 3), (6, 4), (8, None), (9, None), (10, 3)}
    assert (1, 1, 10, 43, 0) in got and (6, 4, 4, 7, 0) in got and (10, 3, 140000, 140009, 0) in got
    assert {r.doc_id for r in dc.clean(docs, bench).collect()} == {3, 7, 11}
