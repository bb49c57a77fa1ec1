"""Language identification and toxicity: brute force for the search, held-out rows for the models."""

import random

import numpy as np
import pytest

from lurewatch.llm import language_id, queries, toxicity
from lurewatch.llm.common import letters

SF = "/root/testdata/sf0.01"


def test_letters():
    line, bounds = letters(["Ab  c!", None, "12", "é"])
    assert "".join(map(chr, line)) == " ab c  é "
    assert bounds.tolist() == [0, 6, 6, 6, 9]


def test_filter_against_sets():
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    masks = rng.integers(1, 8, (5000, 1)).astype(np.uint64)
    model = language_id.Model(["a", "b", "c"], hashes, masks, 0)
    got = model.masks(hashes)
    assert ((got & masks) == masks).all()
    strange = model.masks(rng.integers(0, 1 << 63, 200000).astype(np.uint64))
    for j in range(3):
        rate = model._has(strange, j).mean()
        assert rate < 0.02 and abs(rate - model.false[j]) < 0.005


def test_many_languages():
    n = 150
    hashes = language_id.grams(np.arange(97, 97 + n + 1, dtype=np.uint32), 2)
    masks = np.zeros((n, 3), np.uint64)
    for k in range(n):
        masks[k, k // 64] = np.uint64(1) << np.uint64(k % 64)
    model = language_id.Model([f"l{k}" for k in range(n)], hashes, masks, 0)
    assert model.predict(["  ab"])[0] == ["l0"]


def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    got = queries.op3(spark, SF).join(docs, "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, table):
    rows = [(i, " ".join(random.Random(i).choices(["the", "and", "of", "with"], k=20)), "en")
            for i in range(30)]
    rows += [(100 + i, " ".join(random.Random(i).choices(["der", "und", "nicht", "von"], k=20)), "de")
             for i in range(30)]
    rows += [(None, "the of", None), (200, None, "xx"), (201, "12 !", None), (202, "", None),
             (203, "яблоко", None), (204, "und " * 20000, None), (204, "und " * 20000, None)]
    docs = table([(*r, "lang_pred") for r in rows],
                 "doc_id long, text string, lang string, score string")
    model = language_id.learn(docs)
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(docs, model).collect()]
    by = {i: (p, s) for i, p, s in got}
    assert by[None][0] == "en" and by[204][0] == "de" and by[203] == ("de", 0.0)
    assert by[200] == by[201] == by[202] == ("und", 0.0) and len(got) == len(rows)
    empty = language_id.learn(docs.where("false"))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}
    assert language_id.predict(docs.where("false"), model).count() == 0


def test_nearest_equals_brute_force():
    rng = np.random.default_rng(4)
    n, size = 700, 60
    cells = rng.random((n, size)) < 0.08
    cells[300:360] = cells[300]
    row, term = np.nonzero(cells)
    count = rng.integers(1, 4, len(row))
    count[np.isin(row, range(300, 360))] = 1
    index = toxicity.Index(np.arange(size, dtype=np.uint64), row, term, count, np.arange(n) * 3,
                           (rng.random(n) < 0.3).astype(int), np.ones(n))
    dense = np.zeros((n, size))
    place = {i: k for k, i in enumerate(index.ids)}
    dense[[place[i * 3] for i in row], term] = (1 + np.log(count)) * index.idf[term]
    norm = np.sqrt((dense ** 2).sum(axis=1, keepdims=True))
    dense = dense / np.where(norm == 0, 1, norm)
    for trial in range(200):
        own = np.unique(rng.integers(0, size, rng.integers(1, 9)))
        weight = index.query(own, rng.integers(1, 5, len(own)))
        cosine = dense[:, own] @ weight
        want = np.lexsort((np.arange(n), -np.round(cosine, 9)))[:toxicity.K]
        want = want[cosine[want] > 1e-12]
        got, found = index.nearest(own, weight)
        assert np.allclose(found, cosine[want])
        assert np.allclose(cosine[got], found)


def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    got = queries.op5(spark, SF).join(labels, "doc_id").where("toxic IS NOT NULL").collect()
    fresh = [r for r in got if r.held_out]
    assert len(fresh) > 80
    assert sum((r.predicted == 1) == (r.toxic == 1) for r in fresh) / len(fresh) > 0.95
    bad = [r for r in fresh if r.toxic == 1]
    assert sum(r.predicted for r in bad) >= 0.7 * len(bad)
    assert all(0 <= r.score <= 1 for r in got)


def test_toxicity_edges(spark, table):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(60):
        words = rng.choices(["good", "day", "tree", "water", "house"], k=15)
        if i % 3 == 0:
            words += rng.choices(["vileness", "hateful"], k=3)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 0)))
    labels += [(5, None), (None, 1), (6, 1)]
    rows += [(100, "so hateful a day"), (101, None), (102, ""), (103, "good day"), (None, "vileness"),
             (104, "good " * 20000 + "hateful"), (104, "tree")]
    docs = table([(*r, 1) for r in rows], "doc_id long, text string, toxic int")
    marks = table([(*r, "x") for r in labels], "doc_id long, toxic int, text string")
    index = toxicity.learn(docs, marks)
    got = toxicity.score(docs, index).collect()
    by = {(r.doc_id, len(r.evidence) > 0): r for r in got}
    assert len(got) == len(rows)
    assert by[100, True].score > 0.7 and by[None, True].score > 0.7 and by[104, True].score > 0.7
    assert by[101, False].score == by[102, False].score < 0.3
    assert all(e.label == 1 for e in by[100, True].evidence)
    alone = toxicity.learn(docs, marks.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, alone).collect()} == {0.0}
    assert {r.score for r in toxicity.score(
        docs, toxicity.learn(docs, marks.where("false"))).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), index).count() == 0


def test_languages_of_rows_without_ids(spark):
    """Rows that share one id, or have none, are drawn one by one; and any number of languages is learned."""
    words = {"aa": "kala toma rika solo", "bb": "wren drift stolk brand"}
    rows = [(None if k % 2 else 5, f"{words[x]} {words[x].split()[k % 4]} {k % 97}", x) for x in words for k in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(8)
    model = language_id.learn(docs)
    asked = spark.createDataFrame([(1, "toma solo kala"), (2, "drift brand")], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score > 0.9) for r in language_id.predict(asked, model).collect()}
    assert got == {1: ("aa", True), 2: ("bb", True)}
    many = [(k, " ".join([chr(0x4e00 + k) * 3 + "x"] * 4), f"l{k:04d}") for k in range(1100) for _ in range(3)]
    model = language_id.learn(spark.createDataFrame(many, "doc_id long, text string, lang string"))
    assert len(model.languages) == 1100
    assert model.predict(["万万万x"])[0] == ["l0007"]
