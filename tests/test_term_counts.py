"""Words and pairs are counted once, per batch, and give both the cut of the vocabulary and its weights."""

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from lurewatch.operators import model
from lurewatch.plans import training

TEXTS = ["aa bb aa cc", "bb cc dd aa bb", "", "ee", "aa bb", "cc dd ee aa", "ff aa bb cc dd", "bb", "ee ff ee ff"] * 3


def listed(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, processed string").repartition(4)
    return model.PipelineModel(model.term_stages([])).transform(df)


def brute(max_terms, min_df, max_df):
    tf, df = Counter(), Counter()
    for t in TEXTS:
        w = t.split()
        terms = w + [" ".join(p) for p in zip(w, w[1:])]
        tf.update(terms)
        df.update(set(terms))
    low, high = (x if x >= 1 else x * len(TEXTS) for x in (min_df, max_df))
    inside = [t for t in tf if low <= df[t] <= high]
    return [(t, tf[t], df[t]) for t in sorted(inside, key=lambda t: (-tf[t], t))[:max_terms]]


def test_the_cut_equals_brute_force(spark):
    df = listed(spark)
    for case in ((4, 1, 1000), (3, 2, 0.4), (7, 4, 0.95), (100, 1, 1000), (6, 0.2, 0.5)):
        best, total = model.top_counts(df, *case)
        assert [tuple(r) for r in best] == brute(*case) and total == len(TEXTS)


def test_all_pairs_are_counted_where_too_many_words_tie(spark, monkeypatch):
    monkeypatch.setattr(model, "COMMON_WORDS", 1)
    assert [tuple(r) for r in model.top_counts(listed(spark), 4, 1, 1000)[0]] == brute(4, 1, 1000)


def test_a_batch_gives_one_row_a_term_and_only_pairs_of_common_words(spark):
    df = listed(spark).coalesce(1)
    pairs = model.term_counts(df, pa.array(["aa", "bb"]), pairs=True).select("term").collect()
    assert {r.term for r in pairs} == {"aa bb", "bb aa"}
    empty = model.term_counts(df.where(F.lit(False)), pairs=True)
    assert empty.count() == 0


def test_weights_follow_from_the_counts_and_the_stored_words_are_read(spark):
    mails = spark.createDataFrame(
        [(i, f"urgent verify {'account' if i % 2 else 'meeting'} notes", "", i % 2) for i in range(40)],
        "id bigint, body string, html string, class int")
    text_model, vectors = training.assemble(mails)
    weights = {r.term: r.weight for r in model.with_idf(text_model, spark).collect()}
    assert math.isclose(weights["account"], math.log(41 / 21) + 1) and "urgent" not in weights
    direct = model.assembler().transform(text_model.transform(model.model_columns(
        model.mail.featurize(mails)))).select("id", "features")
    assert {r.id: r.features for r in direct.collect()} == {r.id: r.features for r in vectors.select("id", "features").collect()}
