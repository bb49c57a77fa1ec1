"""Stages of the pipeline judge rows, not ids: null and repeated ids."""

import corpus_pipeline
from lurewatch.llm import common, decontaminate, minhash, queries
from lurewatch.llm.common import read

SF = "/root/testdata/sf0.01"
PASSAGE = "The passage of the benchmark that a document must not hold, word for word or nearly so."


def test_toxic_rows(spark):
    docs = read(spark, SF, "documents")
    judged = {r.doc_id: r.predicted for r in queries.op5(spark, SF).collect()}
    bad = [i for i, x in judged.items() if x][:2]
    good = [i for i, x in judged.items() if not x][:2]
    texts = {r.doc_id: r.text for r in docs.where(docs.doc_id.isin(bad + good)).collect()}
    rows = [(None, texts[bad[0]]), (None, texts[good[0]]), (7, texts[bad[1]]), (7, texts[good[1]])]
    mine = spark.createDataFrame(rows, "doc_id long, text string")
    marked = docs.select("doc_id", "text").unionByName(mine)
    got = corpus_pipeline.drop_toxic(spark, marked, SF).where(
        "doc_id IS NULL OR doc_id = 7").collect()
    assert {texts[good[0]]} == {r.text for r in got if r.doc_id is None}
    assert texts[good[1]] in {r.text for r in got} and texts[bad[1]] not in {r.text for r in got}


def test_benchmark_rows(table):
    docs = table([(None, PASSAGE, 1), (None, "clean text", 2), (7, PASSAGE, 3), (7, "other clean text", 4),
                  (None, None, 5)], "doc_id long, text string, item_id int")
    bench = table([(1, PASSAGE)], "item_id long, text string")
    got = decontaminate.clean(docs, bench)
    assert got.columns == docs.columns
    assert sorted(r.item_id for r in got.collect()) == [2, 4, 5]


def test_copies_among_null_ids(table):
    one, two, three = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    docs = table([(None, one, 1), (None, one, 2), (None, one + " more", 3), (None, two, 4), (9, three, 5),
                  (9, one, 6), (9, one, 7), (3, three, 8), (None, "", 9), (None, None, 10)],
                 "doc_id long, text string, _row int")
    got = [(r.doc_id, (r.text or "")[:2], r._row) for r in minhash.one_of_each(docs).collect()]
    assert sorted(x[:2] for x in got if x[0]) == [(3, "c0"), (9, "a0")]
    assert sorted(x[1] for x in got if x[0] is None) == ["", "", "a0", "b0"]


def test_stages_take_clashing_columns(spark, table):
    extra = ["_key", "_row", "_class", "mix_key", "mix_size", "mix_shards", "_c0", "c0", "key"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{c} int" for c in extra)
    line = [" ".join(f"{x}{k}" for k in range(40)) for x in "abcd"]
    rows = [(i, line[i % 4], "s", *range(i, i + len(extra))) for i in range(12)] + [(None, None, None, *extra_of(extra))]
    docs = table(rows, schema)
    kept = corpus_pipeline.drop_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    found = sorted(map(tuple, kept.where("doc_id IS NOT NULL").collect()))
    assert found == sorted(rows[:4])
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    assert mixed.columns == docs.columns and {tuple(r) for r in mixed.collect()} <= set(rows)
    out = corpus_pipeline.token_output(spark, mixed, SF)
    assert out.count() == mixed.count()


def extra_of(extra):
    return [None] * len(extra)


def test_reading_bounds_arrow_batches(spark, tmp_path):
    key = common.BATCH
    spark.range(3).write.parquet(str(tmp_path / "t.parquet"))
    before = spark.conf.get(key)
    try:
        for given, want in (("64m", str(common.BATCH_BYTES)), ("1m", "1m"), ("67108864b", str(common.BATCH_BYTES))):
            spark.conf.set(key, given)
            assert common.read(spark, str(tmp_path), "t").count() == 3
            assert spark.conf.get(key) in (want, "1048576b", want + "b")
    finally:
        spark.conf.set(key, before)
