"""What Python workers hold while other stages run."""

import re

import numpy as np
import public_tokenizers
import pyarrow as pa

from lurewatch.llm import common, minhash, token_files, toxicity

PATH = public_tokenizers.path("word_bpe_49k.json")


def held() -> int:
    """MB of this process, without mapped files."""
    with open("/proc/self/smaps_rollup") as rollup:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", rollup.read()))) >> 10


def test_workers_drop_what_an_earlier_stage_kept(spark, table):
    docs = table([(i, f"word{i} of a text") for i in range(400)], "doc_id long, text string", 16)
    assert token_files.round_trip(docs, PATH).count() == 400

    def probe(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([token_files._words.cache_info().currsize])], names=["n"])

    assert {r.n for r in docs.mapInArrow(common.lean(probe), "n long").collect()} == {0}


def test_a_stage_keeps_its_own_words(monkeypatch):
    class Task:
        stage = 1

        def get(self):
            return self

        def stageId(self):
            return self.stage

    task = Task()
    monkeypatch.setattr(common, "TaskContext", task)
    monkeypatch.setattr(common, "_last_stage", [None])

    def run(batches):
        for batch in batches:
            yield token_files.encode(PATH, batch)[0].tolist()

    token_files._words.cache_clear()
    got = [list(common.lean(run)([["some words"], ["some"]])) for _ in range(2)]
    assert got[0] == got[1] and token_files._words.cache_info().misses == 1
    task.stage = 2
    assert list(common.lean(lambda batches: batches)([])) == [] and token_files._words.cache_info().currsize == 0
    assert len(common._powers[0]) == 1
    assert list(common.lean(run)([["some words"], ["some"]])) == got[0]


def test_operators_run_lean(spark, table, monkeypatch):
    seen = []
    for module in (minhash, token_files, toxicity):
        monkeypatch.setattr(module, "lean", lambda run: seen.append(run.__module__) or run)
    docs = table([(i, f"a b c {i} words") for i in range(9)], "doc_id long, text string")
    labels = table([(i, i % 2) for i in range(9)], "doc_id long, toxic int")
    assert minhash.classes(docs).count() == token_files.round_trip(docs, PATH).count() == 9
    assert toxicity.below(docs, toxicity.learn(docs, labels), 2.0).count() == 9
    assert [seen.count(m.__name__) for m in (minhash, token_files, toxicity)] == [2, 2, 3]


def test_shingles_of_many_texts_leave_little_memory():
    texts = pa.array([" ".join(f"w{k * 7919 % 5003}" for k in range(i, i + 400)) for i in range(2000)])
    run = common.lean(lambda batches: (sizes for b in batches for _, _, sizes in minhash.shingle_sets(b, 5)))
    common._forget_ladder()
    common.give_back()
    before = held()
    assert np.concatenate(list(run([texts]))).sum() > 700_000
    assert held() - before < 16
