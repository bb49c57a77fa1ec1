"""The registered queries on given tables: their SQL, or the same result computed row by row."""

import hashlib
import importlib.util
import os
import re
from collections import defaultdict
from html import unescape

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lurewatch.llm import minhash, queries
from tests.llm.test_minhash import brute

SF = "/root/testdata/sf0.001"
_path = os.path.join(os.path.dirname(__file__), "..", "..", "tools", "check.py")
_spec = importlib.util.spec_from_file_location("check", _path)
check = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(check)


@pytest.fixture(scope="module")
def con():
    return check.duck(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, con, name):
    assert check.compare(queries.QUERIES[name](spark, SF), con, queries.ORACLE[name]) == []


def test_chat(spark, con):
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    talks = defaultdict(list)
    for conv, turn, role, text in [*rows, *queries.CONTROL_TURNS]:
        talks[conv].append((turn, role or "", text or ""))
    got = {r.conv_id: r for r in queries.op1(spark, SF).collect()}
    assert got.keys() == talks.keys()
    for conv, turns in talks.items():
        turns.sort()
        every = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256(every.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted_chars > sum(len(t) for _, _, t in turns)


def test_pages(spark, con):
    for r in queries.op2(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet")
                                         .select("page_id", "html"), "page_id").collect():
        article = r.html.split("<article>")[1].split("</article>")[0]
        parts = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", " ", p))).strip()
                 for p in re.split(r"</?(?:p|h1|li|ul)>", article)]
        assert r.text == "\n".join(p for p in parts if p) and r.n_chars == len(r.text)


def test_pipeline(spark):
    SF = "/root/testdata/sf0.01"  # noqa: N806
    con = check.duck(SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    toxic = {i for i, in con.execute("SELECT doc_id FROM labels WHERE toxic = 1").fetchall()}
    clean = {i for i, in con.execute("SELECT doc_id FROM labels WHERE toxic = 0").fetchall()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "mixing",
                            "token_output"]

    def step(name, df):
        out = stages[name](spark, df, SF)
        path = f"{spark.conf.get('spark.checkpoint.dir')}/test-{name}-{os.getpid()}"
        out.write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    one = step("toxicity", docs)
    kept = {r.doc_id for r in one.collect()}
    assert one.columns == columns
    assert kept == {r.doc_id for r in queries.op5(spark, SF).where("predicted = 0").collect()}
    assert len(kept & toxic) <= 0.25 * len(toxic) and len(kept & clean) >= 0.99 * len(clean)
    two = step("minhash_near_dedup", one)
    classes = brute([(i, texts[i]) for i in kept], 5)
    assert two.columns == columns
    assert sorted(r.doc_id for r in two.collect()) == sorted(i for i in kept if classes[i][2])
    three = step("benchmark_decontamination", two)
    norm = lambda t: re.sub(r"[\W_]+", " ", t.lower()).strip()
    passages = [norm(t) for t, in con.execute("SELECT text FROM benchmark").fetchall()]
    clean_now = {i for i in kept if classes[i][2] and not any(p in norm(texts[i]) for p in passages)}
    assert three.columns == columns and {r.doc_id for r in three.collect()} == clean_now
    four = step("mixing", three)
    mixed = [r.doc_id for r in four.collect()]
    assert four.columns == columns and set(mixed) <= clean_now
    assert max(mixed.count(i) for i in set(mixed)) <= 3
    size = lambda ids: sum(len(texts[i].split()) for i in ids)
    assert abs(size(mixed) - size(clean_now)) < 0.02 * size(clean_now)
    five = step("token_output", four).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at = 0
    for r, i in zip(sorted(five, key=lambda r: r.start), sorted(mixed)):
        assert (r.doc_id, r.start) == (i, at)
        assert r.n_tokens == len(tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1
        at += r.n_tokens
    assert len(five) == len(mixed)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, five))


def test_defaults_are_used():
    assert minhash.classes.__defaults__[:2] == (5, 80)
