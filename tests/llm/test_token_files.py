import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lurewatch.llm import token_files as tf

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700),
       st.integers(0, 2**32))
def test_segment_round_trip(values, seed):
    ids = np.array(values, np.uint32)
    cuts = np.sort(np.random.default_rng(seed).integers(0, len(ids) + 1, 5))
    ends = np.append(cuts, len(ids)).astype(np.int64)
    seg = tf.Segment(tf.pack(ids, np.arange(6), np.zeros(6, bool), ends))
    assert (seg.ids() == ids).all()
    for k in range(6):
        begin = ends[k - 1] if k else 0
        assert (seg.document(k) == ids[begin:ends[k]]).all()


ODD = ["", " ", "don't  STOP\n\n3 words", "ΑΣ ΑΣ. Σ", "é ́x", "a b c\x1cd\x85e",
       "<|endoftext|> x<|startoftext|>y", "汉字 1234 ½ ß İ", "tab\tand\x0bvt", "\U0001f600 z" * 3,
       "x" * 3000, "l'été 'S 'll", " ́", "ᄀ ᅡᆨ"]


def test_word_by_word_equals_whole():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(" \n\t'aAé́s1½-<|>ΣİK ​汉") for _ in range(60))
                   for _ in range(300)]
    tokenizer = Tokenizer.from_file(PATH)
    for whole in (False, True, False):
        line, sizes = tf.encode(PATH, texts, whole)
        at = 0
        for text, n in zip(texts, sizes):
            assert tokenizer.encode(text, add_special_tokens=False).ids == line[at:at + n].tolist(), text
            at += n
        assert at == len(line)


def test_files_against_library(spark, table):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(ODD + ["word", "thing"]) for _ in range(rng.randrange(30))))
            for i in rng.sample(range(10**6), 300)]
    rows += [(None, "no id"), (7, None), (7, None), (8, ""), (9, "b"), (9, "a"), (10, "long " * 4000)]
    docs = table(rows, "doc_id long, text string")
    from lurewatch.session import shared_path

    path = shared_path(spark, "tokens")
    tf.write(docs, path, PATH, segment=500)
    got = sorted(map(tuple, tf.read(spark, path).collect()), key=lambda r: r[1])
    tokenizer = Tokenizer.from_file(PATH)
    want, at = {}, 0
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert [r[0] for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    for i, start, n, crc in got:
        assert start == at
        at += n
        want[i].remove((n, crc))
    assert not any(want.values())
    assert tf.round_trip(docs.where("false"), PATH).count() == 0
