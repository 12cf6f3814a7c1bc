import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediasift.llm import bpe
from mediasift.llm.queries import VOCABULARY

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
HARD = ["", " ", "  \n\t x", "it's we'LL don't", "<|endoftext|>", "naïve café ｆｕｌｌ", "🧑🏽‍🚀🙃", "日本語のテキスト", "a" * 3000, "ab" * 2000, "123456789 1e5", " ​﻿", "\x00\x01", "Ǆ ﬁ ﷺ", " " * 500 + "x", "\r\n\r\n"]


@pytest.fixture(scope="module")
def own():
    with open(VOCABULARY, "rb") as f:
        return bpe.BytePairEncoder(f.read())


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_those_of_the_public_library(own, reference):
    assert [own.encode(t) for t in HARD] == [x.ids for x in reference.encode_batch(HARD, add_special_tokens=False)]
    assert own.encode(None) == own.encode("") == []


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_any_text_comes_back(own, reference, text):
    ids = own.encode(text)
    assert own.decode(ids) == text and ids == reference.encode(text, add_special_tokens=False).ids


def test_merging_equals_the_plain_loop(own):
    for raw in (b"tokenization", b"mississippi", "überraschend".encode(), b"aaaaaaaaaaaaaaaaaaaaa"):
        s = [bytes([b]) for b in raw]
        while True:
            ranks = [(own.ids.get(a + b, 10**9), i) for i, (a, b) in enumerate(zip(s, s[1:]))]
            if not ranks or min(ranks)[0] == 10**9:
                break
            i = min(ranks)[1]
            s[i : i + 2] = [s[i] + s[i + 1]]
        assert list(own.merge(raw)) == [own.ids[x] for x in s]


def test_columns(spark):
    v = bpe.share(spark, VOCABULARY)
    df = spark.createDataFrame([(1, "hello world"), (2, ""), (3, None), (None, "x")], "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_corpus(df, "doc_id", "text", v).collect()}
    assert got[2] == got[3] == [] and len(got[1]) == 2 and len(got) == 4
    assert [r[0] for r in df.select(bpe.token_count(F.col("text"), v)).collect()] == [2, 0, 0, 1]
    assert [r[0] for r in df.select(bpe.decoded(bpe.token_ids(F.col("text"), v), v)).collect()] == ["hello world", "", "", "x"]
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text", v).count() == 0
