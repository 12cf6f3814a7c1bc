import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mediasift.llm import same_look as S

ALIKE = [
    ("café", "café"), ("Ｔｈｅ　１２", "The 12"), ("zero​width﻿", "zerowidth"), ("a b c d　e", "a b c d e"), ("ﬁne", "fine"),
    ("раss", "pass"), ("Οο", "Oo"), ("so­ft", "soft"), ("a‑b‐c", "a-b-c"), ("й", "й"), ("ё", "ë"), ("デ", "デ"), ("ﾃﾞ", "デ"),
    ("각", "각"), ("a\r\nb\rc\u0085d e", "a\nb\nc\nd\ne"), ("Å", "Å"), ("e‍́", "é"), ("á̧", "á̧"), ("МАХ", "MAX"),
]
DIFFERENT = [("e", "é"), ("e", "E"), ("é", "è"), ("x2", "x²"), ("1", "l"), ("0", "O"), ("a b", "a  b"), ("a\tb", "a b"), ("a\nb", "a b"), ("-", "–"), ("'", "’"), ("½", "1/2"), ("д", "d"), ("", " ")]


@pytest.mark.parametrize("a, b", ALIKE)
def test_alike(a, b):
    assert S.same_look(a) == S.same_look(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(a, b):
    assert S.same_look(a) != S.same_look(b)


def whole(text):
    """All characters, without quick check and segments."""
    for end in S.LINES:
        text = text.replace(end, "\n")
    return unicodedata.normalize("NFC", "".join(map(S._plain, text)))


CHARS = st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aeio \r\ņ́̈​ Ａаο각デﬁ­")), max_size=40)


@settings(max_examples=1500, deadline=None)
@given(CHARS)
def test_segments_equal_the_whole_text(text):
    assert S.same_look(text) == whole(text)
    assert S.same_look(S.same_look(text)) == S.same_look(text)


def test_skipped_blocks_are_steady():
    assert S._pattern([]).pattern == S.unstable_runs().pattern


def test_columns_and_pairs(spark):
    rows = [(1, "café"), (2, "café"), (3, "cafe"), (4, None), (5, ""), (6, "café"), (7, "саfé"), (None, "café​"), (8, "plain"), (9, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("clash"), "t": F.lit(1), "a": F.lit(2)})
    got = [r[0] for r in df.select(S.canonical(F.col("text"))).collect()]
    assert got == [None if t is None else S.same_look(t) for _, t in rows]
    pairs = {(r["a"], r["b"]) for r in S.look_alikes(df, "doc_id", "text").collect()}
    assert pairs == {(1, 2), (1, 6), (1, 7), (2, 7), (6, 7)}
    assert S.look_alikes(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("n, m", [(20, 20), (2000, 2000), (1, 3000)])
def test_copies_are_paired_the_same_way_at_every_size(spark, n, m):
    df = spark.createDataFrame([(i, "abc") for i in range(n)] + [(10_000 + i, "аbc") for i in range(m)], "doc_id long, text string")
    assert {(r["a"], r["b"]) for r in S.look_alikes(df, "doc_id", "text").collect()} == {(0, 10_000 + i) for i in range(m)} | {(i, 10_000) for i in range(n)}


def test_many_spellings_and_a_hot_text_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "SPELLINGS", 7)  # many parts
    marks = ["\u200b" * i for i in range(1, 31)]
    rows = [(i, "abc") for i in range(900)] + [(5000 + i, "abc" + m) for i, m in enumerate(marks)] + [(6000, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = [(r["a"], r["b"]) for r in S.look_alikes(df, "doc_id", "text").collect()]
    want = {(i, 5000 + j) for i in range(900) for j in range(30)} | {(5000 + i, 5000 + j) for i in range(30) for j in range(i + 1, 30)}
    assert set(pairs) == want and len(pairs) == len(want)
    classes = {r["doc_id"]: (r["look"], r["n_rows"], r["n_texts"]) for r in S.look_classes(df.withColumn("look", F.lit("clash")), "doc_id", "text").collect()}
    assert classes == {i: (0, 930, 31) for i, _ in rows[:-1]} | {6000: (6000, 1, 1)}
    assert S.look_classes(df.limit(0), "doc_id", "text").count() == 0
