"""The queries on the smallest tables, against SQL where it can express them, and against brute force where it can't."""

import os

import pytest

from mediasift.llm import queries as Q
from tests.oracle import connect, same

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_query_equals_sql(spark, con, name):
    same(spark, con, Q.QUERIES[name], Q.ORACLES[name], FOLDER)


def test_only_tokens_have_no_sql():
    assert set(Q.QUERIES) - set(Q.ORACLES) == {"p7_ids", "p8_found", "p8_shares", "p8_mixture"}


def test_tokens_and_what_is_mixed_of_them(spark, con):
    """Ids give the texts back; the mixture's figures follow from the numbers of ids, in exact fractions."""
    from collections import Counter
    from fractions import Fraction

    from mediasift.llm.bpe import BytePairEncoder

    with open(Q.VOCABULARY, "rb") as f:
        words = BytePairEncoder(f.read()).texts
    ids = {r["doc_id"]: r["ids"] for r in Q.p7_ids(spark, FOLDER).collect()}
    docs = con.sql("SELECT doc_id, coalesce(text, ''), source FROM documents").fetchall()
    assert set(ids) == {d for d, _, _ in docs} and all(b"".join(words[i] for i in ids[d]).decode() == t for d, t, _ in docs)
    plan = {s: (Fraction(repr(w)), m) for s, w, m in con.sql("SELECT * FROM source_weights").fetchall()}
    tokens = Counter()
    for d, _, s in docs:
        if s in plan:
            tokens[s] += len(ids[d])
    total = sum(tokens.values())
    short = {s for s, (w, m) in plan.items() if tokens[s] * m < w * total}
    assert {r["source"] for r in Q.p8_found(spark, FOLDER).collect()} == short
    report = {r["source"]: r for r in Q.p8_shares(spark, FOLDER).collect()}
    assert set(report) == set(plan) and all(report[s]["tokens"] == tokens[s] and report[s]["reachable"] == (s not in short) for s in plan)
    mixed = Counter()
    for r in Q.p8_mixture(spark, FOLDER).collect():
        assert r["tokens"] == len(ids[r["doc_id"]]) > 0 and 1 <= r["copies"] <= plan[r["source"]][1]
        mixed[r["source"]] += r["tokens"] * r["copies"]
    assert all(report[s]["mixed_tokens"] == mixed[s] for s in plan) and abs(sum(r["actual_share"] for r in report.values()) - 1) < 1e-9
    assert all(mixed[s] == tokens[s] * plan[s][1] for s in short)
    assert all(abs(report[s]["raked_tokens"] - float(plan[s][0] * total)) < 1e-3 for s in set(plan) - short)


def test_pair_columns_are_ordered(spark):
    for name in ("p1_found", "p3_found", "p9_found"):
        assert all(r[0] < r[1] for r in Q.QUERIES[name](spark, FOLDER).collect())
