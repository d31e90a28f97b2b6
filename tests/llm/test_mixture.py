import os

import pytest

from lectern.llm import mixture as M

if not os.path.exists(M.TOKENIZER):
    pytest.skip("the vocabulary file is not here", allow_module_level=True)

DOCS = "doc_id long, source string, text string"
TARGETS = "source string, target_share double, max_repeats int"


def mix(spark, docs, targets, total=None):
    chosen, shares = M.mixture(spark.createDataFrame(docs, DOCS), spark.createDataFrame(targets, TARGETS), total)
    return {r["doc_id"]: r for r in chosen.collect()}, {r["source"]: r for r in shares.collect()}


def docs(n, source, start, words=20):
    return [(start + i, source, " ".join(["word"] * (words + i % 5))) for i in range(n)]


def test_shares_are_reached(spark):
    rows = docs(400, "Big Source", 0) + docs(300, "big_source ", 1000) + docs(60, "small", 5000) + docs(5, "other", 9000)
    chosen, shares = mix(spark, rows, [("big_source", 0.6, 1), ("small", 0.4, 3), ("absent", 0.2, 4)])
    assert shares["absent"]["documents"] == 0 and shares["absent"]["wanted_share"] == 0
    assert shares["big_source"]["actual_share"] == pytest.approx(0.6, abs=0.02)
    assert shares["small"]["actual_share"] == pytest.approx(0.4, abs=0.02)
    assert max(r["repeats"] for r in chosen.values()) <= 3
    assert not any(i >= 9000 for i in chosen)
    for s in shares.values():
        own = [r for r in chosen.values() if r["source"] == s["source"]]
        assert sum(r["tokens"] * r["repeats"] for r in own) == s["used"] <= s["budget"]
        most = max((r["tokens"] for r in own), default=0)
        assert s["budget"] - s["used"] <= most  # what is left is less than a document


def test_larger_mixes_contain_smaller_ones(spark):
    rows = docs(300, "a", 0) + docs(300, "b", 1000)
    targets = [("a", 0.5, 2), ("b", 0.5, 2)]
    small, _ = mix(spark, rows, targets, 4000)
    large, shares = mix(spark, rows, targets, 16000)
    assert all(large[i]["repeats"] >= r["repeats"] for i, r in small.items())
    assert sum(s["used"] for s in shares.values()) == pytest.approx(16000, rel=0.02)
    most, shares = mix(spark, rows, targets, 10**9)  # more than there is: the caps hold
    assert {r["repeats"] for r in most.values()} == {2} and len(most) == 600


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, "a", "some text"), (1, "a", "some text"), (2, None, "x"), (3, "a", None), (4, "a", ""), (None, "a", "x"), (5, "a", "word " * 30_000)]
    chosen, shares = mix(spark, rows, [("a", 1.0, 1), (None, 0.5, 1), ("A ", 0.0, None)])
    assert set(chosen) == {1, 5} and shares["a"]["actual_share"] == 1.0
    chosen, shares = mix(spark, [], [("a", 1.0, 1)])
    assert chosen == {} and shares["a"]["used"] == 0
    assert mix(spark, rows, [])[0] == {}
