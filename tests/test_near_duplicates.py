import itertools
import random

import pytest

from lectern.functions.words import words_of
from lectern.operators import near_duplicates as module
from lectern.operators.near_duplicates import near_duplicates, radius

SCHEMA = "kind string, id string, text string"


def similarity(a, b, run):
    sets = [{tuple(w[i : i + run]) for i in range(len(w) - run + 1)} for w in (words_of(a), words_of(b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if all(sets) else 0.0


def brute(rows, run, threshold):
    unique = {(k, i): t for k, i, t in rows if t is not None and i is not None}
    pairs = set()
    for (ka, a), (kb, b) in itertools.combinations(sorted(unique), 2):
        if ka == kb and similarity(unique[ka, a], unique[kb, b], run) >= threshold:
            pairs.add((ka, a, b))
    return pairs


def found(spark, rows, run, threshold):
    result = near_duplicates(spark.createDataFrame(rows, SCHEMA), run, threshold).pairs().collect()
    assert len(result) == len(set(result))
    return {tuple(r) for r in result}


@pytest.mark.parametrize(("run", "threshold"), [(3, 0.7), (5, 0.8)])
def test_equals_brute_force_with_edits_and_a_hot_group(spark, run, threshold):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for v in range(rng.randint(1, 4)):
            own = list(base)
            for _ in range(v):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [rng.choice(words)] * rng.randint(0, 2)
            rows.append(("chunk", f"{g:03}-{v}", " ".join(own)))
    hot = [rng.choice(words) for _ in range(80)]
    for v in range(90):  # more than a leaf holds
        own = list(hot)
        own[v % 80] = f"x{v}"
        rows.append(("chunk", f"hot-{v:03}", " ".join(own)))
    rows += [("doc", "copy-a", " ".join(hot)), ("doc", "copy-b", " ".join(hot).upper())]
    assert found(spark, rows, run, threshold) == brute(rows, run, threshold)


@pytest.mark.parametrize(("part", "small"), [(8, 3), (24, 4)])
def test_a_hot_shard_is_divided_without_loss(spark, monkeypatch, part, small):
    monkeypatch.setattr(module, "PART", part)
    monkeypatch.setattr(module, "SMALL", small)
    monkeypatch.setattr(module, "FLUSH", 50)
    rng = random.Random(3)
    base = [f"w{rng.randrange(500)}" for _ in range(90)]
    rows = []
    for v in range(140):  # copies of one text with one to nine edits: a bucket of several rings
        own = list(base)
        for _ in range(1 + v % 9):
            own[rng.randrange(90)] = f"x{rng.randrange(60)}"
        rows.append(("chunk", f"h{v:03}", " ".join(own)))
    assert found(spark, rows, 3, 0.7) == brute(rows, 3, 0.7)


def test_the_plan_is_short(spark):
    plan = near_duplicates(spark.createDataFrame([("k", "a", "x y z q")], SCHEMA), 3, 0.7).links._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 20


def test_nulls_short_texts_and_repeats(spark):
    long = " ".join(f"t{i % 977}" for i in range(30_000))
    rows = [
        ("chunk", "a", "one two three four five"), ("chunk", "a", "one two three four five"), ("chunk", "b", "One, two; three FOUR five!"),
        ("chunk", "c", None), ("chunk", "d", ""), ("chunk", "e", "one two"), ("chunk", "f", "one two"), ("chunk", None, "one two three four five"),
        ("doc", "a", "one two three four five"), ("doc", "l1", long), ("doc", "l2", long + " end"),
    ]
    assert found(spark, rows, 3, 0.7) == {("chunk", "a", "b"), ("doc", "l1", "l2")}


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, [], 3, 0.7) == set()
    rows = spark.createDataFrame([("k", "a", "x y z q", 1, "p"), ("k", "b", "x y z q", 2, "p")], SCHEMA + ", size int, class string")
    done = near_duplicates(rows, 3, 0.7)
    assert {tuple(r) for r in done.pairs().collect()} == {("k", "a", "b")}
    assert {(r["id"], r["class"], r["copies"], r["links"]) for r in done.groups().collect()} == {("a", "a", 2, 0), ("b", "a", 2, 0)}


def test_the_radius_grows_as_the_threshold_falls():
    assert radius(0.9) < radius(0.8) < radius(0.7) < 256
