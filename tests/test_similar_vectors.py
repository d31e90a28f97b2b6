import datetime as dt

import numpy as np

from lectern.operators.similar_vectors import _top, latest_valid, pack, pairs_of, similar_vectors, unpack

SCHEMA = "id string, at timestamp, dense array<float>"


def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_packing_keeps_cosines(spark):
    import pandas as pd

    x = np.random.default_rng(0).normal(size=(200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    back = unpack(pd.Series(pack(x)), 64)
    assert np.abs(x @ x.T - back @ back.T).max() < 5e-4


def test_the_greatest_of_each_row():
    rng = np.random.default_rng(1)
    for width in (3, 511, 2047, 2048, 2600, 5000):
        cos = np.round(rng.normal(size=(40, width)), 2).astype(np.float32)  # many ties, which go to the lower column
        for k, least in ((5, -9.0), (5, 2.5), (1, -9.0), (600, 0.0)):
            row, col = _top(cos, k, least)
            want = [(i, j) for i in range(40) for j in np.lexsort((np.arange(width), -cos[i]))[:k] if cos[i, j] >= least]
            assert list(zip(row.tolist(), col.tolist(), strict=True)) == [(i, int(j)) for i, j in want]


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(120, 64))
    x = np.repeat(centre, 15, axis=0) + rng.normal(size=(1800, 64)) * 0.35
    rows = [(f"v{i:05}", day(0), [float(a) for a in row]) for i, row in enumerate(x)]
    got = {tuple(r) for r in pairs_of(similar_vectors(spark.createDataFrame(rows, SCHEMA), 64, 5, 0.85, bucket=100)).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    best = np.argsort(-cos, axis=1)[:, :5]
    true = {tuple(sorted((rows[i][0], rows[j][0]))) for i in range(len(x)) for j in best[i] if cos[i, j] >= 0.85}
    assert len(true & got) / len(true) >= 0.9
    assert len(true & got) / len(got) >= 0.97


def test_only_the_latest_valid_vector_counts(spark):
    nan = float("nan")
    v = [1.0] + [0.0] * 63
    rows = [
        ("a", day(2), v), ("a", day(1), [0.0, 1.0] + [0.0] * 62), ("a", day(2), v), ("b", day(1), v), ("b", day(3), None), ("c", day(1), [0.0] * 64),
        ("d", day(1), v[:63]), ("e", day(1), [nan] * 64), ("f", None, v), (None, day(1), v), ("g", day(1), [2.0] + [0.0] * 63), ("h", day(1), []),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    assert {r["id"] for r in latest_valid(frame, 64).collect()} == {"a", "f", "g"}
    assert {tuple(r) for r in pairs_of(similar_vectors(frame, 64, 5, 0.85)).collect()} == {("a", "f"), ("a", "g"), ("f", "g")}


def test_ties_empty_tables_and_clashing_columns(spark):
    assert similar_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert similar_vectors(spark.createDataFrame([("a", day(0), [1.0] * 64)], SCHEMA)).count() == 0
    rows = [(f"t{i}", day(0), [1.0] * 64, i, b"x") for i in range(9)]
    out = similar_vectors(spark.createDataFrame(rows, SCHEMA + ", n int, packed binary"), 64, 5, 0.85).collect()
    assert len(out) == 45
    assert all(r["id"] != r["neighbour"] for r in out)


def test_a_hot_code_is_divided(spark, monkeypatch):
    from lectern.operators import similar_vectors as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rows = [(f"h{i:04}", day(0), [1.0] * 64) for i in range(300)]
    out = module.similar_vectors(spark.createDataFrame(rows, SCHEMA), 64, 3, 0.9).groupBy("id").count().collect()
    assert len(out) >= 290
    assert all(r["count"] == 3 for r in out)


def brute_force(x, k, least):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = x @ x.T
    np.fill_diagonal(cos, -2)
    best = np.argsort(-cos, axis=1)[:, :k]
    return {(i, int(j)) for i in range(len(x)) for j in best[i] if cos[i, j] >= least}


def test_recall_holds_with_long_substrings(spark):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(900, 64)), 2, axis=0) + rng.normal(size=(1800, 64)) * 0.38
    rows = [(str(i), day(0), [float(a) for a in row]) for i, row in enumerate(x)]
    got = {(int(r["id"]), int(r["neighbour"])) for r in similar_vectors(spark.createDataFrame(rows, SCHEMA), 64, 1, 0.8, bucket=1).collect()}
    true = brute_force(x, 1, 0.8)
    assert len(true & got) / len(true) >= 0.9


def test_all_rows_of_a_large_bucket_meet(spark, monkeypatch):
    from lectern.operators import similar_vectors as module

    monkeypatch.setattr(module, "BLOCK", 16)
    rng = np.random.default_rng(5)
    x = rng.normal(size=64) + rng.normal(size=(400, 64)) * 0.05
    rows = [(str(i), day(0), [float(a) for a in row]) for i, row in enumerate(x)]
    got = {(int(r["id"]), int(r["neighbour"])) for r in module.similar_vectors(spark.createDataFrame(rows, SCHEMA), 64, 5, 0.9).collect()}
    true = brute_force(x, 5, 0.9)
    assert len(true & got) / len(true) >= 0.98  # ranks beyond the precision of packed vectors may swap


def test_copies_are_complete_and_leave_room_for_no_others(spark):
    v, w = [1.0] * 64, [1.0] * 63 + [1.1]
    rows = [(f"v{i:03}", day(0), v) for i in range(40)] + [("w", day(0), w)]
    out = similar_vectors(spark.createDataFrame(rows, SCHEMA), 64, 3, 0.9).collect()
    assert len(out) == 41 * 3
    assert len({(r["id"], r["neighbour"]) for r in out}) == len(out)
    assert all(r["neighbour"] != "w" and r["id"] != r["neighbour"] for r in out)
