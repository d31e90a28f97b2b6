import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.operators.packing import _Containers, fill, hilbert_keys, pack


def test_the_curve_visits_every_cell_and_steps_to_neighbours():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * dims, indexing="ij"), -1).reshape(-1, dims)
        keys = hilbert_keys(cells, bits)
        assert sorted(keys) == list(range(side**dims))
        along = cells[np.argsort(keys)]
        assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_containers_never_overflow(sizes):
    box = _Containers(50, 0)
    used = {}
    for s in sizes:
        n = box.put(s)
        used[n] = used.get(n, 0) + s
        assert used[n] <= 50
    assert sum(used.values()) == sum(sizes)


SCHEMA = "doc string, idx int, text string, tokens int, curve long"


def test_every_item_is_packed_once_and_only_large_ones_are_split(spark):
    rows = [("d", i, "word " * (i % 40 + 1), 0, 5) for i in range(500)] + [("d", 900, "y" * 1003, 0, 0), ("d", 901, "z" * 400, 0, 0), ("d", 902, "z" * 403, 0, 0), ("d", 903, "z" * 404, 0, 0)]
    rows += [("d", 1, "word " * 2, 0, 5), ("e", 0, None, None, None), ("e", 1, "", 0, 0)]
    packed = pack(spark.createDataFrame(rows, SCHEMA), ["doc", "idx"], 100).toPandas()
    whole = packed[packed.pieces == 1]
    assert len(whole) == 500 + 2 + 2
    assert set(packed[packed.pieces > 1].idx) == {900, 903}
    big = packed[packed.idx == 900].sort_values("piece")
    assert big[["char_start", "char_end"]].to_numpy().tolist() == [[0, 400], [400, 800], [800, 1003]]
    assert big.tokens.tolist() == [100, 100, 50]
    assert packed.groupby("container").tokens.sum().max() <= 100
    assert not packed.duplicated(["doc", "idx", "piece"]).any()


def test_little_room_is_left(spark):
    rng = np.random.default_rng(0)
    rows = [("d", i, "x" * int(4 * n), 0, 0) for i, n in enumerate(rng.integers(20, 400, 3000))]
    packed = pack(spark.createDataFrame(rows, SCHEMA), ["doc", "idx"], 1024)
    assert fill(packed, 1024).first()["filled"] >= 0.97


def test_equal_items_empty_tables_and_bad_capacity(spark):
    empty = pack(spark.createDataFrame([], SCHEMA), ["doc", "idx"], 10)
    assert empty.count() == 0
    assert fill(empty, 10).first()["containers"] == 0
    same = pack(spark.createDataFrame([("d", i, "same text here", 0, 0) for i in range(300)], SCHEMA), ["doc", "idx"], 9)
    assert same.groupBy("container").sum("tokens").agg({"sum(tokens)": "max"}).first()[0] <= 9
    assert same.count() == 300
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([], SCHEMA), ["doc", "idx"], 0)


def test_null_keys_are_keys(spark):
    rows = [("d", None, "one text", 0, 0), ("d", None, "one longer text", 0, 0), (None, 1, "x" * 100, 0, 0), (None, 1, "x" * 100, 0, 0)]
    packed = pack(spark.createDataFrame(rows, SCHEMA), ["doc", "idx"], 10).collect()
    assert sorted((str(r["doc"]), str(r["idx"]), r["piece"], r["char_end"]) for r in packed) == [("None", "1", 0, 40), ("None", "1", 1, 80), ("None", "1", 2, 100), ("d", "None", 0, 15)]


def test_items_of_a_container_lie_near_each_other_on_the_curve(spark):
    rng = np.random.default_rng(2)
    topics = [[f"t{k}w{i}" for i in range(12)] for k in range(40)]
    rows = [("d", i, " ".join(rng.choice(topics[i % 40], 24)), 0, 0) for i in range(4_000)]
    packed = pack(spark.createDataFrame(rows, SCHEMA).repartition(1), ["doc", "idx"], 200).toPandas()
    topic = packed["idx"] % 40
    same = lambda boxes: topic.groupby(boxes).agg(lambda x: (x.value_counts() ** 2).sum() / len(x) ** 2).mean()  # noqa: E731 — share of pairs of one topic
    assert same(packed["container"].to_numpy()) > 1.5 * same(rng.permutation(packed["container"].to_numpy()))
