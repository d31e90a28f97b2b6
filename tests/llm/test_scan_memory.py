import glob
import random
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern import tables
from lectern.llm import scans as S

WORDS = "harbour board keeps every sworn barge outer quay weeks decides return owner lighter culvert permit estate lantern clerk market register".split()


def texts(n, words):
    rng = random.Random(5)
    line = lambda: " ".join(rng.choice(WORDS) + rng.choice(["", "", "", f"-{rng.choice(WORDS)}"]) for _ in range(9))
    return [(f"t{i:03}", "\n".join([line() + rng.choice(["", " ware-"]) for _ in range(words // 9)] + ["house end"]), "") for i in range(n)]


def batches(rows):
    columns = [pa.array(c, pa.string()) for c in zip(*rows, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "markdown", "title"])


def test_groups_of_tokens_are_small(spark):
    docs = spark.createDataFrame(texts(50, 18_000), "doc_id string, markdown string, title string").coalesce(1)
    S.find(docs)
    newest = max(glob.glob(tables.shared_dir(spark).removeprefix("file://") + "/tokens-*"))
    groups = [m.row_group(i).total_byte_size for f in glob.glob(f"{newest}/*.parquet") for m in [pq.ParquetFile(f).metadata] for i in range(m.num_row_groups)]
    assert len(groups) > 1
    assert max(groups) <= 3 * S.SMALL_GROUPS["parquet.block.size"] // 2


def test_workers_get_small_batches(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    df = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("harbour "), 125_000).alias("text"))
    size = lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["size"]) for b in bs)
    assert S._kept(df.mapInArrow(size, "size long"), "sizes").agg(F.max("size")).first()[0] <= 12 << 20
    assert spark.conf.get(name) == before


def totals(counts):
    out = Counter()
    for b in counts:
        assert b.num_rows <= S.ROWS
        for kind, form, pair, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            out[kind, form, pair] += n
    return out


def test_counts_and_events_do_not_depend_on_how_texts_are_cut(monkeypatch):
    rows = texts(12, 900)
    want_counts, want_events = totals(S._lexicon(S._tokens([batches(rows)]))), None
    assert {k for k, _, _ in want_counts} == {"f", "j", "b"}
    for chunk, held, rows_out in ((500_000, 2_000_000, 50_000), (1, 1_000, 7), (20_000, 10, 100)):
        monkeypatch.setattr(S, "CHUNK", chunk)
        monkeypatch.setattr(S, "HELD", held)
        monkeypatch.setattr(S, "WORDS", 30)
        monkeypatch.setattr(S, "ROWS", rows_out)
        assert totals(S._lexicon(S._tokens([batches(rows)]))) == want_counts
        events = list(S._events(frozenset(WORDS[5:]))(S._tokens([batches(rows[:5]), batches(rows[5:])])))
        assert max(b.num_rows for b in events) <= rows_out
        got = Counter(tuple(r.values()) for b in events for r in b.to_pylist())
        assert want_events in (None, got)
        want_events = got


@pytest.mark.parametrize("rows", [[], [("a", "", None)], [(None, None, None), ("b", "\n\n", "x")]])
def test_chunks_without_tokens(rows):
    given = list(S._tokens([batches(rows)] if rows else []))
    assert list(S._lexicon(given)) == []
    assert list(S._events(frozenset())(given)) == []
