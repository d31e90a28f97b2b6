from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lectern.conf import Settings
from lectern.functions import text as T
from lectern.operators import chunking
from lectern.plans import ingest
from pyspark.sql import functions as F

ITEMS = "doc_id string, item_idx int, page int, kind string, level int, text string"
BLOCKS = "doc_id string, section_idx int, block_idx int, text string, is_table boolean, pages array<int>"


def test_sections(spark):
    items = [("header", 1, "A"), ("text", 0, "t1"), ("text", 0, "1. Foo. bar"), ("text", 0, "t2"), ("header", 2, "B"), ("text", 0, "t3"), ("header", 1, "C"), ("header", 3, "D"), ("text", 0, "t4"), ("text", 0, "Contents ........ 9")]
    rows = spark.createDataFrame([("d", i, 1, k, n, t) for i, (k, n, t) in enumerate(items)], ITEMS)
    out = chunking.sections(rows).orderBy("item_idx").collect()
    assert [(r["section_idx"], r["path"], r["text"]) for r in out] == [
        (0, ["A"], "t1"), (1, ["A", "Rule 1: Foo"], "1. Foo. bar"), (1, ["A", "Rule 1: Foo"], "t2"), (2, ["A", "B"], "t3"), (3, ["C", "D"], "t4"),
    ]
    assert chunking.sections(spark.createDataFrame([], ITEMS)).count() == 0


def test_prose_is_split_with_overlap():
    s = [f"s{i}" + "x" * 14 for i in range(1, 6)]  # four tokens each
    assert chunking.split_prose(s, 12, 5) == [" ".join(s[:3]), " ".join(s[2:4]), " ".join(s[3:5])]
    assert chunking.split_prose(["y" * 400], 12, 5) == ["y" * 400]


def test_tables_are_split_by_rows():
    head, rows = ["|h|aaa|", "|-|---|"], ["r" * 12 + str(i) for i in range(3)]
    md = "\n".join(head + rows)
    assert chunking.split_table(md, 10) == ["\n".join([*head, *rows[:2]]), "\n".join([*head, rows[2]])] or len(chunking.split_table(md, 10)) == 2
    assert chunking.split_table("\n".join(head + rows[:1]), 1) == ["\n".join(head + rows[:1])]


def test_packing(spark):
    conf = Settings(target_tokens=10, max_tokens=20, min_tokens=3, parent_tokens=40)
    rows = [("d", 0, 0, "a" * 24, False, [1]), ("d", 0, 1, "b" * 20, False, None), ("d", 0, 2, "c" * 60, True, [2, 3]), ("d", 0, 3, "d" * 8, None, [4]), ("d", 0, 3, "d" * 8, None, [4]), ("d", 1, 0, None, False, None), ("d", 2, 0, "e", False, [])]
    out = chunking.pack_children(spark.createDataFrame(rows, BLOCKS), conf).orderBy("seq").collect()
    assert [(r["section_idx"], r["group_idx"], r["seq"], r["element_type"], r["page_start"], r["page_end"], len(r["text"])) for r in out] == [
        (0, 0, 0, "text", 1, 1, 24), (0, 1, 1, "text", None, None, 20), (0, 2, 2, "table", 2, 4, 70), (2, 0, 3, "text", None, None, 1),
    ]
    assert chunking.pack_children(spark.createDataFrame([], BLOCKS), conf).count() == 0


def test_parents(spark):
    kids = spark.createDataFrame([("d", 0, i, f"c{i}", 900, i + 1, i + 2) for i in range(3)], "doc_id string, section_idx int, seq int, chunk_id string, token_count int, page_start int, page_end int")
    up = chunking.parents(chunking.group_parents(kids)).orderBy("seq").collect()
    assert [(r["children"], r["token_count"], r["page_start"], r["page_end"], r["seq"]) for r in up] == [(2, 1800, 1, 3, 0), (1, 900, 3, 4, 2)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(1, 60), min_size=1, max_size=25))
def test_no_text_is_lost_or_reordered(spark, sizes):
    conf = Settings(target_tokens=20, max_tokens=200, min_tokens=4)
    rows = [("d", 0, i, f"{i:02}" + "x" * (4 * n - 2), False, [i]) for i, n in enumerate(sizes)]
    out = chunking.pack_children(spark.createDataFrame(rows, BLOCKS), conf).orderBy("seq").collect()
    assert "\n\n".join(r["text"] for r in out) == "\n\n".join(r[3] for r in rows)
    for r in out[:-1]:
        parts = r["text"].split("\n\n")
        assert sum(max(1, len(p) // 4) for p in parts) <= 20 or len(parts) == 1


def test_a_run_plans_chunks_and_registers(spark):
    found = spark.createDataFrame(
        [("p/a.md", "h1", "A", "md", "# One\n\nfirst text\n\n1. Rule name. more", None), ("p/b.pdf", "h2", "B", "pdf", None, "no converter"), ("p/c.md", "h3", "C", "md", "same", None)],
        "source_path string, doc_id string, title string, doc_type string, markdown string, warning string",
    )
    state = spark.createDataFrame(
        [("p/c.md", "h3", "h3", "indexed", None, "C", "md", 1, None), ("p/x.md", "h9", "h9", "indexed", None, "X", "md", 1, None), ("p/b.pdf", "h0", "h0", "indexed", None, "B", "pdf", 1, None)],
        "source_path string, doc_id string, content_hash string, status string, error string, title string, doc_type string, pipeline_version int, updated_at timestamp",
    ).withColumn("chunk_count", F.lit(5))
    run = ingest.ingest(found, state)
    assert {tuple(r) for r in run.plan.collect()} == {("p/a.md", "new"), ("p/b.pdf", "changed"), ("p/c.md", "unchanged"), ("p/x.md", "deleted")}
    assert {(r["doc_id"], r["embed_text"]) for r in run.chunks.collect()} == {("h1", "A > One\n\nfirst text"), ("h1", "A > One > Rule 1: Rule name\n\n1. Rule name. more")}
    after = {r["source_path"]: (r["doc_id"], r["status"], r["chunk_count"]) for r in run.registry.collect()}
    assert after == {"p/a.md": ("h1", "indexed", 2), "p/b.pdf": ("h0", "failed", 5), "p/c.md": ("h3", "indexed", 5)}
    assert ingest.report(run).first().asDict() == {"new": 1, "changed": 1, "unchanged": 1, "deleted": 1}


def test_token_counts(spark):
    out = spark.createDataFrame([("x" * 400,), ("",)], "t string").select(T.token_count(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in out] == [100, 1]
