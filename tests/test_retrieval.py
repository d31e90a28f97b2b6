import numpy as np
from pyspark.sql import functions as F

from lectern.conf import Settings
from lectern.operators import answering, evaluation, registry
from lectern.operators import retrieval as R
from lectern.operators.encoding import encode
from lectern.plans import ask

HIT = "query_id int, chunk_id string, parent_id string, doc_id string, text string, section_path array<string>, page_start int, page_end int, score double, kept_rank int"
PARENT = "chunk_id string, text string, section_path array<string>, page_start int, page_end int"


def test_dense_search_is_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (901, []), (902, [0.0] * 8), (903, [1.0] * 7), (904, [float("nan")] * 8)]
    index = spark.createDataFrame(rows, "id int, vector array<double>")
    out = R.dense_topk(index.where("id % 100 = 0"), index, 4).collect()
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 100, 200):
        best = sorted(range(300), key=lambda i: (-round(float(x[q] @ x[i]), 6), i))[:4]
        assert [r["chunk_id"] for r in sorted((r for r in out if r["query_id"] == q), key=lambda r: r["rank"])] == best
    assert R.dense_topk(index.where("id < 0"), index, 4).count() == 0


def test_dense_search_puts_no_query_on_rows(spark):
    rng = np.random.default_rng(2)
    index = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(12_000, 4)))], "id int, vector array<double>")
    out = R.dense_topk(index.where("id < 10000"), index, 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoop" not in plan
    assert out.count() == 30_000


def test_shuffled_blocks_of_queries_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(400, 3)), 1)  # many ties
    index = spark.createDataFrame([(f"v{i:03}", [float(a) for a in r]) for i, r in enumerate(x)] + [("z", None), ("y", [1.0])], "id string, vector array<double>")
    queries = index.where("substr(id, 4, 1) = '0'")
    one = {tuple(r) for r in R.dense_topk(queries, index, 5).collect()}
    monkeypatch.setattr(R, "QUERY_BLOCK", 7)
    monkeypatch.setattr(R, "INDEX_PART", 64)
    monkeypatch.setattr(R, "STRIP", 3)
    assert {tuple(r) for r in R.dense_topk(queries, index, 5).collect()} == one
    assert len(one) == 5 * sum(bool((r != 0).any()) for r in x[::10])


def test_word_search_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(30)]
    share = np.r_[[0.9, 0.7, 0.6], np.full(27, 0.08)]  # three words that most texts have
    texts = [(i, " ".join(w for w, p in zip(vocabulary, share, strict=True) if rng.random() < p)) for i in range(120)]
    asked = [(i, " ".join(rng.choice(vocabulary, 3))) for i in range(20)] + [(20, "w0 w1"), (21, "w0"), (22, "nothing"), (23, None)]
    weights, idf = R.word_postings(spark.createDataFrame(texts, "id int, text string"))
    q = R.query_postings(spark.createDataFrame(asked, "id int, text string"), idf)
    got = {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in R.word_topk(q, weights, idf, 4).collect()}
    assert got == {(r["query_id"], r["chunk_id"], r["score"], r["rank"]) for r in R.sparse_topk(q, weights, 4, 6).collect()}
    assert {r[0] for r in got} >= {20, 21}


def test_texts_are_encoded_and_found(spark):
    texts = [("a", "the tide table of the port"), ("b", "whale oil and candles"), ("c", None), ("d", "")]
    index = encode(spark.createDataFrame(texts, "id string, text string"))
    rows = {r["id"]: r for r in index.collect()}
    assert len(rows["a"]["vector"]) == 64
    assert abs(sum(x * x for x in rows["a"]["vector"]) - 1) < 1e-5
    assert rows["c"]["indices"] == rows["d"]["indices"] == []
    asked = spark.createDataFrame([(1, "tide table"), (2, "candles")], "query_id int, question string")
    best = {r["query_id"]: r["chunk_id"] for r in ask.encoded_search(asked, index).where("rank = 1").collect()}
    assert best == {1: "a", 2: "b"}
    other = encode(spark.createDataFrame(texts, "id string, text string"), lambda ts: (np.ones((len(ts), 2)), [{len(t): 1.0} for t in ts]))
    assert {(r["id"], tuple(r["vector"]), tuple(r["indices"])) for r in other.collect()} == {(i, (1.0, 1.0), (len(t or ""),)) for i, t in texts}


def test_retrieval_takes_a_search_and_a_scorer(spark):
    chunks = spark.createDataFrame([(f"c{i}", "d", "p", "child", f"text {i}", ["s"], i, i) for i in range(3)] + [("p", "d", None, "parent", "whole", ["s"], 0, 2)], "chunk_id string, doc_id string, parent_id string, kind string, text string, section_path array<string>, page_start int, page_end int")
    docs = spark.createDataFrame([("d", "Title", "a.md")], "doc_id string, title string, source_path string")
    asked = spark.createDataFrame([(1, "q"), (2, "q")], "query_id int, question string")
    found = spark.createDataFrame([(1, "c0", 1), (1, "c2", 2)], "query_id int, chunk_id string, rank int")
    done = ask.retrieve(asked, chunks, docs, found=found, score=F.when(F.col("text") == "text 2", 0.9).otherwise(0.01))
    assert [(r["block_key"], r["score"], r["matched_chunks"], r["title"]) for r in done.blocks.collect()] == [("p", 0.9, 1, "Title")]
    assert {tuple(r) for r in done.outcome.collect()} == {(1, False, 0.9), (2, True, 0.0)}


def test_sparse_search_and_fusion(spark):
    p = lambda rows: spark.createDataFrame(rows, "id string, indices array<int>, values array<float>")
    index = R.postings(p([("a", [1, 2], [1.0, 2.0]), ("b", [2, 2], [1.0, 1.0]), ("c", [9], [1.0]), ("d", None, None), ("e", [1], [1.0, 2.0])]))
    out = R.sparse_topk(R.postings(p([("q", [2], [3.0])])), index, 5).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in out] == [("a", 6.0), ("b", 6.0)]
    ranked = lambda rows: spark.createDataFrame(rows, "query_id string, chunk_id string, rank int")
    fused = R.fuse([ranked([("q", "a", 1), ("q", "b", 2)]), ranked([("q", "b", 1), ("q", "c", 2)])], 2, 60).orderBy("rank").collect()
    assert [r["chunk_id"] for r in fused] == ["b", "a"]


def test_floor_and_outcome(spark):
    rows = [(1, "a", 1, "tide table", "the tide table of the port"), (1, "b", 2, "tide table", "nothing"), (2, "a", 1, "whale oil", "the tide table")]
    done = R.rerank(spark.createDataFrame(rows, "query_id int, chunk_id string, rank int, question string, text string"))
    assert {(r["query_id"], r["chunk_id"]) for r in R.kept(done).collect()} == {(1, "a")}
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    assert {tuple(r) for r in R.outcome(asked, done).collect()} == {(1, False, 1.0), (2, True, 0.0), (3, True, 0.0)}


def test_siblings_merge_and_missing_parents_stay_alone(spark):
    hits = [(1, f"c{i}", p, "d", f"t{i}", ["s"], i, i, s, i) for i, (p, s) in enumerate([("p1", 0.9), ("p9", 0.8), ("p1", 0.7), ("p9", 0.6), (None, 0.5)], 1)]
    out = R.expand_to_parents(spark.createDataFrame(hits, HIT), spark.createDataFrame([("p1", "parent text", ["s"], 1, 3)], PARENT)).orderBy("rank").collect()
    assert [(r["block_key"], r["score"], r["matched_chunks"], r["text"], r["page_end"]) for r in out] == [
        ("p1", 0.9, 2, "parent text", 3), ("c2", 0.8, 1, "t2", 2), ("c4", 0.6, 1, "t4", 4), ("c5", 0.5, 1, "t5", 5),
    ]


def test_budget_skips_and_keeps_the_first(spark):
    blocks = [(1, 1, "a", "x" * 24), (1, 2, "b", "x" * 28), (1, 3, "c", "x" * 12), (2, 1, "a", "x" * 60), (2, 2, "b", "x")]
    out = R.within_budget(spark.createDataFrame(blocks, "query_id int, rank int, block_key string, text string"), 10)
    assert {(r["query_id"], r["block_key"], r["block_no"]) for r in out.collect()} == {(1, "a", 1), (1, "c", 2), (2, "a", 1)}


def test_context_and_answers(spark):
    rows = [(1, 1, "Act", ["One", "Rule 2: Name"], 2, 3, "body", 0.91256, "p/a.md"), (1, 2, "Act", None, None, None, "more", 0.5, "p/a.md")]
    blocks = spark.createDataFrame(rows, "query_id int, block_no int, title string, section_path array<string>, page_start int, page_end int, text string, score double, source_path string")
    assert R.context(blocks).first()["context"] == "[1] Act — One > Rule 2: Name (p.2-3)\nbody\n\n---\n\n[2] Act — Act ()\nmore"
    sources = answering.source_list(blocks)
    prompted = spark.createDataFrame([(1, False), (2, True)], "query_id int, no_answer boolean")
    calls = answering.complete(spark.createDataFrame([(1, "q")], "query_id int, prompt string"), lambda texts: ["yes [2] no [7]" for _ in texts])
    conf = Settings(no_answer_text="nothing found")
    out = {r["query_id"]: r for r in answering.answers(prompted, calls, sources, conf).collect()}
    assert (out[1]["text"], [s["n"] for s in out[1]["sources"]]) == ("yes [2] no ", [2])
    assert (out[2]["text"], out[2]["sources"]) == ("nothing found", None)


def test_a_failing_model_fails_row_by_row(spark):
    def model(texts):
        if any(t == "bad" for t in texts):
            raise RuntimeError("refused")
        return [t.upper() for t in texts]

    out = answering.complete(spark.createDataFrame([("ok",), ("bad",)], "prompt string").coalesce(1), model).collect()
    assert {(r["reply"], r["error"]) for r in out} == {("OK", ""), (None, "refused")}


def test_history_stream_and_condensing(spark):
    turns = spark.createDataFrame([(1, t, "user" if t % 2 else "bot", f"m{t}") for t in range(1, 9)], "conv_id int, turn int, role string, text string")
    assert answering.history(turns).first()["history"] == "\n".join(f"{'user' if t % 2 else 'bot'}: m{t}" for t in range(3, 9))
    lines = ["data: " + '{"choices":[{"delta":{"content":"a"}}]}', ": note", "data: oops", 'data: {"choices":[{"delta":{"content":""}}]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"z"}}]}']
    got = answering.stream_deltas(spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "query_id int, seq int, line string")).collect()
    assert [r["delta"] for r in got] == ["a"]
    row = spark.createDataFrame([("q", " "), ("q", "better")], "q string, r string").select(answering.condensed(F.col("q"), F.col("r")).alias("x")).collect()
    assert [r["x"] for r in row] == ["q", "better"]


STATE = "source_path string, content_hash string, status string, pipeline_version int"


def test_plan_upsert_and_delete(spark):
    found = spark.createDataFrame([("a", "h1"), ("b", "new"), ("c", "h3"), ("e", "h5"), ("f", None)], "source_path string, content_hash string")
    old = spark.createDataFrame([("b", "old", "indexed", 1), ("c", "h3", "indexed", 1), ("d", "h4", "indexed", 1), ("e", "h5", "failed", 1), ("f", None, "indexed", 1)], STATE)
    plan = {r["source_path"]: r["action"] for r in registry.plan_actions(found, old, 1).collect()}
    assert plan == {"a": "new", "b": "changed", "c": "unchanged", "d": "deleted", "e": "changed", "f": "changed"}
    assert {r["action"] for r in registry.plan_actions(found, old, 2).where("source_path = 'c'").collect()} == {"changed"}
    merged = registry.upsert(old, spark.createDataFrame([("c", None, 7), ("z", "indexed", 7)], "source_path string, status string, pipeline_version int"))
    rows = {r["source_path"]: (r["content_hash"], r["status"], r["pipeline_version"]) for r in merged.collect()}
    assert rows["c"] == ("h3", None, 7) and rows["z"] == (None, "indexed", 7) and rows["b"] == ("old", "indexed", 1)
    index = spark.createDataFrame([("c1", "d1"), ("c2", "d2")], "chunk_id string, doc_id string")
    new = spark.createDataFrame([("c9", "d1")], "chunk_id string, doc_id string")
    assert {tuple(r) for r in registry.replace_by_document(index, new).select("chunk_id", "doc_id").collect()} == {("c9", "d1"), ("c2", "d2")}
    assert registry.delete_documents(index, new).count() == 1


RESULT = "result_id int, hit boolean, rank int, refusal_correct boolean, keywords_found double, faithfulness double, relevance double, seconds double"


def test_scores(spark):
    rows = [(1, True, 2, None, None, 4.0, None, 1.0), (1, True, 2, None, None, 4.0, None, 1.0), (2, False, None, None, None, None, None, 2.0), (3, None, None, True, None, None, None, 3.0)]
    out = {r["metric"]: r["value"] for r in evaluation.summarize(spark.createDataFrame(rows, RESULT)).collect()}
    assert out == {"cases": 3.0, "hit_rate": 0.5, "mrr": 0.25, "refusal_accuracy": 1.0, "keyword_recall": None, "faithfulness": 4.0, "relevance": None, "avg_seconds": 2.0}
    assert {r["metric"]: r["value"] for r in evaluation.summarize(spark.createDataFrame([], RESULT)).collect()}["hit_rate"] is None


def test_rules_match_by_number(spark):
    blocks = spark.createDataFrame([(1, 1, ["Rule 66: x"]), (1, 2, ["Part", "Rule 6: y"]), (2, 1, ["Rule 66"])], "case_id int, block_no int, section_path array<string>")
    cases = spark.createDataFrame([(1, "Rule 6", False), (2, "Rule 6", None), (3, "Rule 6", True)], "case_id int, expect_rule string, expect_refusal boolean")
    assert {tuple(r) for r in evaluation.rule_hits(blocks, cases).collect()} == {(1, True, 2), (2, False, None)}
