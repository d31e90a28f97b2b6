import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lectern import tables
from lectern.conf import Settings
from lectern.operators import answering as A
from lectern.plans import ask, evaluate, ingest
from lectern.sources import files
from lectern.sources.snapshots import Store, dump_chunks, dump_markdown, read_snapshot, write_snapshot


def pages_reader():
    """A converter that workers can be sent: a class of the test module could not be imported there."""

    class Pages(files.Converter):
        """A made-up format: pages are separated by form feeds; ranges are refused for some files."""

        def pages(self, kind, content):
            return None if kind == "docx" else content.count(b"\f") + 1

        def markdown(self, kind, content, first, last):
            if first is not None and b"whole" in content and last != first:
                raise ValueError("ranges are not supported")
            if b"broken" in content:
                raise ValueError("not readable")
            return "\n".join(content.decode().split("\f")[(first or 1) - 1 : last])

    return Pages()


def test_files_are_converted_range_by_range():
    five = b"a\fb\fc\fd\fe"
    assert files.converted(pages_reader(), "pdf", five, 2, None) == ("a\nb\n\nc\nd\n\ne", 5)
    assert files.converted(pages_reader(), "pdf", five, 2, 3) == ("a\nb\n\nc", 3)
    assert files.converted(pages_reader(), "pdf", b"whole\fx", 5, None) == ("whole\nx", 2)
    assert files.converted(pages_reader(), "docx", b"x", 5, None) == ("x", None)
    with pytest.raises(ValueError, match="not readable"):
        files.converted(pages_reader(), "pdf", b"broken", 5, None)


def test_runs_keep_the_store_up_to_date(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.md").write_text("# One\n\nfirst text of the port\n\n1. Rule name. more of it")
    (docs / "b.md").write_text("second text")
    (docs / "c.pdf").write_bytes(b"page one\fpage two")
    (docs / "d.pdf").write_bytes(b"broken")
    store = Store(spark, str(tmp_path / "store")).create().create()
    assert store.count("chunks") == 0
    go = lambda **kw: ingest.run(store, files.discover(spark, str(docs)), converter=pages_reader(), **kw)
    dry = ingest.report(go(dry_run=True)).first().asDict()
    assert dry == {"new": 4, "changed": 0, "unchanged": 0, "deleted": 0}
    assert store.count("registry") == 0
    first = go()
    assert ingest.report(first).first().asDict() == dry
    assert [(r["source_path"][-5:], r["error"]) for r in ingest.failures(first).collect()] == [("d.pdf", "not readable")]
    texts = lambda: sorted(r["text"] for r in store.read("chunks").collect())
    assert texts() == ["1. Rule name. more of it", "first text of the port", "page one\npage two", "second text"]
    vectors = store.count("vectors")
    assert vectors == 4
    (docs / "b.md").unlink()
    (docs / "a.md").write_text("# One\n\nfirst text of the port\n\nchanged")
    second = go()
    assert ingest.report(second).first().asDict() == {"new": 0, "changed": 2, "unchanged": 1, "deleted": 1}
    assert texts() == ["first text of the port\n\nchanged", "page one\npage two"]
    assert {r["chunk_id"] for r in store.read("parents").collect()} == {r["parent_id"] for r in store.read("chunks").collect()}
    states = {r["source_path"][-5:].lstrip("/"): (r["status"], r["chunk_count"]) for r in store.read("registry").collect()}
    assert states["a.md"] == ("indexed", 1)
    assert "b.md" not in states
    assert states["d.pdf"][0] == "failed"
    assert store.count("vectors") == vectors + 1  # only the new text was encoded
    assert {r["stage"] for r in store.read("progress").collect()} == {"parsed", "chunked", "encoded", "indexed", "registered"}
    dump_chunks(store.read("chunks"), store.read("parents"), str(tmp_path / "dump"))
    assert [r["kind"] for r in spark.read.json(str(tmp_path / "dump")).orderBy("kind").collect()] == ["child"] * 2 + ["parent"] * 2
    dump_markdown(store.read("parsed"), str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).where("value = 'second text'").count() == 1


def test_a_pointer_half_written_is_passed_over(spark, tmp_path):
    root = str(tmp_path / "t")
    write_snapshot(spark.range(3).toDF("x"), root)
    (tmp_path / "t" / "_pointers" / "000000000009").mkdir()
    (tmp_path / "t" / "_pointers" / "000000000009" / "part").write_text('{"number": 9')
    assert read_snapshot(spark, root).count() == 3
    with pytest.raises(FileNotFoundError):
        read_snapshot(spark, str(tmp_path / "none"))


CHUNKS = "chunk_id string, doc_id string, parent_id string, kind string, text string, section_path array<string>, page_start int, page_end int"
QUESTIONS = "query_id long, question string"


@pytest.fixture
def corpus(spark):
    rows = [("c1", "d", "p1", "child", "the tide table of the port", ["Book", "Rule 6: Tides"], 1, 1), ("c2", "d", "p2", "child", "whale oil and candles", ["Book", "Rule 66: Oil"], 2, 2), ("c3", "d", None, "child", "barrels and ropes and anchors", ["Book"], 3, 3)]
    rows += [("p1", "d", None, "parent", "the tide table of the port, in full", ["Book", "Rule 6: Tides"], 1, 1)]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([("d", "Guide", "a.md")], "doc_id string, title string, source_path string")


def test_questions_become_answers(spark, corpus):
    chunks, docs = corpus
    asked = spark.createDataFrame([(1, "And the tide table?"), (2, "zeppelin mooring mast"), (3, "whale oil candles"), (4, "barrels ropes anchors")], QUESTIONS)
    history = spark.createDataFrame([(1, "user: tell me of the port")], "query_id long, history string")

    def model(prompts):
        out = []
        for p in prompts:
            if p.startswith(ask.CONDENSE):
                out.append("tide table of the port")
                continue
            content = json.loads(p)[1]["content"]
            if "ropes" in content:
                raise ValueError("no credit")
            out.append("It stands there [1][7].")
        return out

    got = {r["query_id"]: r for r in ask.answer(asked, chunks, docs, model, history=history).collect()}
    assert got[1]["question"] == "tide table of the port"
    assert (got[1]["text"], got[1]["no_answer"], [s["n"] for s in got[1]["sources"]]) == ("It stands there [1].", False, [1])
    assert (got[2]["text"], got[2]["no_answer"], got[2]["sources"]) == (Settings().no_answer_text, True, None)
    assert got[3]["text"] == "It stands there [1]."
    assert (got[4]["text"], got[4]["error"]) == (None, "no credit")


def test_calls_are_tried_again_while_there_are_too_many():
    calls = []

    def busy(texts):
        calls.append(len(texts))
        if len(calls) < 3:
            raise RuntimeError("HTTP 429")
        return texts

    assert A.called(busy, ["a"], pause=0.0) == ["a"]
    assert calls == [1, 1, 1]
    with pytest.raises(RuntimeError, match="rate"):
        A.called(lambda t: (_ for _ in ()).throw(RuntimeError("rate limit")), ["a"], tries=2, pause=0.0)
    with pytest.raises(ValueError, match="other"):
        A.called(lambda t: (_ for _ in ()).throw(ValueError("other")), ["a"], pause=99.0)


def test_completions_and_summaries(spark):
    bodies = ['{"choices":[{"message":{"content":"yes"}}]}', '{"error":{"message":"no"}}', '{"error":"bad"}', "<html>", None]
    out = spark.createDataFrame([(b,) for b in bodies], "b string").select(A.completion(F.col("b")).alias("c")).select("c.*").collect()
    assert [tuple(r) for r in out] == [("yes", None), (None, "no"), (None, "bad"), (None, "no JSON"), (None, "no JSON")]
    chunks = spark.createDataFrame([("a", "d", 2, "child", "x"), ("b", "d", 1, "child", "bad"), ("b", "d", 1, "child", "bad"), ("p", "d", 0, "parent", "y")], "chunk_id string, doc_id string, seq int, kind string, embed_text string")
    assert [r["chunk_id"] for r in A.enrichment_targets(chunks, 1).collect()] == ["b"]

    def model(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("refused")
        return ["About x."] * len(prompts)

    assert {r["chunk_id"]: r["embed_text"] for r in A.enrich(A.enrichment_targets(chunks), model).collect()} == {"a": "About x.\n\nx", "b": "bad"}


def test_an_evaluation_from_cases_to_report(spark, corpus, tmp_path):
    chunks, docs = corpus
    (tmp_path / "cases.json").write_text("\n".join(json.dumps(c) for c in [
        {"case_id": 1, "question": "the tide table", "expect_rule": "Rule 6", "expect_keywords": ["high", "low"]}, {"case_id": 2, "question": "zeppelin mast", "expect_refusal": True}, {"case_id": 3, "question": "whale oil", "expect_rule": "Rule 6"}, {"case_id": 4, "question": "zeppelin", "expect_rule": "Rule 6"}, {"case_id": 5},
    ]))
    cases = evaluate.load_cases(spark, str(tmp_path / "cases.json"))
    found = ask.retrieve(cases.select(F.col("case_id").alias("query_id"), "question"), chunks, docs)
    told = spark.createDataFrame([(1, "at HIGH water", None), (2, "high", None), (3, None, "failed")], "query_id long, text string, error string")
    out = evaluate.case_outcomes(cases, found, told)
    got = {r["case_id"]: (r["hit"], r["rank"], r["refusal_correct"], r["keywords_found"], r["error"]) for r in out.collect()}
    assert got == {1: (True, 1, None, 0.5, None), 2: (None, None, True, None, None), 3: (False, None, None, None, "failed"), 4: (False, None, None, None, None)}
    folder = str(tmp_path / "reports")
    assert evaluate.previous_report(spark, folder) is None
    first = {r["metric"]: (r["value"], r["delta"]) for r in evaluate.write_report(out, folder, "20240101-000000").collect()}
    assert first["hit_rate"] == (0.333, None)
    second = {r["metric"]: (r["value"], r["delta"]) for r in evaluate.write_report(out.where("case_id < 3"), folder, "20240102-000000").collect()}
    assert second["hit_rate"] == (1.0, 0.667)
    assert {r["metric"]: r["value"] for r in evaluate.previous_report(spark, folder).collect()}["hit_rate"] == 1.0


def test_tables_in_the_shared_folder_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    monkeypatch.setattr(tables, "_WRITTEN", {})
    assert tables.materialise(spark.range(5).toDF("x"), "five").count() == 5
    assert len(list((tmp_path / "shared").iterdir())) == 1
    assert tables.forget(spark) == 1
    assert not list((tmp_path / "shared").iterdir())


def test_a_cluster_must_name_its_shared_folder():
    session = lambda master, folder=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: folder), sparkContext=SimpleNamespace(master=master, applicationId=f"none-{master}"))
    assert tables.shared_dir(session("spark://host:7077", "hdfs://a/b")) == "hdfs://a/b"
    assert tables.shared_dir(session("local[4]")).startswith("file:///")
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            tables.shared_dir(session(master))
