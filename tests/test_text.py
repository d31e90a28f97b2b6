import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import cleaning


def one(spark, column, *values, schema="t string"):
    return spark.createDataFrame([values], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("com-\nmittee", "committee"), ("Straß-\nenbahn", "Straßenbahn"), ("â€œquotedâ€\u009d", '"quoted"'), ("a   b\t c", "a b c"), ("‖word‖ ― x", '"word" - x'),
        ("ﬁne", "fine"), ("　 x \n", "x"), ("", ""), (None, None), ("1-\n2", "12"),
    ],
)
def test_prose(spark, text, expected):
    assert one(spark, T.normalize_text(F.col("t")), text) == expected


@pytest.mark.parametrize(("line", "expected"), [("Part II ........ 45", True), ("Ends here. See page 4.", False), ("Intro .... 7 ", True), ("....", False)])
def test_toc_lines(spark, line, expected):
    assert one(spark, T.is_toc_line(F.col("t")), line) is expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("6. Mooring of vessels. The holder shall", "Rule 6: Mooring of vessels"), ("(a) any person", None), ("1994. The year", None), ("7. lower case", None),
        ("12. No stop here", "Rule 12: No stop here"), ("3. " + "A" * 200, "Rule 3: " + "A" * 100), ("5. A" + "b" * 160 + ". x", "Rule 5: A" + "b" * 99), (None, None),
    ],
)
def test_rule_titles(spark, text, expected):
    assert one(spark, T.rule_title(F.col("t")), text) == expected


@pytest.mark.parametrize(("pages", "expected"), [((2, 3), "p.2-3"), ((2, 2), "p.2"), ((2, None), "p.2"), ((None, 5), "-5"), ((0, 0), ""), ((None, None), "")])
def test_page_labels(spark, pages, expected):
    assert one(spark, T.page_label(F.col("a"), F.col("b")), *pages, schema="a int, b int") == expected


@pytest.mark.parametrize(
    ("text", "n", "clean", "cited"),
    [("a [0] b [01] c [3]", 2, "a  b [01] c ", [1]), ("x [1] y [9] z [2]", 2, "x [1] y  z [2]", [1, 2]), ("none", 0, "none", []), ("[99999999999999999999999]", 3, "", [])],
)
def test_citations(spark, text, n, clean, cited):
    row = spark.createDataFrame([(text, n)], "t string, n int").select(T.without_invalid_citations(F.col("t"), F.col("n")).alias("c"), T.cited(F.col("t"), F.col("n")).alias("k")).first()
    assert (row["c"], row["k"]) == (clean, cited)


@pytest.mark.parametrize(
    ("reply", "expected"),
    [('so: {"faithfulness": 4, "relevance": 5} ok', (4.0, 5.0)), ('{"faithfulness": 9, "relevance": 2}', (None, 2.0)), ('{"faithfulness": "x", "relevance": 2}', (None, None)), ("no json", (None, None)), ("{broken", (None, None))],
)
def test_judge_replies(spark, reply, expected):
    row = spark.createDataFrame([(reply,)], "t string").select(T.judged(F.col("t"), "faithfulness"), T.judged(F.col("t"), "relevance")).first()
    assert tuple(row) == expected


def test_markdown_keeps_tables_and_code(spark):
    md = "# Head  line\n\n| a  | b |\n|---|---|\n\n```\nx   =  1\n```\n\n\n\nsome   prose ‖ok‖"
    rows = spark.createDataFrame([("d", md), ("d", md), ("e", None), ("f", "")], "doc_id string, markdown string")
    out = {r["doc_id"]: r["markdown"] for r in cleaning.normalize_markdown(rows).collect()}
    assert out == {"d": '# Head line\n\n| a  | b |\n|---|---|\n\n```\nx   =  1\n```\n\nsome prose "ok"\n', "f": "\n"}


def test_boilerplate(spark):
    rows = [("d", p, k) for p in range(1, 11) for k in (f"page {p}", "gazette", str(p))] + [("d", 1, "only once")] + [("s", p, "gazette") for p in (1, 2)]
    rows += [("q", p, "three of four") for p in (1, 2, 3)] + [("q", 4, "other"), ("q", None, "x"), ("q", 1, None)]
    items = spark.createDataFrame(rows, "doc_id string, page int, raw string").withColumn("match_key", T.match_key(F.col("raw")))
    keys = {(r["doc_id"], r["match_key"]) for r in cleaning.boilerplate_keys(items).collect()}
    assert keys == {("d", "page #"), ("d", "gazette"), ("q", "three of four")}
    left = cleaning.strip_boilerplate(items.where("doc_id = 'd'"), cleaning.boilerplate_keys(items))
    assert {r["raw"] for r in left.collect()} == {"only once"} | {str(p) for p in range(1, 11)}


@pytest.mark.parametrize(("ms", "expected"), [(0, "0ms"), (999, "999ms"), (1000, "1.0s"), (25_260, "25.3s"), (None, None)])
def test_durations(spark, ms, expected):
    assert one(spark, T.format_duration(F.col("t")), ms, schema="t long") == expected


def test_identities_markers_and_scores(spark):
    row = spark.createDataFrame([("d", 0, "x", "3.", True)], "a string, b int, t string, m string, e boolean").select(
        T.short_id(F.col("a"), F.col("b"), F.lit(None)).alias("i"), T.restore_marker(F.col("t"), F.col("m"), F.col("e")).alias("r"), T.unit_score(F.lit(0.0)).alias("s"), T.content_id(F.encode("a", "UTF-8")).alias("c"),
    ).first()
    import hashlib

    assert row["i"] == hashlib.sha1(b"d:0:").hexdigest()[:16]
    assert (row["r"], row["s"], row["c"]) == ("3. x", 0.5, hashlib.sha256(b"d").hexdigest()[:16])


def test_misread_utf8_is_put_right_whatever_the_character(spark):
    good = "Großes Café, 20 €, naïve Œuvre — “señor’s” … Ørsted, ½ Ÿ"
    wrong = "".join(bytes([b]).decode("cp1252") if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else chr(b) for b in good.encode("utf-8"))
    fine = ["Straße’s", "É’", "Â", "Ça va", "ÀÉ", "naïve", "x â€", None, "plain"]
    rows = spark.createDataFrame([(0, wrong), *enumerate(fine, 1)], "i int, t string")
    got = {r["i"]: r["t"] for r in rows.select("i", T.repair_unicode(F.col("t")).alias("t")).collect()}
    want = spark.createDataFrame([(0, good)], "i int, t string").select(T.repair_unicode(F.col("t")).alias("t")).first()["t"]
    assert got[0] == want
    assert [got[i] for i in range(1, len(fine) + 1)] == [t and t.replace("’", "'") for t in fine]


def test_settings_come_from_a_file_and_the_environment(tmp_path):
    from lectern.conf import Settings

    (tmp_path / "c.json").write_text('{"target_tokens": 300, "score_floor": 0.2}')
    own = Settings.load(str(tmp_path / "c.json"), {"LECTERN_TARGET_TOKENS": "200", "LECTERN_NO_ANSWER_TEXT": "none", "OTHER": "1"})
    assert (own.target_tokens, own.score_floor, own.no_answer_text, own.max_tokens) == (200, 0.2, "none", 1024)
    assert Settings.load(None, {}) == Settings()
