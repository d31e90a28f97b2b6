import pytest

from lectern.llm import leaks as L

DOCS = "doc_id long, text string"
CASES = "case_id long, question string, reference_text string"
REF = "the harbour board keeps every sworn barge at the outer quay for nine weeks and then decides to return it to its owner"


def found(spark, docs, cases, **kw):
    return {tuple(r) for r in L.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(cases, CASES), **kw).select("doc_id", "case_id").collect()}


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_partial_passages_markup_and_broken_words(spark, limit):
    words = REF.split()
    docs = [
        (1, "x " * 500 + REF + " y" * 500), (2, "Intro. " + " ".join(words[4:16]) + "!"), (3, " ".join(words[4:15])),
        (4, "<p>The <b>Har</b>bour​ Board — keeps, EVERY sworn barge at the out-\ner quay for ni­ne weeks and</p> then"),
        (5, " ".join(words[:6]) + " but " + " ".join(words[6:14])), (6, None), (None, REF), (7, ""), (8, " ".join(f"{w}<br>" for w in words)), (9, "who keeps it? Yes"),
    ]
    cases = [(10, "Who keeps it?", REF), (11, "never asked in these words", None), (12, None, "too short for a run"), (13, "", ""), (None, None, REF)]
    assert found(spark, docs, cases, broadcast_rows=limit) == {(1, 10), (2, 10), (4, 10), (8, 10), (9, 10)}


def test_tags_of_any_length_and_signs_that_are_no_tags(spark):
    words = REF.split()
    link = '<a class="' + "x y " * 200 + f'" href={"z" * 500} title=\'a > b\' hidden>'
    docs = [(1, " ".join(words[:7]) + link + " ".join(["", *words[7:]])), (2, "depth <b> " + REF), (3, "if a <b, so " + REF + " and c> d"), (4, " ".join(words[:6]) + " <!-- a\nnote --> " + " ".join(words[6:]))]
    assert found(spark, docs, [(10, None, REF)]) == {(1, 10), (2, 10), (3, 10), (4, 10)}


def test_questions_need_all_their_words(spark):
    q = "does the lit tender box of the skiff count towards the lower estimate of the salted quay today"
    docs = [(1, "A: " + q.upper() + "?"), (2, q[: q.rindex(" ")]), (3, q.replace("tender box", "tender-\nbox")), (4, q.replace("skiff", "skiff old"))]
    assert found(spark, docs, [(1, q, None)]) == {(1, 1), (3, 1)}


def test_repeats_empty_tables_and_clashing_columns(spark):
    assert found(spark, [], [(1, "q w e r", REF)]) == set()
    assert found(spark, [(1, REF)], []) == set()
    docs = spark.createDataFrame([(1, REF, 5, "s"), (1, REF, 5, "s")], DOCS + ", item long, signature string")
    cases = spark.createDataFrame([(1, None, REF, 7), (1, None, REF, 8)], CASES + ", length int")
    assert L.leaks(docs, cases).count() == 1
