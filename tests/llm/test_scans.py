import random
from collections import Counter

import pytest

from lectern.llm import scans as S

DOCS = "doc_id string, markdown string, title string, source_path string"
WORDS = "harbour board keeps every sworn barge outer quay weeks decides return owner lighter culvert permit estate lantern clerk market register".split()


def corpus(n=60):
    rng = random.Random(4)
    return [(f"c{i}", "\n".join(" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(12)) + "\n\nthe open-deck barge and the full-depth quay", "", None) for i in range(n)]


PAGE = """The harb-
our board keeps every sw0rn barge at the outer
quay. A lan†ern and the perrnit of the open-
deck barge go to the
- 4 -
Guide to Lower Quays
owner of the ciilvert.

Page 12 of the old book is missing.

The late Wimlinish sends form K-433 to the board"""


@pytest.fixture(scope="module")
def found(spark):
    rows = [*corpus(), ("d", PAGE, "Guide to Lower Quays", "a/b/lower-office-01/2020/d.pdf"), ("d", PAGE, "Guide to Lower Quays", "copy/d.pdf"), ("n", None, None, None), ("e", "", None, None)]
    return spark.createDataFrame(rows, DOCS)


def test_lines(found):
    got = {(r["line_no"], r["defect"]) for r in S.defects(found).where("doc_id = 'd'").collect()}
    assert got == {(1, "hyphen"), (2, "misread"), (3, "misread"), (5, "furniture"), (6, "furniture"), (7, "misread")}
    assert S.defects(found).where("doc_id != 'd'").count() == 0


def test_the_text_becomes_continuous(found):
    row = S.repair(found).where("doc_id = 'd'").collect()
    assert len(row) == 1
    first, *rest = row[0]["markdown"].split("\n\n")
    assert first == "The harbour board keeps every sworn barge at the outer quay. A lantern and the permit of the open-deck barge go to the owner of the culvert."
    assert rest == ["Page 12 of the old book is missing.", "The late Wimlinish sends form K-433 to the board"]
    assert (row[0]["boilerplate_lines_removed"], row[0]["ocr_used"]) == (2, True)


def test_an_empty_corpus(spark):
    assert S.defects(spark.createDataFrame([], DOCS)).count() == 0
    assert S.repair(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("form", "word", "close"), [("perrnit", "permit", True), ("ciilvert", "culvert", True), ("b0ard", "board", True), ("svvorn", "sworn", True), ("weéks", "weeks", True), ("board", "hoard", True), ("atfer", "after", False), ("quay", "key", False), ("same", "same", True)])
def test_weighted_distance(form, word, close):
    assert (S.weighted_distance(form, word) <= S.COST) is close


def test_keys_of_confused_forms_meet():
    for form, word in (("perrnit", "permit"), ("ciilvert", "culvert"), ("lan†ern", "lantern"), ("perishablc", "perishable"), ("hazardous", "bazardous")):
        assert S.delete_keys(form) & S.delete_keys(word)


@pytest.mark.parametrize(("line", "odd"), [("- 12 -", True), ("xiv", True), ("P a g e | 3", True), ("Page 3 of 9", True), ("3/19", True), ("9   Guide to Lower Quays", True), ("GUIDE TO LOWER QUAYS", True), ("# Guide to Lower Quays", False), ("12 berths", False), ("Volume 3 was closed in 1991.", False), ("Counted: 12", False), ("| 3 | 4 |", False), ("", False)])
def test_furniture(line, odd):
    lines = ["Some running text of the page that goes on", "", line, "", "And more of the running text here"]
    assert S.furniture(lines, "Guide to Lower Quays")[2] is odd


def pages(head, n=8, foot=None, cut=True):
    """Pages of running text between recurring lines."""
    rng = random.Random(7)
    out = []
    for i in range(n):
        out += [head(i), ""] if head else []
        out += [" ".join(rng.choice(WORDS) for _ in range(9)) for _ in range(11)] + [" ".join(rng.choice(WORDS) for _ in range(8)) + ("" if cut else ".")]
        out += ["", foot(i)] if foot else []
    return out


@pytest.mark.parametrize("cut", [True, False])
@pytest.mark.parametrize("head", [lambda i: "the tolls of the lower quays", lambda i: "Scanned at counter 4", lambda i: f"Office copy of the register, sheet {i + 20}", lambda i: "Doc ref TX-14 / issue 3 / internal use", lambda i: f"{i + 3}   Lower Office 01"])
def test_lines_that_recur_on_every_page_are_furniture(head, cut):
    for lines in (pages(head, cut=cut), pages(None, foot=head, cut=cut)):
        got = S.furniture(lines, None)
        assert [i for i, f in enumerate(got) if f] == [i for i, t in enumerate(lines) if t in {head(k) for k in range(8)}]


def test_headings_and_labels_that_recur_are_kept():
    both = pages(None, 2, cut=False)
    first, second = both[:12], ["The " + both[12], *both[13:]]
    lines = ["Notes", "", *first, "", "Notes", "", *second, "", "55 berths", "", "A third text.", "", "31 berths", "", "A fourth text.", "", "29 berths"]
    assert not any(S.furniture(lines, None))
    again = ["One of the harbour boards keeps every sworn barge at the outer", "quay of the market and the register of the clerk."]
    assert not any(S.furniture([*first, "", *again, "", *second, "", *again, "", "A third text.", "", *again], None))


def test_long_lines_and_odd_tokens(spark):
    rows = [*corpus(), ("x", "word " * 50_000 + "\n" + "y" * 100_000, None, "p"), ("y", "-\n-\n­\n| a |\n|", "", "")]
    assert S.defects(spark.createDataFrame(rows, DOCS)).where("doc_id = 'y'").count() == 0


def scanned(paragraphs, rng, title, office):
    """The paragraphs as pages of a scan: wrapped, broken at line ends, with heads, feet and page numbers."""
    lines, page, n = [], 1, 0
    for p in paragraphs:
        line = ""
        for word in p.split():
            while word:
                if len(line) + len(word) + 1 <= 58:
                    line, word = f"{line} {word}".strip(), ""
                elif len(word) > 6 and "-" not in word and len(line) < 52:
                    lines.append(f"{line} {word[:3]}-")
                    line, word = "", word[3:]
                    n += 1
                else:
                    lines.append(line)
                    line = ""
                    n += 1
                if n >= 24:  # a page ends in the middle of the paragraph
                    n = 0
                    lines += [f"{title}   {page}" if page % 2 else f"{page}   {office}", "", f"copy of the {office.lower()}, sheet {page + 40}"]
                    page += 1
        lines += [line, ""]
        n += 2
    return "\n".join(lines)


def test_clean_texts_come_back(spark):
    rng = random.Random(11)
    sentence = lambda: " ".join([rng.choice(WORDS).capitalize(), *(rng.choice(WORDS) for _ in range(rng.randint(6, 14)))]) + "."
    clean = {f"s{d:02}": [" ".join(sentence() for _ in range(rng.randint(3, 9))) for _ in range(12)] for d in range(30)}
    rows = [*corpus(), *((d, scanned(ps, rng, f"Guide to Quay {d}", f"Office {d}"), None, None) for d, ps in clean.items())]
    got = {r["doc_id"]: r["markdown"].split("\n\n") for r in S.repair(spark.createDataFrame(rows, DOCS)).collect()}
    # a page that ends with a sentence hides whether its paragraph goes on
    same = sum(p in got[d] for d, ps in clean.items() for p in ps)
    assert same / sum(map(len, clean.values())) >= 0.98
    assert sum(len(got[d]) for d in clean) <= 1.03 * sum(map(len, clean.values()))


def test_repair_changes_nothing_but_what_was_found(spark, data):
    docs = spark.read.parquet(f"{data}/parsed_docs.parquet").select("doc_id", "markdown", "title", "source_path")
    found = {}
    for r in S.defects(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["line_no"], r["defect"]))
    before = {r["doc_id"]: r["markdown"] for r in docs.where("markdown is not null").collect()}
    for r in S.repair(docs).collect():
        own = found.get(r["doc_id"], [])
        furniture = {n for n, d in own if d == "furniture"}
        assert r["boilerplate_lines_removed"] == len(furniture)
        kept = " ".join(line for i, line in enumerate(before[r["doc_id"]].split("\n"), 1) if i not in furniture).split()
        changed = Counter(kept)
        changed.subtract(r["markdown"].split())
        assert sum(abs(n) for n in changed.values()) <= 4 * sum(d != "furniture" for _, d in own) + 2
