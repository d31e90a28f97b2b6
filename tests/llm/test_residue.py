import pytest

from lectern.llm import residue as R

BODY = "The harbour board keeps the sworn barge for nine weeks and then decides to return it. Any person who holds the lower kiln sends a form to the clerk of the port with the name of the barge."


DOCS = "doc_id long, text string"


def found(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    return {r["doc_id"]: r["residue"] for r in R.residue(spark.createDataFrame(rows, DOCS)).collect()}


FILLER = [
    "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do.\n" * 3, "asdf jkl qwer test xxx asdf jkl asdfgh qwer jkl test xxx", "Sample text goes here. " * 9, "Dates: to be written\nContact: ???\nAnnex: tbd", "Headline goes here\n\nText block. Text block. Text block.",
    "Guide to Tolls\nPublished 1/2/2003\n\nAnnex: content coming soon\nContact: tbd\n\nRelated\n* Guide to Quays\n* Handbook on the Lower Barges of the Port",
    *("This is placeholder text for the layout of the page. " * n for n in (15, 25, 400)), "The clerk of the port is at the desk for you. " * 25,
]
CONTENT = [
    BODY, BODY + '\n\nIf the portal shows "Error 404", check the number on the form and call the desk.', "Visitors must enable JavaScript before the map will load.\n\n" + BODY, "", "\n", BODY * 40, *("Any of the desks is open on the day of the fair. " * n + BODY for n in (15, 25, 400)), "| Dates | tbd |\n| Fees | 4 |",
]


def test_filler_needs_no_other_records(spark):
    assert found(spark, FILLER + CONTENT) == dict.fromkeys(range(len(FILLER)), "filler")


MESSAGES = [
    ("HTTP 503 - the server could not complete your request.\nReference: a05db6ebdd", "error_page"), ("Error 404\nThe page you asked for does not exist or has been moved.", "error_page"), ("Noscript: content loads dynamically and cannot be displayed", "script_notice"),
    ("Esta hoja del portal no contesta por ahora, vuelva más tarde.", "error_page"), ("Please enable JavaScript to view this page.", "script_notice"), ("Unhandled exception at render_page (quay.src:12)\n  caused by: null pointer in the loader\n  at dispatch:9", "error_page"),
]
SHELLS = ["{}", "Menu  Search  Contact\n\n{}", "Guide to Tolls\nPublished 1/2/2003\n\n{}\n\nRelated\n* Guide to Quays\n\nFennick counter, open 9 to 12", "{}\n\nHome | Forms | Sign in"]


def test_messages_that_recur_on_pages_without_content(spark):
    texts, kinds = [], {}
    for i, (message, kind) in enumerate(MESSAGES):
        for j, shell in enumerate(SHELLS):
            kinds[len(texts)] = kind
            text = shell.format(message.replace("9", str(i + j)))
            texts.append(text.upper() if j == 1 else text)
    assert found(spark, texts + [BODY + f" Text {i}." for i in range(9)]) == kinds


def test_lines_of_pages_with_content_are_no_messages(spark):
    said = "For all other questions please call the desk of the port."
    texts = [f"{BODY} This is text {w}.\n{said}" for w in "abcdefghijklmnop"] + [f"Title {w}\n{said}" for w in "abcd"]  # mostly beside content
    texts += ["The tolls of the lower quay are paid at the desk on the first day of the fair."] * 9  # one page, copied
    assert found(spark, texts) == {}


def test_any_message_counts_whatever_its_length(spark):
    message = "page not found on this portal, sorry to say so. " * 25
    texts = [shell.format(message + "\n" + message) for shell in SHELLS] + [f"{BODY} {w}." for w in "abcdef"]
    assert set(found(spark, texts)) == {0, 1, 2, 3}


def test_defaults_and_blanks_in_slots_that_other_records_fill(spark):
    fee = "The fee for the annual permit is {} and must be paid by {} at the desk.\n\n" + BODY
    filled = [fee.format(f"{'abcdefgh'[i]} marks", f"day {'abcdefgh'[i]}") + f" Text {i}." for i in range(6)]
    owner = [f"Owner: {w} and Daughters of Orrenby\n\n{BODY} Text {w}." for w in ("Peloskis", "Culimish", "Braulund")]
    greeting = [f"We thank you, {w}, for your order of the quay.\n\n{BODY} Text {w}." for w in ("Denpelan", "Torkelling", "Gornesan")]
    residue = [fee.format("TBD", "the first of May"), fee.format("????", "____"), f"Owner: ?????\n\n{BODY}", f"We thank you, [Customer Name], for your order of the quay.\n\n{BODY}"]
    kept = [f"The annex marked TBD in the old draft has since been written.\n\n{BODY} Text {i}." for i in range(3)] + [f"Name: ______ Date: ____\n\n{BODY}", f"The clerk wrote [illegible] and [sic] beside two names.\n\n{BODY}"]
    texts = residue + filled + owner + greeting + kept
    assert found(spark, texts) == dict.fromkeys(range(len(residue)), "placeholder")


@pytest.mark.parametrize("slot", ["{{ name }}", "${berth_no}", "<<title>>", "<%= company %>", "[[body]]", "@@ref_no@@", "%PARISH_NAME%", "__YEAR__", "<enter title here>", "[INSERT REF NO]", "[your company]", "[●]", "XX/XX/XXXX", "{0}", "{year}", "#RECIPIENT#", "[OFFICER]", "«Amount_Due»"])
def test_slots(spark, slot):
    assert found(spark, [f"Dear {slot},\n\n{BODY}", BODY]) == {0: "placeholder"}


def test_texts_that_show_such_things_are_kept(spark):
    shown = [
        'In a template, write `{{ field }}` where the name should appear.', '```\ngreeting = "Dear ${name}"\n```', "The clerk wrote [illegible] and [sic] beside two names.", "The set {a, b, c} lists three gauges, and [0] refers to the note.",
        "Name: ______________   Date: ____/____/______", "The annex marked TBD in the old draft has since been written.", '{"berth": 12, "state": "open"} is what the gauge sends.',
    ]
    assert found(spark, [f"{s}\n\n{BODY}" for s in shown]) == {}


def test_a_sentence_that_recurs_unchanged_is_no_slot(spark):
    texts = [f"Heading number {i} of the gazette. In templates the mark [OFFICER] stands for the clerk. {BODY} This is text {i}." for i in range(12)]
    assert found(spark, texts) == {}


def test_nulls_repeats_long_texts_and_the_rest(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, f"Dear {{{{x}}}}, {BODY}", "a"), (3, f"Dear {{{{x}}}}, {BODY}", "a"), (4, BODY * 2_000, "b"), (5, BODY, None), (None, "Error 404", "c")]
    docs = spark.createDataFrame(rows, DOCS + ", residue string")
    assert [tuple(r) for r in R.residue(docs).collect()] == [(3, "placeholder")]
    assert sorted(r["doc_id"] for r in R.without_residue(docs).collect() if r["doc_id"] is not None) == [1, 2, 4, 5]
    assert R.residue(spark.createDataFrame([], DOCS)).count() == 0


def test_copies_with_small_edits_stay_residue(spark):
    text = f"Heading of the gazette. In every letter the clerk [OFFICER] signs for the port. {BODY}"
    texts = [text + f" Edited {i}." for i in range(30)] + [text.replace("Heading", f"Heading {c}") for c in "abcdefgh"]
    assert set(found(spark, texts)) == set(range(len(texts)))


def test_recurring_unambiguous_residue_stays_residue(spark):
    texts = [f"Heading number {'abcdefghijkl'[i]} of the gazette.\n\nThe letter is signed: @@valid_until@@\n\n{BODY} This is text {i}." for i in range(12)]
    assert set(found(spark, texts)) == set(range(12))
    shown = [f"Heading number {'abcdefghijkl'[i]} of the gazette. In templates the mark {{{{ officer }}}} stands for the clerk. {BODY} This is text {i}." for i in range(12)]
    assert found(spark, shown) == {}
