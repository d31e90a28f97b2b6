import datetime as dt
import itertools
import random

import pytest

from lectern.llm import pairs as P


@pytest.mark.parametrize(("answer", "empty"), [(None, True), ("", True), ("  ​", True), ("-", True), ("N/A", True), ("[1]", True), ("Answer:", True), ("{}", True), ("65 days [3]", False), ("No.", False), ("none of them", False)])
def test_empty(answer, empty):
    assert P.is_empty(answer) is empty


Q = "What happens to the lower kiln if the sworn buoy is not returned in time?"


@pytest.mark.parametrize(
    ("answer", "copy"),
    [(Q, True), ("  " + Q.upper(), True), ("You asked: " + Q, True), (Q + "\n" + Q, True), (Q + " The kiln is sold and the money goes to the owner of the buoy.", False), ("The kiln is sold.", False), ("", False), (None, False)],
)
def test_copy(answer, copy):
    assert P.is_copy(Q, answer) is copy


#: A few texts in each of five languages, some of them with a label that is spelt differently or wrong.
TEXTS = {
    "en": ["The holder of the buoy must return it to the office before the end of the week.", "What happens to the kiln if the money is not paid in time by the owner of the land?", "Any person who is late with the form should ask the clerk for another three days.", "This rule was changed when the old harbour had been closed and which boats were there is not known.", "The kiln is sold and the money goes to the owner of the buoy, as they have always done.", "Where does the clerk keep the list of all the boats that were brought here last year?"],
    "de": ["Die alte Fähre wurde geschlossen, obwohl die Sitzung noch nicht beendet war.", "Wer muss dem Amt die Liste vorlegen, wenn die Frist schon verstrichen ist?", "Ohne eine schriftliche Vollmacht darf niemand die Werft betreten oder verschieben.", "Nach dreißig Tagen wird der Antrag von dem Ausschuss gelesen und dann verschickt.", "Für jede verspätete Lieferung sind zwölf Mark zu zahlen, falls nichts anderes gilt.", "Das Formular heißt Antrag auf die Zulassung und gehört zu den Unterlagen der Stadt."],
    "fr": ["La vieille barge a été fermée alors que la séance restait ouverte aux personnes.", "Quand est-ce que le bureau peut payer la taxe qui manque dans la caisse commune?", "Toute personne qui perd la lanterne doit demander une nouvelle pièce au comité.", "Cette taxe coûte trente euros et elle est payée avant la fin du mois par le propriétaire.", "Après dix jours, le comité a lu la quittance et l'a renvoyée vers la ville voisine.", "Il faut payer pour la clause ancienne, à moins que la cale privée ne suffise."],
    "es": ["La antigua barca se cerró aunque la factura seguía abierta para todos los vecinos.", "¿Cuántos días tiene la oficina para presentar la nueva solicitud del puerto?", "Quien pierda la llave debe pedir otra y presentar también la lista del año pasado.", "El comité leyó la pequeña cláusula y envió la grande caja a la ciudad.", "Pasados tres días, la licencia no vale salvo que falte la firma del dueño.", "No hay nada que pagar por la fianza si el contrato se firmó sin errores."],
}
LABELLED = [(t, spelt) for k, ts in TEXTS.items() for i, t in enumerate(ts) for spelt in (k, k.upper() if i % 2 else f" {k}-XX ", k)] + [(TEXTS["de"][0], "fr"), (TEXTS["en"][0], None), (None, "en"), ("", "de"), ("etwas", "?")]


def labelled(spark):
    return spark.createDataFrame(LABELLED, "text string, lang string")


def test_languages_are_learned(spark):
    known = P.learn_languages(labelled(spark))
    assert known.names == ["de", "en", "es", "fr"]
    answers = {
        "Ohne die alte Frist darf niemand die Sitzung öffnen oder die Werft verschieben.": True, "Cette taxe coûte trente euros, payés à la fin du mois.": True, "Sí. En 1976 se cerró la verbal barca, aunque la pública factura seguía abierta.": True,
        "La tassa costa trenta euro e deve essere pagata prima della fine del mese dal proprietario.": True, "65 days [3]": False, "Yes.": False, "": False, "The clerk keeps the list of the boats in the old harbour.": False, "Wexholm, Skelwick": False,
    }
    got = known.foreign([Q] * len(answers), list(answers))
    assert dict(zip(answers, got.tolist(), strict=True)) == answers
    assert not known.foreign([TEXTS["fr"][1]], ["Cette taxe coûte trente euros."])[0]
    assert P.learn_languages(spark.createDataFrame([], "text string, lang string")).foreign([Q], [Q]).tolist() == [False]
    assert known.foreign([], []).tolist() == []


@pytest.mark.parametrize(("answer", "opens", "last"), [("It ends here.", False, ""), ("It ends with,", True, ""), ("goes to (", True, ""), ('the "old quay', True, ""), ("at [2", True, ""), ("It is kept [1][2]", False, "kept"), ("It is kept", False, "kept"), ("Form K433 [1]", False, ""), ("- a quay\n- a kiln", False, "kiln"), ("Not so etc.", False, "")])
def test_ends(answer, opens, last):
    assert P.left_open(answer) == (opens, last)


RESULTS = "result_id long, case_id long, question string, answer string, refusal_correct boolean, loaded_at timestamp"


def run(spark, rows, flags=()):
    results = spark.createDataFrame([(i, c, q, a, r, dt.datetime(2024, 1, 1)) for i, c, q, a, r in rows], RESULTS)
    answers = spark.createDataFrame(list(flags), "query_id long, no_answer boolean")
    out = [tuple(r) for r in P.defects(results, answers, labelled(spark)).collect()]
    assert len(out) == len(dict(out))
    return dict(out)


def test_templates_that_recur_across_prompts_are_refusals(spark):
    asked = [f"When must holder {i} return the quay number {i} of the port?" for i in range(40)]
    rows = [(i, i, asked[i], "That is beyond what these pages tell me." + (" Ask again tomorrow please." if i % 2 else ""), None) for i in range(10)]
    rows += [(100 + i, i, asked[i], f"An applicant who is late gets {i + 20} more days [2].", None) for i in range(20)]
    rows += [(200 + i, i, asked[i], f"The holder of quay {i} returns it after the fair at port {i}.", None) for i in range(20)]
    flags = [(i, True) for i in range(8)] + [(i, False) for i in range(100, 120)]
    got = run(spark, rows, flags)
    assert {i for i, d in got.items() if d == "refusal"} == set(range(10))
    assert set(got) == set(range(10))


def test_kinds_repeats_and_nulls(spark):
    good = "The kiln is sold and the money goes to the owner of the buoy."
    rows = [
        (1, 1, Q, None, None), (1, 1, Q, None, None), (2, 2, Q, Q, None), (4, 4, Q, "Wer die alte Fähre verliert, muss die Frist beantragen und die Liste vorlegen.", None),
        (5, 5, Q, "The kiln is sold and the money goes to the", None), (6, 6, Q, good, None), (7, 7, Q, good[:-1], None), (8, 8, Q, None, True), (9, None, None, good, None), (None, 1, Q, None, None),
    ]
    rows += [(100 + i, i, Q, f"The clerk of the port sees that the boat of owner {i} is in the list of the year.", None) for i in range(12)]
    rows += [(200 + i, 20 + i, Q, "Sorry, but I cannot help with this.", None) for i in range(3)]
    assert run(spark, rows, [(1, None), (6, False), (6, False), (200, True), (201, True)]) == {1: "empty", 2: "copy", 4: "language", 5: "truncated", 200: "refusal", 201: "refusal", 202: "refusal"}
    assert run(spark, []) == {}


def test_sentence_ends_are_learned_and_templates_that_answer_are_kept(spark):
    rows = [(i, i, Q, f"The boat {i} is kept by the owner with the list of the old harbour.", None) for i in range(40)]
    rows += [(50, 50, Q, "It is kept by the owner with", None), (51, 51, Q, "It is kept in the harbour", None)]
    rows += [(60 + i, i, Q, "Yes, that is so.", None) for i in range(9)]  # recurs, but isn't recorded as no answer
    assert run(spark, rows, [(60, True)]) == {50: "truncated"}


def test_openings_of_one_template_are_one_cluster(spark):
    base = "per the rules of the port the board keeps the sworn barge".split()
    openings = [" ".join(base[:11] + [w]) for w in ("barge", "barges")] + ["a very different opening of an answer about nothing at all here"]
    got = dict(map(tuple, P.opening_clusters(spark.createDataFrame([(o,) for o in openings], "opening string")).collect()))
    assert len(got) == 3
    assert got[openings[2]] == openings[2]


def test_clusters_lose_no_similar_openings(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(60)]
    openings = set()
    for _ in range(60):
        base = [rng.choice(words) for _ in range(12)]
        openings |= {" ".join(base[:n]) for n in (10, 11, 12)} | {" ".join(base[:4] + [rng.choice(words)] + base[5:])}
    openings = sorted(openings | {"one", "one two", "one two three four five six"})
    got = dict(map(tuple, P.opening_clusters(spark.createDataFrame([(o,) for o in openings], "opening string")).collect()))
    sets = {o: set(P._shingles(o).tolist()) for o in openings}
    close = [(a, b) for a, b in itertools.combinations(openings, 2) if len(sets[a] & sets[b]) >= P.SIMILAR * len(sets[a] | sets[b])]
    assert len(close) > 100
    assert sum(got[a] == got[b] for a, b in close) / len(close) >= 0.99
