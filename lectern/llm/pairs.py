"""Broken question-answer pairs, each with its kind of defect.

Method: the openings of all answers are clustered by MinHash, every link verified by exact Jaccard
similarity. A cluster that recurs across unrelated prompts is a template; where it carries nothing
that belongs to a prompt and is mostly recorded as no answer, it is a refusal. Copies of the
question, answers in another language and answers that break off are found by checks of the single
pair. What a language looks like is learned from labelled texts, as frequencies of three letters in a
row; whether a last word can end a sentence is learned from the ends of all sentences.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.tables import materialise

#: Words of an answer that make its opening, words of a shingle, and the similarity of a link.
OPENING, SHINGLE, SIMILAR = 12, 5, 0.8
#: Bands and rows of the MinHash index: a pair at SIMILAR is missed once in 3,500 times.
BANDS, ROWS = 8, 2
#: Unrelated prompts that make an opening a template.
PROMPTS = 3
#: Share of a template's answers recorded as no answer that makes it a refusal.
DECLINED = 0.3
#: Share of a template's answers that cite sources from which it is an answer.
CITING = 0.2
#: Occurrences from which the learned sentence ends are trusted, and the least share of ends.
SEEN, ENDS = 30, 0.004
#: Labelled texts that the languages are learned from, at most about, and texts that make a language.
LABELLED, LANGUAGE_TEXTS = 20_000, 3
#: Letters are numbered up to this; the natural logarithm of the odds from which a language is told.
LETTERS, ODDS = 64, 8.0

# ---- fixed values -------------------------------------------------------------------------
#: Written forms of nothing.
NOTHING = ("none", "null", "nil", "nan", "na", "n a", "no text", "no answer", "answer", "antwort", "réponse", "respuesta", "undefined", "empty", "keine antwort", "sin respuesta", "pas de réponse", "tbd")
#: Marks that close a sentence, and marks that leave it open.
CLOSING, OPEN = ".!?。！？…|", ",;:–—-([{/&+=<"
# -------------------------------------------------------------------------------------------

_CITE = re.compile(r"\s*\[\d+\]")
_QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|«[^»\n]*»|„[^“”\n]*[“”]")
_SENTENCE_END = re.compile(r"([^\W_]+)[\"”»')]*[.!?]+(?=\s|$)")
_NOTHING = frozenset(NOTHING)


def _bare(answer: str | None) -> str:
    """The answer without citations, invisible characters and outer white space."""
    return re.sub("[ ​-‏⁠﻿­]", " ", _CITE.sub("", answer or "")).strip()


def is_empty(answer: str | None) -> bool:
    """No content: nothing, marks only, or a written form of nothing."""
    own = W.words_of(_bare(answer))
    return not own or " ".join(own) in _NOTHING


def is_copy(question: str | None, answer: str | None) -> bool:
    """Only gives back the question, perhaps with a lead-in or more than once."""
    q, a = W.words_of(question), W.words_of(_bare(answer))
    if len(q) < 3 or len(a) < 0.7 * len(q):
        return False
    extra = Counter(a)
    for w, n in Counter(q).items():
        if w in extra:  # the question may be given back several times
            extra[w] = max(0, extra[w] - n * max(1, round(len(a) / len(q))))
    return sum(extra.values()) <= 4 and len(set(a) & set(q)) >= 0.8 * len(set(q))


@cache
def _letters() -> np.ndarray:
    """Number of every code point of the basic plane: 0 for what is no letter, a to z, and the rest by remainder."""
    out = np.zeros(1 << 16, np.int32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % (LETTERS - 27)
    return out


def _triples(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code of every three characters in a row, text of each); runs of what is no letter count as one."""
    joined = "\n\n".join(texts) + "\n\n"
    points = np.minimum(np.frombuffer(joined.lower().encode("utf-32-le", "replace"), np.uint32), 0xFFFF)
    if len(points) != len(joined):  # a letter whose lower case is longer
        return _triples([t.casefold().lower().encode("ascii", "ignore").decode() for t in texts])
    letter = _letters()[points]
    text = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    keep = np.ones(len(letter), bool)
    keep[1:] = (letter[1:] > 0) | (letter[:-1] > 0)
    letter, text = letter[keep], text[keep]
    code = (letter[:-2] * LETTERS + letter[1:-1]) * LETTERS + letter[2:]
    own = (text[:-2] == text[2:]) & (letter[1:-1] > 0)
    return code[own], text[:-2][own]


class Languages:
    """Frequencies of three letters in a row, by language."""

    def __init__(self, names: list[str], counts: np.ndarray) -> None:
        self.names = names
        share = (counts + 0.05) / (counts.sum(axis=1, keepdims=True) + 0.05 * counts.shape[1])
        self.log = np.log(share).astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): logarithm of the likelihood of the letters of a text."""
        code, text = _triples(texts)
        return np.stack([np.bincount(text, row[code], len(texts)) for row in self.log], axis=1) if self.names else np.zeros((len(texts), 0))

    def foreign(self, questions: list[str], answers: list[str]) -> np.ndarray:
        """Whether the answer's language is clear and isn't the question's."""
        if len(self.names) < 2 or not questions:
            return np.zeros(len(questions), bool)
        asked, told = self.scores(questions), self.scores(answers)
        best = asked.argmax(axis=1)
        every = np.arange(len(best))
        clear = best_lead(asked) >= ODDS / 2
        return clear & (told.max(axis=1) - told[every, best] >= ODDS)


def best_lead(scores: np.ndarray) -> np.ndarray:
    """How far the best language is before the next."""
    top = np.partition(scores, -2, axis=1)
    return top[:, -1] - top[:, -2]


def _count_triples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for name, own in pdf.groupby("lang", sort=False):
            code, n = np.unique(_triples(list(own["text"]))[0], return_counts=True)
            yield pd.DataFrame({"lang": name, "code": code.astype(np.int32), "n": n, "texts": np.r_[len(own), np.zeros(max(len(code) - 1, 0), np.int64)][: len(code)]})


def learn_languages(texts: DataFrame, limit: int = LABELLED) -> Languages:
    """The languages of labelled texts (text, lang), from about ``limit`` of them, chosen by hash.

    Labels are read by their first two letters in any case; some wrong ones do no harm. What is
    collected has a row per language and three letters in a row, at most LETTERS ** 3 a language.
    """
    name = F.regexp_extract(F.lower(F.trim("lang")), r"^([a-z]{2})(?:[-_].*)?$", 1)
    named = texts.select(F.col("text").alias("text"), name.alias("lang")).where("text is not null and lang != ''")
    total = named.count()
    chosen = named if total <= limit else named.where(F.pmod(F.xxhash64("text"), F.lit(total)) < limit)
    # copies of a text share a hash: they count once, however many there are
    counted = chosen.dropDuplicates(["text", "lang"]).mapInPandas(_count_triples, "lang string, code int, n long, texts long").groupBy("lang", "code").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).toPandas()
    sizes = counted.groupby("lang")["texts"].sum() if len(counted) else {}
    names = sorted(k for k in dict(sizes) if sizes[k] >= max(LANGUAGE_TEXTS, 0.002 * sum(sizes)))
    counts = np.zeros((len(names), LETTERS**3))
    for i, k in enumerate(names):
        own = counted[counted["lang"] == k]
        counts[i, own["code"].to_numpy()] = own["n"].to_numpy()
    return Languages(names, counts)


def left_open(answer: str) -> tuple[bool, str]:
    """(breaks off by its marks, last word where only the word can tell)."""
    raw = answer.rstrip().rstrip("*_`").rstrip()
    text = _CITE.sub("", raw).rstrip()
    if not text:
        return False, ""
    marks = _QUOTED.sub("", text)
    if re.search(r"\[\d*$", raw) or text[-1] in OPEN or marks.count('"') % 2 or any(marks.count(a) > marks.count(b) for a, b in ("()", "[]", "«»", "“”")):
        return True, ""
    if text[-1] in CLOSING or (text[-1] in "\"”»')" and text[-2:-1] in CLOSING):
        return False, ""
    last = re.search(r"([^\W_]+)[\"”»')\]]*$", text)
    word = last.group(1).lower() if last else ""
    return False, "" if any(c.isdigit() for c in word) or text[-1] in "\"”»')]}" else word


FEATURES = "result_id long, prompt string, no_answer boolean, kind string, last string, opening string, tail string, cites boolean, word string, seen long, ends long, opens long"


def _features(languages: Languages):
    """mapInPandas function: a row per pair, and the counts of words (word, seen, ends, opens), added up before they leave the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[str] = Counter()
        ends: Counter[str] = Counter()
        opens: Counter[str] = Counter()

        def counted() -> pd.DataFrame:
            none = np.full(len(seen), None, dtype=object)
            own = {"word": np.array([*seen, None], dtype=object)[:-1], "seen": list(seen.values()), "ends": [ends[w] for w in seen], "opens": [opens[w] for w in seen]}
            return pd.DataFrame({c.split()[0]: own.get(c.split()[0], none) for c in FEATURES.split(", ")})

        for pdf in batches:
            out = []
            foreign = languages.foreign([_QUOTED.sub(" ", q or "") for q in pdf["question"]], [_QUOTED.sub(" ", _bare(a)) for a in pdf["answer"]])
            for question, answer, other in zip(pdf["question"], pdf["answer"], foreign.tolist(), strict=True):
                if is_empty(answer):
                    out.append(("empty", "", "", "", False))
                    continue
                broken, last = left_open(answer)
                text = _CITE.sub("", answer).lower()
                seen.update(W.WORD.findall(text))
                ends.update(_SENTENCE_END.findall(text))
                if last:
                    opens[last] += 1
                kind = "copy" if is_copy(question, answer) else "language" if other else "truncated" if broken else ""
                first, *rest = re.split(r"(?<=[.!?])\s+", _bare(answer), maxsplit=1)
                out.append((kind, last, " ".join("0" if w.isdigit() else w for w in W.words_of(first)[:OPENING]), " ".join(W.words_of(rest[0] if rest else "")), bool(_CITE.search(answer))))
            yield pd.concat([pdf[["result_id", "prompt", "no_answer"]], pd.DataFrame(out, columns=["kind", "last", "opening", "tail", "cites"], index=pdf.index, dtype=object)], axis=1).assign(word=np.full(len(pdf), None, dtype=object), seen=0, ends=0, opens=0)
            if len(seen) > 200_000:
                yield counted()
                seen, ends, opens = Counter(), Counter(), Counter()
        if seen:
            yield counted()

    return run


def _shingles(opening: str) -> np.ndarray:
    own = opening.split(" ")
    return np.unique(W.shingle_hashes(W.hash_words(own), min(SHINGLE, len(own))))


def _bands(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seeds = W.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
    for pdf in batches:
        keys = np.stack([W.mix(_shingles(o)[:, None] ^ seeds[None, :]).min(0).reshape(BANDS, ROWS) for o in pdf["opening"]]) if len(pdf) else np.empty((0, BANDS, ROWS), np.uint64)
        total = np.zeros(keys.shape[:2], np.uint64)
        for r in range(ROWS):
            total = W.mix(total + keys[:, :, r])
        total = W.mix(total + np.arange(BANDS, dtype=np.uint64)[None, :])
        yield pd.DataFrame({"opening": np.repeat(pdf["opening"].to_numpy(), BANDS), "bucket": total.reshape(-1).view(np.int64)})


def _alike(a: set[int], b: set[int]) -> bool:
    both = len(a & b)
    return both >= SIMILAR * (len(a) + len(b) - both)


def _led(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (bucket, opening, leads) of buckets of two or more: an opening that no leader before it is similar to leads."""
    bucket, leaders, held = None, [], None
    for pdf in batches:
        out = []
        for b, opening in zip(pdf["bucket"], pdf["opening"], strict=True):
            if b != bucket:
                bucket, leaders, held = b, None, opening  # a row alone in its bucket goes no further
                continue
            if leaders is None:
                out.append((b, held, True))
                leaders = [set(_shingles(held).tolist())]
            own = set(_shingles(opening).tolist())
            leads = not any(_alike(own, x) for x in leaders)
            if leads:
                leaders.append(own)
            out.append((b, opening, leads))
        yield pd.DataFrame(out, columns=["bucket", "opening", "leads"]).astype({"opening": object})


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Verified links (opening, leader) of rows sorted by bucket, its leaders first: every row to every leader it is similar to."""
    bucket, leaders = None, []
    for pdf in batches:
        out = []
        for b, opening, leads in zip(pdf["bucket"], pdf["opening"], pdf["leads"], strict=True):
            if b != bucket:
                bucket, leaders = b, []
            own = set(_shingles(opening).tolist())
            out += [(opening, name) for name, known in leaders if _alike(own, known)]
            if leads:
                leaders.append((opening, own))
        yield pd.DataFrame(out, columns=["opening", "leader"], dtype=object)


def opening_clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster) of distinct openings.

    The members of a bucket are linked to all its leaders, so a bucket that holds a third of all rows
    costs no more than its rows times its different wordings. The least label spreads along the links
    and from label to label, so that chains shrink by half a round.
    """
    banded = openings.mapInPandas(_bands, "opening string, bucket long")
    ordered = banded.repartition("bucket").sortWithinPartitions("bucket", "opening")
    led = materialise(ordered.mapInPandas(_led, "bucket long, opening string, leads boolean"), "led")
    ordered = led.repartition("bucket").sortWithinPartitions("bucket", F.desc("leads"), "opening")
    links = materialise(ordered.mapInPandas(_linked, "opening string, leader string").distinct(), "links")
    both = links.unionByName(links.select(F.col("leader").alias("opening"), F.col("opening").alias("leader")))
    labels = materialise(both.groupBy("opening").agg(F.least(F.min("leader"), F.col("opening")).alias("cluster")), "labels")
    while True:
        near = both.join(labels.select(F.col("opening").alias("leader"), F.col("cluster").alias("other")), "leader").groupBy("opening").agg(F.min("other").alias("other"))
        step = labels.join(near, "opening").select("opening", "cluster", F.least("cluster", "other").alias("least"))
        up = labels.select(F.col("opening").alias("least"), F.col("cluster").alias("above"))
        step = materialise(step.join(up, "least", "left").select("opening", F.least("least", F.coalesce("above", "least")).alias("next"), "cluster"), "labels")
        labels = step.select("opening", F.col("next").alias("cluster"))
        if step.where("next < cluster").isEmpty():
            break
    return openings.join(labels, "opening", "left").select("opening", F.coalesce("cluster", "opening").alias("cluster"))


def defects(results: DataFrame, answers: DataFrame, labelled: DataFrame) -> DataFrame:
    """(result_id, defect) of every broken pair whose refusal_correct is null.

    ``labelled`` (text, lang) are texts that the languages are learned from; without any no answer is
    in another language. Repeated rows count once; missing answers rows and null flags count as not
    recorded. A null answer, question or prompt is an empty text. Defects are looked for in the order
    empty, copy, refusal, language, truncated; the first that holds is given.
    """
    languages = learn_languages(labelled)
    said = answers.select(F.col("query_id").alias("result_id"), "no_answer").groupBy("result_id").agg(F.max("no_answer").alias("no_answer"))
    own = results.where(F.col("refusal_correct").isNull() & F.col("result_id").isNotNull()).groupBy("result_id").agg(F.max_by(F.struct("question", "answer", "case_id"), F.struct(F.col("loaded_at").isNotNull(), "loaded_at")).alias("r"))
    pairs = own.select("result_id", "r.question", "r.answer", F.coalesce(F.col("r.case_id").cast("string"), "r.question").alias("prompt"))
    rows = pairs.join(said, "result_id", "left").select("result_id", "question", "answer", "prompt", "no_answer")
    both = materialise(rows.mapInPandas(_features(languages), FEATURES), "pairs")
    f = both.where("result_id is not null").select("result_id", "prompt", "no_answer", "kind", "last", "opening", "tail", "cites")
    lexicon = both.where("result_id is null").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("seen", "ends", "opens")))

    # templates: openings that recur across unrelated prompts
    spoken = f.where("opening != ''")
    clusters = opening_clusters(spoken.select("opening").distinct())
    tails = spoken.where("tail != ''").select("tail", "prompt").distinct().groupBy("tail").agg((F.count("*") >= PROMPTS).alias("stock"))
    cast = spoken.join(clusters, "opening").join(tails, "tail", "left").withColumn("bare", (F.col("tail") == "") | F.coalesce("stock", F.lit(False)))
    cast = materialise(cast.select("result_id", "prompt", "cluster", "no_answer", "bare", "cites"), "cast")
    prompts = cast.select("cluster", "prompt").distinct().groupBy("cluster").agg(F.count("*").alias("prompts")).where(F.col("prompts") >= PROMPTS)
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    templates = cast.groupBy("cluster").agg(share(F.col("no_answer")).alias("declined"), share(F.col("bare")).alias("bare"), share(F.col("cites")).alias("cites"))
    refusing = templates.where((F.col("declined") >= DECLINED) & (F.col("bare") >= 0.5) & (F.col("cites") < CITING)).join(prompts, "cluster", "left_semi").select("cluster")
    refusals = cast.where("bare").join(refusing, "cluster").select("result_id", F.lit(True).alias("refuses"))

    # terminations: a last word that is common but never ends a sentence, a piece of a common word, or one seen at open ends only
    lexicon = materialise(lexicon, "ends")
    last = f.where("last != ''").select("last").distinct()
    known = last.join(lexicon, last["last"] == lexicon["word"], "left")
    longer = F.broadcast(last) if last.count() <= 100_000 else last
    piece = lexicon.where(f"seen >= {SEEN}").select(F.col("word").alias("whole")).withColumn("last", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("whole") - 1, F.lit(1))), lambda n: F.substring("whole", F.lit(1), n))))
    piece = piece.where("last != whole").join(longer, "last", "left_semi").select("last").distinct().withColumn("piece", F.lit(True))
    never = (F.col("seen") >= SEEN) & (F.col("ends") < ENDS * F.col("seen"))
    part = F.coalesce("piece", F.lit(False)) & (F.coalesce("ends", F.lit(0)) == 0)
    ends = known.join(piece, "last", "left").select("last", (never | part | ((F.col("seen") >= 2) & (F.col("seen") <= F.col("opens")))).alias("breaks"))
    judged = f.join(refusals, "result_id", "left").join(ends, "last", "left")
    defect = F.when(F.col("kind").isin("empty", "copy"), F.col("kind")).when(F.col("refuses"), "refusal").when(F.col("kind") != "", F.col("kind")).when(F.col("breaks"), "truncated")
    return judged.select("result_id", defect.alias("defect")).where(F.col("defect").isNotNull()).distinct()
