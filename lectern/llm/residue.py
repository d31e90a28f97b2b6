"""Template residue and pages that hold a message instead of content.

Method: records of one template are aligned and compared. Sentences are aligned by their opening
words; where aligned records differ there is a slot, and a slot that still holds a variable name, a
default or a blank is residue. A sentence that recurs unchanged beside different neighbours is a
constant of its template, not a slot, so texts that merely show a placeholder are kept; an
unambiguous variable must also be quoted or explained in it, since true residue recurs unchanged in
large tables. Pages are compared by the words of their lines: a line that recurs on different pages
without other content, and hardly on others, is the message of a template, and pages that say nothing
else are error pages or script notices. Pages of dummy words, of one sentence over and over, or of
unfilled labels are filler.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.tables import materialise, spread

# ---- fixed values -------------------------------------------------------------------------
#: Written forms that unambiguously mark a variable of a template language.
STRONG = (
    r"\{\{\s*[\w .-]{1,40}?\s*\}\}|\$\{[\w .-]{1,40}\}|<<\s*[\w .-]{1,40}?\s*>>|<%=?\s*[\w .-]{1,40}?\s*%>"
    r"|\[\[\s*[\w .-]{1,40}?\s*\]\]|@@\w{1,40}@@|%[A-Za-z]+(?:_[A-Za-z]+)*%|__[A-Z]+(?:_[A-Z]+)*__"
    r"|<(?:enter|insert|add|type|your) [^<>\n]{1,40}>|\[(?i:enter|insert|add|type|your) [^\[\]\n]{1,40}\]"
    r"|\[[●•…_]+\]|\bXX/XX/XX(?:XX)?\b"
)
#: Forms that may also be ordinary writing; they need the evidence of other records.
WEAK = r"\{(?:\d|[a-z]+(?:_[a-z]+)*)\}|#[A-Z]+(?:_[A-Z]+)*#|\[[A-Z]{2,}(?:[ _][A-Z]+)*\]|«[A-Z][a-z]+(?:_[A-Z][a-z]+)*»"
#: Values that stand where a field was never filled in.
DEFAULT = r"\?{2,}|t\.?b\.?[acd]\.?|to be (?:written|added|confirmed|defined|announced|completed)|(?:content )?coming soon|n/?n|x{3,}|_{3,}|\.{3,}|…+"
#: Defaults and blanks that may stand in a sentence; they need the evidence of other records too.
BLANK = r"\?{3,}|\b(?i:t\.?b\.?[acd])\b|\bto be (?:written|added|confirmed|defined|announced|completed)\b|\[[A-Za-z]+(?: [A-Za-z]+){0,3}\]|_{4,}"
LABEL_LINE = rf"(?im)^[ \t]*[\w][\w ]{{1,24}}:[ \t]*(?:{DEFAULT})[ \t]*$"
CODE = r"```[\s\S]*?(?:```|\z)|`[^`\n]*`"
#: Words so common in the four languages that running text cannot do without them.
COMMON_WORDS = (
    "the of and to is are that this each any for with from not may be in on at by der die das und ist nicht auch wenn den für mit auf "
    "muss wurde le les des une est pas pour dans sur qui que et du el los las por para una con se hay y"
).split()
#: Words by which a message that recurs on pages without content is named a script notice; all others are error pages.
SCRIPT_WORDS = ("script", "browser", "cookie")
#: The syllables of mock Latin, and what is typed to fill space.
SYLLABLES = "lorem ipsum dolor sit amet con sec tetur adipis cing elit sed do eius mod tempor in cidi dunt ut la bore et magna ali qua enim ad minim veniam quis nos trud exer ci ta tion ul lam co boris nisi ex ea modo quat duis au te iru re vol up velit esse cil lum fu giat nul pariatur lor met iam tur mag ris ven pis si ni na bo".split()
MASH = r"[asdfghjkl]{3,6}|[qwertyuiop]{4,6}|[zxcvbnm]{3,6}|fdsa|jkl|x{2,}|test|foo|bar|baz|blah|bla"
# -------------------------------------------------------------------------------------------

MARK = f"(?:{STRONG}|{WEAK})"
#: Sentences that speak of a mark (masked) instead of using it: it is quoted, or they explain templates.
SHOWN = (
    r"""["“”„'‘’‚»›]□["“”'‘’«‹]"""
    r"|\bmarks? □|(?i:\b(?:templates?|placeholders?|variables?|merge fields?|stands? for|syntax|vorlagen?|platzhalter|steht für|modèles?|gabarits?|plantillas?|marcador(?:es)?)\b)"
)
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("(?:" + "|".join(sorted(SYLLABLES, key=len, reverse=True)) + ")+")
_MASH = re.compile(MASH)
_DEFAULT = re.compile(LABEL_LINE)
_COMMON_SET = frozenset(COMMON_WORDS)
_TOKEN = re.compile(r"[^\W\d_]+|\n")
_ENDS = frozenset(".!?:\"”")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")

#: Words of running text, outside of what makes a page residue, up to which it has no content.
LITTLE = 8
#: Words from which a line without an end mark is running text.
LONG_LINE = 12
#: Different pages on which a message recurs, and the share of its pages that have no other content.
PAGES, EMPTY_SHARE = 3, 0.9

#: Recurring lines up to this number (about 2 MB) are broadcast, more are joined by shuffle.
BROADCAST_LINES = 200_000

PAGE = "doc_id bigint, page bigint, filler boolean, lines array<long>, running array<int>, role array<tinyint>"


@lru_cache(1 << 16)
def _mock(word: str) -> bool:
    return bool(_LATIN.fullmatch(word) or _MASH.fullmatch(word))


def _one_sentence(text: str) -> bool:
    """One sentence three times or more, and hardly anything else."""
    counts: dict[str, int] = {}
    for line in text.split("\n"):
        line = line.strip()
        if line and (line[-1] in ".!?" or len(line.split()) >= LONG_LINE):
            for x in _SENTENCE.split(line):
                counts[x.strip(" .!?")] = counts.get(x.strip(" .!?"), 0) + 1
    most = max(counts, key=lambda x: counts[x], default="")
    return counts.get(most, 0) >= 3 and sum(n * len(_WORD.findall(x)) for x, n in counts.items() if x != most) <= LITTLE


def _sequence(hashed: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """One hash for each of ``size`` sequences: ``at`` tells, in rising order, which sequence a value belongs to."""
    count = np.bincount(at, minlength=size)
    start = np.concatenate(([0], np.cumsum(count)[:-1]))
    place = (np.arange(len(at)) - start[at]).astype(np.uint64)
    out = count.astype(np.uint64)
    full = np.flatnonzero(count)
    if len(full):
        out[full] += np.add.reduceat(W.mix(hashed + place * np.uint64(0x9E3779B97F4A7C15)), start[full])
    return W.mix(out)


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row a page: its lines as hashes of their words, their words of running text, and what they can be.

    role: 0 text that can't be a message, 1 a possible message, 2 one that speaks of scripts.
    """
    for whole in batches:
        size = whole["text"].str.len().cumsum() // 4_000_000
        for _, pdf in whole.groupby(size, sort=False):
            tokens: list[str] = []
            ends, field, bars, page, lows, distinct = [], [], [], [], [], []
            for i, text in enumerate(pdf["text"]):
                low = text.lower()
                own = _TOKEN.findall(low)
                distinct.append(len(set(own)))
                tokens += own
                tokens.append("\n")
                lows.append(low)
                lines = [x.strip() for x in low.split("\n")]
                ends += [x[-1:] in _ENDS for x in lines]
                field += [":" in x and _DEFAULT.fullmatch(x) is not None for x in lines] if ":" in low else [False] * len(lines)
                bars += ["|" in x for x in lines] if "|" in low else [False] * len(lines)
                page += [i] * len(lines)
            codes, unique = pd.factorize(np.array(tokens, dtype=object))
            stop = (unique == "\n")[codes]
            at, codes = (np.cumsum(stop) - stop)[~stop], codes[~stop]  # the line and the code of every word
            ends, field, bars, page = np.array(ends), np.array(field), np.array(bars), np.array(page)
            count = lambda of: np.bincount(at, of[codes], len(page)).astype(np.int64)  # noqa: B023, E731
            total = lambda x: np.bincount(page, x, len(pdf)).astype(np.int64)  # noqa: B023, E731
            n = np.bincount(at, minlength=len(page))
            mock, common = count(np.array([_mock(w) for w in unique])), count(np.array([w in _COMMON_SET for w in unique]))
            dummy = (n > 0) & (mock >= 0.6 * n) & (common < 0.3 * n) & ~field
            running = np.where((ends | (n >= LONG_LINE) | dummy) & ~field, n, 0)
            rest, filled = total(np.where(dummy, 0, running)), total(np.where(dummy, n, 0))
            filler = ((filled > 0) & (filled >= rest)) | ((total(field) > 0) & (rest == 0) & ((total(field) > 1) | (total(np.where(field, 0, n)) <= LITTLE)))
            for i in np.flatnonzero(~filler & (np.array(distinct) * 3 <= total(n) + 3 * LITTLE + 3) & (rest > 0)):
                filler[i] = _one_sentence(lows[i])
            hashed = _sequence(pd.util.hash_array(unique, categorize=False)[codes], at, len(page))
            role = np.where(((running >= 3) | (n >= 5)) & ~bars, 1 + (count(np.array([any(x in w for x in SCRIPT_WORDS) for w in unique])) > 0), 0).astype(np.int8)
            page_hash = _sequence(hashed, page, len(pdf)).view(np.int64)
            kept = np.flatnonzero((running > 0) | (role > 0))
            cuts = np.searchsorted(page[kept], np.arange(1, len(pdf)))
            hashed, running = hashed.view(np.int64)[kept], running[kept].astype(np.int32)
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].to_numpy(), "page": page_hash, "filler": filler,
                "lines": np.split(hashed, cuts), "running": np.split(running, cuts), "role": np.split(role[kept], cuts),
            })


def page_residue(docs: DataFrame) -> DataFrame:
    """Pages without content and their kind: (doc_id, residue).

    A line is a message if it recurs on PAGES different pages of which EMPTY_SHARE or more have no
    other content. A page that has a message and hardly any other running text is residue.
    """
    pages = materialise(docs.select("doc_id", "text").mapInPandas(_pages, PAGE), "pages")
    said = pages.where("not filler").select("doc_id", "page", F.aggregate("running", F.lit(0), lambda a, x: a + x).alias("total"), F.explode(F.arrays_zip("lines", "running", "role")).alias("l"))
    said = said.select("doc_id", "page", "total", F.col("l.lines").alias("line"), F.col("l.running").alias("words"), F.col("l.role").alias("role"))
    alone = F.col("total") - F.col("words") <= LITTLE
    often = said.where("role > 0").groupBy("line").agg(F.count("*").alias("n"), F.count_if(alone).alias("empty")).where((F.col("empty") >= PAGES) & (F.col("empty") >= EMPTY_SHARE * F.col("n")))
    often = materialise(often.select("line"), "often")
    hint = lambda d: F.broadcast(d) if d.count() <= BROADCAST_LINES else d
    different = said.where(alone).join(hint(often), "line").select("line", "page").distinct().groupBy("line").agg(F.count("*").alias("pages"))
    messages = hint(materialise(different.where(F.col("pages") >= PAGES).select("line"), "messages"))
    hits = said.join(messages, "line").groupBy("doc_id", "page", "total").agg(F.sum("words").alias("words"), F.count_if(F.col("role") == 2).alias("scripts"), F.count("*").alias("lines"))
    notices = hits.where(F.col("total") - F.col("words") <= LITTLE).select("doc_id", F.when(F.col("scripts") * 2 > F.col("lines"), "script_notice").otherwise("error_page").alias("residue"))
    return pages.where("filler").select("doc_id", F.lit("filler").alias("residue")).unionByName(notices)


def _may_mark(text: Column) -> Column:
    """Whether a text has a character that a mark begins with: spares the expression on most texts."""
    out = text.rlike(r"#[A-Z]")
    for sign in ("{", "<", "[", "%", "@@", "__", "«", "XX/"):
        out = F.contains(text, F.lit(sign)) | out
    return out


def _no_code(text: Column) -> Column:
    return F.regexp_replace(text, CODE, " ")


def _sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+|\n+")


def _opening(sentence: Column) -> Column:
    """A label up to its colon, or the first three words, numbers and variables masked: the key records are aligned by."""
    masked = F.when(_may_mark(sentence), F.regexp_replace(sentence, MARK, "□")).otherwise(sentence)
    return F.regexp_replace(F.lower(F.regexp_extract(masked, r"^\W*?(\w[\w ]{0,24}:|(?:[\w□'-]+\W+){0,2}[\w□'-]+)", 1)), r"\d+", "0")


def blanks(docs: DataFrame) -> DataFrame:
    """Sentences with a default or a blank: (doc_id, opening, before, after), lower case, with what stands before it and the next words.

    What stands before must be a label or three words at least; a line to write on after a label is part of a form.
    """
    may = F.col("text").rlike(r"[Tt]\.?[Bb]\.?[ACDacd]")
    for sign in ("???", "____", "[", "to be "):
        may = F.contains("text", F.lit(sign)) | may
    has = docs.where(may & F.col("text").rlike(BLANK)).select("doc_id", F.explode(_sentences(_no_code(F.col("text")))).alias("s")).where(F.col("s").rlike(BLANK) & ~F.col("s").rlike(MARK))
    before = F.lower(F.regexp_extract("s", rf"^(.*?)(?:{BLANK})", 1))
    after = F.lower(F.regexp_extract(F.regexp_extract("s", rf"^.*?(?:{BLANK})(.*)$", 1), r"^\W*([\w'-]+(?:\W+[\w'-]+)?)", 1))
    out = has.select("doc_id", F.xxhash64(_opening(F.col("s"))).alias("opening"), before.alias("before"), after.alias("after"), F.regexp_extract("s", f"({BLANK})", 1).alias("mark"))
    label = F.col("before").rlike(r"^\W*\w[\w ]{0,24}:\s*$")
    return out.where((label & ~F.startswith("mark", F.lit("_"))) | F.col("before").rlike(r"^\W*(?:[\w'-]+\W+){3,}$")).drop("mark")


def template_openings(docs: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(opening, number of aligned sentences), and the distinct sentences (opening, s) of the ``wanted`` openings.

    Counted before the shuffle, over all documents.
    """
    s = docs.select(F.explode(_sentences(F.col("text"))).alias("s")).where(F.length("s") > 3).withColumn("opening", F.xxhash64(_opening(F.col("s"))))
    wanted = wanted.select("opening").distinct()
    kept = s.join(F.broadcast(wanted.withColumn("kept", F.lit(True))) if wanted.count() <= BROADCAST_LINES else wanted.withColumn("kept", F.lit(True)), "opening", "left")
    counts = materialise(kept.groupBy("opening", F.when(F.col("kept"), F.lower("s")).alias("s")).agg(F.count("*").alias("n")), "openings")
    return counts.groupBy("opening").agg(F.sum("n").alias("aligned")), counts.where("s is not null").select("opening", "s")


def unfilled(found: DataFrame, sentences: DataFrame) -> DataFrame:
    """(doc_id): records with a default or blank where others of the same template hold something else.

    Others begin with the same words and go on with the same words after the slot. At least two
    different ones must be filled, and as many as are not.
    """
    slots = found.groupBy("opening", "before", "after").agg(F.countDistinct("doc_id").alias("open"))
    lengths = slots.groupBy("opening").agg(F.collect_set(F.length("before")).alias("lengths"))
    begin = sentences.where(~F.col("s").rlike(BLANK) & ~F.col("s").rlike(f"(?i){MARK}")).join(lengths, "opening").select("opening", "s", F.explode("lengths").alias("length"))
    begin = begin.where(F.length("s") > F.col("length")).withColumn("before", F.expr("left(s, length)")).withColumn("rest", F.expr("substring(s, length + 1)"))
    same = begin.join(slots, ["opening", "before"]).where((F.col("after") == "") | F.contains("rest", "after"))
    filled = same.groupBy("opening", "before", "after", "open").agg(F.count("*").alias("filled")).where("filled >= 2 and filled >= open")
    return found.join(filled.select("opening", "before", "after"), ["opening", "before", "after"]).select("doc_id").distinct()


def slot_residue(docs: DataFrame) -> DataFrame:
    """(doc_id) of documents with a slot that still holds a variable, a default or a blank.

    Sentences with a variable are few, so only they are regrouped; the counts of aligned sentences
    come from one map-side-combined pass over all sentences.
    """
    has = docs.where(_may_mark(F.col("text")) & F.col("text").rlike(MARK)).select("doc_id", _no_code(F.col("text")).alias("text"))
    marked = (
        has.where(F.col("text").rlike(MARK))
        .withColumn("all", _sentences(F.col("text")))
        .select("doc_id", F.xxhash64("text").alias("copy"), F.posexplode("all").alias("pos", "s"), "all")
        .where(F.col("s").rlike(MARK))
        .select("doc_id", "copy", "s", F.xxhash64(F.get("all", F.col("pos") - 1)).alias("before"))
        .withColumn("opening", F.xxhash64(_opening(F.col("s"))))
        .withColumn("same", F.xxhash64(F.regexp_replace(F.lower("s"), r"\d+", "0")))
        .withColumn("literal", F.explode(F.array_distinct(F.regexp_extract_all("s", F.lit(f"({MARK})"), F.lit(1)))))
    )
    marked = materialise(marked, "marked")
    # a sentence that is the same beside different neighbours is a constant of the template
    constant = marked.groupBy("same").agg(F.countDistinct("before").alias("beside"), F.countDistinct("copy").alias("copies"))
    by_literal = marked.groupBy("literal").agg(F.countDistinct("same").alias("sentences"))
    by_slot = marked.groupBy("opening").agg(F.countDistinct("literal").alias("fillers"), F.count("*").alias("unfilled"))
    found = materialise(blanks(docs), "blanks")
    openings, sentences = template_openings(docs, found)
    aligned = marked.join(constant, "same").join(by_literal, "literal").join(by_slot, "opening").join(openings, "opening", "left")
    weak_proof = (F.col("sentences") >= 2) | (F.col("fillers") >= 2) | (F.coalesce("aligned", F.lit(0)) > F.col("unfilled")) | (F.col("copies") <= 2) | (F.col("beside") * 2 < F.col("copies"))
    # copies of one text with small edits mostly keep the neighbour, so it must differ as a rule
    fixed = (F.col("beside") >= 4) & (F.col("copies") >= 4) & (F.col("beside") * 2 >= F.col("copies")) & (F.length("s") >= 20)
    # true residue recurs too, the more the larger the table: an unambiguous variable must also be shown as one
    strong = F.col("literal").rlike(f"^(?:{STRONG})$")
    fixed = fixed & (~strong | F.regexp_replace("s", STRONG, "□").rlike(SHOWN))
    return aligned.where(~fixed & (strong | weak_proof)).select("doc_id").unionByName(unfilled(found, sentences)).distinct()


def residue(docs: DataFrame) -> DataFrame:
    """(doc_id, residue) of every document that holds residue.

    ``docs`` needs doc_id and text; other columns are ignored. Null ids and null or empty texts have no residue.
    Repeated rows give one row. A page without content is reported by the kind of page, a text with
    content by its unfilled slots.
    """
    docs = spread(docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()))
    pages = page_residue(docs)
    slots = slot_residue(docs).select("doc_id", F.lit("placeholder").alias("residue"))
    return slots.unionByName(pages).groupBy("doc_id").agg(F.min_by("residue", F.when(F.col("residue") == "placeholder", 1).otherwise(0)).alias("residue"))


def without_residue(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with all their columns."""
    found = residue(docs).select("doc_id")
    return docs.join(found, "doc_id", "left_anti")
