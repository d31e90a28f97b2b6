"""Repair of text that was extracted from scanned pages.

Method: a lexicon of all words of the corpus with their frequencies; a symmetric-delete index over the
frequent words proposes corrections for the others; an edit distance weighted by the letters that
recognition confuses ranks them, and the frequency of the resulting word pairs picks among them.
Page heads and feet are told from the text by recurrence: the same line, apart from its numbers, comes
again page after page, cuts sentences in two, counts pages or stands beside a page number. Words broken
at line ends are joined where the lexicon knows the whole word rather than the compound.

Texts are tokenised once. The tokens are written as numbers into a dictionary of their chunk of
documents; the lexicon and the search for odd words both read that table. What a task holds of it at
once, in the JVM and in Python, doesn't depend on the size of the task.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.tables import materialise, small_batches, spread

#: A word is a dictionary word if it makes up this share of all words, and occurs this often.
#: By the share there are at most 500,000 of them, whatever the size of the corpus.
SHARE, LEAST = 2e-6, 5
#: A correction must be this many times as frequent as the form that it replaces. A form of letters alone may
#: be a word itself: it must be rarer by the second number, or stand at the places of the correction.
RATIO, LETTERS_RATIO = 20, 200
#: Share of the places of a form of letters alone at which the word is known beside both neighbours.
PLACES = 0.5
#: Highest weighted edit distance of a correction: less than two confusions of single letters, which is how typing errors look.
COST = 0.8
#: Repeated rows up to this number (about 3 MB) are broadcast when they are left out, more are joined by shuffle.
REPEATS = 300_000
#: Shortest form that is corrected; shorter than SHORT only with a sign that no word has, or next to a known pair.
MIN_LENGTH, SHORT = 2, 5
#: Characters of a chunk of documents; and word pairs, different words and rows that a task counts or hands on at once.
CHUNK, HELD, WORDS, ROWS = 500_000, 2_000_000, 200_000, 50_000
#: Row groups of few chunks: a reader unpacks up to 4,096 rows of one group at once, and a writer keeps its group in memory.
SMALL_GROUPS = {"parquet.block.size": 4 << 20, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}

# ---- fixed values -------------------------------------------------------------------------
#: Characters that recognition puts for a letter.
LOOKALIKES = {"0": "o", "1": "li", "|": "li", "!": "li", "ı": "i", "5": "s", "$": "s", "8": "b", "6": "b", "9": "g", "3": "e", "€": "e", "†": "t", "@": "a", "4": "a", "2": "z", "7": "t", "¢": "c", "£": "e"}
#: Letters and letter groups that recognition confuses, either way.
CONFUSED = "rn:m vv:w ii:u cl:d li:h ri:n ni:m nn:m in:m lc:k ln:h iu:m tt:u c:e c:o e:o u:v n:u h:b f:t l:i i:j l:t r:t h:n a:o a:e g:q s:e y:v".split()
HYPHENS = "-‐­¬"
# -------------------------------------------------------------------------------------------

_PAIR_COST = {}
for _pair in CONFUSED:
    _a, _b = _pair.split(":")
    _PAIR_COST[_a, _b] = _PAIR_COST[_b, _a] = 0.35 if len(_a) + len(_b) > 2 else 0.45
_SIGNS = "".join(c for c in LOOKALIKES if not c.isalnum())
_EDGE = re.compile(rf"^[^\w{re.escape(_SIGNS)}]+|[^\w{re.escape(_SIGNS)}]+$")
_PARTS = re.compile(r"[-‐'’/­]")
_BREAK = re.compile(rf"([^\W\d_](?:[\w'{re.escape(_SIGNS)}]*[^\W_])?)[{HYPHENS}]\s*$")
_START = re.compile(r"^\s*([^\W\d_][^\s.,;:!?()\"“”\[\]]*)")
_ROMAN = r"[ivxlc]{1,7}"
_NUMBER = re.compile(rf"(?:[-–—~]\s*)?(?:\d{{1,4}}|{_ROMAN})(?:\s*[-–—~])?|[PpSs] ?[aáe] ?[gi] ?[ei] ?(?:n ?a)?[\s|:.]*\d+(?:\s*(?:of|/|von|de|sur)\s*\d+)?|\d{{1,4}}\s*(?:/|of|von|de|sur)\s*\d{{1,4}}|\S{{4,6}}\s\d{{1,4}}\s(?:of|von|de|sur)\s\d{{1,4}}")
_TRIM = re.compile(rf"^\s*(?:\d{{1,4}}|{_ROMAN})\s{{2,}}|\s{{2,}}(?:\d{{1,4}}|{_ROMAN})\s*$|\s*[\[(][^()\[\]]*[\])]\s*$|(?:\s*\*)+\s*$", re.I)
_TABLE = re.compile(r"\s*\|.*\|\s*$")
_ALNUM = re.compile(r"[^a-z0-9]+")
_COUNT = re.compile(r"\b\d+\b")
_NO_LETTER = {i: None for i in range(128) if not chr(i).isalpha()}


def _plain(text: str) -> str:
    return _ALNUM.sub("", unicodedata.normalize("NFKD", text).lower())


def _like(a: str, b: str) -> bool:
    return bool(a) and bool(b) and abs(len(a) - len(b)) <= 3 and (a == b or (len(a) > 6 and SequenceMatcher(None, a, b, False).ratio() >= 0.85))


def _is_head(line: str) -> bool:
    """Set like a heading: capitalised throughout, no sentence."""
    if ":" in line or line[-1:] in ".;,?":
        return False
    own = [w for w in re.split(r"[\s|]+", _TRIM.sub("", _TRIM.sub("", line)).strip()) if w[:1].isalpha()]
    if not 1 <= len(own) <= 9:
        return False
    big = sum(w[0].isupper() for w in own)
    return big == len(own) or (len(own) > 2 and big >= len(own) - 2 and not any(w[0].islower() and len(w) > 3 for w in own))


def _wording(line: str) -> str:
    """The letters of a line: what stays the same from page to page while the numbers change."""
    if line[-1] in "])*" or "  " in line:
        line = _TRIM.sub("", line)
    return line.lower().translate(_NO_LETTER)


def _numbers(lines: list[str]) -> str:
    """How the numbers of recurring lines go: ``count`` if one rises a little from each to the next, ``same``, or ``free``."""
    own = [[int(x[:9]) for x in _COUNT.findall(line)] for line in lines]
    if any(len(x) != len(own[0]) for x in own):
        return "free"
    counts = False
    for column in zip(*own, strict=True):
        if all(a < b <= a + 4 for a, b in zip(column, column[1:], strict=False)):
            counts = True
        elif len(set(column)) > 1:
            return "free"
    return "count" if counts else "same"


def furniture(lines: list[str], title: str | None) -> list[bool]:
    """Which lines are page heads, page feet or page numbers and no part of the text.

    A line in the form of a page number is furniture. A line that recurs, numbers apart, is
    furniture if most of its occurrences cut a sentence in two or stand beside furniture, if its
    number counts pages, or if it recurs three times or more about a page apart with the same numbers.
    A line that occurs once is furniture if it gives the title, is nearly a recurring one, or is short,
    set like a heading and cuts a sentence or stands beside furniture.
    """
    text = [line.strip() for line in lines]
    n, out = len(text), [False] * len(text)
    name = _plain(title or "")
    widths = sorted(len(t) for t in text if len(t) > 30)
    narrow = 0.75 * widths[len(widths) // 2] if widths else 40
    groups: dict[str, list[int]] = {}
    for i, t in enumerate(text):
        if not t or len(t) > 90 or t[0] in "#|`>":
            continue
        if len(t) <= 24 and _NUMBER.fullmatch(t):
            out[i] = True
        elif t[0] not in "-*+" and t[-1] not in ".!?:;,":
            groups.setdefault(_wording(t), []).append(i)

    def around(i: int) -> tuple[str, str]:
        a, b = i - 1, i + 1
        while a >= 0 and (not text[a] or out[a]):
            a -= 1
        while b < n and (not text[b] or out[b]):
            b += 1
        return text[a] if a >= 0 else "", text[b] if b < n else ""

    def cuts(i: int) -> bool:
        before, after = around(i)
        return bool(before and after) and before[-1] not in ".!?:" and before[0] not in "#|" and after[0].islower()

    def beside(i: int) -> bool:
        return (i > 0 and out[i - 1]) or (i + 1 < n and out[i + 1])

    def recurs(wording: str, at: list[int]) -> bool:
        before, after = ({x[k] for x in map(around, at)} for k in (0, 1))
        if len(before) == 1 and len(after) == 1:  # a passage that is repeated, unless it stands beside furniture
            return all(map(beside, at))
        marked = sum(cuts(i) or beside(i) for i in at)
        gaps = sorted(b - a for a, b in zip(at, at[1:], strict=False))
        numbers = _numbers([text[i] for i in at])
        if len(at) >= 3 and numbers != "free" and (marked or (gaps[0] >= 5 and gaps[-1] <= 3 * gaps[len(gaps) // 2])):
            return min(len(before), len(after)) > 1 or marked > 0
        apart = all("  " in text[i] for i in at)  # the number is set apart from the rest, as page numbers are
        return marked * 2 >= len(at) or (numbers == "count" and (apart or (len(wording) >= 12 and marked > 0)))

    groups = {w: at for w, at in groups.items() if len(w) >= 3 or len(at) == 1}
    many = {w: at for w, at in groups.items() if len(at) >= 2}
    recurring: list[str] = []
    for _ in range(2):
        for wording in [w for w in many if recurs(w, many[w])]:
            recurring.append(wording)
            for i in many.pop(wording):
                out[i] = True
    single = [(i, w) for w, at in groups.items() if len(at) == 1 or w in many for i in at]
    for _ in range(2):  # what stands beside a line found in the first round is found in the second
        for i, wording in single:
            t = text[i]
            if out[i] or (len(t) > narrow and not t[0].isupper() and not t[0].isdigit()):
                continue
            head, numbered = _is_head(t), t[0].isdigit() and "  " in t  # a page number set apart
            titled = head and name and _like(_plain(_TRIM.sub("", _TRIM.sub("", t))), name)
            if titled or any(abs(len(r) - len(wording)) <= 3 and r[:1] == wording[:1] and _like(wording, r) for r in recurring):
                out[i] = True
            elif len(t) <= narrow:
                out[i] = (head and beside(i)) or ((head or t[-1].isdigit() or numbered) and (t[0].isupper() or numbered) and cuts(i))
    return out


def _form(token: str) -> str:
    """A token without outer punctuation, in lower case; empty for numbers, codes and marks."""
    form = _EDGE.sub("", token)
    if not form or not any(c.isalpha() for c in form):
        return ""
    parts = _PARTS.split(form)
    digits = sum(c.isdigit() for c in form)
    if digits and (any(p.isdigit() for p in parts) or digits * 2 > len(form) or re.fullmatch(r"[A-Z][\dA-Zl|]*-?\d+", form)):
        return ""
    return form.lower()


_cached_form = lru_cache(1 << 16)(_form)


def _chunks(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[list[tuple]]:
    """Rows of at most about CHUNK characters, one text more at most, so that memory doesn't depend on the size of batches."""
    part, size = [], 0
    for batch in batches:
        for row in zip(*(batch.column(c) for c in columns), strict=True):
            part.append(tuple(x.as_py() for x in row))
            size += len(part[-1][1] or "")
            if size >= CHUNK:
                yield part
                part, size = [], 0
    if part:
        yield part


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


TOKENS = "docs array<string>, forms string, codes binary, lines binary, furniture binary, breaks binary, left string, right string, soft binary"
_TOKENS = pa.schema([(c, pa.list_(pa.string()) if kind == "array<string>" else pa.string() if kind == "string" else pa.binary()) for c, kind in map(str.split, TOKENS.split(", "))])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per chunk of documents: tokens as codes into the chunk's forms, the lines they stand on, furniture lines, and words broken at line ends."""
    for part in _chunks(batches, ("doc_id", "markdown", "title")):
        tokens: list[str] = []
        sizes, odd_lines, breaks, left, right, soft = [], [], [], [], [], []
        for d, (_, md, title) in enumerate(part):
            lines = (md or "").split("\n")
            odd = furniture(lines, title)
            odd_lines += [(d, i + 1) for i, f in enumerate(odd) if f]
            carry = None  # (line, left part, mark) of a word broken at the end of the last text line
            for i, line in enumerate(lines):
                if odd[i]:
                    continue
                own = (line.replace("|", " ") if "|" in line and _TABLE.match(line) else line).split()
                if not own:
                    continue
                if carry:
                    start = _START.match(line)
                    if start:
                        breaks.append((d, carry[0] + 1, i + 1, len(tokens) - 1))
                        left.append(carry[1].lower())
                        right.append(_EDGE.sub("", start.group(1)).lower())
                        soft.append(carry[2] not in "-‐")
                    carry = None
                tokens += own
                sizes.append((i + 1, d, len(own)))
                mark = own[-1][-1]
                end = _BREAK.search(line) if mark in HYPHENS else None
                if end:
                    carry = (i, end.group(1), mark)
        codes, unique = pd.factorize(np.array(tokens, dtype=object)) if tokens else (np.empty(0, np.int64), ())
        row = [[d for d, _, _ in part], "\n".join(_cached_form(t) if len(t) <= 40 else _form(t) for t in unique), codes.astype(np.int32).tobytes()]  # tokens hold no line ends
        row += [np.array(x, np.int32).tobytes() for x in (sizes, odd_lines, breaks)]
        row += ["\n".join(left), "\n".join(right), np.array(soft, bool).tobytes()]
        yield _batch([tuple(row)], _TOKENS)


class _Page:
    """The tokens of one chunk of documents as flat arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int) -> None:
        array = lambda c, *shape: np.frombuffer(batch.column(c)[row].as_buffer(), np.int32).reshape(*shape)
        listed = lambda c, some: batch.column(c)[row].as_py().split("\n") if some else []
        self.codes, lines = array("codes", -1), array("lines", -1, 3)
        self.furniture, self.breaks = array("furniture", -1, 2), array("breaks", -1, 4)
        self.line, self.doc = np.repeat(lines[:, 0], lines[:, 2]), np.repeat(lines[:, 1], lines[:, 2])
        self.ids, self.forms = batch.column("docs")[row].as_py(), np.array(listed("forms", len(self.codes)), dtype=object)
        self.left, self.right = listed("left", len(self.breaks)), listed("right", len(self.breaks))
        self.soft = np.frombuffer(batch.column("soft")[row].as_buffer(), bool)
        self.broken = np.zeros(len(self.codes), bool)
        self.broken[self.breaks[:, 3]] = True
        self.broken[self.breaks[:, 3] + 1] = True


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[_Page]:
    return (_Page(batch, row) for batch in batches for row in range(batch.num_rows))


def _kept(df: DataFrame, label: str, options: dict[str, int] | None = None) -> DataFrame:
    """``materialise`` with small batches for the workers."""
    with small_batches(df.sparkSession):
        return materialise(df, label, options)


def _pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return W.mix(a * np.uint64(31) + W.mix(b))


_COUNTS = pa.schema([("kind", pa.string()), ("form", pa.string()), ("pair", pa.int64()), ("n", pa.int64())])


def _counts(kind: str, forms: list[str] | None, pairs: np.ndarray | None, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(n), ROWS):
        size = len(n[i : i + ROWS])
        form = pa.repeat("", size) if forms is None else pa.array(forms[i : i + ROWS], pa.string())
        pair = np.zeros(size, np.int64) if pairs is None else pairs[i : i + ROWS]
        yield pa.RecordBatch.from_arrays([pa.repeat(kind, size), form, pa.array(pair), pa.array(n[i : i + ROWS], pa.int64())], schema=_COUNTS)


def _lexicon(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of forms (kind f), compounds and parts alike, of joined line breaks (j) and of word pairs (b), added up first."""
    seen: Counter[str] = Counter()
    joined: Counter[str] = Counter()
    held: list[np.ndarray] = []

    def out(least: int, pairs: int) -> Iterator[pa.RecordBatch]:
        """Hands on the counts of at least so many words, or of so many pairs."""
        if sum(map(len, held)) >= pairs:
            flat = np.concatenate(held)
            held.clear()
            flat.sort()
            starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
            yield from _counts("b", None, flat[starts], np.diff(starts, append=len(flat)))
        for kind, counted in (("f", seen), ("j", joined)):
            if len(counted) >= least:
                yield from _counts(kind, list(counted), None, np.array(list(counted.values()), np.int64))
                counted.clear()

    for page in _pages(batches):
        n = np.bincount(page.codes[~page.broken], minlength=len(page.forms))
        for form, k in zip(page.forms, n.tolist(), strict=True):
            if form and k:
                seen[form] += k
                if not form.isalnum():
                    for part in _PARTS.split(form):
                        if part != form and part:
                            seen[part] += k
        joined.update(a + b for a, b in zip(page.left, page.right, strict=True))
        if len(page.codes):
            h, ok = pd.util.hash_array(page.forms, categorize=False)[page.codes], (page.forms != "")[page.codes] & ~page.broken
            good = ok[1:] & ok[:-1] & (page.doc[1:] == page.doc[:-1])
            held.append(_pair_hash(h[:-1][good], h[1:][good]).view(np.int64))
        yield from out(WORDS, HELD)
    yield from out(1, 1)


def lexicon(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(form, n, joined) and (pair, n) over all texts."""
    counts = tokens.mapInArrow(_lexicon, "kind string, form string, pair long, n long")
    counts = _kept(counts.groupBy("kind", "form", "pair").agg(F.sum("n").alias("n")), "counts")
    n = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    forms = counts.where("kind != 'b'").groupBy("form").agg(n("f").alias("n"), n("j").alias("joined"))
    return forms, counts.where("kind = 'b'").select("pair", "n")


def _fold(form: str, groups: bool) -> str:
    """A form with lookalikes and marks on letters replaced, and optionally letter groups too."""
    text = unicodedata.normalize("NFKD", form)
    text = "".join(c for c in text if not unicodedata.combining(c))
    if groups:
        for a, b in (("vv", "w"), ("rn", "m"), ("ii", "u"), ("cl", "d"), ("ri", "n"), ("li", "h")):
            text = text.replace(a, b)
    return "".join(LOOKALIKES.get(c, c)[-1] for c in text).replace("l", "i").replace("c", "e")


def delete_keys(form: str) -> set[str]:
    """Keys of the symmetric-delete index: the folded form and all forms with one character less."""
    out = set()
    for folded in {_fold(form, False), _fold(form, True)}:
        out.add(folded)
        out.update(folded[:i] + folded[i + 1 :] for i in range(len(folded)))
    return out


def weighted_distance(form: str, word: str, limit: float = COST) -> float:
    """Edit distance in which confusions of recognition cost less than other edits."""
    n, m = len(form), len(word)
    best = np.full((n + 1, m + 1), 9.0)
    best[0, 0] = 0
    for i in range(n + 1):
        for j in range(m + 1):
            x = best[i, j]
            if x > limit:
                continue
            if i < n and j < m:
                a, b = form[i], word[j]
                if a == b:
                    cost = 0.0
                elif b in LOOKALIKES.get(a, ""):
                    cost = 0.2
                elif not a.isascii() and unicodedata.normalize("NFKD", a)[0] == b:
                    cost = 0.3
                else:
                    cost = _PAIR_COST.get((a, b), 1.0)
                best[i + 1, j + 1] = min(best[i + 1, j + 1], x + cost)
            if i < n:
                best[i + 1, j] = min(best[i + 1, j], x + 1)
            if j < m:
                best[i, j + 1] = min(best[i, j + 1], x + 1)
            for p, q in ((1, 2), (2, 1), (2, 2)):
                if i + p <= n and j + q <= m and (cost := _PAIR_COST.get((form[i : i + p], word[j : j + q]))):
                    best[i + p, j + q] = min(best[i + p, j + q], x + cost)
    return float(best[n, m])


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        keys = [delete_keys(f) for f in pdf["form"]]
        out = pdf.loc[pdf.index.repeat([len(k) for k in keys])].reset_index(drop=True)
        yield out.assign(key=[k for own in keys for k in own])


def _distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cost = np.array([weighted_distance(f, w) for f, w in zip(pdf["form"], pdf["word"], strict=True)])
        yield pdf.assign(cost=cost)[cost <= COST]


def corrections(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(form, word, cost, n, word_n) of proposed corrections, and the dictionary words (form, n)."""
    total = forms.agg(F.sum("n")).first()[0] or 0
    words = forms.where((F.col("n") >= max(LEAST, int(SHARE * total))) & F.col("form").rlike(r"^\p{L}+$") & (F.length("form") >= 2))
    longest = (words.agg(F.max(F.length("form"))).first()[0] or 0) + 4  # a longer form is no edit of any word
    odd = forms.where((F.col("n") < max(LEAST * RATIO, total // 2000)) & (F.length("form") >= MIN_LENGTH) & (F.length("form") <= longest) & ~F.col("form").rlike("[-‐'’/]"))
    left = odd.select("form", "n").mapInPandas(_keyed, "form string, n long, key string")
    right = words.select(F.col("form"), F.col("n")).mapInPandas(_keyed, "form string, n long, key string").select(F.col("form").alias("word"), F.col("n").alias("word_n"), "key")
    pairs = left.join(right, "key").where((F.col("form") != F.col("word")) & (F.col("word_n") >= RATIO * F.greatest("n", F.lit(1))) & (F.levenshtein("form", "word", 4) >= 0))
    pairs = pairs.select("form", "word", "n", "word_n").distinct()
    return _kept(pairs.mapInPandas(_distances, "form string, word string, n long, word_n long, cost double"), "corrections"), words.select("form", "n")


_EVENTS = pa.schema([(c, pa.int32() if c in ("line_no", "next_line") else pa.string()) for c in ("doc_id", "line_no", "kind", "form", "rest", "before", "after", "next_line")])


def _events(known: frozenset[str]):
    """mapInArrow function: furniture lines, broken words and words outside ``known``, with their neighbours."""

    def of(page: _Page) -> Iterator[tuple]:
        last = len(page.codes) - 1
        # a neighbour is one of the same document: which documents share a chunk changes no result
        form_at = lambda t, d: page.forms[page.codes[t]] if 0 <= t <= last and page.doc[t] == d else ""
        yield from ((page.ids[d], i, "furniture", "", "", "", "", 0) for d, i in page.furniture.tolist())
        for (d, i, j, a), left, right, soft in zip(page.breaks.tolist(), page.left, page.right, page.soft.tolist(), strict=True):
            yield page.ids[d], i, "soft" if soft else "break", left, right, form_at(a - 1, d), form_at(a + 2, d), j
        strange = np.array([bool(f) and f not in known for f in page.forms], bool)
        for t in np.flatnonzero(strange[page.codes] & ~page.broken).tolist() if last >= 0 else ():
            form, d = page.forms[page.codes[t]], page.doc[t]
            parts = [p for p in _PARTS.split(form) if p and p not in known] if not form.isalnum() else [form]
            yield from ((page.ids[d], int(page.line[t]), "word", p, form, form_at(t - 1, d), form_at(t + 1, d), 0) for p in parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for page in _pages(batches):
            rows = of(page)
            while part := list(islice(rows, ROWS)):
                yield _batch(part, _EVENTS)

    return run


def _pair_column(a: str, b: str):
    @F.pandas_udf("long")
    def hashed(x: pd.Series, y: pd.Series) -> pd.Series:
        h = [pd.util.hash_array(s.to_numpy(object), categorize=False) for s in (x.fillna(""), y.fillna(""))]
        return pd.Series(_pair_hash(*h).view(np.int64))

    return hashed(F.col(a), F.col(b))


class Found:
    """What the search finds: lines that are furniture, words broken at line ends, words misread."""

    def __init__(self, furniture: DataFrame, broken: DataFrame, misread: DataFrame) -> None:
        self.furniture, self.broken, self.misread = furniture, broken, misread


def once(docs: DataFrame) -> DataFrame:
    """One row per doc_id; only keys are shuffled, and the texts only where more than REPEATS rows repeat others."""
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    first = numbered.groupBy("doc_id").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    repeats = materialise(numbered.select("doc_id", "row").join(first, "doc_id").where("row != first").select("row"), "repeats")
    few = repeats.count() <= REPEATS
    return numbered.join(F.broadcast(repeats) if few else repeats, "row", "left_anti").drop("row")


def find(docs: DataFrame) -> Found:
    """Searches parsed documents (doc_id, markdown, title) for what recognition broke.

    Of rows with the same doc_id the first counts; null or empty texts give no findings.
    """
    docs = spread(once(docs.select("doc_id", "markdown", "title").where(F.col("markdown").isNotNull())))
    tokens = _kept(docs.mapInArrow(_tokens, TOKENS), "tokens", SMALL_GROUPS)
    forms, pairs = lexicon(tokens)
    proposed, words = corrections(forms)
    stop = words.join(proposed.select("form").distinct(), "form", "left_anti").select("form")
    known = frozenset(r[0] for r in stop.collect())  # at most 1 / SHARE words
    events = _kept(tokens.mapInArrow(_events(known), "doc_id string, line_no int, kind string, form string, rest string, before string, after string, next_line int"), "events")

    # words broken at line ends: the whole word against the compound
    count = forms.select(F.col("form").alias("joined"), F.col("n").alias("whole_n"))
    compound = forms.select(F.col("form").alias("compound"), F.col("n").alias("compound_n"))
    part = words.select(F.col("form").alias("part"), F.lit(True).alias("is_word"))
    ends = events.where("kind in ('break', 'soft')").withColumn("joined", F.concat("form", "rest")).withColumn("compound", F.concat_ws("-", "form", "rest"))
    ends = ends.join(count, "joined", "left").join(compound, "compound", "left")
    for side in ("form", "rest"):
        ends = ends.join(part.select(F.col("part").alias(side), F.col("is_word").alias(f"{side}_is_word")), side, "left")
    none = F.lit(0)
    own = (F.coalesce("compound_n", none) > F.coalesce("whole_n", none)) | (F.col("form_is_word").isNotNull() & F.col("rest_is_word").isNotNull() & (F.coalesce("whole_n", none) == 0))
    broken = materialise(ends.where((F.col("kind") == "soft") | ~own).where(~F.col("rest").rlike(r"^\d")), "broken")

    # misread words, broken ones included; the pair with the neighbours picks among corrections
    single = events.where("kind = 'word'").select("doc_id", "line_no", "form", "before", "after", F.lit(0).alias("cut"), F.lit(0).alias("next_line"))
    split = broken.select("doc_id", "line_no", F.col("joined").alias("form"), "before", "after", F.length("form").alias("cut"), "next_line")
    at = single.unionByName(split).join(proposed, "form")
    # both at once: a second Python function behind a broadcast join would be a second worker a task
    at = at.withColumns({"before_pair": _pair_column("before", "word"), "after_pair": _pair_column("word", "after")})
    for side in ("before", "after"):
        at = at.join(pairs.select(F.col("pair").alias(f"{side}_pair"), F.col("n").alias(f"{side}_n")), f"{side}_pair", "left").drop(f"{side}_pair")
    support = F.coalesce("before_n", none) + F.coalesce("after_n", none)
    strange = F.col("form").rlike(r"[^\p{L}]|[^a-zà-ÿœß]")
    fits = (F.length("form") >= SHORT) | strange | (support > 0)
    # a form of letters alone may be a word: it must be far rarer, or stand where the word stands
    signs = F.col("form").rlike(r"[^\p{L}\p{M}]")
    at = _kept(at, "candidates")
    # what is no word beside it, such as a number, speaks neither for nor against
    both = ((F.col("before") == "") | (F.coalesce("before_n", none) > 0)) & ((F.col("after") == "") | (F.coalesce("after_n", none) > 0)) & (support > 0)
    alike = at.where(~signs & (F.col("word_n") < LETTERS_RATIO * F.col("n"))).groupBy("form", "word").agg(F.avg(both.cast("int")).alias("share")).where(F.col("share") >= PLACES).select("form", "word", F.lit(True).alias("placed"))
    at = at.join(alike, ["form", "word"], "left").where(signs | (F.col("word_n") >= LETTERS_RATIO * F.col("n")) | F.col("placed"))
    picked = at.where(fits).groupBy("doc_id", "line_no", "form", "before", "after", "cut", "next_line").agg(
        F.max_by(F.struct("word", "cost", "n", "word_n", support.alias("support")), F.struct(-F.round(F.col("cost") - 0.1 * F.log10(1 + support), 3), "word_n", "word")).alias("c")
    )
    misread = picked.select("doc_id", "line_no", "form", "before", "after", "cut", "next_line", "c.*")
    return Found(events.where("kind = 'furniture'").select("doc_id", "line_no"), broken.select("doc_id", "line_no", "next_line", "form", "rest", "joined"), misread)


def _sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The line of a broken word on which the misread characters stand."""
    for pdf in batches:
        out = []
        for d, line, form, word, cut, following in zip(pdf["doc_id"], pdf["line_no"], pdf["form"], pdf["word"], pdf["cut"], pdf["next_line"], strict=True):
            if not cut:
                out.append((d, line))
                continue
            start = next((i for i, (a, b) in enumerate(zip(form, word, strict=False)) if a != b), min(len(form), len(word)))
            tail = next((i for i, (a, b) in enumerate(zip(form[::-1], word[::-1], strict=False)) if a != b), min(len(form), len(word)))
            if start < cut:
                out.append((d, line))
            if len(form) - tail > cut:
                out.append((d, following))
        yield pd.DataFrame(out, columns=["doc_id", "line_no"])


def _replaced(line: str, form: str, word: str) -> str:
    """The line with the form corrected, in the case and punctuation of the token."""

    def one(m: re.Match) -> str:
        token = m.group(0)
        core = _EDGE.sub("", token)
        if core.lower() != form and form not in _PARTS.split(core.lower()):
            return token
        at = token.lower().find(form)
        found = token[at : at + len(form)]
        letters = [c for c in found if c.isalpha()]
        big = bool(letters) and all(c.isupper() for c in letters) and len(letters) > 1
        new = word.upper() if big else word[:1].upper() + word[1:] if found[:1].isupper() or (not found[:1].isalpha() and letters and letters[0].isupper()) else word
        return token[:at] + new + token[at + len(form) :]

    return re.sub(r"\S+", one, line)


def repaired(markdown: str, findings: list[dict]) -> tuple[str, int]:
    """The text in continuous paragraphs, and the number of lines that were left out."""
    lines = markdown.split("\n")
    out = {f["line_no"] for f in findings if f["kind"] == "furniture"}
    for f in findings:
        if f["kind"] == "misread" and not f["cut"]:
            lines[f["line_no"] - 1] = _replaced(lines[f["line_no"] - 1], f["form"], f["word"])
    for f in sorted((f for f in findings if f["kind"] == "hyphen"), key=lambda f: -f["line_no"]):
        a, b = f["line_no"] - 1, f["next_line"] - 1
        left, right = lines[a].rstrip().rstrip(HYPHENS), lines[b].lstrip()
        size = len(f["rest"])
        tail = re.match(r"[^\s]*", right[size:]).group(0)
        fixed = next((m["word"] for m in findings if m["kind"] == "misread" and m["cut"] and m["line_no"] == f["line_no"] and m["form"] == f["form"] + f["rest"]), None)
        if fixed:
            start = left[: len(left) - len(f["form"])]
            own = left[len(start) :]
            lines[a] = start + (fixed[:1].upper() + fixed[1:] if own[:1].isupper() else fixed) + tail
        else:
            lines[a] = left + right[:size] + tail
        lines[b] = right[size + len(tail) :].lstrip()
    paragraphs: list[str] = []
    gap, page = True, False
    for i, line in enumerate(lines):
        text = line.strip()
        if i + 1 in out:
            page = True
            continue
        if not text:
            gap = True
            continue
        if page and gap and paragraphs and paragraphs[-1][-1:] not in ".!?:|" and text[:1].islower():
            gap = False  # the paragraph goes on over the page break
        own_line = text[:1] in "#|" or re.match(r"(?:[-*+]|\d+[.)])\s", text)
        if gap or own_line or not paragraphs or paragraphs[-1][:1] in "#|":
            paragraphs.append(text)
        else:
            paragraphs[-1] += text if re.search(r"\w[-‐]$", paragraphs[-1]) else " " + text
        gap = page = False
    return "\n\n".join(paragraphs).replace("|\n\n|", "|\n|"), len(out)


_REPAIRED = pa.schema([("doc_id", pa.string()), ("markdown", pa.string()), ("boilerplate_lines_removed", pa.int32()), ("ocr_used", pa.bool_())])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in _chunks(batches, ("doc_id", "markdown", "findings", "ocr")):
        rows = [(doc_id, *repaired(markdown, findings or []), ocr) for doc_id, markdown, findings, ocr in part]
        yield _batch(rows, _REPAIRED)


def repair(docs: DataFrame) -> DataFrame:
    """(doc_id, markdown, boilerplate_lines_removed, ocr_used): every document's text, repaired.

    Findings are gathered by document, of which each has as many as lines at most. ocr_used tells
    whether misread words were found, which is what a recognised page leaves behind.
    """
    found = find(docs)
    none = [F.lit(x).alias(c) for c, x in (("form", ""), ("rest", ""), ("word", ""), ("cut", 0), ("next_line", 0))]
    rows = found.furniture.select("doc_id", "line_no", F.lit("furniture").alias("kind"), *none)
    rows = rows.unionByName(found.broken.select("doc_id", "line_no", F.lit("hyphen").alias("kind"), "form", "rest", F.lit("").alias("word"), F.lit(0).alias("cut"), "next_line"))
    rows = rows.unionByName(found.misread.select("doc_id", "line_no", F.lit("misread").alias("kind"), "form", F.lit("").alias("rest"), "word", "cut", "next_line"))
    by_doc = rows.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "kind", "form", "rest", "word", "cut", "next_line")).alias("findings"), F.max(F.col("kind") == "misread").alias("ocr"))
    texts = docs.where(F.col("markdown").isNotNull()).select("doc_id", "markdown").dropDuplicates(["doc_id"])
    joined = texts.join(by_doc, "doc_id", "left").withColumn("ocr", F.coalesce("ocr", F.lit(False)))
    return joined.mapInArrow(_repair, "doc_id string, markdown string, boilerplate_lines_removed int, ocr_used boolean")


def defects(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, defect) of all lines with furniture, broken or misread words, each once."""
    found = find(docs)
    furn = found.furniture.withColumn("defect", F.lit("furniture"))
    hyphen = found.broken.select("doc_id", "line_no", F.lit("hyphen").alias("defect"))
    misread = found.misread.select("doc_id", "line_no", "form", "word", "cut", "next_line").mapInPandas(_sides, "doc_id string, line_no int").withColumn("defect", F.lit("misread"))
    return furn.unionByName(hyphen).unionByName(misread).distinct()
