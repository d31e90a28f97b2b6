"""Text functions on columns; all of them keep null as null unless stated otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# ---- fixed values -------------------------------------------------------------------------
#: Glyphs that some files use in place of ASCII marks.
GLYPHS = ("‖―‗", '"-_')
#: Curly quotes and their straight forms.
QUOTES = ("‘’‚‛“”„‟", "''''\"\"\"\"")
#: A line of a table of contents: a dot leader and a number.
CONTENTS_LINE = r"\.{4,}\s*\d+\s*$"
#: The number of a rule that a text begins with.
RULE_NUMBER = r"^(\d{1,3})\.\s+(?=[A-Z])"
#: The marker of an item in a numbered list.
MARKER = r"^\d{1,3}\.$"
#: White space between two sentences.
SENTENCE_END = r"(?<=[.!?;])\s+(?=[A-Z(\d])"
#: Citation of a context block.
CITATION = r"\[(\d+)\]"
# -------------------------------------------------------------------------------------------


#: What a character of UTF-8 looks like that was read as Windows-1252: a lead byte and the bytes that follow it.
_MISREAD = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u203a\u20ac\u2122]{1,3}")


def _byte(char: str) -> bytes:
    try:
        return char.encode("cp1252")
    except UnicodeEncodeError:  # the five bytes that Windows-1252 leaves open are read as themselves
        return char.encode("latin-1")


def _reread(match: re.Match) -> str:
    """A misread character put right; the text as it is where its bytes are no character, or one that texts don't have."""
    text = match.group(0)
    for n in range(len(text), 1, -1):
        try:
            right = b"".join(map(_byte, text[:n])).decode("utf-8")
        except UnicodeError:
            continue
        if all(c < "\u0250" or "\u2000" <= c <= "\u2122" for c in right):
            return right + _MISREAD.sub(_reread, text[n:])
    return text


@F.pandas_udf(StringType())
def repair_unicode(text: pd.Series) -> pd.Series:
    """Misread UTF-8 and curly quotes put right, then Unicode's compatibility composition; Spark has no function for these."""
    quotes = str.maketrans(*QUOTES)

    def one(t: str | None) -> str | None:
        if t is None or t.isascii():
            return t
        return unicodedata.normalize("NFKC", _MISREAD.sub(_reread, t).translate(quotes))

    return text.map(one)


def map_glyphs(text: Column) -> Column:
    """Odd glyphs to their ASCII marks."""
    return F.translate(text, *GLYPHS)


def dehyphenate(text: Column) -> Column:
    """Joins words that are broken by a hyphen and a line end."""
    return F.regexp_replace(text, r"(?U)(\w)-\n(\w)", "$1$2")


def collapse_blanks(text: Column) -> Column:
    """Runs of blanks and tabs to one blank, line ends kept, outer white space removed."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"(?U)^\s+|\s+$", "")


def normalize_text(text: Column) -> Column:
    """Prose: unicode, glyphs, broken words, blanks, in this order."""
    return collapse_blanks(dehyphenate(map_glyphs(repair_unicode(text))))


def normalize_table(text: Column) -> Column:
    """Tables: unicode and glyphs; pipes, blanks and lines stay as they are."""
    return map_glyphs(repair_unicode(text))


def is_toc_line(text: Column) -> Column:
    """A dot leader and a number at the end: a line of a table of contents."""
    return text.rlike(CONTENTS_LINE)


def match_key(text: Column) -> Column:
    """Text in lower case with runs of digits masked, to compare lines of different pages."""
    return F.regexp_replace(F.lower(text), r"(?U)\d+", "#")


def rule_title(text: Column) -> Column:
    """Title of a numbered rule that the text begins, or null.

    The title ends at the first full stop within 150 characters, else after 100 characters.
    """
    number = F.regexp_extract(text, RULE_NUMBER, 1)
    rest = F.regexp_replace(text, RULE_NUMBER, "")
    stop = F.instr(rest, ".") - 1
    title = F.when((stop >= 1) & (stop <= 150), F.substring_index(rest, ".", 1)).otherwise(F.substring(rest, 1, 100))
    return F.when(number != "", F.concat(F.lit("Rule "), number, F.lit(": "), F.regexp_replace(title, r"(?U)^\s+|\s+$", "")))


def restore_marker(text: Column, marker: Column, enumerated: Column) -> Column:
    """A list item with its number in front again."""
    return F.when(enumerated & marker.rlike(MARKER), F.concat_ws(" ", marker, text)).otherwise(text)


def token_count(text: Column) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def sentences(text: Column) -> Column:
    """Sentences, cut at white space between an end mark and a capital, digit or bracket."""
    return F.split(text, SENTENCE_END)


def breadcrumb(title: Column, path: Column) -> Column:
    """Title and section path in one line."""
    return F.array_join(F.concat(F.array(title), path), " > ")


def embed_text(title: Column, path: Column, text: Column) -> Column:
    """What is embedded: the breadcrumb, a blank line, the text."""
    return F.concat(breadcrumb(title, path), F.lit("\n\n"), text)


def short_id(*parts: Column) -> Column:
    """Sixteen hex digits that identify the parts; null parts count as empty."""
    return F.substring(F.sha1(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))), 1, 16)


def content_id(content: Column) -> Column:
    """Identity of a file's content."""
    return F.substring(F.sha2(content, 256), 1, 16)


def page_label(start: Column, end: Column) -> Column:
    """``p.2``, ``p.2-3`` or what is known of it; page 0 counts as unknown."""
    first = F.when(start != 0, F.concat(F.lit("p."), start.cast("string"))).otherwise("")
    last = F.when((end != 0) & ~end.eqNullSafe(start), F.concat(F.lit("-"), end.cast("string"))).otherwise("")
    return F.concat(F.coalesce(first, F.lit("")), F.coalesce(last, F.lit("")))


def snippet(text: Column, size: int = 600) -> Column:
    """The first characters."""
    return F.substring(text, 1, size)


def cited(text: Column, blocks: Column) -> Column:
    """Sorted numbers that the text cites and that exist among ``blocks`` blocks."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= blocks))))


def without_invalid_citations(text: Column, blocks: Column) -> Column:
    """The text without markers that cite no existing block; nothing else changes."""
    markers = F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(0)))
    number = lambda m: F.try_to_number(F.regexp_extract(m, r"(\d+)", 1), F.lit("9" * 20))
    bad = F.filter(markers, lambda m: ~F.coalesce((number(m) >= 1) & (number(m) <= blocks), F.lit(False)))
    return F.aggregate(bad, text, lambda t, m: F.replace(t, m, F.lit("")))


def format_duration(ms: Column) -> Column:
    """Milliseconds, from one second on in seconds with one decimal."""
    return F.when(ms >= 1000, F.format_string("%.1fs", ms / 1000)).otherwise(F.concat(ms.cast("long").cast("string"), F.lit("ms")))


def unit_score(logit: Column) -> Column:
    """A score between 0 and 1."""
    return 1 / (1 + F.exp(-logit))


def judged(reply: Column, name: str) -> Column:
    """A mark of 1 to 5 from the first JSON object of a reply; null where it holds none.

    If either of the two marks is no number, both are null.
    """
    found = F.try_parse_json(F.nullif(F.regexp_extract(reply, r"\{[^{}]*\}", 0), F.lit("")))
    mark = lambda n: F.try_variant_get(found, f"$.{n}", "double")
    odd = [F.try_variant_get(found, f"$.{n}", "string").isNotNull() & mark(n).isNull() for n in ("faithfulness", "relevance")]
    value = mark(name)
    return F.when(~(odd[0] | odd[1]) & (value >= 1) & (value <= 5), value)
