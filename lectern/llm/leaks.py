"""Evaluation texts inside training text.

Method: MinHash containment search, partitioned by size. Test items are short and documents long, so
the Jaccard similarity of the two is tiny and one signature per document finds nothing. Items are
therefore partitioned by their number of words, each partition has a window length (the least size
in it), and a document is signed window by window: the signature of a window joins the MinHashes of
its five-word shingles under ROWS hash functions. A window that is contained in a document is one of
the document's windows, so its signature is too: candidates are found by an equi-join without loss,
whatever ROWS is. Candidates are verified by exact containment of the word runs.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.tables import materialise, spread

#: Consecutive words of a reference text that count as a leak.
RUN = 12
#: Words of a shingle.
SHINGLE = 5
#: Hash functions joined in a signature; more make fewer false candidates.
ROWS = 2
#: Least sizes of the size partitions, and with that the window lengths.
CLASSES = (1, 3, 6, RUN)
#: Signatures up to this number, and texts of items up to this many bytes, are broadcast (about 30 MB); more are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32_000_000

_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff\u180e\u034f]")
_BROKEN = re.compile("(?<=[^\\W_])[-\u2010\u00ad\u00ac][ \\t\u200b\u2060]*\\r?\\n[ \\t>]*(?=[^\\W_])")
#: Attributes of a tag, of any number and length, up to its end.
_ATTRIBUTES = r"""(?:\s+[\w:@.-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))?)*\s*/?>"""
_INLINE = re.compile(r"</?(?:b|i|u|em|strong|span|sup|sub|a|font|mark|code|small|big)\b" + _ATTRIBUTES, re.I)
_TAG = re.compile(r"</?[a-zA-Z][\w:-]*" + _ATTRIBUTES + r"|<!--[\s\S]*?-->")
_ENTITY = re.compile(r"&#?\w{1,10};")


def clean_words(text: str | None) -> list[str]:
    """Words without regard to case, markup, white space and invisible characters.

    A word split by a hyphen and a line end is one word.
    """
    if not text:
        return []
    if "\n" in text:
        text = _BROKEN.sub("", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group(0)), text)
    return W.WORD.findall(text.lower())


def clean_split_words(text: str | None) -> list[str]:
    """As clean_words, but a compound broken at its own hyphen stays two words."""
    return clean_words(re.sub(r"-[ \t]*\r?\n", "- ", text) if text else text)


def _signatures(key: str, lengths: tuple[int, ...]):
    """mapInPandas function: (key, window length, signature) of all windows of the texts."""

    def signed(ids: np.ndarray, texts: pd.Series, tokenise, length: int) -> Iterator[pd.DataFrame]:
        k = min(SHINGLE, length)
        for first, sizes, hashed in W.passes(texts, tokenise):
            starts, text = W.runs(sizes, length)
            if not len(starts):
                continue
            shingles, least = W.shingle_hashes(hashed, k), np.zeros(len(starts), np.uint64)
            for row in range(ROWS):
                least = W.mix(least + W.sliding_min(W.mix(shingles + np.uint64(row)), length - k + 1)[starts])
            new = np.ones(len(least), bool)  # neighbouring windows mostly share their signature
            new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
            yield pd.DataFrame({key: ids[first + text[new]], "length": np.int32(length), "signature": least[new].view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"]
            broken = texts.str.contains(r"-[ \t]*\r?\n", regex=True, na=False)
            for length in lengths:
                yield from signed(pdf[key].to_numpy(), texts, clean_words, length)
                if broken.any():
                    yield from signed(pdf[key].to_numpy()[broken], texts[broken], clean_split_words, length)

    return run


def test_items(cases: DataFrame) -> DataFrame:
    """(item, case_id, whole, text): the question, wanted as a whole, and the reference, wanted by runs.

    Repeated rows count once; null and blank texts are no items.
    """
    question = cases.select("case_id", F.lit(True).alias("whole"), F.col("question").alias("text"))
    reference = cases.select("case_id", F.lit(False).alias("whole"), F.col("reference_text").alias("text"))
    items = question.unionByName(reference).where(F.col("text").isNotNull() & F.col("case_id").isNotNull()).distinct()
    return items.withColumn("item", F.xxhash64("case_id", "whole", "text"))


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pdf.assign(words=[len(clean_words(t)) for t in pdf["text"]])


def _runs(words: list[str], length: int) -> frozenset[str]:
    return frozenset(" ".join(words[i : i + length]) for i in range(len(words) - length + 1))


def _contained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Keeps the pairs whose item is in the document; pairs come sorted by document."""
    items: dict[int, frozenset[str] | str] = {}
    doc, forms, in_doc = None, [], frozenset()
    for pdf in batches:
        keep = []
        for d, text, item, whole, wanted in zip(pdf["doc_id"], pdf["text"], pdf["item"], pdf["whole"], pdf["item_text"], strict=True):
            if d != doc:
                own = [clean_words(text)]
                if "-" in text and "\n" in text:
                    own.append(clean_split_words(text))
                doc, forms, in_doc = d, [" " + " ".join(w) + " " for w in own], frozenset().union(*(_runs(w, RUN) for w in own))
            if item not in items:
                if len(items) > 20_000:
                    items.clear()
                w = clean_words(wanted)
                items[item] = " " + " ".join(w) + " " if whole else _runs(w, RUN)
            keep.append(any(items[item] in f for f in forms) if whole else not in_doc.isdisjoint(items[item]))
        yield pdf.loc[keep, ["doc_id", "case_id", "whole"]]


def leaks(docs: DataFrame, cases: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, case_id, whole) for every document that holds an item of a case.

    ``whole`` tells the question (all its words in a row) from the reference text (at least RUN
    words in a row). Documents and cases may repeat rows or have null texts; those
    without id, references of fewer than RUN words and questions without words give nothing.
    """
    docs = docs.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    items = test_items(cases).mapInPandas(_measure, "case_id bigint, whole boolean, text string, item bigint, words int")
    items = items.where((F.col("words") >= F.when(F.col("whole"), 1).otherwise(RUN)))
    least = F.lit(CLASSES[0])
    for c in CLASSES[1:]:
        least = F.when(F.col("words") >= c, F.lit(c)).otherwise(least)
    items = materialise(items.withColumn("length", least.cast("int")), "items")
    measured = items.groupBy("length").agg(F.sum(F.octet_length("text")).alias("bytes")).collect()  # at most len(CLASSES) rows
    lengths, light = sorted(r["length"] for r in measured), sum(r["bytes"] for r in measured) <= BROADCAST_BYTES
    if not lengths:
        return docs.join(items.select("case_id", "whole"), F.lit(False)).select("doc_id", "case_id", "whole")
    wanted = items.select("item", "text").mapInPandas(_signatures("item", tuple(lengths)), "item bigint, length int, signature bigint")
    wanted = materialise(wanted.join(items.select("item", "length"), ["item", "length"]).distinct(), "wanted")
    small = wanted.count() <= broadcast_rows
    signed = spread(docs).mapInPandas(_signatures("doc_id", tuple(lengths)), "doc_id bigint, length int, signature bigint")
    found = signed.join(F.broadcast(wanted) if small else wanted, ["length", "signature"]).select("doc_id", "item").distinct()
    texts = items.select("item", "case_id", "whole", F.col("text").alias("item_text"))
    found = found.join(F.broadcast(texts) if light else texts, "item")
    # documents with candidates are few: their texts are read again rather than carried through the join
    pairs = docs.join(found, "doc_id").sortWithinPartitions("doc_id")
    return pairs.select("doc_id", "text", "item", "case_id", "whole", "item_text").mapInPandas(_contained, "doc_id bigint, case_id bigint, whole boolean").distinct()
