"""Source files: discovery, identity, page segments, and readers for text formats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators.cleaning import doc_type

#: Suffixes that are discovered.
PATTERNS = ("pdf", "docx", "pptx", "xlsx", "html", "md", "txt")
#: Pages that are converted at once.
SEGMENT = 40


def discover(spark: SparkSession, folder: str, patterns: tuple[str, ...] = PATTERNS) -> DataFrame:
    """(source_path, doc_id, doc_type, length, content) of all matching files below a folder, each once.

    An identity is that of the content: equal files at two paths share it.
    """
    glob = "*.{" + ",".join(patterns) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return files.select(F.col("path").alias("source_path"), T.content_id(F.col("content")).alias("doc_id"), doc_type(F.col("path")).alias("doc_type"), "length", "content").dropDuplicates(["source_path"])


def page_segments(total: Column, size: int = SEGMENT) -> Column:
    """Inclusive page ranges of at most ``size`` pages, the last one short; none without pages."""
    starts = F.when(total >= 1, F.sequence(F.lit(1), total, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(s + (size - 1), total).alias("end")))


def html_text(html: Column) -> Column:
    """Text of HTML with headings, list items and paragraphs as markdown lines; scripts and styles dropped."""
    text = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    for level in range(1, 7):
        text = F.regexp_replace(text, rf"(?is)<h{level}\b[^>]*>\s*(.*?)\s*</h{level}\s*>", "\n\n" + "#" * level + " $1\n\n")
    text = F.regexp_replace(text, r"(?i)<li\b[^>]*>\s*", "\n- ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</(?:p|div|tr|table|ul|ol)\s*>|<p\b[^>]*>", "\n\n")
    text = F.regexp_replace(text, r"<[^>]+>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n")


class Converter:
    """Reads formats that need a library: page counts and the markdown of a range of pages.

    Sent to the workers and used there file by file; what is slow to make is made once a worker.
    """

    def pages(self, kind: str, content: bytes) -> int | None:
        """Number of pages; None for formats without pages."""
        return None

    def markdown(self, kind: str, content: bytes, first: int | None, last: int | None) -> str:
        """Text of the pages from ``first`` to ``last``, or of the whole file where they are None."""
        raise NotImplementedError(f"no converter for {kind}")


class _Function(Converter):
    """A function of (type, content) as a converter of whole files."""

    def __init__(self, function: Callable[[str, bytes], str]) -> None:
        self.function = function

    def markdown(self, kind: str, content: bytes, first: int | None, last: int | None) -> str:
        return self.function(kind, content)


def converted(converter: Converter, kind: str, content: bytes, segment: int, max_pages: int | None) -> tuple[str, int | None]:
    """(markdown, pages) of one file: range by range in order; as a whole if that fails or there are no pages."""
    total = converter.pages(kind, content)
    wanted = min(total, max_pages) if total and max_pages else total
    try:
        ranges = [(i, min(i + segment - 1, wanted)) for i in range(1, (wanted or 0) + 1, segment)]
        if ranges:
            return "\n\n".join(converter.markdown(kind, content, i, j) for i, j in ranges), wanted
    except Exception:  # a file that can't be read in ranges may still be read as a whole
        return converter.markdown(kind, content, 1 if max_pages else None, wanted if max_pages else None), wanted
    return converter.markdown(kind, content, None, None), wanted


def parse(files: DataFrame, converter: Converter | Callable[[str, bytes], str] | None = None, segment: int = SEGMENT, max_pages: int | None = None) -> DataFrame:
    """(source_path, doc_id, doc_type, title, markdown, num_pages, warning) of discovered files.

    Markdown, text and HTML are read by text functions. Other formats need a ``converter``, or a function
    from (type, content) to markdown, called in tasks; without one they get a warning and no text. A file that fails is reported and does not fail
    the others.
    """
    title = F.regexp_extract("source_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    text = F.decode("content", "UTF-8")
    native = F.when(F.col("doc_type").isin("md", "txt"), text).when(F.col("doc_type") == "html", html_text(text))
    out = files.select("source_path", "doc_id", "doc_type", title.alias("title"), native.alias("markdown"), "content")
    own = F.col("doc_type").isin("md", "txt", "html")
    plain = out.where(own).drop("content").withColumn("num_pages", F.lit(None).cast("int")).withColumn("warning", F.lit(None).cast("string"))
    reader = converter if isinstance(converter, Converter) else _Function(converter) if converter else Converter()

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for kind, content in zip(pdf["doc_type"], pdf["content"], strict=True):
                try:
                    done.append((*converted(reader, kind, content, segment, max_pages), None))
                except Exception as problem:
                    done.append((None, None, str(problem)[:500]))
            frame = pd.DataFrame(done, columns=["markdown", "num_pages", "warning"], index=pdf.index, dtype=object)
            yield pd.concat([pdf[["source_path", "doc_id", "doc_type", "title"]], frame.astype({"num_pages": "Int32"})], axis=1)

    read = out.where(~own).mapInPandas(convert, "source_path string, doc_id string, doc_type string, title string, markdown string, num_pages int, warning string")
    return plain.unionByName(read)
