"""Cleaning of parsed documents: markdown normalisation and repeated page lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.conf import DEFAULTS
from lectern.functions import text as T


def normalize_markdown(docs: DataFrame, key: str = "doc_id", column: str = "markdown") -> DataFrame:
    """(key, markdown): lines of prose normalised; tables and code stay as they are.

    A line that starts with three backticks opens or closes code. Three or more line ends become
    two; the text ends with one line end. Repeated rows give one row, null texts none.
    """
    rows = docs.where(F.col(column).isNotNull()).select(key, F.col(column).alias("md")).dropDuplicates([key])
    lines = rows.select(key, F.posexplode(F.split("md", "\n")).alias("pos", "line"))
    bare = F.regexp_replace("line", r"(?U)^\s+", "")
    fence = F.startswith(bare, F.lit("```"))
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("fence", fence).withColumn("in_code", F.sum(F.col("fence").cast("int")).over(before) % 2 == 1)
    kept = F.col("fence") | F.col("in_code") | F.startswith(bare, F.lit("|"))
    done = marked.withColumn("line", F.when(kept, F.col("line")).otherwise(T.normalize_text(F.col("line"))))
    joined = done.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("md"))
    text = F.regexp_replace(F.regexp_replace("md", "\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")
    return joined.select(key, F.concat(text, F.lit("\n")).alias(column))


def markdown_items(docs: DataFrame, lines_per_page: int = 40) -> DataFrame:
    """(doc_id, item_idx, page, kind, level, text): the items of parsed documents in reading order.

    Items are separated by blank lines; a heading is an item of its own. The page follows from the
    line, since markdown has none: ``lines_per_page`` lines make a page. Repeated rows count once.
    """
    rows = docs.where(F.col("markdown").isNotNull()).select("doc_id", "markdown").dropDuplicates(["doc_id"])
    lines = rows.select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("line_no", "line"))
    blank = F.col("line").rlike(r"^\s*$")
    head = F.col("line").rlike(r"^#{1,6} ")
    order = Window.partitionBy("doc_id").orderBy("line_no")
    first = blank | head | F.coalesce(F.lag(blank | head).over(order), F.lit(True))
    grouped = lines.withColumn("g", F.sum(first.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(~blank)
    items = grouped.groupBy("doc_id", "g").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n").alias("raw"))
    level = F.length(F.regexp_extract("raw", r"^(#{1,6}) ", 1))
    kind = F.when(level > 0, "header").when(F.col("raw").rlike(r"^\|"), "table").when(F.col("raw").rlike(r"^\s*(?:[-*+]|\d{1,3}[.)])\s"), "list").otherwise("text")
    text = F.when(level > 0, F.regexp_replace("raw", r"^#{1,6} +", "")).otherwise(F.col("raw"))
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1
    return items.select("doc_id", idx.alias("item_idx"), (F.floor(F.col("line_no") / lines_per_page) + 1).cast("int").alias("page"), kind.alias("kind"), level.alias("level"), text.alias("text"))


def boilerplate_keys(items: DataFrame, frequency: float = DEFAULTS.boilerplate_frequency) -> DataFrame:
    """(doc_id, match_key, pages, total_pages) of lines that recur on most pages of a document.

    ``items`` has doc_id, page and match_key. Documents of fewer than four pages have none; a key
    counts with at least max(3, int(pages * frequency)) pages, fewer than 120 characters and no
    leading ``#``, which also stands for a leading digit.
    """
    used = items.where(F.col("match_key").isNotNull() & F.col("page").isNotNull())
    per_key = used.groupBy("doc_id", "match_key").agg(F.countDistinct("page").alias("pages"))
    per_doc = used.groupBy("doc_id").agg(F.countDistinct("page").alias("total_pages")).where("total_pages >= 4")
    least = F.greatest(F.lit(3), F.floor(F.col("total_pages") * F.lit(frequency)))
    return per_key.join(per_doc, "doc_id").where((F.col("pages") >= least) & (F.length("match_key") < 120) & ~F.startswith(F.col("match_key"), F.lit("#")))


def strip_boilerplate(items: DataFrame, keys: DataFrame) -> DataFrame:
    """The items whose key is none of the recurring ones."""
    return items.join(keys.select("doc_id", "match_key"), ["doc_id", "match_key"], "left_anti")


def doc_type(path: Column) -> Column:
    """Lower-case suffix of a path."""
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
