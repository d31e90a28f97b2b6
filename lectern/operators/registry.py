"""The registry of documents and the index as snapshots: diff, upsert, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as T


def latest_states(registry: DataFrame) -> DataFrame:
    """The newest row of every source path; older states may come late, ties go to the higher version."""
    order = F.struct(F.col("updated_at").isNotNull(), "updated_at", F.coalesce("pipeline_version", F.lit(-1)), F.coalesce("content_hash", F.lit("")))
    columns = [c for c in registry.columns if c != "source_path"]
    newest = registry.where("source_path is not null").groupBy("source_path").agg(F.max_by(F.struct(*columns), order).alias("r"))
    return newest.select("source_path", "r.*")


def plan_actions(found: DataFrame, registry: DataFrame, version: int) -> DataFrame:
    """(source_path, action): new, changed, unchanged or deleted, by a full outer join on the path.

    A path is unchanged only if hash, version and the status ``indexed`` all agree; null differs.
    """
    a = found.select("source_path", F.col("content_hash").alias("now"), F.lit(True).alias("there")).dropDuplicates(["source_path"])
    b = registry.select("source_path", F.col("content_hash").alias("then"), "status", "pipeline_version", F.lit(True).alias("known"))
    same = F.col("then").eqNullSafe(F.col("now")) & F.col("now").isNotNull() & F.col("pipeline_version").eqNullSafe(F.lit(version)) & F.col("status").eqNullSafe(F.lit("indexed"))
    action = F.when(F.col("known").isNull(), "new").when(F.col("there").isNull(), "deleted").when(same, "unchanged").otherwise("changed")
    return a.join(b, "source_path", "full_outer").select("source_path", action.alias("action"))


def upsert(old: DataFrame, new: DataFrame, key: str = "source_path") -> DataFrame:
    """Rows of ``old`` with the columns that ``new`` supplies replaced; rows that only ``new`` has are added.

    A column that ``new`` doesn't have keeps its old value; a supplied null replaces the old value.
    """
    given = [c for c in new.columns if c != key]
    n = new.dropDuplicates([key]).select(F.col(key), F.struct(*given).alias("n"))
    joined = old.join(n, key, "full_outer")
    pick = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c)
    return joined.select(key, *(pick(c) for c in old.columns if c != key))


def replace_by_document(old: DataFrame, new: DataFrame, key: str = "chunk_id") -> DataFrame:
    """The index with the documents of ``new`` replaced as a whole, and equal keys overwritten."""
    without = old.join(new.select("doc_id").distinct(), "doc_id", "left_anti").join(new.select(key).distinct(), key, "left_anti")
    return without.unionByName(new, allowMissingColumns=True)


def delete_documents(index: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The index without some documents."""
    return index.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def listing(registry: DataFrame) -> DataFrame:
    """The registry for display, times as text, by path."""
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return registry.select("source_path", "doc_id", "status", "error", "title", "doc_type", "num_pages", "chunk_count", "pipeline_version", at("last_indexed_at")).orderBy("source_path")


def cache_key(text: str = "embed_text", model: str = "model"):
    """Key of an embedding in a content-addressed table: the text and the model."""
    return F.sha2(F.concat(F.coalesce(text, F.lit("")), F.lit("\u0001"), F.coalesce(model, F.lit(""))), 256)


def cache_misses(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows of ``wanted`` whose key the table of embeddings lacks."""
    return wanted.join(cached.select("cache_key").distinct(), "cache_key", "left_anti")


def found_files(files: DataFrame) -> DataFrame:
    """(source_path, content_hash) of files read as binary."""
    return files.select(F.col("path").alias("source_path"), T.content_id(F.col("content")).alias("content_hash"))
