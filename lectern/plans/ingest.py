"""Ingestion as one plan: diff, items, sections, chunks, vectors, and the new snapshots."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.conf import DEFAULTS, Settings
from lectern.functions import text as T
from lectern.operators import chunking, cleaning, registry
from lectern.operators.encoding import Encoder, encode, hashed_encoder
from lectern.sources.files import Converter, parse
from lectern.sources.snapshots import Store
from lectern.tables import materialise


@dataclass
class Ingested:
    """What a run makes: the plan, the chunks of new and changed documents, the registry after it."""

    plan: DataFrame
    chunks: DataFrame
    registry: DataFrame


def document_blocks(docs: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Blocks with section and path of parsed documents, repeated page lines removed."""
    items = cleaning.markdown_items(docs)
    prose = F.when(F.col("kind") == "table", T.normalize_table(F.col("text"))).otherwise(T.normalize_text(F.col("text")))
    items = items.withColumn("text", prose).withColumn("match_key", F.when(F.col("kind").isin("text", "list"), T.match_key(F.col("text"))).otherwise(F.concat(F.lit("\u0001"), "item_idx")))
    clean = cleaning.strip_boilerplate(items, cleaning.boilerplate_keys(items.where("kind in ('text', 'list')"), conf.boilerplate_frequency))
    own = chunking.sections(clean)
    return own.select("doc_id", "section_idx", F.col("item_idx").alias("block_idx"), "text", (F.col("kind") == "table").alias("is_table"), F.array("page").alias("pages"), "rule_title", "path")


def document_chunks(docs: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Children of parsed documents with their parent, path and the text to embed."""
    blocks = document_blocks(docs, conf)
    children = chunking.pack_children(blocks, conf)
    up = chunking.group_parents(children, conf).select("chunk_id", "parent_id")
    paths = blocks.groupBy("doc_id", "section_idx").agg(F.first("path").alias("section_path"))
    titles = docs.select("doc_id", F.coalesce("title", F.lit("")).alias("title")).dropDuplicates(["doc_id"])
    joined = children.join(up, "chunk_id").join(paths, ["doc_id", "section_idx"]).join(titles, "doc_id")
    return joined.withColumn("embed_text", T.embed_text(F.col("title"), F.col("section_path"), F.col("text")))


def ingest(found: DataFrame, state: DataFrame, conf: Settings = DEFAULTS) -> Ingested:
    """Plans a run over found documents (source_path, doc_id, title, doc_type, markdown, warning).

    Only new and changed paths are chunked; a document without text fails and keeps the identity
    that was indexed last, so that its old chunks can still be found and deleted.
    """
    now = found.withColumn("content_hash", F.col("doc_id"))
    old = registry.latest_states(state)
    plan = registry.plan_actions(now, old, conf.pipeline_version)
    due = now.join(plan.where("action in ('new', 'changed')"), "source_path")
    chunks = document_chunks(due.where("markdown is not null"), conf)
    counts = chunks.groupBy("doc_id").agg(F.count("*").cast("int").alias("chunk_count"))
    good = due.where("markdown is not null").join(counts, "doc_id", "left").select(
        "source_path", "doc_id", "content_hash", F.lit("indexed").alias("status"), F.lit(None).cast("string").alias("error"), "title", "doc_type", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.lit(conf.pipeline_version).alias("pipeline_version"),
    )
    bad = due.where("markdown is null").select("source_path", F.lit("failed").alias("status"), F.coalesce("warning", F.lit("no text")).alias("error"))
    kept = old.join(plan.where("action = 'deleted'").select("source_path"), "source_path", "left_anti")
    return Ingested(plan, chunks, registry.upsert(registry.upsert(kept, good), bad))


def report(result: Ingested) -> DataFrame:
    """One row: paths by action."""
    is_ = lambda a: F.count_if(F.col("action") == a).alias(a)
    return result.plan.agg(is_("new"), is_("changed"), is_("unchanged"), is_("deleted"))


def failures(result: Ingested) -> DataFrame:
    """(source_path, error) of the paths that this run tried and could not index."""
    due = result.plan.where("action in ('new', 'changed')").select("source_path")
    return result.registry.where("status = 'failed'").join(due, "source_path", "left_semi").select("source_path", "error")


def parents_of(chunks: DataFrame) -> DataFrame:
    """The parents of children, with their text, as rows of an index."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n")
    return chunks.groupBy("doc_id", "section_idx", F.col("parent_id").alias("chunk_id")).agg(
        F.min("seq").alias("seq"), text.alias("text"), F.first("section_path").alias("section_path"), F.sum("token_count").cast("int").alias("token_count"), F.min_by("page_start", "seq").alias("page_start"), F.max_by("page_end", "seq").alias("page_end"),
    )


def run(store: Store, files: DataFrame, conf: Settings = DEFAULTS, converter: Converter | None = None, encoder: Encoder | None = hashed_encoder, model: str = "hashed", dry_run: bool = False, max_pages: int | None = None) -> Ingested:
    """Brings the tables of a store up to the discovered files; report and failures tell what was done.

    Parsed texts are kept by identity and settings, vectors by text and model, so that only what is new
    is converted and encoded. Documents that no path has any more leave chunks and parents; those of
    changed and new paths are replaced as a whole. The registry is written last: a run that fails
    before is made up for by the next. ``dry_run`` reports what would be done.
    """
    run_id, version = uuid.uuid4().hex, f"{conf.fingerprint()}.p{max_pages}" if max_pages else conf.fingerprint()
    spark = store.spark

    def progress(stage: str, rows: int) -> None:
        store.add("progress", spark.range(1).select(F.lit(run_id).alias("run"), F.lit(stage).alias("stage"), F.lit(rows).cast("long").alias("rows"), F.current_timestamp().alias("at")))

    state = store.read("registry")
    known = files.select("source_path", "doc_id", "doc_type").dropDuplicates(["source_path"])
    plan = registry.plan_actions(known.withColumn("content_hash", F.col("doc_id")), registry.latest_states(state), conf.pipeline_version)
    plan = materialise(plan, "plan")
    due = files.join(plan.where("action in ('new', 'changed')").select("source_path"), "source_path", "left_semi")
    if dry_run:
        return Ingested(plan, store.read("chunks").limit(0), state)

    have = store.read("parsed").where(F.col("version") == version)
    misses = due.dropDuplicates(["doc_id"]).join(have.select("doc_id"), "doc_id", "left_anti")
    fresh = materialise(parse(misses, converter, max_pages=max_pages).withColumn("version", F.lit(version)), "parsed")
    if not fresh.isEmpty():
        store.add("parsed", fresh.where("markdown is not null"))
    texts = have.select("doc_id", "title", "markdown", "num_pages", "warning").unionByName(fresh.select("doc_id", "title", "markdown", "num_pages", "warning")).dropDuplicates(["doc_id"])
    progress("parsed", fresh.count())

    result = ingest(known.join(texts, "doc_id", "left"), state, conf)
    chunks = materialise(result.chunks, "chunks")
    after = materialise(result.registry, "registry")
    progress("chunked", chunks.count())
    if encoder is not None:
        wanted = chunks.withColumn("model", F.lit(model)).select(registry.cache_key("embed_text", "model").alias("cache_key"), "embed_text")
        new = registry.cache_misses(wanted.dropDuplicates(["cache_key"]), store.read("vectors"))
        vectors = materialise(encode(new.select(F.col("cache_key").alias("id"), F.col("embed_text").alias("text")), encoder).withColumnRenamed("id", "cache_key"), "vectors")
        store.add("vectors", vectors)
        progress("encoded", vectors.count())

    gone = state.select("doc_id").distinct().join(after.select("doc_id"), "doc_id", "left_anti")
    up = parents_of(chunks)
    for name, rows in (("chunks", chunks), ("parents", up)):
        store.write(name, registry.replace_by_document(registry.delete_documents(store.read(name), gone), rows))
    progress("indexed", store.count("chunks"))
    store.write("registry", after)
    progress("registered", store.count("registry"))
    return Ingested(plan, chunks, after)
