"""Queries of the retrieval operators over the corpus tables, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern import corpus_sql
from lectern.conf import DEFAULTS
from lectern.functions import text as T
from lectern.operators import answering, chunking, cleaning, encoding, evaluation, registry, traces
from lectern.operators import retrieval as R
from lectern.plans import ask, evaluate, ingest
from lectern.sources import files
from lectern.streaming.traces import windowed_counts
from lectern.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of the same result where there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- text functions and cleaning -----------------------------------------------------------

#: Documents once each; DuckDB's \w is ASCII only, so words are spelt as classes.
_PARSED = "p AS (SELECT DISTINCT doc_id, markdown FROM parsed_docs WHERE markdown IS NOT NULL)"


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "parsed_docs").where("markdown is not null").select("doc_id", "markdown").distinct()


@query(rf"""WITH {_PARSED} SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(translate(markdown, '‖―‗', '"-_'), '([\pL\pN\pM_])-\n([\pL\pN\pM_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM p""")
def normalized_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs, broken words and blanks of whole documents, by digest."""
    text = T.collapse_blanks(T.dehyphenate(T.map_glyphs(F.col("markdown"))))
    return _parsed(spark, sf_dir).select("doc_id", F.md5(text).alias("text_md5"))


@query(rf"""WITH {_PARSED}, l AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line FROM p)
SELECT doc_id, count(*) FILTER (NOT regexp_matches(line, '\.{{4,}}\s*\d+\s*$')) AS kept, count(*) FILTER (regexp_matches(line, '\.{{4,}}\s*\d+\s*$')) AS dropped FROM l GROUP BY doc_id""")
def toc_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines kept and dropped as lines of a table of contents."""
    lines = _parsed(spark, sf_dir).select("doc_id", F.explode(F.split("markdown", "\n")).alias("line"))
    toc = T.is_toc_line(F.col("line"))
    return lines.groupBy("doc_id").agg(F.count_if(~toc).alias("kept"), F.count_if(toc).alias("dropped"))


@query(r"""WITH b AS (SELECT DISTINCT doc_id, section_idx, block_idx, text FROM blocks WHERE regexp_matches(text, '^\d{1,3}\.\s+[A-Z]')),
r AS (SELECT *, regexp_extract(text, '^(\d{1,3})\.', 1) AS n, regexp_replace(text, '^\d{1,3}\.\s+', '') AS rest FROM b)
SELECT doc_id, section_idx, block_idx, 'Rule ' || n || ': ' || trim(CASE WHEN instr(rest, '.') - 1 BETWEEN 1 AND 150 THEN split_part(rest, '.', 1) ELSE substr(rest, 1, 100) END) AS rule_title FROM r""")
def rule_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of the numbered rules that blocks begin."""
    blocks = table(spark, sf_dir, "blocks").select("doc_id", "section_idx", "block_idx", "text").distinct()
    return blocks.select("doc_id", "section_idx", "block_idx", T.rule_title(F.col("text")).alias("rule_title")).where("rule_title is not null")


@query("""SELECT DISTINCT chunk_id, coalesce(token_count, -1) AS recorded, greatest(1, length(text) // 4)::INT AS counted FROM chunks
WHERE token_count IS DISTINCT FROM greatest(1, length(text) // 4)""")
def stale_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose recorded size isn't that of their text."""
    counted = table(spark, sf_dir, "chunks").select("chunk_id", F.col("token_count").alias("recorded"), T.token_count(F.col("text")).alias("counted")).distinct()
    return counted.where(~F.col("recorded").eqNullSafe(F.col("counted"))).fillna(-1, ["recorded"])


@query("""SELECT DISTINCT chunk_id, CASE WHEN page_start <> 0 THEN 'p.' || page_start ELSE '' END || CASE WHEN page_end <> 0 AND page_end IS DISTINCT FROM page_start THEN '-' || page_end ELSE '' END AS pages FROM chunks""")
def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page label of every chunk."""
    return table(spark, sf_dir, "chunks").select("chunk_id", T.page_label(F.col("page_start"), F.col("page_end")).alias("pages")).distinct()


@query("""WITH t AS (SELECT doc_id, max(title) AS title FROM parsed_docs GROUP BY doc_id), c AS (SELECT DISTINCT chunk_id, doc_id, text, embed_text, section_path FROM chunks WHERE kind = 'child')
SELECT chunk_id, md5(coalesce(title, '') || CASE WHEN len(section_path) > 0 THEN ' > ' || array_to_string(section_path, ' > ') ELSE '' END || chr(10) || chr(10) || text) AS embed_md5 FROM c LEFT JOIN t USING (doc_id)""")
def embed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text to embed of every child: breadcrumb and text, by digest."""
    titles = table(spark, sf_dir, "parsed_docs").groupBy("doc_id").agg(F.max("title").alias("title"))
    children = table(spark, sf_dir, "chunks").where("kind = 'child'").select("chunk_id", "doc_id", "text", "section_path").distinct()
    own = children.join(titles, "doc_id", "left")
    path = F.coalesce("section_path", F.array().cast("array<string>"))
    return own.select("chunk_id", F.md5(T.embed_text(F.coalesce("title", F.lit("")), path, F.col("text"))).alias("embed_md5"))


@query(rf"""WITH {_PARSED}, l AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) - 1 AS pos FROM p),
k AS (SELECT doc_id, pos // 40 + 1 AS page, regexp_replace(lower(regexp_replace(regexp_replace(line, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')), '\d+', '#', 'g') AS match_key FROM l),
u AS (SELECT * FROM k WHERE match_key <> ''), d AS (SELECT doc_id, count(DISTINCT page) AS total_pages FROM u GROUP BY doc_id HAVING count(DISTINCT page) >= 4)
SELECT doc_id, match_key, count(DISTINCT page) AS pages, total_pages FROM u JOIN d USING (doc_id) GROUP BY doc_id, match_key, total_pages
HAVING count(DISTINCT page) >= greatest(3, floor(total_pages * 0.6)) AND length(match_key) < 120 AND match_key NOT LIKE '#%'""")
def boilerplate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that recur on most pages of a document, forty lines a page."""
    lines = _parsed(spark, sf_dir).select("doc_id", F.posexplode(F.split("markdown", "\n")).alias("pos", "line"))
    keyed = lines.select("doc_id", (F.floor(F.col("pos") / 40) + 1).alias("page"), T.match_key(T.collapse_blanks(F.col("line"))).alias("match_key")).where("match_key != ''")
    return cleaning.boilerplate_keys(keyed)


@query(rf"""WITH {_PARSED}, l AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS pos FROM p),
f AS (SELECT *, starts_with(regexp_replace(line, '^\s+', ''), '```') AS fence FROM l), c AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS in_code FROM f),
d AS (SELECT doc_id, pos, CASE WHEN fence OR in_code OR starts_with(regexp_replace(line, '^\s+', ''), '|') THEN line
ELSE regexp_replace(regexp_replace(translate(line, '‖―‗', '"-_'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g') END AS line FROM c)
SELECT doc_id, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10) AS markdown FROM d GROUP BY doc_id""")
def normalized_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown with prose normalised and tables and code untouched."""
    return cleaning.normalize_markdown(table(spark, sf_dir, "parsed_docs"))


@query(rf"""WITH {_PARSED} SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^#{{1,6}} ')) AS headings, count(*) FILTER (line LIKE '|%') AS table_lines
FROM (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line FROM p) GROUP BY doc_id""")
def parse_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, headings and table lines of every document."""
    lines = _parsed(spark, sf_dir).select("doc_id", F.explode(F.split("markdown", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("line").rlike("^#{1,6} ")).alias("headings"), F.count_if(F.startswith("line", F.lit("|"))).alias("table_lines"))


@query("""SELECT DISTINCT source_path, lower(regexp_extract(source_path, '\\.([^./]+)$', 1)) AS suffix, doc_type FROM parsed_docs
WHERE source_path IS NOT NULL AND doc_type IS DISTINCT FROM lower(regexp_extract(source_path, '\\.([^./]+)$', 1))""")
def doc_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose recorded type isn't the suffix of their path."""
    docs = table(spark, sf_dir, "parsed_docs").where("source_path is not null").select("source_path", cleaning.doc_type(F.col("source_path")).alias("suffix"), "doc_type").distinct()
    return docs.where(~F.col("doc_type").eqNullSafe(F.col("suffix")))


@query("""WITH d AS (SELECT doc_id, max(stats.num_pages) AS n FROM parsed_docs GROUP BY doc_id)
SELECT doc_id, s AS start, least(s + 39, n) AS "end" FROM (SELECT doc_id, n, unnest(range(1, n + 1, 40)) AS s FROM d WHERE n >= 1)""")
def page_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page ranges in which a document is converted."""
    docs = table(spark, sf_dir, "parsed_docs").groupBy("doc_id").agg(F.max("stats.num_pages").alias("n"))
    return docs.select("doc_id", F.explode(files.page_segments(F.col("n"))).alias("s")).select("doc_id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


# ---- sections and chunks --------------------------------------------------------------------


@query(corpus_sql.SECTION_PATHS)
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of parsed documents with their path and number of blocks."""
    blocks = chunking.sections(cleaning.markdown_items(table(spark, sf_dir, "parsed_docs")))
    return blocks.groupBy("doc_id", "section_idx").agg(F.first(F.array_join("path", " > ")).alias("path"), F.count("*").alias("n_blocks"))


@query(corpus_sql.PACKED_CHILDREN)
def packed_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks packed into children."""
    children = chunking.pack_children(table(spark, sf_dir, "blocks"))
    return children.select("doc_id", "section_idx", "chunk_id", "seq", "token_count", "element_type", "page_start", "page_end", F.md5("text").alias("text_md5")).fillna(-1, ["page_start", "page_end"])


@query(corpus_sql.GROUPED_PARENTS)
def grouped_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children grouped into parents."""
    return chunking.parents(chunking.group_parents(chunking.pack_children(table(spark, sf_dir, "blocks")))).fillna(-1, ["page_start", "page_end"])


@query("""WITH c AS (SELECT DISTINCT ON (chunk_id) *, greatest(1, length(text) // 4) AS n FROM chunks)
SELECT doc_id, count(*) FILTER (kind = 'child') AS children, count(*) FILTER (kind = 'parent') AS parents,
coalesce(sum(n) FILTER (kind = 'child'), 0)::BIGINT // greatest(1, count(*) FILTER (kind = 'child')) AS avg_tokens, coalesce(max(n) FILTER (kind = 'child'), 0) AS max_tokens,
count(*) FILTER (kind = 'child' AND element_type = 'table') AS table_chunks, count(DISTINCT array_to_string(section_path, chr(1))) FILTER (kind = 'child') AS sections FROM c GROUP BY doc_id""")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and kinds of the chunks of every document."""
    return chunking.chunk_stats(table(spark, sf_dir, "chunks"))


@query("""WITH c AS (SELECT DISTINCT chunk_id, parent_id, kind FROM chunks) SELECT c.chunk_id, c.parent_id FROM c
WHERE c.kind = 'child' AND c.parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c p WHERE p.kind = 'parent' AND p.chunk_id = c.parent_id)""")
def orphan_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children whose parent does not exist."""
    c = table(spark, sf_dir, "chunks").select("chunk_id", "parent_id", "kind").distinct()
    up = c.where("kind = 'parent'").select(F.col("chunk_id").alias("parent_id"))
    return c.where("kind = 'child' and parent_id is not null").join(up, "parent_id", "left_anti").select("chunk_id", "parent_id")


@query(corpus_sql.INGESTED_CHUNKS)
def ingested_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed documents through cleaning, sections and packing to the children of an index."""
    chunks = ingest.document_chunks(table(spark, sf_dir, "parsed_docs"))
    return chunks.select("chunk_id", "doc_id", "parent_id", "seq", "token_count", F.array_join("section_path", " > ").alias("path"), F.md5("embed_text").alias("embed_md5"))


@query("""SELECT DISTINCT doc_id, section_idx, block_idx, substr(sha1(coalesce(doc_id, '') || ':' || coalesce(section_idx::VARCHAR, '') || ':' || coalesce(block_idx::VARCHAR, '')), 1, 16) AS short_id FROM blocks""")
def block_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positional identity of every block."""
    key = ["doc_id", "section_idx", "block_idx"]
    return table(spark, sf_dir, "blocks").select(*key, T.short_id(*(F.col(c) for c in key)).alias("short_id")).distinct()


@query("""WITH c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE kind = 'child' AND parent_id IS NOT NULL)
SELECT parent_id, count(*) AS children, sum(greatest(1, length(text) // 4))::BIGINT AS token_count, coalesce(arg_min_null(page_start, seq), -1) AS page_start, coalesce(arg_max_null(page_end, seq), -1) AS page_end FROM c GROUP BY parent_id""")
def parent_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children, size and pages of every parent: from its first child's first page to its last child's last."""
    c = table(spark, sf_dir, "chunks").where("kind = 'child' and parent_id is not null").dropDuplicates(["chunk_id"])
    spans = c.groupBy("parent_id").agg(F.count("*").alias("children"), F.sum(T.token_count(F.coalesce("text", F.lit("")))).alias("token_count"), F.min_by("page_start", "seq").alias("page_start"), F.max_by("page_end", "seq").alias("page_end"))
    return spans.fillna(-1, ["page_start", "page_end"])


@query(rf"""WITH {_PARSED}, l AS (SELECT doc_id, unnest(string_split(markdown, chr(10))) AS line FROM p)
SELECT doc_id, md5(string_agg(DISTINCT k, '|' ORDER BY k)) AS keys_md5, count(DISTINCT k) AS keys FROM (SELECT doc_id, regexp_replace(lower(line), '\d+', '#', 'g') AS k FROM l) GROUP BY doc_id""".replace("\\\\", "\\"))
def match_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct lines of every document with numbers masked, by digest."""
    lines = _parsed(spark, sf_dir).select("doc_id", F.explode(F.split("markdown", "\n")).alias("line"))
    keyed = lines.groupBy("doc_id").agg(F.array_sort(F.collect_set(T.match_key(F.col("line")))).alias("k"))
    return keyed.select("doc_id", F.md5(F.array_join("k", "|")).alias("keys_md5"), F.size("k").cast("long").alias("keys"))


# ---- registry -------------------------------------------------------------------------------

_LATEST = """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY (updated_at IS NOT NULL) DESC, updated_at DESC, coalesce(pipeline_version, -1) DESC, coalesce(content_hash, '') DESC) AS rn
FROM registry WHERE source_path IS NOT NULL) WHERE rn = 1)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "parsed_docs").where("source_path is not null")
    return parsed.groupBy("source_path").agg(F.max_by("doc_id", F.struct(F.col("loaded_at").isNotNull(), "loaded_at", "doc_id")).alias("doc_id"), F.max("title").alias("title"), F.max("doc_type").alias("doc_type")).withColumn("content_hash", F.col("doc_id"))


_FOUND = "f AS (SELECT source_path, doc_id AS content_hash FROM (SELECT *, row_number() OVER (PARTITION BY source_path ORDER BY (loaded_at IS NOT NULL) DESC, loaded_at DESC, doc_id DESC) AS rn FROM parsed_docs WHERE source_path IS NOT NULL) WHERE rn = 1)"
_ACTION = """CASE WHEN r.source_path IS NULL THEN 'new' WHEN f.source_path IS NULL THEN 'deleted' WHEN r.content_hash = f.content_hash AND r.pipeline_version = 1 AND r.status = 'indexed' THEN 'unchanged' ELSE 'changed' END"""


@query(f"WITH {_LATEST} SELECT source_path, doc_id, status, coalesce(pipeline_version, -1) AS pipeline_version FROM r")
def registry_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest state of every path."""
    return registry.latest_states(table(spark, sf_dir, "registry")).select("source_path", "doc_id", "status", F.coalesce("pipeline_version", F.lit(-1)).alias("pipeline_version"))


@query(f"WITH {_LATEST}, {_FOUND} SELECT coalesce(f.source_path, r.source_path) AS source_path, {_ACTION} AS action FROM f FULL JOIN r ON f.source_path = r.source_path")
def ingest_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run has to do with every path."""
    return registry.plan_actions(_found(spark, sf_dir), registry.latest_states(table(spark, sf_dir, "registry")), DEFAULTS.pipeline_version)


@query(f"WITH {_LATEST}, {_FOUND}, a AS (SELECT {_ACTION} AS action FROM f FULL JOIN r ON f.source_path = r.source_path) SELECT action, count(*) AS paths FROM a GROUP BY action")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths by action."""
    return ingest_plan(spark, sf_dir).groupBy("action").agg(F.count("*").alias("paths"))


@query(f"""WITH {_LATEST}, {_FOUND} SELECT coalesce(f.source_path, r.source_path) AS source_path, coalesce(f.content_hash, r.content_hash) AS content_hash,
CASE WHEN f.source_path IS NOT NULL THEN 'indexed' ELSE r.status END AS status, CASE WHEN f.source_path IS NOT NULL THEN 1 ELSE coalesce(r.pipeline_version, -1) END AS pipeline_version, r.title FROM f FULL JOIN r ON f.source_path = r.source_path""")
def registry_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after a run over all found paths: supplied columns replaced, others kept."""
    new = _found(spark, sf_dir).select("source_path", "content_hash", F.lit("indexed").alias("status"), F.lit(1).alias("pipeline_version"))
    old = registry.latest_states(table(spark, sf_dir, "registry"))
    return registry.upsert(old, new).select("source_path", "content_hash", "status", F.coalesce("pipeline_version", F.lit(-1)).alias("pipeline_version"), "title")


@query(f"""WITH {_LATEST} SELECT source_path, doc_id, status, error, title, doc_type, coalesce(num_pages, -1) AS num_pages, coalesce(chunk_count, -1) AS chunk_count, coalesce(pipeline_version, -1) AS pipeline_version, strftime(last_indexed_at, '%Y-%m-%d %H:%M:%S') AS last_indexed_at FROM r""")
def registry_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry for display."""
    return registry.listing(registry.latest_states(table(spark, sf_dir, "registry"))).fillna(-1, ["num_pages", "chunk_count", "pipeline_version"])


@query(f"""WITH {_LATEST}, d AS (SELECT DISTINCT doc_id FROM r WHERE status = 'failed' AND doc_id IS NOT NULL) SELECT DISTINCT chunk_id, doc_id FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM d)""")
def delete_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index without documents whose last run failed."""
    failed = registry.latest_states(table(spark, sf_dir, "registry")).where("status = 'failed' and doc_id is not null")
    return registry.delete_documents(table(spark, sf_dir, "chunks").select("chunk_id", "doc_id").distinct(), failed)


@query("""WITH w AS (SELECT DISTINCT chunk_id, sha256(coalesce(text, '') || chr(1) || 'base') AS k FROM chunks WHERE kind = 'child'), c AS (SELECT DISTINCT w.k FROM w JOIN chunk_vectors v ON v.chunk_id = w.chunk_id WHERE v.dense IS NOT NULL)
SELECT chunk_id FROM w WHERE k NOT IN (SELECT k FROM c)""")
def embedding_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children whose text no stored vector covers: a cache keyed by content."""
    children = table(spark, sf_dir, "chunks").where("kind = 'child'").select("chunk_id", "text").distinct().withColumn("model", F.lit("base"))
    keyed = children.select("chunk_id", registry.cache_key("text", "model").alias("cache_key"))
    have = table(spark, sf_dir, "chunk_vectors").where("dense is not null").select("chunk_id").distinct()
    return registry.cache_misses(keyed, keyed.join(have, "chunk_id", "left_semi")).select("chunk_id")


# ---- search ---------------------------------------------------------------------------------

#: Of repeated and older vectors of a chunk the latest counts.
_VECTORS = """v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY embedded_at DESC NULLS LAST, dense DESC) AS rn FROM chunk_vectors) WHERE rn = 1),
g AS (SELECT chunk_id, list_transform(dense, lambda x: x::DOUBLE) AS d FROM v WHERE len(dense) = 64 AND NOT list_contains(list_transform(dense, lambda x: isnan(x)), true) AND list_sum(list_transform(dense, lambda x: abs(x))) > 0)"""
_IS_QUERY = "('0x' || substr({0}, 8, 9))::BIGINT % 100 = 0"


def _index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vector, indices, values): the latest row of every chunk."""
    rows = table(spark, sf_dir, "chunk_vectors").select("chunk_id", "embedded_at", "dense", "sparse_indices", "sparse_values")
    latest = rows.groupBy("chunk_id").agg(F.max_by(F.struct("dense", "sparse_indices", "sparse_values"), F.struct(F.col("embedded_at").isNotNull(), "embedded_at", "dense")).alias("r"))
    return latest.select(F.col("chunk_id").alias("id"), F.col("r.dense").alias("vector"), F.col("r.sparse_indices").alias("indices"), F.col("r.sparse_values").alias("values"))


def _every_hundredth(index: DataFrame) -> DataFrame:
    """The stated query set: rows whose id, as a number, is divisible by 100."""
    return index.where(F.conv(F.substring("id", 8, 9), 16, 10).cast("long") % 100 == 0)


@query(f"""WITH q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS q FROM embeddings WHERE vec_id % 100 = 0), e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
s AS (SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(q, e), 6) AS score FROM q, e)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 15""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine search of every hundredth vector among all."""
    index = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.dense_topk(index.where("id % 100 = 0"), index, DEFAULTS.fused_top_k)


_SPARSE = f"""{_VECTORS}, sp AS (SELECT chunk_id, unnest(sparse_indices) AS token, unnest(sparse_values)::DOUBLE AS w FROM v WHERE len(sparse_indices) = len(sparse_values)),
p AS (SELECT chunk_id, token, sum(w) AS w FROM sp GROUP BY ALL), ss AS (SELECT a.chunk_id AS query_id, b.chunk_id, round(sum(a.w * b.w), 4) AS score FROM p a JOIN p b USING (token) WHERE {_IS_QUERY.format('a.chunk_id')} GROUP BY ALL),
st AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ss WHERE score > 0 QUALIFY rank <= 15)"""
_DENSE = f"""ds AS (SELECT a.chunk_id AS query_id, b.chunk_id, round(list_cosine_similarity(a.d, b.d), 6) AS score FROM g a, g b WHERE {_IS_QUERY.format('a.chunk_id')}),
dt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM ds QUALIFY rank <= 15)"""


@query(f"WITH {_SPARSE} SELECT query_id, chunk_id, score, rank FROM st")
def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse search of every hundredth chunk among all."""
    index = _index(spark, sf_dir)
    return R.sparse_topk(R.postings(_every_hundredth(index)), R.postings(index), DEFAULTS.fused_top_k)


@query(f"""WITH {_SPARSE}, {_DENSE}, f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 8) AS score FROM (SELECT query_id, chunk_id, rank FROM dt UNION ALL SELECT query_id, chunk_id, rank FROM st) GROUP BY ALL)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM f QUALIFY rank <= 15""")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense and sparse search of every hundredth chunk among all, fused by reciprocal ranks."""
    index = _index(spark, sf_dir)
    valid = index.withColumn("vector", F.when((F.size("vector") == 64) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)), F.col("vector")))
    return ask.hybrid(_every_hundredth(valid), valid)


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "eval_cases").select(F.col("case_id").alias("query_id"), "question").dropDuplicates(["query_id"])


def _retrieved(spark: SparkSession, sf_dir: str) -> ask.Retrieved:
    return ask.retrieve(_questions(spark, sf_dir), table(spark, sf_dir, "chunks"), table(spark, sf_dir, "parsed_docs"))


@query(corpus_sql.LEXICAL_SEARCH)
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluation questions among all children, by words."""
    children = table(spark, sf_dir, "chunks").where("kind = 'child'").dropDuplicates(["chunk_id"])
    return ask.lexical(_questions(spark, sf_dir), children)


@query(corpus_sql.RERANKED_SEARCH)
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the evaluation questions in the order of the reranker."""
    return _retrieved(spark, sf_dir).reranked.select("query_id", "chunk_id", "rerank_score", "rerank_rank")


@query(corpus_sql.RETRIEVAL_OUTCOME)
def retrieval_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a question finds anything above the floor, and its best score."""
    return _retrieved(spark, sf_dir).outcome


@query(corpus_sql.CONTEXT_BLOCKS)
def context_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in the context of every question: parents merged, budget kept."""
    return _retrieved(spark, sf_dir).blocks.select("query_id", "block_key", "block_no", "score", "matched_chunks", "page_start", "page_end").fillna(-1, ["page_start", "page_end"])


@query(corpus_sql.CONTEXTS)
def contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context that a model reads, by digest."""
    return R.context(_retrieved(spark, sf_dir).blocks).select("query_id", "n_blocks", F.md5("context").alias("context_md5"))


@query("""WITH h AS (SELECT result_id AS query_id, r.n AS n, row_number() OVER (PARTITION BY result_id ORDER BY r.score DESC, r.n) AS k, r.title, greatest(1, length(r.section) // 4) AS tokens FROM (SELECT DISTINCT query_id AS result_id, unnest(sources) AS r FROM answers)),
l AS (SELECT query_id, list(struct_pack(k := k, n := n, t := tokens) ORDER BY k) AS b FROM h GROUP BY query_id),
f AS (SELECT query_id, list_reduce(list_prepend(struct_pack(keep := []::INT[], used := 0::BIGINT, n := 0::INT, t := 0::BIGINT), list_transform(b, lambda x: struct_pack(keep := []::INT[], used := 0::BIGINT, n := x.n::INT, t := x.t::BIGINT))),
lambda a, x: CASE WHEN a.used + x.t <= 20 OR len(a.keep) = 0 THEN struct_pack(keep := list_append(a.keep, x.n), used := a.used + x.t, n := 0::INT, t := 0::BIGINT) ELSE a END) AS s FROM l)
SELECT query_id, unnest(s.keep)::VARCHAR AS block_key FROM f""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of answers by score, as many as fit twenty tokens of section names: skip, not stop."""
    rows = table(spark, sf_dir, "answers").select("query_id", F.explode("sources").alias("s")).distinct()
    best = Window.partitionBy("query_id").orderBy(F.desc("s.score"), "s.n")
    blocks = rows.select("query_id", F.col("s.n").cast("string").alias("block_key"), F.row_number().over(best).alias("rank"), F.col("s.section").alias("text"))
    return R.within_budget(blocks.where("text is not null"), 20).select("query_id", "block_key")


# ---- answers --------------------------------------------------------------------------------

_ANSWERS = "a AS (SELECT DISTINCT query_id, text, len(sources) AS n FROM answers WHERE text IS NOT NULL AND sources IS NOT NULL)"


@query(f"""WITH {_ANSWERS} SELECT query_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\[(\\d{{1,9}})\\]', 1), lambda x: x::BIGINT), lambda x: x BETWEEN 1 AND n))), ',') AS cited FROM a""")
def cited_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that an answer cites and that exist among its sources."""
    a = table(spark, sf_dir, "answers").where("text is not null and sources is not null").select("query_id", "text", F.size("sources").alias("n")).distinct()
    return a.select("query_id", F.array_join(F.transform(T.cited(F.col("text"), F.col("n")), lambda x: x.cast("string")), ",").alias("cited"))


@query(f"""WITH {_ANSWERS}, b AS (SELECT query_id, text, list_filter(list_distinct(regexp_extract_all(text, '\\[\\d+\\]')), lambda m: coalesce(try_cast(m[2:-2] AS BIGINT), 0) NOT BETWEEN 1 AND n) AS bad FROM a)
SELECT query_id, list_reduce(list_prepend(text, bad), lambda t, m: replace(t, m, '')) AS text FROM b""")
def validated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers without markers of sources that don't exist."""
    a = table(spark, sf_dir, "answers").where("text is not null and sources is not null").select("query_id", "text", F.size("sources").alias("n")).distinct()
    return a.select("query_id", T.without_invalid_citations(F.col("text"), F.col("n")).alias("text"))


@query(f"""WITH {_ANSWERS}, c AS (SELECT query_id, list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\[(\\d{{1,9}})\\]', 1), lambda x: x::BIGINT), lambda x: x BETWEEN 1 AND n)) AS c FROM a),
s AS (SELECT DISTINCT query_id, unnest(sources) AS s FROM answers) SELECT query_id, s.n AS n, s.section AS section, s.pages AS pages FROM s JOIN c USING (query_id) WHERE len(c) = 0 OR list_contains(c, s.n)""")
def cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources shown with an answer: those cited, or all where none is."""
    a = table(spark, sf_dir, "answers").where("text is not null and sources is not null").select("query_id", "text", "sources").distinct()
    shown = answering.cited_sources(F.col("sources"), T.cited(F.col("text"), F.size("sources")))
    return a.select("query_id", F.explode(shown).alias("s")).select("query_id", "s.n", "s.section", "s.pages").distinct()


@query(f"""WITH a AS (SELECT DISTINCT query_id, no_answer, text, coalesce(len(sources), 0) AS blocks, (SELECT max(x) FROM (SELECT unnest(map_values(timings)) AS x)) AS longest FROM answers)
SELECT query_id, no_answer, blocks, length(coalesce(text, '')) AS answer_chars, substr(coalesce(text, ''), 1, 600) AS snippet, coalesce(longest, -1) AS longest_ms FROM a""")
def answer_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is traced of every answer."""
    a = table(spark, sf_dir, "answers").select("query_id", "no_answer", "text", F.greatest(F.coalesce(F.size("sources"), F.lit(0)), F.lit(0)).cast("long").alias("blocks"), F.array_max(F.map_values("timings")).alias("longest")).distinct()
    return a.select("query_id", "no_answer", "blocks", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("answer_chars"), T.snippet(F.coalesce("text", F.lit(""))).alias("snippet"), F.coalesce("longest", F.lit(-1)).alias("longest_ms"))


@query("""WITH c AS (SELECT DISTINCT case_id, result_id, question FROM case_results WHERE question IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY result_id DESC) AS back FROM c)
SELECT case_id, md5(string_agg('user: ' || question, chr(10) ORDER BY result_id)) AS history_md5 FROM r WHERE back <= 6 GROUP BY case_id""")
def question_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last six questions asked of every case, as a condensing prompt has them, by digest."""
    rows = table(spark, sf_dir, "case_results").where("question is not null").select(F.col("case_id").alias("conv_id"), F.col("result_id").alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")).distinct()
    return answering.history(rows).select(F.col("conv_id").alias("case_id"), F.md5("history").alias("history_md5"))


@query("""SELECT DISTINCT result_id FROM case_results WHERE question IS NOT NULL AND length(question) BETWEEN 3 AND 2000""")
def valid_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results whose question a request may hold: 3 to 2,000 characters."""
    return table(spark, sf_dir, "case_results").where(F.length("question").between(3, 2000)).select("result_id").distinct()


# ---- evaluation -----------------------------------------------------------------------------

_RESULTS = "c AS (SELECT DISTINCT ON (result_id) * FROM case_results)"
_MEAN = "round(sum(round(({0})::DOUBLE, 9)::DECIMAL(28, 9))::DOUBLE / nullif(count({0}), 0), 3)"
_METRICS = "count(*)::DOUBLE AS cases, " + ", ".join(f"{_MEAN.format(v)} AS {k}" for k, v in {
    "hit_rate": "hit::INT", "mrr": "CASE WHEN hit IS NOT NULL THEN coalesce(1.0::DOUBLE / rank, 0.0) END", "refusal_accuracy": "refusal_correct::INT", "keyword_recall": "keywords_found", "faithfulness": "faithfulness", "relevance": "relevance", "avg_seconds": "seconds",
}.items())
_UNPIVOT = "m UNPIVOT INCLUDE NULLS (value FOR metric IN (cases, hit_rate, mrr, refusal_accuracy, keyword_recall, faithfulness, relevance, avg_seconds))"


@query(f"WITH {_RESULTS}, m AS (SELECT {_METRICS} FROM c) SELECT metric, value FROM {_UNPIVOT}")
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores over all results."""
    return evaluation.summarize(table(spark, sf_dir, "case_results"))


@query(f"""WITH {_RESULTS}, m AS (SELECT strftime(run_at, '%Y-%m-%d') AS day, {_METRICS} FROM c WHERE run_at IS NOT NULL GROUP BY 1), u AS (SELECT * FROM {_UNPIVOT}), b AS (SELECT *, lag(value) OVER (PARTITION BY metric ORDER BY day) AS before FROM u)
SELECT day, metric, value, round(value - before, 3) AS delta FROM b WHERE value IS NOT NULL AND before IS NOT NULL""")
def report_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of every score from one day's run to the next."""
    return evaluation.deltas(evaluation.summarize_by_day(table(spark, sf_dir, "case_results")))


@query(f"WITH {_RESULTS} SELECT result_id, case_id, hit, refusal_correct FROM c WHERE hit = false OR refusal_correct = false")
def eval_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that missed or refused wrongly."""
    return evaluation.misses(table(spark, sf_dir, "case_results")).select("result_id", "case_id", "hit", "refusal_correct")


@query(f"WITH {_RESULTS} SELECT error, count(*) AS results FROM c WHERE error IS NOT NULL AND error <> '' GROUP BY error")
def eval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error texts and how often they occur."""
    return evaluation.errors(table(spark, sf_dir, "case_results")).groupBy("error").agg(F.count("*").alias("results"))


@query(f"""WITH {_RESULTS}, e AS (SELECT DISTINCT case_id, expect_keywords AS k FROM eval_cases WHERE len(expect_keywords) > 0)
SELECT result_id, round(len(list_filter(k, lambda x: contains(lower(coalesce(answer, '')), lower(x))))::DOUBLE / len(k), 6) AS recall FROM c JOIN e USING (case_id)""")
def keyword_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the expected keywords that each answer has."""
    results = table(spark, sf_dir, "case_results").dropDuplicates(["result_id"])
    wanted = table(spark, sf_dir, "eval_cases").select("case_id", "expect_keywords").distinct().where(F.size("expect_keywords") > 0)
    return results.join(wanted, "case_id").select("result_id", F.round(evaluation.keyword_recall(F.col("answer"), F.col("expect_keywords")), 6).alias("recall"))


@query(f"""WITH {_RESULTS}, s AS (SELECT DISTINCT query_id, unnest(sources) AS s FROM answers), b AS (SELECT c.result_id, c.case_id, s.n AS n, string_split(s.section, ' > ') AS p FROM s JOIN c ON c.result_id = s.query_id),
w AS (SELECT DISTINCT c.result_id, e.expect_rule AS r FROM c JOIN eval_cases e USING (case_id) WHERE e.expect_rule IS NOT NULL AND NOT coalesce(e.expect_refusal, false)),
m AS (SELECT w.result_id, min(b.n) AS rank FROM w JOIN b ON b.result_id = w.result_id WHERE len(list_filter(b.p, lambda x: x = r OR starts_with(x, r || ':'))) > 0 GROUP BY 1)
SELECT w.result_id, m.rank IS NOT NULL AS hit, coalesce(m.rank, 0) AS rank FROM w LEFT JOIN m ON m.result_id = w.result_id""")
def rule_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether and where the sources of a result name the expected rule."""
    results = table(spark, sf_dir, "case_results").dropDuplicates(["result_id"]).select("result_id", "case_id")
    cases = results.join(table(spark, sf_dir, "eval_cases").select("case_id", "expect_rule", "expect_refusal").distinct(), "case_id").drop("case_id").withColumnRenamed("result_id", "case_id")
    rows = table(spark, sf_dir, "answers").select("query_id", F.explode("sources").alias("s")).distinct()
    blocks = rows.select(F.col("query_id").alias("case_id"), F.col("s.n").alias("block_no"), F.split("s.section", " > ").alias("section_path"))
    return evaluation.rule_hits(blocks, cases).withColumnRenamed("case_id", "result_id").fillna(0, ["rank"])


@query(f"WITH {_RESULTS}, t AS (SELECT unnest(map_entries(timings)) AS e FROM c) SELECT e.key AS stage, count(*) AS requests, round(avg(e.value), 3) AS avg_ms, max(e.value) AS max_ms FROM t WHERE e.value IS NOT NULL GROUP BY 1")
def stage_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latency of the stages of all requests."""
    return traces.stage_latencies(table(spark, sf_dir, "case_results"))


# ---- traces ---------------------------------------------------------------------------------


@query("""WITH d AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts IS NOT NULL) SELECT day, event_id, event_type FROM d WHERE day = (SELECT max(day) FROM d) ORDER BY ts DESC, event_id DESC LIMIT 30""")
def trace_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last thirty events of the latest day."""
    return traces.tail(table(spark, sf_dir, "events"), 30).select("day", "event_id", "event_type")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def trace_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their values by hour; the stream's twin in batch."""
    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("""WITH o AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000 AS far FROM events WHERE ts IS NOT NULL),
s AS (SELECT *, sum(coalesce(far::INT, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM o)
SELECT user_id, session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS events FROM s GROUP BY user_id, session""")
def trace_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users: events no more than half an hour apart."""
    return traces.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 30).select("user_id", "session", "started", "ended", "events")


# ---- parts of documents, blocks and chunks ----------------------------------------------------


@query(f"WITH {corpus_sql.PARSED} SELECT doc_id, substr(sha256(markdown), 1, 16) AS content_id FROM p")
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of the content of every parsed document."""
    return _parsed(spark, sf_dir).select("doc_id", T.content_id(F.encode("markdown", "UTF-8")).alias("content_id"))


@query("SELECT DISTINCT doc_id, section_idx, block_idx, translate(text, '‖―‗', '\"-_') AS text FROM blocks WHERE is_table AND text IS NOT NULL")
def normalized_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with their glyphs put right, pipes and line ends as they were."""
    rows = table(spark, sf_dir, "blocks").where("is_table and text is not null").select("doc_id", "section_idx", "block_idx", "text").distinct()
    return rows.withColumn("text", T.normalize_table(F.col("text")))


@query(r"""WITH b AS (SELECT DISTINCT doc_id, section_idx, block_idx, text FROM blocks WHERE text IS NOT NULL),
s AS (SELECT *, string_split(regexp_replace(text, '([.!?;])\s+([A-Z(\d])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS s FROM b)
SELECT doc_id, section_idx, block_idx, len(s) AS sentences, list_max(list_transform(s, lambda x: length(x))) AS longest FROM s""")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every block and the length of the longest."""
    rows = table(spark, sf_dir, "blocks").where("text is not null").select("doc_id", "section_idx", "block_idx", "text").distinct()
    s = rows.withColumn("s", T.sentences(F.col("text")))
    return s.select("doc_id", "section_idx", "block_idx", F.size("s").cast("long").alias("sentences"), F.array_max(F.transform("s", F.length)).cast("long").alias("longest"))


@query(rf"""WITH RECURSIVE {corpus_sql.ITEMS}, l AS (SELECT doc_id, item_idx, regexp_extract(text, '^\s*([-*+]|\d{{1,3}}[.)])\s', 1) AS marker, regexp_replace(text, '^\s*([-*+]|\d{{1,3}}[.)])\s+', '') AS rest FROM i WHERE kind = 'list')
SELECT doc_id, item_idx, CASE WHEN regexp_matches(marker, '^\d{{1,3}}\.$') THEN marker || ' ' || rest ELSE rest END AS text FROM l""")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List items without their bullets, numbers restored."""
    rows = cleaning.markdown_items(table(spark, sf_dir, "parsed_docs")).where("kind = 'list'")
    pattern = r"^\s*([-*+]|\d{1,3}[.)])\s"
    own = rows.select("doc_id", "item_idx", F.regexp_extract("text", pattern, 1).alias("marker"), F.regexp_replace("text", pattern + r"+", "").alias("rest"))
    return own.select("doc_id", "item_idx", T.restore_marker(F.col("rest"), F.col("marker"), F.lit(True)).alias("text"))


@query("SELECT doc_id, count(*) AS children FROM (SELECT DISTINCT ON (chunk_id) chunk_id, doc_id FROM chunks WHERE kind = 'child') GROUP BY doc_id")
def enrichment_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children that get a summary, by document."""
    return answering.enrichment_targets(table(spark, sf_dir, "chunks")).groupBy("doc_id").agg(F.count("*").alias("children"))


@query("SELECT kind, count(DISTINCT chunk_id) AS chunks, count(DISTINCT doc_id) AS documents FROM chunks GROUP BY kind")
def index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the index, once each: children and parents."""
    chunks = table(spark, sf_dir, "chunks").dropDuplicates(["chunk_id"])
    both = chunks.where("kind = 'child'").unionByName(chunks.where("kind = 'parent'"))
    return both.groupBy("kind").agg(F.count("*").alias("chunks"), F.countDistinct("doc_id").alias("documents"))


_NEW = """n AS (SELECT substr(sha1(doc_id || ':' || section_idx || ':' || block_idx), 1, 16) AS chunk_id, doc_id, 'block' AS origin FROM (SELECT DISTINCT doc_id, section_idx, block_idx FROM blocks WHERE doc_id IN (SELECT doc_id FROM r WHERE status = 'indexed')))"""


@query(f"""WITH {_LATEST}, {_NEW}, c AS (SELECT DISTINCT chunk_id, doc_id, 'chunk' AS origin FROM chunks)
SELECT chunk_id, doc_id, origin FROM c WHERE doc_id NOT IN (SELECT doc_id FROM n) AND chunk_id NOT IN (SELECT chunk_id FROM n) UNION ALL SELECT chunk_id, doc_id, origin FROM n""")
def replaced_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after indexed documents were replaced as a whole by their blocks."""
    indexed = registry.latest_states(table(spark, sf_dir, "registry")).where("status = 'indexed'").select("doc_id").distinct()
    blocks = table(spark, sf_dir, "blocks").select("doc_id", "section_idx", "block_idx").distinct().join(indexed, "doc_id", "left_semi")
    new = blocks.select(T.short_id(F.col("doc_id"), F.col("section_idx"), F.col("block_idx")).alias("chunk_id"), "doc_id", F.lit("block").alias("origin"))
    old = table(spark, sf_dir, "chunks").select("chunk_id", "doc_id").distinct().withColumn("origin", F.lit("chunk"))
    return registry.replace_by_document(old, new)


@query(f"""WITH {_LATEST}, {_FOUND}, g AS (SELECT DISTINCT doc_id FROM r WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT content_hash FROM f)) SELECT doc_id, count(DISTINCT chunk_id) AS chunks FROM chunks WHERE doc_id NOT IN (SELECT doc_id FROM g) GROUP BY doc_id""")
def after_deletions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the index once documents that no path has any more are deleted, by document."""
    known = registry.latest_states(table(spark, sf_dir, "registry")).where("doc_id is not null").select("doc_id").distinct()
    gone = known.join(_found(spark, sf_dir).select("doc_id"), "doc_id", "left_anti")
    left = registry.delete_documents(table(spark, sf_dir, "chunks").select("chunk_id", "doc_id").distinct(), gone)
    return left.groupBy("doc_id").agg(F.count("*").alias("chunks"))


# ---- prompts and model replies ----------------------------------------------------------------


@query(corpus_sql.PROMPTS)
def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message that asks the model, for every question with a context, by digest."""
    asked = R.context(_retrieved(spark, sf_dir).blocks).join(_questions(spark, sf_dir), "query_id")
    user = F.element_at(answering.messages(F.col("question"), F.col("context")), 2)["content"]
    return asked.select("query_id", F.md5(user).alias("prompt_md5"))


@query(corpus_sql.SOURCES)
def context_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered sources of every context, with page label, score and snippet."""
    rows = answering.source_list(_retrieved(spark, sf_dir).blocks).select("query_id", F.explode("sources").alias("s"))
    return rows.select("query_id", "s.n", F.coalesce("s.section", F.lit("")).alias("section"), "s.pages", "s.score", F.md5("s.snippet").alias("snippet_md5"))


@query(corpus_sql.CASE_OUTCOMES)
def case_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every evaluation case through the search by words: hit and rank of its rule, or whether a refusal is right."""
    cases = table(spark, sf_dir, "eval_cases")
    found = _retrieved(spark, sf_dir)
    return evaluate.case_outcomes(cases, found).select("case_id", "hit", F.coalesce("rank", F.lit(0)).cast("long").alias("rank"), "refusal_correct", "top_score")


_BODIES = "SELECT DISTINCT query_id, text, no_answer FROM answers WHERE text IS NOT NULL"


@query(f"WITH a AS ({_BODIES}) SELECT query_id, CASE WHEN no_answer THEN '' ELSE text END AS text, CASE WHEN no_answer THEN 'refused' ELSE '' END AS error FROM a")
def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response bodies made of the answers, read back: refusals as errors, all others as the first choice's content."""
    a = table(spark, sf_dir, "answers").where("text is not null").select("query_id", "text", F.coalesce("no_answer", F.lit(False)).alias("no_answer")).distinct()
    choice = F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices"))
    body = F.when(F.col("no_answer"), F.to_json(F.struct(F.struct(F.lit("refused").alias("message")).alias("error")))).otherwise(F.to_json(choice))
    read = a.select("query_id", answering.completion(body).alias("c"))
    return read.select("query_id", F.coalesce("c.text", F.lit("")).alias("text"), F.coalesce("c.error", F.lit("")).alias("error"))


#: A delta that comes after the end of its stream and doesn't count.
_LATE = 'data: {"choices":[{"delta":{"content":"late"}}]}'


@query(r"SELECT query_id, md5(text) AS text_md5 FROM (SELECT DISTINCT query_id, text FROM answers WHERE length(text) > 0)")
def streamed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers cut into server-sent lines by words, read back and put together, by digest."""
    a = table(spark, sf_dir, "answers").where("length(text) > 0").select("query_id", "text").distinct()
    parts = a.select("query_id", F.posexplode(F.split("text", r"(?<=\s)(?=\S)")).alias("seq", "part"))
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("part").alias("content")).alias("delta"))).alias("choices")))
    lines = parts.select("query_id", "seq", F.concat(F.lit("data: "), body).alias("line"))
    ends = a.select("query_id", F.explode(F.array(F.lit(2**30), F.lit(2**30 + 1))).alias("seq")).withColumn("line", F.when(F.col("seq") == 2**30, "data: [DONE]").otherwise(_LATE))
    read = answering.stream_deltas(lines.unionByName(ends))
    joined = read.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "").alias("text"))
    return joined.select("query_id", F.md5("text").alias("text_md5"))


@query(f"WITH {_RESULTS} SELECT result_id, faithfulness, relevance FROM c WHERE faithfulness BETWEEN 1 AND 5 AND relevance BETWEEN 1 AND 5")
def judged_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks that a judge's reply holds as JSON within text."""
    rows = table(spark, sf_dir, "case_results").dropDuplicates(["result_id"]).where("faithfulness is not null and relevance is not null")
    reply = F.concat(F.lit("My marks: "), F.to_json(F.struct("faithfulness", "relevance")), F.lit(" — as asked."))
    read = rows.select("result_id", T.judged(reply, "faithfulness").alias("faithfulness"), T.judged(reply, "relevance").alias("relevance"))
    return read.where("faithfulness is not null and relevance is not null")


@query(f"WITH {_RESULTS}, t AS (SELECT result_id, unnest(map_entries(timings)) AS e FROM c) SELECT result_id, e.key AS stage, CASE WHEN e.value >= 1000 THEN printf('%.1fs', e.value / 1000.0) ELSE e.value || 'ms' END AS took FROM t WHERE e.value IS NOT NULL")
def stage_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long every stage of a request took, as it is shown."""
    rows = table(spark, sf_dir, "case_results").where("timings is not null").dropDuplicates(["result_id"]).select("result_id", F.explode("timings").alias("stage", "ms"))
    return rows.where("ms is not null").select("result_id", "stage", T.format_duration(F.col("ms")).alias("took"))


@query(f"WITH {_RESULTS} SELECT result_id, round(1 / (1 + exp(-top_score)), 6) AS score FROM c WHERE top_score IS NOT NULL")
def unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best scores of results, as a reranker's logits, between 0 and 1."""
    rows = table(spark, sf_dir, "case_results").dropDuplicates(["result_id"]).where("top_score is not null")
    return rows.select("result_id", F.round(T.unit_score(F.col("top_score")), 6).alias("score"))


@query(f"WITH {_RESULTS} SELECT result_id, CASE WHEN hit THEN 'up' ELSE 'down' END AS verdict, substr(coalesce(answer, ''), 1, 1000) AS answer, 'feedback' AS kind, strftime(run_at, '%Y-%m-%d') AS day FROM c WHERE hit IS NOT NULL AND run_at IS NOT NULL")
def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits and misses as feedback, with the day they are filed under."""
    rows = table(spark, sf_dir, "case_results").dropDuplicates(["result_id"]).where("run_at is not null")
    verdict = F.when(F.col("hit"), "up").when(~F.col("hit"), "down").otherwise("none")
    events = traces.feedback(rows.select("result_id", verdict.alias("verdict"), F.coalesce("answer", F.lit("")).alias("answer"), F.col("run_at").alias("ts")))
    return traces.with_day(events).select("result_id", "verdict", "answer", "kind", "day")


@query(r"""WITH c AS (SELECT DISTINCT chunk_id, text FROM chunks WHERE kind = 'child' AND text IS NOT NULL), w AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '[\pL\pN]+')) AS w FROM c),
t AS (SELECT chunk_id, w, 1 + ln(count(*)) AS weight FROM w GROUP BY ALL), s AS (SELECT chunk_id, ('0x' || substr(md5(w), 1, 8))::BIGINT >> 4 AS token, sum(weight) AS weight FROM t GROUP BY ALL)
SELECT chunk_id, count(*) AS tokens, min(token) AS lowest, max(token) AS highest, round(sum(weight), 2) AS weights FROM s GROUP BY chunk_id""")
def encoded_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse vectors of the children by the encoder that needs no model."""
    rows = table(spark, sf_dir, "chunks").where("kind = 'child' and text is not null").select(F.col("chunk_id").alias("id"), "text").distinct()
    total = F.aggregate("values", F.lit(0.0), lambda a, x: a + x.cast("double"))
    done = encoding.encode(rows).where(F.size("indices") > 0)
    return done.select(F.col("id").alias("chunk_id"), F.size("indices").cast("long").alias("tokens"), F.array_min("indices").cast("long").alias("lowest"), F.array_max("indices").cast("long").alias("highest"), F.round(total, 2).alias("weights"))
