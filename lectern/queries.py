"""Queries of the core, by name, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import corpus_queries
from lectern.operators import near_duplicates as nd
from lectern.operators import packing
from lectern.operators import similar_vectors as sv
from lectern.tables import table

#: Near-duplicate records of the corpus: runs of three words, similarity 0.7.
CORPUS_RUN, CORPUS_SIMILARITY = 3, 0.7


def _corpus_duplicates(spark: SparkSession, sf_dir: str) -> nd.NearDuplicates:
    records = nd.corpus_records(table(spark, sf_dir, "chunks"), table(spark, sf_dir, "parsed_docs"))
    return nd.near_duplicates(records, CORPUS_RUN, CORPUS_SIMILARITY)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of nearly equal chunks and of nearly equal documents."""
    return _corpus_duplicates(spark, sf_dir).pairs().withColumnRenamed("kind", "record_kind")


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with the class of its copies and the number of its links."""
    return _corpus_duplicates(spark, sf_dir).groups()


def _neighbours(spark: SparkSession, sf_dir: str, least: float) -> DataFrame:
    vectors = table(spark, sf_dir, "chunk_vectors").select(F.col("chunk_id").alias("id"), F.col("embedded_at").alias("at"), "dense")
    return sv.similar_vectors(vectors, dim=64, k=5, least=least)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of which one is among the five most similar of the other, at cosine 0.85 or more."""
    return sv.pairs_of(_neighbours(spark, sf_dir, 0.85))


def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar chunks of every chunk, with cosine and rank."""
    return _neighbours(spark, sf_dir, -1.0).withColumn("cosine", F.round("cosine", 3))


BLOCK_KEY = ["doc_id", "section_idx", "block_idx"]


def _capacity(spark: SparkSession, sf_dir: str, limit_id: int) -> int:
    """The capacity of one row of pack_limits."""
    return table(spark, sf_dir, "pack_limits").where(F.col("limit_id") == limit_id).agg(F.max("capacity_tokens")).first()[0]


def _packed_blocks(spark: SparkSession, sf_dir: str, limit_id: int) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "blocks"), BLOCK_KEY, _capacity(spark, sf_dir, limit_id))


def _packed_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "chunks").where("kind = 'child'")
    return packing.pack(children, ["chunk_id"], _capacity(spark, sf_dir, 3))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks that were split, since no container can hold them."""
    return _packed_blocks(spark, sf_dir, 1).where("pieces > 1").select(*BLOCK_KEY).distinct()


def p5_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks put into chunks of the first limit."""
    return _packed_blocks(spark, sf_dir, 1)


def p5_small_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks put into chunks of the second limit."""
    return _packed_blocks(spark, sf_dir, 2)


def p5_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child chunks put into parents."""
    return _packed_children(spark, sf_dir)


def p5_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers of each limit are."""
    done = [(1, _packed_blocks(spark, sf_dir, 1)), (2, _packed_blocks(spark, sf_dir, 2)), (3, _packed_children(spark, sf_dir))]
    rows = [packing.fill(packed, _capacity(spark, sf_dir, i)).withColumn("limit_id", F.lit(i)) for i, packed in done]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


#: Pairs by brute force over shared runs of words; the sets are small enough for it at test scale.
_SETS = r"""r AS (
    SELECT DISTINCT 'chunk' AS kind, chunk_id AS id, text FROM chunks WHERE kind = 'child' AND text IS NOT NULL
    UNION ALL SELECT DISTINCT 'doc', doc_id, markdown FROM parsed_docs WHERE markdown IS NOT NULL),
w AS (SELECT kind, id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM r),
s AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, len(w) - 1), lambda i: hash(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS h FROM w WHERE len(w) >= 3),
n AS (SELECT kind, id, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT a.kind, a.id AS id_a, b.id AS id_b, count(*) AS c FROM s a JOIN s b ON a.kind = b.kind AND a.h = b.h AND a.id < b.id GROUP BY ALL),
p AS (SELECT c.kind, id_a, id_b FROM c JOIN n x ON x.kind = c.kind AND x.id = id_a JOIN n y ON y.kind = c.kind AND y.id = id_b WHERE c.c >= 0.7 * (x.n + y.n - c.c))"""

SQL_P2 = f"WITH {_SETS} SELECT kind AS record_kind, id_a, id_b FROM p"

SQL_P2_GROUPS = f"""WITH {_SETS},
g AS (SELECT kind, id, md5(array_to_string(list_sort(list(h)), ',')) AS g FROM s GROUP BY ALL),
m AS (SELECT kind, id, min(id) OVER (PARTITION BY kind, g) AS class, count(*) OVER (PARTITION BY kind, g) AS copies FROM g),
e AS (SELECT p.kind, id_a, id_b FROM p JOIN m x ON x.kind = p.kind AND x.id = id_a AND x.class = id_a JOIN m y ON y.kind = p.kind AND y.id = id_b AND y.class = id_b),
d AS (SELECT kind, class, count(*) AS links FROM (SELECT kind, id_a AS class FROM e UNION ALL SELECT kind, id_b FROM e) GROUP BY ALL)
SELECT m.kind, id, m.class, copies, coalesce(links, 0) AS links FROM m LEFT JOIN d ON d.kind = m.kind AND d.class = m.class"""

SQL_P5 = """
SELECT DISTINCT doc_id, section_idx, block_idx FROM blocks
WHERE greatest(1, length(text) // 4) > (SELECT max(capacity_tokens) FROM pack_limits WHERE limit_id = 1)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p2_found, p2_groups, p3_found, p3_neighbours, p5_found, p5_chunks, p5_small_chunks, p5_parents, p5_fill)
} | corpus_queries.QUERIES

SQL: dict[str, str] = {"p2_found": SQL_P2, "p2_groups": SQL_P2_GROUPS, "p5_found": SQL_P5} | corpus_queries.SQL
