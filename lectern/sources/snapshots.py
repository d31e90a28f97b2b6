"""Tables as immutable snapshots with numbered pointers, and the engine's tables below one folder."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _newest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """Number and name of the newest snapshot. A pointer that was not written to its end has no row."""
    try:
        rows = spark.read.schema("number long, name string").json(f"{root}/_pointers/*")
    except AnalysisException:
        return None
    best = rows.where("number is not null and name is not null").agg(F.max(F.struct("number", "name")).alias("p")).first()["p"]
    return (best["number"], best["name"]) if best else None


def write_snapshot(df: DataFrame, root: str, partition_by: list[str] | None = None) -> str:
    """Writes a new snapshot and then a pointer with the next number; readers take the highest.

    Nothing is ever overwritten: readers see the old snapshot or the new one, whole, and a job that
    fails leaves the old one in place. Of two writers at once the later pointer fails.
    """
    spark = df.sparkSession
    newest = _newest(spark, root)
    number, name = (newest[0] + 1 if newest else 1), f"snapshot-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{root}/{name}")
    spark.range(1).select(F.lit(number).alias("number"), F.lit(name).alias("name")).coalesce(1).write.mode("error").json(f"{root}/_pointers/{number:012d}")
    return f"{root}/{name}"


def read_snapshot(spark: SparkSession, root: str) -> DataFrame:
    """The newest snapshot."""
    newest = _newest(spark, root)
    if newest is None:
        raise FileNotFoundError(f"no snapshot in {root}")
    return spark.read.parquet(f"{root}/{newest[1]}")


#: Tables of a store.
TABLES = {
    "registry": "source_path string, doc_id string, content_hash string, status string, error string, title string, doc_type string, num_pages int, chunk_count int, pipeline_version int, last_indexed_at timestamp, updated_at timestamp",
    "parsed": "doc_id string, version string, title string, doc_type string, markdown string, num_pages int, warning string",
    "chunks": "chunk_id string, doc_id string, parent_id string, section_idx int, seq int, text string, embed_text string, section_path array<string>, element_type string, token_count int, page_start int, page_end int",
    "parents": "chunk_id string, doc_id string, section_idx int, seq int, text string, section_path array<string>, token_count int, page_start int, page_end int",
    "vectors": "cache_key string, vector array<float>, indices array<int>, values array<float>",
    "progress": "run string, stage string, rows long, at timestamp",
}


class Store:
    """The engine's tables: a folder each, every change a new snapshot."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def create(self) -> Store:
        """Makes the tables that don't exist yet; those that do stay as they are."""
        for name, schema in TABLES.items():
            if _newest(self.spark, f"{self.root}/{name}") is None:
                self.write(name, self.spark.createDataFrame([], schema))
        return self

    def read(self, name: str) -> DataFrame:
        return read_snapshot(self.spark, f"{self.root}/{name}")

    def write(self, name: str, df: DataFrame) -> None:
        """Replaces a table; columns are put into the table's order and types, missing ones are null."""
        schema = self.spark.createDataFrame([], TABLES[name]).schema
        own = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
        write_snapshot(df.select(*own), f"{self.root}/{name}")

    def add(self, name: str, df: DataFrame) -> None:
        """A snapshot with further rows."""
        self.write(name, self.read(name).unionByName(df, allowMissingColumns=True))

    def count(self, name: str) -> int:
        """Rows of a table."""
        return self.read(name).count()


def dump_chunks(children: DataFrame, parents: DataFrame, path: str) -> None:
    """Children, then parents, as JSON lines."""
    both = children.withColumn("kind", F.lit("child")).unionByName(parents.withColumn("kind", F.lit("parent")), allowMissingColumns=True)
    both.repartitionByRange("kind", "doc_id").sortWithinPartitions("kind", "doc_id", "seq").write.json(path)


def dump_markdown(docs: DataFrame, path: str) -> None:
    """The markdown of every document (doc_id, markdown) in a folder of its own."""
    docs.where("markdown is not null").select("doc_id", F.col("markdown").alias("value")).write.partitionBy("doc_id").text(path)
