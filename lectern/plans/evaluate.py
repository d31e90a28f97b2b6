"""An evaluation as one plan: cases, retrieval, outcome of every case, report, change since the last report."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import evaluation as E
from lectern.plans.ask import Retrieved

CASES = "case_id long, question string, expect_rule string, expect_keywords array<string>, expect_refusal boolean"


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """Cases from JSON lines; what a case leaves out is empty, a refusal is expected only where it says so."""
    rows = spark.read.schema(CASES).json(path).where("question is not null")
    return rows.withColumn("expect_keywords", F.coalesce("expect_keywords", F.array().cast("array<string>"))).withColumn("expect_refusal", F.coalesce("expect_refusal", F.lit(False)))


def case_outcomes(cases: DataFrame, retrieved: Retrieved, answers: DataFrame | None = None) -> DataFrame:
    """(case_id, question, hit, rank, refusal_correct, keywords_found, top_score, error) of every case.

    A case that expects a refusal is right if nothing was found; the rule of another one is looked for
    among the context blocks, and one without an answer is a miss. ``answers`` (query_id, text, error) are
    scored by keywords, except where a refusal is expected. Repeated cases count once.
    """
    own = cases.select("case_id", "question", "expect_rule", "expect_keywords", F.coalesce("expect_refusal", F.lit(False)).alias("expect_refusal")).dropDuplicates(["case_id"])
    outcome = retrieved.outcome.select(F.col("query_id").alias("case_id"), "no_answer", "top_score")
    blocks = retrieved.blocks.select(F.col("query_id").alias("case_id"), "block_no", "section_path")
    hits = E.rule_hits(blocks, own)
    told = answers.select(F.col("query_id").alias("case_id"), "text", "error") if answers is not None else outcome.select("case_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("error"))
    joined = own.join(outcome, "case_id", "left").join(hits, "case_id", "left").join(told, "case_id", "left")
    scored = ~F.col("expect_refusal") & ~F.coalesce("no_answer", F.lit(True)) & F.col("text").isNotNull()
    return joined.select(
        "case_id", "question", "hit", "rank", F.when(F.col("expect_refusal"), F.coalesce("no_answer", F.lit(True))).alias("refusal_correct"),
        F.when(scored, E.keyword_recall(F.col("text"), F.col("expect_keywords"))).alias("keywords_found"), F.coalesce("top_score", F.lit(0.0)).alias("top_score"), "error",
    )


def summary(outcomes: DataFrame) -> DataFrame:
    """(metric, value) of the outcomes of a run."""
    none = F.lit(None).cast("double")
    return E.summarize(outcomes.select(F.col("case_id").alias("result_id"), "hit", "rank", "refusal_correct", "keywords_found", none.alias("faithfulness"), none.alias("relevance"), none.alias("seconds")))


def previous_report(spark: SparkSession, folder: str) -> DataFrame | None:
    """(metric, value) of the newest report in a folder; None where there is none."""
    try:
        rows = spark.read.schema("metric string, value double").json(f"{folder}/report-*")
    except AnalysisException:
        return None
    named = rows.withColumn("report", F.regexp_extract(F.input_file_name(), r"(report-[^/]+)", 1))
    newest = named.agg(F.max("report")).first()[0]
    return named.where(F.col("report") == newest).select("metric", "value")


def write_report(outcomes: DataFrame, folder: str, stamp: str) -> DataFrame:
    """Writes the summary as JSON lines under ``stamp``, a time in sortable form.

    Returns (metric, value, delta), delta being the change since the newest report before; null without one.
    """
    spark, now = outcomes.sparkSession, summary(outcomes)
    before = previous_report(spark, folder)
    now.coalesce(1).write.mode("error").json(f"{folder}/report-{stamp}")  # a row a metric
    done = spark.read.schema("metric string, value double").json(f"{folder}/report-{stamp}")
    if before is None:
        return done.withColumn("delta", F.lit(None).cast("double"))
    change = spark.createDataFrame(before.collect(), "metric string, was double")  # a row a metric
    return done.join(change, "metric", "left").select("metric", "value", F.round(F.col("value") - F.col("was"), 3).alias("delta"))
