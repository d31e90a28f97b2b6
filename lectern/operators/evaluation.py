"""Scores of retrieval and answers, and what changed between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def rule_hits(blocks: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, hit, rank) of cases with an expected rule: the first block whose path has the rule.

    ``blocks`` has case_id, block_no and section_path; ``Rule 6`` matches itself and ``Rule 6: …``,
    not ``Rule 66``. Cases without a match have no rank.
    """
    wanted = cases.where("expect_rule is not null and not coalesce(expect_refusal, false)").select("case_id", "expect_rule").distinct()
    under = F.exists("section_path", lambda p: (p == F.col("expect_rule")) | F.startswith(p, F.concat("expect_rule", F.lit(":"))))
    found = wanted.join(blocks, "case_id").where(under).groupBy("case_id").agg(F.min("block_no").alias("rank"))
    return wanted.join(found, "case_id", "left").select("case_id", F.col("rank").isNotNull().alias("hit"), "rank")


def keyword_recall(answer: Column, keywords: Column) -> Column:
    """Share of the keywords that the answer has, in any case; null without keywords."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.when(F.size(keywords) > 0, F.size(F.filter(keywords, lambda k: F.contains(low, F.lower(k)))) / F.size(keywords))


def _latest_results(results: DataFrame) -> DataFrame:
    return results.dropDuplicates(["result_id"])


def metrics() -> list[Column]:
    """Aggregates of a run: null where nothing applies; a missing rank counts as zero.

    Values are summed as decimals, so that a mean doesn't depend on the order of its rows.
    """
    hit = F.col("hit").isNotNull()

    def mean(c: Column | str) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return F.round(F.try_divide(F.sum(F.round(c.cast("double"), 9).cast("decimal(28,9)")).cast("double"), F.count(c)), 3)

    return [
        F.count("*").cast("double").alias("cases"),
        mean(F.when(hit, F.col("hit").cast("int"))).alias("hit_rate"),
        mean(F.when(hit, F.coalesce(1 / F.col("rank"), F.lit(0.0)))).alias("mrr"),
        mean(F.col("refusal_correct").cast("int")).alias("refusal_accuracy"),
        mean("keywords_found").alias("keyword_recall"),
        mean("faithfulness").alias("faithfulness"),
        mean("relevance").alias("relevance"),
        mean("seconds").alias("avg_seconds"),
    ]


NAMES = ["cases", "hit_rate", "mrr", "refusal_accuracy", "keyword_recall", "faithfulness", "relevance", "avg_seconds"]


def summarize(results: DataFrame) -> DataFrame:
    """(metric, value) over all results; repeated rows count once."""
    return _latest_results(results).agg(*metrics()).unpivot([], NAMES, "metric", "value")


def summarize_by_day(results: DataFrame) -> DataFrame:
    """(day, metric, value): the results of a day are a run."""
    days = _latest_results(results).where("run_at is not null").groupBy(F.date_format("run_at", "yyyy-MM-dd").alias("day")).agg(*metrics())
    return days.unpivot(["day"], NAMES, "metric", "value")


def deltas(by_day: DataFrame) -> DataFrame:
    """(day, metric, value, delta) against the day before; only where both have a value."""
    before = F.lag("value").over(Window.partitionBy("metric").orderBy("day"))
    return by_day.withColumn("before", before).where("value is not null and before is not null").select("day", "metric", "value", F.round(F.col("value") - F.col("before"), 3).alias("delta"))


def misses(results: DataFrame) -> DataFrame:
    """Results that missed or refused wrongly; null is neither."""
    return _latest_results(results).where("hit = false or refusal_correct = false")


def errors(results: DataFrame) -> DataFrame:
    """Results with an error text."""
    return _latest_results(results).where("error is not null and error != ''")
