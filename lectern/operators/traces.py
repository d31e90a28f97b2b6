"""Traces of answers and feedback: daily JSON, tails and latencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_day(events: DataFrame, at: str = "ts") -> DataFrame:
    """Events with their day; an event without a time gets the present one."""
    return events.withColumn(at, F.coalesce(at, F.current_timestamp())).withColumn("day", F.date_format(at, "yyyy-MM-dd"))


def append(events: DataFrame, path: str, at: str = "ts") -> None:
    """Appends events as JSON lines, a folder a day."""
    with_day(events, at).write.mode("append").partitionBy("day").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All events of a trace folder."""
    return spark.read.json(path)


def tail(events: DataFrame, n: int, at: str = "ts", tie: str = "event_id") -> DataFrame:
    """The last n events of the latest day, oldest first."""
    days = events.where(F.col(at).isNotNull()).withColumn("day", F.date_format(at, "yyyy-MM-dd"))
    latest = days.agg(F.max("day").alias("day"))
    return days.join(F.broadcast(latest), "day").orderBy(F.desc(at), F.desc(tie)).limit(n).orderBy(at, tie)  # latest is one row


def feedback(verdicts: DataFrame) -> DataFrame:
    """Feedback events with the answer cut to a thousand characters; other verdicts than up and down are dropped."""
    return verdicts.where(F.col("verdict").isin("up", "down")).withColumn("answer", F.substring("answer", 1, 1000)).withColumn("kind", F.lit("feedback"))


def stage_latencies(results: DataFrame, key: str = "result_id") -> DataFrame:
    """(stage, requests, avg_ms, max_ms) of the timings of all requests; repeated rows count once."""
    once = results.where("timings is not null").dropDuplicates([key])
    flat = once.select(F.explode("timings").alias("stage", "ms")).where("ms is not null")
    return flat.groupBy("stage").agg(F.count("*").alias("requests"), F.round(F.avg("ms"), 3).alias("avg_ms"), F.max("ms").alias("max_ms"))


def sessions(events: DataFrame, key: str, at: str, gap_minutes: int) -> DataFrame:
    """(key, session, started, ended, events): events of a key no more than a gap apart."""
    order = Window.partitionBy(key).orderBy(at, "event_id")
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    far = micros - F.lag(micros).over(order) > gap_minutes * 60_000_000
    numbered = events.where(F.col(at).isNotNull()).withColumn("session", F.sum(F.coalesce(far.cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("events"))
