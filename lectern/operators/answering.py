"""Answers and their sources, prompts and stage events; model calls are injected functions."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.conf import DEFAULTS, Settings
from lectern.functions import text as T

#: What the model is told before question and context.
INSTRUCTION = "Answer only from the numbered context blocks and cite them as [n]. Say so if they hold no answer."


def source_list(blocks: DataFrame) -> DataFrame:
    """(query_id, sources): numbered sources of the context blocks, with page label, section and snippet."""
    row = F.struct(F.col("block_no").alias("n"), "title", F.array_join("section_path", " > ").alias("section"), T.page_label(F.col("page_start"), F.col("page_end")).alias("pages"), "source_path", F.bround("score", 3).alias("score"), T.snippet(F.col("text")).alias("snippet"))
    return blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("sources"))


def cited_sources(sources: Column, cited: Column) -> Column:
    """The sources that are cited; all of them where none is."""
    return F.when(F.size(cited) == 0, sources).otherwise(F.filter(sources, lambda s: F.array_contains(cited, s["n"])))


def messages(question: Column, context: Column) -> Column:
    """The two messages of a prompt."""
    user = F.concat(F.lit("Context:\n\n"), context, F.lit("\n\nQuestion: "), question)
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(INSTRUCTION).alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))


def history(turns: DataFrame, last: int = 6) -> DataFrame:
    """(conv_id, history): the last turns (conv_id, turn, role, text), oldest first, as lines."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    recent = turns.withColumn("back", F.row_number().over(order)).where(F.col("back") <= last)
    line = F.struct(F.col("turn"), F.concat_ws(": ", "role", "text").alias("l"))
    return recent.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["l"]), "\n").alias("history"))


#: Tries of a model call, and seconds before the second, doubled before each further one.
TRIES, PAUSE = 4, 5.0


def may_pass(problem: Exception) -> bool:
    """Whether an error is one of too many calls, which a pause may mend."""
    return "429" in str(problem) or "rate" in str(problem).lower()


def called(model: Callable[[list[str]], list[str]], texts: list[str], tries: int = TRIES, pause: float = PAUSE) -> list[str]:
    """The replies of a model, tried again after growing pauses while it is called too often."""
    for attempt in range(tries):
        try:
            return model(texts)
        except Exception as problem:
            if attempt + 1 == tries or not may_pass(problem):
                raise
            time.sleep(pause * 2**attempt)
    return []


def complete(prompts: DataFrame, model: Callable[[list[str]], list[str]], column: str = "prompt", tries: int = TRIES, pause: float = PAUSE) -> DataFrame:
    """``prompts`` with reply and error: the model gets a batch of texts; a failed batch is tried row by row.

    The function is sent to the workers; it makes its client there, once a partition.
    """
    fields = ", ".join(f"{c} {t}" for c, t in prompts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            try:
                yield pdf.assign(reply=called(model, list(pdf[column]), tries, pause), error="")
            except Exception:
                replies, errors = [], []
                for text in pdf[column]:
                    try:
                        replies.append(called(model, [text], tries, pause)[0])
                        errors.append("")
                    except Exception as problem:
                        replies.append(None)
                        errors.append(str(problem)[:500])
                yield pdf.assign(reply=replies, error=errors)

    return prompts.mapInPandas(run, f"{fields}, reply string, error string")


def completion(body: Column) -> Column:
    """Struct (text, error) of a model's response body: the first choice's content, or what it says went wrong."""
    parsed = F.try_parse_json(body)
    get = lambda path: F.try_variant_get(parsed, path, "string")
    wrong = F.coalesce(get("$.error.message"), get("$.error"), F.when(parsed.isNull(), F.lit("no JSON")))
    return F.struct(F.when(wrong.isNull(), get("$.choices[0].message.content")).alias("text"), wrong.alias("error"))


def enrichment_targets(chunks: DataFrame, limit: int | None = None) -> DataFrame:
    """The children that get a summary, once each; ``limit`` takes the first by document and place."""
    children = chunks.where("kind = 'child'").dropDuplicates(["chunk_id"])
    return children if limit is None else children.orderBy("doc_id", "seq", "chunk_id").limit(limit)


def enrich(children: DataFrame, model: Callable[[list[str]], list[str]], instruction: str = "Say in one sentence where this passage stands in its document.", pause: float = PAUSE) -> DataFrame:
    """Children (chunk_id, embed_text) with a model's sentence in front of what is embedded; unchanged where it fails."""
    asked = children.withColumn("prompt", F.concat(F.lit(instruction + "\n\n"), F.coalesce("embed_text", F.lit(""))))
    done = complete(asked, model, pause=pause)
    return done.withColumn("embed_text", enriched(F.col("embed_text"), F.col("reply"))).drop("prompt", "reply", "error")


def condensed(question: Column, reply: Column) -> Column:
    """The standalone question; the raw one where the model gave none."""
    return F.coalesce(F.nullif(F.trim(reply), F.lit("")), question)


def enriched(embed_text: Column, summary: Column) -> Column:
    """The embedded text with a context in front; unchanged without one."""
    return F.coalesce(F.concat(F.nullif(F.trim(summary), F.lit("")), F.lit("\n\n"), embed_text), embed_text)


def answers(prompted: DataFrame, replies: DataFrame, sources: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """(query_id, text, no_answer, sources) of all queries.

    ``prompted`` has query_id and no_answer, ``replies`` query_id and reply of the answered ones. A
    refused query gets the fixed sentence and no sources; markers of blocks that don't exist are
    removed from replies; the sources are those cited, or all where none is.
    """
    joined = prompted.join(replies.select("query_id", "reply"), "query_id", "left").join(sources, "query_id", "left")
    n = F.coalesce(F.size("sources"), F.lit(0))
    shown = cited_sources(F.col("sources"), T.cited(F.col("reply"), n))
    return joined.select("query_id", F.when(F.col("no_answer"), F.lit(conf.no_answer_text)).otherwise(T.without_invalid_citations(F.col("reply"), n)).alias("text"), "no_answer", F.when(~F.col("no_answer"), shown).alias("sources"))


def stream_deltas(lines: DataFrame) -> DataFrame:
    """(query_id, seq, delta) of server-sent lines (query_id, seq, line): data lines up to ``[DONE]``.

    Lines that hold no JSON or an empty delta are skipped.
    """
    data = lines.where(F.startswith("line", F.lit("data: "))).withColumn("body", F.regexp_replace("line", "^data: ", ""))
    done = F.max(F.when(F.col("body") == "[DONE]", 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("seq"))
    delta = F.try_variant_get(F.try_parse_json("body"), "$.choices[0].delta.content", "string")
    return data.withColumn("done", done).where("done = 0").select("query_id", "seq", delta.alias("delta")).where("delta is not null and delta != ''")
