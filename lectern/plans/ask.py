"""Retrieval for batches of questions, from search to the context that a model reads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.conf import DEFAULTS, Settings
from lectern.operators import answering as A
from lectern.operators import retrieval as R
from lectern.operators.encoding import Encoder, encode, hashed_encoder
from lectern.tables import materialise

#: From a batch of prompts to their replies.
Model = Callable[[list[str]], list[str]]
#: What the model is told before a conversation.
CONDENSE = "Put the last question of this conversation so that it can be understood alone."


@dataclass
class Retrieved:
    """Reranked candidates, the outcome of every query, and the context blocks of the answered ones."""

    reranked: DataFrame
    outcome: DataFrame
    blocks: DataFrame


def hybrid(queries: DataFrame, index: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Fused top-k of dense and sparse search; queries and index have id, vector, indices, values."""
    dense = R.dense_topk(queries, index, conf.fused_top_k)
    sparse = R.sparse_topk(R.postings(queries), R.postings(index), conf.fused_top_k)
    return R.fuse([dense, sparse], conf.fused_top_k, conf.rrf_constant)


def lexical(questions: DataFrame, chunks: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """Top-k of questions (query_id, question) over chunks (chunk_id, text) by tf-idf of words."""
    weights, idf = R.word_postings(chunks.select(F.col("chunk_id").alias("id"), "text"))
    asked = R.query_postings(questions.select(F.col("query_id").alias("id"), F.col("question").alias("text")), idf)
    return R.word_topk(asked, weights, idf, conf.fused_top_k)


def encoded_search(questions: DataFrame, index: DataFrame, encoder: Encoder = hashed_encoder, conf: Settings = DEFAULTS) -> DataFrame:
    """Hybrid search of question texts (query_id, question) in an index that the same encoder made."""
    asked = encode(questions.select(F.col("query_id").alias("id"), F.col("question").alias("text")), encoder)
    return hybrid(asked, index, conf)


def retrieve(questions: DataFrame, chunks: DataFrame, docs: DataFrame, conf: Settings = DEFAULTS, found: DataFrame | None = None, score: Column | None = None) -> Retrieved:
    """Answers-to-be of questions: search, rerank, floor, parents, budget.

    ``found`` (query_id, chunk_id, rank) comes from a search, such as encoded_search; without it the
    questions are searched by words. ``score`` is the reranker's column over question and text.
    Questions without candidates and those below the floor keep their row in the outcome. Texts are
    read for candidates only, and again for the few that are kept.
    """
    children = chunks.where("kind = 'child'").dropDuplicates(["chunk_id"])
    found = found if found is not None else lexical(questions, children, conf)
    found = materialise(found.select("query_id", "chunk_id", "rank"), "found")
    candidates = found.join(children.select("chunk_id", "text"), "chunk_id").join(questions.select("query_id", "question"), "query_id")
    reranked = materialise(R.rerank(candidates, conf, score).drop("text", "question"), "reranked")
    own = children.select("chunk_id", "parent_id", "doc_id", "text", "section_path", "page_start", "page_end")
    hits = R.kept(reranked, conf).withColumn("score", F.col("rerank_score")).join(own, "chunk_id")
    blocks = materialise(R.expand_to_parents(hits, chunks.where("kind = 'parent'")), "blocks")
    titles = docs.groupBy("doc_id").agg(F.max("title").alias("title"), F.min("source_path").alias("source_path"))
    return Retrieved(reranked, R.outcome(questions, reranked, conf), R.within_budget(blocks, conf.context_token_budget).join(titles, "doc_id", "left"))


def answer(questions: DataFrame, chunks: DataFrame, docs: DataFrame, model: Model, conf: Settings = DEFAULTS, history: DataFrame | None = None, found: DataFrame | None = None, score: Column | None = None, pause: float = A.PAUSE) -> DataFrame:
    """(query_id, question, text, no_answer, error, top_score, sources): questions through search and model to answers.

    With ``history`` (query_id, history) the model first makes a question that stands on its own.
    Questions that nothing above the floor was found for get the fixed sentence and no call. An error
    of the model leaves the text null and is reported.
    """
    asked = questions.select("query_id", "question")
    if history is not None:
        told = asked.join(history.select("query_id", "history"), "query_id", "left")
        talk = told.where("history is not null").withColumn("prompt", F.concat(F.lit(CONDENSE + "\n\n"), "history", F.lit("\n\nQuestion: "), "question"))
        own = A.complete(talk, model, pause=pause).select("query_id", A.condensed(F.col("question"), F.col("reply")).alias("question"))
        asked = own.unionByName(told.where("history is null").select("query_id", "question"))
    asked = materialise(asked, "asked")
    done = retrieve(asked, chunks, docs, conf, found, score)
    blocks = materialise(done.blocks, "context")
    prompts = R.context(blocks).join(asked, "query_id").join(done.outcome.where("not no_answer").select("query_id"), "query_id")
    prompts = prompts.select("query_id", F.to_json(A.messages(F.col("question"), F.col("context"))).alias("prompt"))
    replies = materialise(A.complete(prompts, model, pause=pause), "replies")
    told = A.answers(done.outcome.select("query_id", "no_answer"), replies, A.source_list(blocks), conf)
    problem = replies.select("query_id", F.nullif("error", F.lit("")).alias("error"))
    return told.join(asked, "query_id").join(problem, "query_id", "left").join(done.outcome.select("query_id", "top_score"), "query_id").select("query_id", "question", "text", "no_answer", "error", "top_score", "sources")
