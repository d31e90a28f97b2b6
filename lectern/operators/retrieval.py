"""Batches of queries: dense and sparse search, rank fusion, rerank, parents and context budget."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.conf import DEFAULTS, Settings
from lectern.functions import text as T
from lectern.tables import materialise

#: Queries of a block of the exact dense search; so many vectors (about 10 MB) are broadcast, more are shuffled in blocks.
QUERY_BLOCK = 20_000
#: Rows of a part of the index where queries are shuffled, and queries whose scores are in memory at once.
INDEX_PART, STRIP = 100_000, 256


def top_k(scored: DataFrame, k: int, score: str = "score", tie: str = "chunk_id") -> DataFrame:
    """The k best rows of every query with their rank, ties by id; planned as a partial and a final limit."""
    best = Window.partitionBy("query_id").orderBy(F.desc(score), tie)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _unit(vectors: pd.Series, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, unit vectors) of those that have ``dim`` finite values and a length."""
    at = np.flatnonzero(vectors.str.len().to_numpy() == dim)
    x = np.stack(vectors.to_numpy()[at]).astype(float) if len(at) else np.empty((0, dim))
    norm = np.linalg.norm(x, axis=1)
    ok = np.isfinite(norm) & (norm > 0)
    return at[ok], x[ok] / norm[ok][:, None]


class _Best:
    """The k best rows of every query of a block, kept while parts of the index come by."""

    def __init__(self, names: np.ndarray, queries: np.ndarray, k: int, decimals: int) -> None:
        self.names, self.q, self.k, self.decimals = names, queries, k, decimals
        self.floor = np.full(len(names), -np.inf)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        for lo in range(0, len(self.q), STRIP):
            score = np.round(self.q[lo : lo + STRIP] @ x.T, self.decimals)
            floor = self.floor[lo : lo + STRIP]
            if score.shape[1] > self.k:
                floor = np.maximum(floor, np.partition(score, -self.k, axis=1)[:, -self.k])
            row, col = np.nonzero(score >= floor[:, None])
            self.held.append(self._first(row + lo, score[row, col], ids[col]))
        if sum(len(h[0]) for h in self.held) > 4 * self.k * len(self.q) + 1_000_000:
            self.merge()

    def _first(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        return row[keep], score[keep], ids[keep]

    def merge(self) -> None:
        row, score, ids = self._first(*(np.concatenate(c) for c in zip(*self.held, strict=True)))
        full = np.flatnonzero(np.bincount(row, minlength=len(self.q)) >= self.k)
        self.floor[full] = score[np.searchsorted(row, full) + self.k - 1]
        self.held = [(row, score, ids)]

    def result(self) -> pd.DataFrame:
        if self.held:
            self.merge()
        row, score, ids = self.held[0] if self.held else (np.empty(0, int), np.empty(0), np.empty(0, object))
        return pd.DataFrame({"query_id": self.names[row].astype(object), "chunk_id": ids.astype(object), "score": score})


def _names(ids: pd.Series) -> np.ndarray:
    return np.array(ids.tolist())


def dense_topk(queries: DataFrame, index: DataFrame, k: int, decimals: int = 6) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact cosine top-k of stated queries against all rows.

    Both have id and vector. The length of vectors is that of most queries; vectors of another one,
    with nulls, NaN or without a direction are skipped. A block of queries is broadcast as one
    matrix; each task keeps the k best of every query while its rows come by and hands on only those.
    Larger query sets are shuffled: every block of them meets every part of the index in a task.
    """
    clean = lambda d: d.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    asked = clean(queries).select(F.col("id").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    sizes = asked.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").collect()  # a row per length of vectors
    dim, count = (sizes[0]["dim"], sizes[0]["n"]) if sizes else (0, 0)
    asked = asked.where(F.size("vector") == dim)
    rows = clean(index).where(F.size("vector") == dim).select("id", F.col("vector").cast("array<double>").alias("vector"))
    fields = f"query_id {dict(queries.dtypes)['id']}, chunk_id {dict(index.dtypes)['id']}, score double"
    if count <= QUERY_BLOCK:
        held = asked.toPandas()  # at most QUERY_BLOCK rows
        at, unit = _unit(held["vector"], dim) if count else (np.empty(0, int), np.empty((0, dim)))
        block = index.sparkSession.sparkContext.broadcast((_names(held["query_id"].iloc[at]), unit))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best = _Best(*block.value, k, decimals)
            for pdf in batches:
                own, x = _unit(pdf["vector"], dim)
                if len(own) and len(best.q):
                    best.add(_names(pdf["id"].iloc[own]), x)
            yield best.result()

        return top_k(rows.mapInPandas(scan, fields), k)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        qa, q = _unit(left["vector"], dim)
        xa, x = _unit(right["vector"], dim)
        best = _Best(_names(left["query_id"].iloc[qa]), q, k, decimals)
        if len(qa) and len(xa):
            best.add(_names(right["id"].iloc[xa]), x)
        return best.result()

    blocks, parts = -(-count // QUERY_BLOCK), max(1, -(-rows.count() // INDEX_PART))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("part", each(parts))
    right = rows.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", each(blocks))
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(meet, fields)
    return top_k(met, k)


def postings(vectors: DataFrame) -> DataFrame:
    """(id, token, weight) of sparse vectors (id, indices, values); a token that recurs is added up."""
    flat = vectors.where(F.size("indices") == F.size("values")).select("id", F.explode(F.arrays_zip("indices", "values")).alias("p"))
    return flat.select("id", F.col("p.indices").alias("token"), F.col("p.values").cast("double").alias("weight")).where("token is not null and weight is not null").groupBy("id", "token").agg(F.sum("weight").alias("weight"))


def sparse_topk(query_postings: DataFrame, index_postings: DataFrame, k: int, decimals: int = 4) -> DataFrame:
    """(query_id, chunk_id, score, rank): dot products by an equi-join on tokens."""
    q = query_postings.select(F.col("id").alias("query_id"), "token", F.col("weight").alias("qw"))
    hits = q.join(index_postings.select(F.col("id").alias("chunk_id"), "token", "weight"), "token")
    scored = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("qw") * F.col("weight")), decimals).alias("score"))
    return top_k(scored.where("score > 0"), k)


def fuse(ranked: list[DataFrame], k: int, constant: int = DEFAULTS.rrf_constant) -> DataFrame:
    """(query_id, chunk_id, score, rank): reciprocal-rank fusion of ranked lists."""
    parts = [r.select("query_id", "chunk_id", "rank") for r in ranked]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    fused = rows.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (F.lit(constant) + F.col("rank"))), 8).alias("score"))
    return top_k(fused, k)


def _word_counts(texts: DataFrame) -> DataFrame:
    """(id, token, tf) of texts (id, text)."""
    words = texts.select("id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("token"))
    return words.groupBy("id", "token").agg(F.count("*").alias("tf"))


def _unit_weights(tf: DataFrame, idf: DataFrame) -> DataFrame:
    """(id, token, weight): tf-idf of unit length; words that all texts have weigh nothing and are left out."""
    weighted = tf.join(idf.where("idf > 0"), "token").select("id", "token", (F.col("tf") * F.col("idf")).alias("w"))
    norm = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weighted.join(norm, "id").select("id", "token", (F.col("w") / F.col("norm")).alias("weight"))


def word_postings(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tf-idf postings (id, token, weight) of texts (id, text), of unit length, and the idf (token, idf, common).

    The idf is ln(texts / texts with the word); ``common`` marks words that more than half of the texts have.
    """
    tf = materialise(_word_counts(texts), "words")
    total = texts.agg(F.countDistinct("id")).first()[0]
    idf = tf.groupBy("token").agg(F.count("*").alias("df")).select("token", F.log(F.lit(float(total)) / F.col("df")).alias("idf"), (F.col("df") * 2 > total).alias("common"))
    idf = materialise(idf, "idf")
    return materialise(_unit_weights(tf, idf.select("token", "idf")), "postings"), idf


def query_postings(queries: DataFrame, idf: DataFrame) -> DataFrame:
    """Postings of query texts by the index's idf; words the index lacks have none."""
    return _unit_weights(_word_counts(queries), idf.select("token", "idf"))


def word_topk(query_postings: DataFrame, index_postings: DataFrame, idf: DataFrame, k: int, decimals: int = 6) -> DataFrame:
    """(query_id, chunk_id, score, rank): dot products of words, exact, without meeting every text that has a common word.

    The other words are scored first. The common words of a query add at most the sum of its weights
    times their greatest weights; texts that can't reach the k-th best with that are settled. Only the
    remaining ones look their common words up, and only queries that a text could answer by common
    words alone read all postings of these.
    """
    q = materialise(query_postings.join(idf.select("token", "common"), "token").select(F.col("id").alias("query_id"), "token", F.col("weight").alias("qw"), "common"), "asked")
    w = index_postings.select(F.col("id").alias("chunk_id"), "token", "weight")
    common = idf.where("common").select("token")
    most = w.join(F.broadcast(common), "token").groupBy("token").agg(F.max("weight").alias("most"))  # words of more than half of the texts: no more than twice the words of a text
    rare = q.where("not common").join(w, "token").groupBy("query_id", "chunk_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("part"))
    rare = materialise(rare, "partial")
    bound = q.where("common").join(F.broadcast(most), "token").groupBy("query_id").agg(F.sum(F.col("qw") * F.col("most")).alias("more"))
    kth = top_k(rare, k, "part").where(F.col("rank") == k).select("query_id", F.col("part").alias("kth"))
    state = q.select("query_id").distinct().join(bound, "query_id", "left").join(kth, "query_id", "left")
    # a margin of a rounding step keeps texts that tie after rounding
    state = materialise(state.select("query_id", F.coalesce("more", F.lit(0.0)).alias("more"), (F.coalesce("kth", F.lit(0.0)) - 2 * 10.0**-decimals).alias("floor")), "floors")
    open_ = state.where("more >= floor").select("query_id")
    near = rare.join(state, "query_id").where("part + more >= floor").select("query_id", "chunk_id", "part")
    asked = q.where("common").select("query_id", "token", "qw")
    looked = near.join(asked, "query_id").join(w, ["chunk_id", "token"]).select("query_id", "chunk_id", (F.col("qw") * F.col("weight")).alias("part"))
    alone = asked.join(open_, "query_id").join(w, "token").join(near.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").select("query_id", "chunk_id", (F.col("qw") * F.col("weight")).alias("part"))
    scored = near.unionByName(looked).unionByName(alone).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), decimals).alias("score"))
    return top_k(scored.where("score > 0"), k)


def overlap_score(question: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder: the share of the question's distinct words that the text has."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    q = words(question)
    return F.round(F.size(F.array_intersect(q, words(text))) / F.greatest(F.lit(1), F.size(q)), 6)


def rerank(candidates: DataFrame, conf: Settings = DEFAULTS, score: Column | None = None) -> DataFrame:
    """Candidates (query_id, chunk_id, rank, question, text) with rerank_score and rerank_rank, all of them.

    ``score`` is the scorer, by default the word overlap. Ties keep the fused order.
    """
    scored = candidates.withColumn("rerank_score", score if score is not None else overlap_score(F.col("question"), F.col("text")))
    best = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    return scored.withColumn("rerank_rank", F.row_number().over(best))


def kept(reranked: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """The best rows at or above the floor, at most rerank_top_n of each query."""
    best = Window.partitionBy("query_id").orderBy("rerank_rank")
    return reranked.where(F.col("rerank_score") >= conf.score_floor).withColumn("kept_rank", F.row_number().over(best)).where(F.col("kept_rank") <= conf.rerank_top_n)


def outcome(queries: DataFrame, reranked: DataFrame, conf: Settings = DEFAULTS) -> DataFrame:
    """(query_id, no_answer, top_score) of every query, also those without candidates."""
    best = reranked.groupBy("query_id").agg(F.max("rerank_score").alias("best"))
    joined = queries.select("query_id").distinct().join(best, "query_id", "left")
    return joined.select("query_id", F.coalesce(F.col("best") < conf.score_floor, F.lit(True)).alias("no_answer"), F.coalesce("best", F.lit(0.0)).alias("top_score"))


def expand_to_parents(hits: DataFrame, parents: DataFrame) -> DataFrame:
    """(query_id, block_key, score, matched_chunks, chunk_id, doc_id, text, page_start, page_end, section_path, rank).

    ``hits`` has query_id, chunk_id, parent_id, score, kept_rank and the chunk's own attributes.
    Children of one parent become one block with the parent's text; children without an existing
    parent stay alone. Blocks are ranked by their best score, then by their first child.
    """
    fields = ["text", "section_path", "page_start", "page_end"]
    up = parents.select(F.col("chunk_id").alias("parent_id"), F.struct(*fields).alias("parent")).dropDuplicates(["parent_id"])
    joined = hits.join(up, "parent_id", "left").withColumn("block_key", F.when(F.col("parent").isNotNull(), F.col("parent_id")).otherwise(F.col("chunk_id")))
    child = F.struct(*fields)
    merged = joined.groupBy("query_id", "block_key").agg(
        F.max("score").alias("score"), F.count("*").alias("matched_chunks"), F.min("kept_rank").alias("first"),
        F.min_by(F.struct("chunk_id", "doc_id", F.coalesce("parent", child).alias("b")), "kept_rank").alias("x"),
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "first")
    return merged.select("query_id", "block_key", "score", "matched_chunks", "x.chunk_id", "x.doc_id", "x.b.*", F.row_number().over(best).alias("rank"))


def within_budget(blocks: DataFrame, budget: int = DEFAULTS.context_token_budget) -> DataFrame:
    """The blocks of each query that fit the context: a block that would overflow is skipped, the first is always kept.

    A query has rerank_top_n blocks at most, so its blocks are folded as one small array.
    """
    listed = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block_key", T.token_count(F.col("text")).alias("tokens")))).alias("b"))
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.lit(0).cast("long").alias("used"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["used"] + x["tokens"] <= budget) | (F.size(s["keys"]) == 0)
        return F.struct(F.when(fits, F.concat(s["keys"], F.array(x["block_key"].cast("string")))).otherwise(s["keys"]).alias("keys"), F.when(fits, s["used"] + x["tokens"]).otherwise(s["used"]).alias("used"))

    keys = listed.select("query_id", F.explode(F.aggregate("b", start, step)["keys"]).alias("block_key"))
    numbered = blocks.join(keys, ["query_id", "block_key"])
    return numbered.withColumn("block_no", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def context(blocks: DataFrame) -> DataFrame:
    """(query_id, n_blocks, context): numbered blocks of each query in one text."""
    where = F.when(F.size(F.coalesce("section_path", F.array().cast("array<string>"))) > 0, F.array_join("section_path", " > ")).otherwise(F.coalesce("title", F.lit("")))
    head = F.concat(F.lit("["), F.col("block_no").cast("string"), F.lit("] "), F.coalesce("title", F.lit("")), F.lit(" — "), where, F.lit(" ("), T.page_label(F.col("page_start"), F.col("page_end")), F.lit(")\n"), F.coalesce("text", F.lit("")))
    return blocks.groupBy("query_id").agg(F.count("*").alias("n_blocks"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", head.alias("t")))), lambda x: x["t"]), "\n\n---\n\n").alias("context"))
