"""Mixing sources to target weights.

Method: hash-threshold histograms. Every document has a hash; the tokens of a source are summed by
hash bucket, and the budget of a source is met by the documents below a hash threshold. The bucket
in which the budget is reached is refined by the next bits of the hash, again and again, and only
that bucket; documents are then filtered by threshold, without a sort. Budgets above a source's
tokens are met by whole repeats and a threshold for the rest, so a larger mix contains the smaller.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.tables import materialise, spread

#: Vocabulary file of the public tokenizer (byte-level BPE, as ranks).
TOKENIZER = os.environ.get("LECTERN_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Bits of the hash that one histogram resolves, and how many histograms there are at most.
BITS, LEVELS = 12, 5

# fixed value: how the tokenizer cuts text before merging bytes
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _counted(name: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoding = _encoding(SparkFiles.get(name))
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": np.array([len(encoding.encode_ordinary(t)) for t in pdf["text"]], np.int64)})

    return run


def source_name(column: str):
    """One spelling of a source: lower case, without outer white space, words joined by underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(column), r"^[\s_-]+|[\s_-]+$", ""), r"[\s_-]+", "_")


def token_sizes(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, hash): sizes in tokens of the public tokenizer; repeated rows once.

    Documents without text or source can have no share and are left out. The vocabulary needs to lie
    on the driver only: Spark hands it to the workers.
    """
    docs.sparkSession.sparkContext.addFile(tokenizer)
    named = docs.select("doc_id", source_name("source").alias("source"), "text").where("doc_id is not null and source is not null and text is not null and text != ''")
    sized = spread(named).mapInPandas(_counted(os.path.basename(tokenizer)), "doc_id long, source string, tokens long")
    return sized.groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("d")).select("doc_id", "d.source", "d.tokens", F.xxhash64("doc_id").alias("hash"))


def budgets(sized: DataFrame, targets: DataFrame, total: int | None = None) -> DataFrame:
    """(source, target_share, wanted_share, max_repeats, available, budget) by source of ``targets``.

    Sources without documents can't contribute: the others' shares are raised in proportion
    (wanted_share). Without ``total`` the mix is as large as the scarcest source allows at its
    share, so that every share is reached; with it, scarce sources fall short by what they lack.
    """
    have = sized.groupBy("source").agg(F.sum("tokens").alias("available"))
    wanted = targets.select(source_name("source").alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0)).alias("max_repeats"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    # one row a source: the table is as small as the list of targets
    each = wanted.join(have, "source", "left").withColumn("available", F.coalesce("available", F.lit(0)))
    usable = F.when((F.col("available") > 0) & (F.col("max_repeats") > 0), F.col("target_share"))
    each = each.withColumn("wanted_share", F.coalesce(usable / F.sum(usable).over(Window.partitionBy(F.lit(1))), F.lit(0.0)))
    most = F.when(F.col("wanted_share") > 0, F.col("available") * F.col("max_repeats") / F.col("wanted_share"))
    size = F.lit(float(total)) if total is not None else F.min(most).over(Window.partitionBy(F.lit(1)))
    budget = F.least(F.floor(F.col("wanted_share") * size + F.lit(1e-6)), F.col("available") * F.col("max_repeats"))
    return each.withColumn("budget", F.coalesce(budget, F.lit(0)).cast("long"))


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """(source, repeats, below): whole repeats of a source, and the hash below which documents come once more.

    below is an unsigned position in BITS * LEVELS bits. Each level sums the tokens of one bucket
    by its next BITS bits, before the shuffle; the result has a row a source. A bucket of one document
    needs no refinement: that document is the one that doesn't fit.
    """
    state = plan.select("source", F.when(F.col("available") > 0, F.floor(F.col("budget") / F.col("available"))).otherwise(0).cast("long").alias("repeats"), "available", "budget", "max_repeats")
    state = state.withColumn("left", F.when(F.col("repeats") < F.col("max_repeats"), F.col("budget") - F.col("repeats") * F.col("available")).otherwise(0)).withColumn("prefix", F.lit(0).cast("long"))
    state = materialise(state.select("source", "repeats", "left", "prefix"), "budgets")
    position = F.shiftrightunsigned("hash", 64 - BITS * LEVELS)
    for level in range(1, LEVELS + 1):
        down = BITS * (LEVELS - level)
        inside = sized.select("source", "tokens", position.alias("at")).join(F.broadcast(state), "source").where(F.shiftright("at", down + BITS) == F.col("prefix"))  # state: a row a source
        sums = inside.groupBy("source", F.shiftright("at", down).alias("bucket")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        running = sums.withColumn("upto", F.sum("tokens").over(upto)).join(F.broadcast(state), "source")  # at most 2 ** BITS rows a source
        fits = F.col("upto") <= F.col("left")
        reached = running.groupBy("source").agg(F.max(F.when(fits, F.col("upto"))).alias("used"), F.max("bucket").alias("last"), F.min(F.when(~fits, F.struct("bucket", "n"))).alias("boundary"))
        joined = state.join(reached, "source", "left")
        first = F.shiftleft("prefix", BITS)
        state = materialise(joined.select("source", "repeats", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), F.coalesce("boundary.bucket", F.col("last") + 1, first).alias("prefix"), F.coalesce(F.col("boundary.n") > 1, F.lit(False)).alias("open")), "budgets")
        if state.where("open").isEmpty():
            break
    return state.select("source", "repeats", F.shiftleft("prefix", down).alias("below"))


def mixture(docs: DataFrame, targets: DataFrame, total: int | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): chosen has (doc_id, source, tokens, repeats) of every document of the mix.

    shares has a row for every source of ``targets``: target_share, wanted_share, max_repeats,
    available, budget, documents, used tokens and actual_share of the mix.
    """
    sized = materialise(token_sizes(docs, tokenizer), "sizes")
    plan = materialise(budgets(sized, targets, total), "plan")
    cut = thresholds(sized, plan)
    position = F.shiftrightunsigned("hash", 64 - BITS * LEVELS)
    repeats = F.col("repeats") + F.when(position < F.col("below"), 1).otherwise(0)
    chosen = sized.join(F.broadcast(cut), "source").select("doc_id", "source", "tokens", repeats.cast("int").alias("repeats")).where("repeats > 0")
    used = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("used"))
    shares = plan.join(used, "source", "left").fillna(0, ["documents", "used"])
    whole = F.sum("used").over(Window.partitionBy(F.lit(1)))
    shares = shares.withColumn("actual_share", F.coalesce(F.round(F.try_divide("used", whole), 6), F.lit(0.0)))
    return chosen, shares
