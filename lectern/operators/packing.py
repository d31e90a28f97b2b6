"""Filling containers of fixed capacity with items of varying length.

Method: space-filling-curve order. The hashed words of an item's text are projected to a few
dimensions, the point is given its Hilbert key, items are sorted by key in ranges, and neighbours
along the curve are packed together: within a window of the curve the longest items first, each
into the fullest open container that takes it. Only keys and lengths are moved, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.tables import spread

#: Dimensions of the curve and bits of each.
DIMS, BITS = 4, 8
#: Items of the curve that are packed longest first, and containers left open for the next window.
WINDOW, OPEN = 2_048, 256
#: Characters (code points) that count as one token.
TOKEN_CHARS = 4


def tokens_of(text: Column) -> Column:
    """Token count of a text: a quarter of its characters, at least one; null counts as empty."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / TOKEN_CHARS)).cast("int")


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer points (n, dims) along the Hilbert curve of ``bits`` bits a dimension."""
    x = points.astype(np.uint64).T.copy()
    dims, top = len(x), np.uint64(1 << (bits - 1))
    q = top
    while q > 1:  # undo the rotations of the sub-cubes, from the largest to the smallest
        low = q - np.uint64(1)
        for i in range(dims):
            turned = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(turned, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(turned, x[i], x[i] ^ swap)
        q >>= np.uint64(1)
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = top
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - np.uint64(1)), t)
        q >>= np.uint64(1)
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key.astype(np.int64)


def _curve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        key = np.zeros(len(pdf), np.int64)
        for first, sizes, hashed in W.passes(pdf["text"]):
            full = np.flatnonzero(sizes)
            points = np.zeros((len(sizes), DIMS))
            if len(full):
                begin = np.concatenate(([0], np.cumsum(sizes)[:-1]))[full]
                for d in range(DIMS):
                    signs = ((W.mix(hashed + np.uint64(d + 1)) >> np.uint64(63)).astype(np.int64) * 2 - 1).astype(float)
                    points[full, d] = np.add.reduceat(signs, begin) / np.sqrt(sizes[full])
            cells = np.clip((points / 6 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1)
            key[first : first + len(sizes)] = hilbert_keys(cells, BITS)
        yield pdf.drop(columns="text").assign(curve=key)


class _Containers:
    """Open containers by the room that is left in them."""

    def __init__(self, capacity: int, prefix: int) -> None:
        self.capacity, self.next, self.room = capacity, prefix, []

    def put(self, size: int) -> int:
        at = bisect_left(self.room, (size, -1))
        if at < len(self.room):
            room, number = self.room.pop(at)
        else:
            room, number = self.capacity, self.next
            self.next += 1
        if room > size:
            insort(self.room, (room - size, number))
        return number

    def close(self) -> None:
        """The emptiest stay open for the next window."""
        del self.room[:-OPEN]


def _packed(capacity: int):
    """mapInPandas function over items sorted along the curve."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        containers = _Containers(capacity, TaskContext.get().partitionId() << 33)
        for pdf in batches:
            size = pdf["tokens"].to_numpy()
            number = np.zeros(len(pdf), np.int64)
            for lo in range(0, len(pdf), WINDOW):
                for i in (lo + np.argsort(-size[lo : lo + WINDOW], kind="stable")).tolist():
                    number[i] = containers.put(int(size[i]))
                containers.close()
            yield pdf.assign(container=number)

    return run


def pack(items: DataFrame, key: list[str], capacity: int) -> DataFrame:
    """Assigns every item to a container of at most ``capacity`` tokens.

    ``items`` has the key columns and text; other columns are ignored. Result: the key, piece and
    pieces (an item above the capacity is split into pieces of the whole capacity and a rest; all
    others are one piece), char_start and char_end, tokens, container. Repeated rows count once;
    rows that share a key but not the text count as one, the longest. Null and empty texts are
    items of one token.
    """
    if capacity < 1:
        raise ValueError("the capacity must be at least one token")
    keyed = spread(items).select(*key, F.coalesce("text", F.lit("")).alias("text"))
    lengths = keyed.withColumn("chars", F.length("text")).withColumn("tokens", tokens_of(F.col("text")))
    fields = ", ".join(f"{c} {t}" for c, t in lengths.drop("text").dtypes)
    at_curve = lengths.mapInPandas(_curve, f"{fields}, curve long")
    once = at_curve.groupBy(*key).agg(F.max(F.struct("chars", "tokens", "curve")).alias("i")).select(*key, "i.*")
    piece_chars = capacity * TOKEN_CHARS
    pieces = F.when(F.col("tokens") > capacity, F.ceil(F.col("chars") / piece_chars)).otherwise(1).cast("int")
    cut = once.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    cut = cut.withColumn("char_start", F.col("piece") * piece_chars).withColumn("char_end", F.when(F.col("piece") == F.col("pieces") - 1, F.col("chars")).otherwise((F.col("piece") + 1) * piece_chars))
    own = F.greatest(F.lit(1), F.floor((F.col("char_end") - F.col("char_start")) / TOKEN_CHARS)).cast("int")
    cut = cut.select(*key, "piece", "pieces", "char_start", "char_end", own.alias("tokens"), "curve")
    # equal keys are spread by the item's own key, so that a hot point of the curve fills several ranges
    ranged = cut.repartitionByRange("curve", *key, "piece").sortWithinPartitions("curve", *key, "piece")
    fields = ", ".join(f"{c} {t}" for c, t in ranged.dtypes)
    return ranged.mapInPandas(_packed(capacity), f"{fields}, container long").drop("curve")


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could do, fullest, and the share filled."""
    each = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    total = F.coalesce(F.sum("tokens"), F.lit(0))
    return each.agg(
        F.count("*").alias("containers"), total.alias("tokens"), F.ceil(total / capacity).cast("long").alias("least"), F.max("tokens").alias("fullest"), F.round(F.try_divide(total, F.count("*") * capacity), 6).alias("filled"),
    )
