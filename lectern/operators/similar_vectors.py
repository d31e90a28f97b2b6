"""The most similar vectors of every vector.

Method: multi-index hashing. Learned rotations (iterative quantisation, fitted on a bounded sample)
turn a vector into a binary code, the code is split into substrings and every substring is indexed.
Two codes that differ in fewer bits than there are substrings share one of them (pigeonhole), so an
equi-join on the substrings retrieves every code within that Hamming radius, and many beyond it.
Longer substrings are shared by fewer of the true neighbours, so their number grows with their
length. What is retrieved is ranked by the cosine of the vectors themselves: all rows of a bucket
meet, those of a large one in pairs of parts.

Vectors travel as unit vectors of 12-bit fixed-point numbers: a cosine of two of them is within
0.0005 of the exact one at 64 dimensions, and a row is 96 bytes instead of 256.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.tables import materialise

#: Substrings of a code, each one index: at least so many, and so many per bit of a substring.
TABLES, TABLES_A_BIT = 7, 1.5
#: Mean size of a bucket, by which the bits of a substring follow from the number of vectors.
BUCKET = 8_192
#: Rows of the sample that the rotations are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 25
#: Rows of a part of a bucket: buckets above four times that are divided, and each two parts meet.
BLOCK = 8_192
#: Rows whose cosines with a bucket are in memory at once, and groups of columns whose maxima are looked at first.
STRIP, GROUPS = 256, 512
#: Copies up to this number (about 10 MB) are broadcast, more are joined by shuffle.
HOT_ROWS = 200_000

_SCALE = 2047.0


def pack(x: np.ndarray) -> list[bytes]:
    """Unit vectors as 12-bit fixed-point numbers: the high eight bits of all, then the low four."""
    top = np.abs(x).max(axis=1, keepdims=True)
    q = np.rint(x / top * _SCALE).astype(np.int16) + 2048
    high, low = (q >> 4).astype(np.uint8), (q & 15).astype(np.uint8)
    return [r.tobytes() for r in np.concatenate([high, low[:, ::2] << 4 | low[:, 1::2]], axis=1)]


def unpack(rows: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors from their packed form."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    low = np.empty((len(rows), dim), np.uint8)
    low[:, ::2], low[:, 1::2] = raw[:, dim:] >> 4, raw[:, dim:] & 15
    x = ((raw[:, :dim].astype(np.int16) << 4) + low - 2048).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(dim: int):
    """mapInArrow function: (id, at, packed), packed null for vectors that are not valid."""
    schema = pa.schema([("id", pa.string()), ("at", pa.timestamp("us", "UTC")), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dense = batch.column("dense")
            size = np.array(dense.value_lengths().fill_null(0))
            right = np.flatnonzero(size == dim)
            whole = dense.take(pa.array(right)).flatten() if len(right) else pa.array([], pa.float32())
            x = np.asarray(whole.fill_null(np.nan), np.float32).reshape(-1, dim)
            good = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            out: list[bytes | None] = [None] * len(size)
            for i, row in zip(right[good].tolist(), pack(x[good].astype(np.float64)) if good.any() else [], strict=True):
                out[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("at").cast(schema.field("at").type), pa.array(out, pa.binary())], schema=schema)

    return run


def latest_valid(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, packed) of every id whose latest row holds a valid vector.

    ``vectors`` has id, at and dense. A vector is valid with ``dim`` finite values that are not all
    zero; rows without a time are the oldest; of rows at the same time the greatest vector counts.
    """
    rows = vectors.select("id", F.col("at").cast("timestamp").alias("at"), F.col("dense").cast("array<float>").alias("dense")).where(F.col("id").isNotNull())
    packed = rows.mapInArrow(_packed(dim), "id string, at timestamp, packed binary")
    order = F.struct(F.col("at").isNotNull(), "at", F.col("packed").isNotNull(), "packed")
    return packed.groupBy("id").agg(F.max(order).alias("r")).select("id", "r.packed").where(F.col("packed").isNotNull())


def fit_rotations(sample: np.ndarray, bits: int, rounds: int = ROUNDS) -> np.ndarray:
    """(dim, bits) directions whose signs are the code: rotations that iterative quantisation moves off the data."""
    dim, out = sample.shape[1], []
    for seed in range(-(-bits // dim)):
        rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0]
        for _ in range(rounds if len(sample) > dim else 0):
            u, _, v = np.linalg.svd(np.sign(sample @ rotation).T @ sample)
            rotation = (u @ v).T
        out.append(rotation)
    return np.concatenate(out, axis=1)[:, :bits]


def _keys(packed: pd.Series, directions: np.ndarray, tables: int, bits: int, dim: int) -> np.ndarray:
    """(rows, tables) substrings of the codes."""
    signs = (unpack(packed, dim) @ directions > 0).reshape(len(packed), tables, bits)
    return (signs * (1 << np.arange(bits))).sum(axis=2).astype(np.int32)


def _sizes(directions: np.ndarray, tables: int, bits: int, dim: int):
    """mapInPandas function: (bucket, own), the rows of each bucket in a batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                bucket, own = np.unique(_keys(pdf["packed"], directions, tables, bits, dim) + (np.arange(tables, dtype=np.int32) << bits), return_counts=True)
                yield pd.DataFrame({"bucket": bucket, "own": own})

    return run


def _substrings(directions: np.ndarray, tables: int, bits: int, dim: int):
    """mapInPandas function: one row per vector and substring, with the substrings of the earlier tables."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            keys = _keys(pdf["packed"], directions, tables, bits, dim)
            code = [r.tobytes() for r in keys.astype(_code_type(bits))]
            width = _code_type(bits)().itemsize
            for t in range(tables):
                yield pd.DataFrame({"bucket": keys[:, t] + (t << bits), "n": pdf["n"], "packed": pdf["packed"], "code": [c[: t * width] for c in code]})

    return run


def _code_type(bits: int) -> type:
    return np.uint16 if bits <= 16 else np.uint32


def _top(cos: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k greatest of each row that are ``least`` or more."""
    n, width = cos.shape
    floor = np.full(n, np.float32(least))
    even = width // GROUPS * GROUPS if width >= 4 * GROUPS and k <= GROUPS else 0
    if even:
        # the k-th greatest of the maxima of groups is no greater than the k-th greatest of all, so only
        # groups whose maximum reaches it hold one of the k greatest
        grouped = cos[:, :even].reshape(n, -1, GROUPS)
        maxima = grouped.max(axis=1)
        floor = np.maximum(floor, np.partition(maxima, -k, axis=1)[:, -k])
        at, group = np.nonzero(maxima >= floor[:, None])
        i, j = np.nonzero(grouped[at, :, group] >= floor[at][:, None])
        row, col = at[i], j * GROUPS + group[i]
    tail_row, tail_col = np.nonzero(cos[:, even:] >= floor[:, None])
    row, col = (np.concatenate((row, tail_row)), np.concatenate((col, tail_col + even))) if even else (tail_row, tail_col)
    order = np.lexsort((col, -cos[row, col], row))
    row, col = row[order], col[order]
    start = np.searchsorted(row, np.arange(n))
    keep = np.arange(len(row)) - start[row] < k
    return row[keep], col[keep]


def _best(left: np.ndarray, right: np.ndarray, n: np.ndarray, x: np.ndarray, code: np.ndarray, k: int, least: float) -> Iterator[pd.DataFrame]:
    """The k best in ``right`` of each row in ``left``, if no earlier table has the pair."""
    y = np.ascontiguousarray(x[right].T)
    for lo in range(0, len(left), STRIP):
        own = left[lo : lo + STRIP]
        cos = x[own] @ y
        if left is right:
            cos[np.arange(len(own)), np.arange(lo, lo + len(own))] = -2.0
        row, col = _top(cos, k, max(least, -1.5))
        a, b = own[row], right[col]
        first = ~(code[a] == code[b]).any(axis=1)
        yield pd.DataFrame({"a": n[a[first]], "b": n[b[first]], "cos": cos[row[first], col[first]]})


def _buckets(bits: int, dim: int, k: int, least: float):
    """mapInPandas function over rows sorted by bucket and salt: each group's best pairs.

    A group is a whole bucket, one part of a bucket, or two parts of which only rows of different
    parts meet; ``side`` tells the parts apart.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []

        def done(part: pd.DataFrame) -> Iterator[pd.DataFrame]:
            n, x, side = part["n"].to_numpy(), unpack(part["packed"], dim), part["side"].to_numpy()
            code = np.frombuffer(b"".join(part["code"]), _code_type(bits)).reshape(len(part), int(part["bucket"].iloc[0]) >> bits)
            sides = [np.flatnonzero(side == i) for i in (0, 1)]
            if len(sides[1]):
                yield from _best(sides[0], sides[1], n, x, code, k, least)
                yield from _best(sides[1], sides[0], n, x, code, k, least)
            elif len(part) > 1 and part["meets"].iloc[0]:
                yield from _best(sides[0], sides[0], n, x, code, k, least)

        for pdf in batches:
            bucket, salt = pdf["bucket"].to_numpy(), pdf["salt"].to_numpy()
            edges = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1]), True])
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if rest and (rest[0]["bucket"].iloc[0] != bucket[i] or rest[0]["salt"].iloc[0] != salt[i]):
                    yield from done(pd.concat(rest, ignore_index=True))
                    rest = []
                rest.append(pdf.iloc[i:j])
        if rest:
            yield from done(pd.concat(rest, ignore_index=True))

    return run


def _without_copies(valid: DataFrame, k: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows to be searched, k + 1 at most of each vector, and the pairs (a, b, cos) of the further copies.

    No row needs more than k copies of any vector, and a further copy has its k best in the first k.
    """
    same = F.xxhash64("packed")
    copies = materialise(valid.groupBy(same.alias("same")).agg(F.count("*").alias("copies")).where(F.col("copies") > k + 1).select("same"), "copies")
    if copies.isEmpty():
        return valid, None
    small = F.broadcast(copies) if copies.count() <= HOT_ROWS else copies
    copied = valid.withColumn("same", same).join(small, "same")
    first = copied.withColumn("copy", F.row_number().over(Window.partitionBy("packed").orderBy("n"))).where(F.col("copy") <= k + 1).select("n", "same", "packed", "copy")
    first = materialise(first, "first")
    further = copied.select("n", "same", "packed").join(first.select("n"), "n", "left_anti")
    once = valid.withColumn("same", same).join(small, "same", "left_anti").select("n", "packed")
    firsts = first.where(F.col("copy") <= k).select("same", F.col("packed").alias("p"), F.col("n").alias("b"))
    firsts = F.broadcast(firsts) if firsts.count() <= HOT_ROWS else firsts
    pairs = further.join(firsts, "same").where(F.col("packed") == F.col("p")).select(F.col("n").alias("a"), "b", F.lit(1.0).cast("float").alias("cos"))
    return once.unionByName(first.select("n", "packed")), pairs


def similar_vectors(vectors: DataFrame, dim: int = 64, k: int = 5, least: float = -1.0, tables: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar others of every valid vector, at cosine ``least`` or more.

    ``vectors`` has id, at and dense; see latest_valid for which rows count. Ties are ranked by id.
    With fewer than two valid vectors the result is empty. ``tables`` follows from the number of
    vectors where it isn't given.
    """
    valid = latest_valid(vectors, dim).withColumn("n", F.monotonically_increasing_id())
    valid = materialise(valid, "vectors")
    total = valid.count()
    bits = int(np.clip(np.rint(np.log2(max(total, 1) / bucket)), 1, 24))
    tables = tables or max(TABLES, int(np.ceil(TABLES_A_BIT * bits)))
    # about SAMPLE rows by hash, the same on every run, without a sort that sends each partition's best
    chosen = valid.where(F.pmod(F.xxhash64("id"), F.lit(max(total, 1))) < SAMPLE).select("packed").limit(2 * SAMPLE).toPandas().sort_values("packed")
    directions = fit_rotations(unpack(chosen["packed"], dim) if len(chosen) else np.empty((0, dim), np.float32), tables * bits)
    searched, further = _without_copies(valid.select("n", "packed"), k)
    rows = searched.mapInPandas(_substrings(directions, tables, bits, dim), "bucket int, n long, packed binary, code binary")
    salt, side, meets = F.lit(0), F.lit(0), F.lit(True)
    if total > 4 * BLOCK:
        # a large bucket is divided into parts, and each two parts meet in a group of their own
        sizes = searched.select("packed").mapInPandas(_sizes(directions, tables, bits, dim), "bucket int, own long").groupBy("bucket").agg(F.sum("own").alias("all"))
        hot = materialise(sizes.where(F.col("all") > 4 * BLOCK).select("bucket", F.ceil(F.col("all") / BLOCK).cast("int").alias("parts")), "hot")
        if not hot.isEmpty():
            # as many rows as buckets that hold 4 BLOCK rows or more
            rows = rows.join(F.broadcast(hot), "bucket", "left").withColumn("part", F.pmod(F.xxhash64("n"), F.col("parts")).cast("int"))
            rows = rows.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
            salt = F.when(F.col("parts").isNull(), 0).otherwise(F.least("part", "other") * F.col("parts") + F.greatest("part", "other"))
            side = F.when(F.col("part") > F.col("other"), 1).otherwise(0)
            meets = F.col("parts").isNull() | (F.col("part") == F.col("other"))
    spread = rows.select("bucket", "n", "packed", "code", salt.cast("int").alias("salt"), side.cast("int").alias("side"), meets.alias("meets"))
    spread = spread.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "n")
    pairs = spread.mapInPandas(_buckets(bits, dim, k, least), "a long, b long, cos float")
    pairs = pairs if further is None else pairs.unionByName(further)
    best = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = valid.select("n", "id")
    out = ranked.join(names.select(F.col("n").alias("a"), "id"), "a").join(names.select(F.col("n").alias("b"), F.col("id").alias("neighbour")), "b")
    return out.select("id", "neighbour", F.col("cos").cast("double").alias("cosine"), "rank")


def pairs_of(neighbours: DataFrame) -> DataFrame:
    """(id_a, id_b) of neighbours, id_a < id_b, each pair once."""
    return neighbours.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
