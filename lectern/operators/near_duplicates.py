"""Near-duplicate records with small edits.

Method: vantage-point partitions of fingerprints. The fingerprint of a record holds bits of its MinHash
values, so the Hamming distance of two fingerprints falls with the Jaccard similarity of their sets
of word runs. A vantage point divides the records around it into rings by distance; by the triangle
bound two similar records lie in the same ring or in neighbouring ones, so only these are compared.
A large shard is divided into such rings, and large rings into parts of which each two meet in a task
of their own; within a task further vantage points bound the comparisons.

One tree over all records cannot prune: unrelated fingerprints are all about half their bits apart
from every vantage point (256 of 512, give or take 11), closer together than the search radius. The
roots of the partitions are therefore buckets of MinHash bands; a pair at the threshold misses all
bands once in 6,000 times. Exact copies are one class with one representative throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import words as W
from lectern.tables import materialise, spread

#: MinHash values of a record, and how they form bands.
BANDS, ROWS = 32, 4
#: Fingerprint bits taken from each value, and 64-bit words of a fingerprint.
BITS = 4
WORDS = BANDS * ROWS * BITS // 64
#: Members of a shard or ring above which it is divided, so that a task compares twice as many at most.
PART = 4_096
#: Vantage points whose distances bound the comparisons of a task, cells below this size apart.
VANTAGES, SMALL = 2, 32
#: Pairs that a task holds before it hands them on.
FLUSH = 500_000
#: Hot shards and rings up to this number (about 10 MB) are broadcast to their rows.
BROADCAST_SHARDS = 100_000
#: Candidate records up to this number (about 30 MB) are broadcast when their texts are read again.
BROADCAST_ROWS = 1_000_000

_MULT = W.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def radius(threshold: float) -> int:
    """Hamming distance that a pair at the threshold exceeds once in thirty thousand times (four deviations)."""
    n = BANDS * ROWS
    differ = n * (1 - threshold)
    return round(differ * BITS / 2 + 4 * np.sqrt(n * threshold * (1 - threshold) * (BITS / 2) ** 2 + differ * BITS / 4))


def _sets(texts: pd.Series, run: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text of each shingle, shingle) of the distinct shingles, sorted, pass by pass."""
    for first, sizes, hashed in W.passes(texts):
        starts, text = W.runs(sizes, run)
        shingles = W.shingle_hashes(hashed, run)[starts]
        order = np.lexsort((shingles, text))
        text, shingles = text[order], shingles[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (shingles[1:] != shingles[:-1])
        yield first, text[new], shingles[new]


def _signed(run: int):
    """mapInPandas function: set hashes, band keys and fingerprints of the texts that have a run."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, text, shingles in _sets(pdf["text"], run):
                if not len(text):
                    continue
                bounds = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
                at = first + text[bounds]
                low = np.stack([np.minimum.reduceat(shingles * m, bounds) for m in _MULT], axis=1)
                keys = np.zeros((len(at), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = W.mix(keys + low[:, r::ROWS])
                nibble = (W.mix(low) >> np.uint64(64 - BITS)).reshape(len(at), WORDS, -1)
                shift = (np.arange(nibble.shape[2], dtype=np.uint64) * np.uint64(BITS))[None, None, :]
                print_ = np.bitwise_or.reduce(nibble << shift, axis=2)
                yield pd.DataFrame({
                    "kind": pdf["kind"].to_numpy()[at], "id": pdf["id"].to_numpy()[at],
                    "set_a": np.add.reduceat(W.mix(shingles), bounds).view(np.int64), "set_b": np.add.reduceat(W.mix(shingles ^ _MULT[0]), bounds).view(np.int64),
                    "bands": list(keys.view(np.int64)), "print": list(print_.view(np.int64)),
                })

    return sign


def _shingle_sets(run: int):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for first, text, shingles in _sets(pdf["text"], run):
                bounds = np.flatnonzero(np.r_[True, text[1:] != text[:-1]]) if len(text) else []
                if len(bounds):
                    at = first + text[bounds]
                    yield pd.DataFrame({"kind": pdf["kind"].to_numpy()[at], "id": pdf["id"].to_numpy()[at], "shingles": np.split(shingles.view(np.int64), bounds[1:])})

    return read


def _distance(a: Column, b: Column) -> Column:
    """Hamming distance of two fingerprints."""
    total = F.lit(0)
    for i in range(WORDS):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints (…, WORDS)."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int16)


def _within(prints: np.ndarray, left: np.ndarray, right: np.ndarray, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (a, b) of close fingerprints, a of ``left`` and b of ``right``, or both of the same where these are one.

    Rows are sorted by their distance from a vantage point; a row meets only those that the triangle
    bound leaves, and of these only the ones that the other vantage points leave.
    """
    same = left is right
    points = prints[left[np.linspace(0, len(left) - 1, VANTAGES).astype(int)]]
    away = lambda at: np.stack([_far(prints[at], p) for p in points], axis=1)
    dl, dr = away(left), away(right)
    ol, or_ = np.argsort(dl[:, 0], kind="stable"), np.argsort(dr[:, 0], kind="stable")
    left, dl, right, dr = left[ol], dl[ol], right[or_], dr[or_]
    for lo in range(0, len(left), 64):
        own, d = left[lo : lo + 64], dl[lo : lo + 64]
        first, last = np.searchsorted(dr[:, 0], d[0, 0] - limit, "left"), np.searchsorted(dr[:, 0], d[-1, 0] + limit, "right")
        first = max(first, lo) if same else first
        near = (np.abs(d[:, None, :] - dr[None, first:last, :]) <= limit).all(axis=2)
        i, j = np.nonzero(near)
        if same:
            keep = j + first > i + lo
            i, j = i[keep], j[keep]
        for k in range(0, len(i), 1 << 20):
            a, b = own[i[k : k + (1 << 20)]], right[first + j[k : k + (1 << 20)]]
            close = _far(prints[a], prints[b]) <= limit
            yield a[close], b[close]


def _close(limit: int):
    """mapInPandas function over rows sorted by cell: pairs (kind, a, b) within the limit.

    All rows of a cell meet; where it has two sides, only rows of different sides do.
    """
    columns = [f"p{i}" for i in range(WORDS)]

    def pairs(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        prints = pdf[columns].to_numpy(np.int64).view(np.uint64)
        cell, side, ids, kind = pdf["cell"].to_numpy(), pdf["side"].to_numpy(), pdf["id"].to_numpy(), pdf["kind"].to_numpy()
        edges = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
        size = np.diff(edges)
        two = side[edges[:-1]] >= 2  # sides 2 and 3 belong to cells of two parts
        small = np.repeat((size <= SMALL) & ~two, size)
        found = []
        for step in range(1, min(SMALL, int(size.max()))):  # small cells all at once: each row meets the one ``step`` after it
            i = np.flatnonzero(small[:-step] & (cell[step:] == cell[:-step]))
            i = i[_far(prints[i], prints[i + step]) <= limit] if len(i) else i
            found.append((i, i + step))
        held = 0
        for c in np.flatnonzero((size > SMALL) | two):
            at = np.arange(edges[c], edges[c + 1])
            left = at[side[at] % 2 == 0]
            right = at[side[at] == 3] if two[c] else left
            for pair in _within(prints, left, right, limit) if len(left) and len(right) else ():
                found.append(pair)
                held += len(pair[0])
                if held > FLUSH:
                    yield frame(found, ids, kind)
                    found, held = [], 0
        if found:
            yield frame(found, ids, kind)

    def frame(found: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, kind: np.ndarray) -> pd.DataFrame:
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
        a, b = ids[i], ids[j]
        turned = a > b
        return pd.DataFrame({"kind": kind[i], "a": np.where(turned, b, a), "b": np.where(turned, a, b)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            cell = pdf["cell"].to_numpy()
            if rest and rest[0]["cell"].iloc[0] == cell[-1]:
                rest.append(pdf)
                continue
            start = int(np.flatnonzero(cell == cell[-1])[0])
            whole = pd.concat([*rest, pdf.iloc[:start]], ignore_index=True)
            if len(whole):
                yield from pairs(whole)
            rest = [pdf.iloc[start:]]
        if rest:
            yield from pairs(pd.concat(rest, ignore_index=True))

    return run


def _cells(shards: DataFrame, limit: int) -> DataFrame:
    """(kind, cell, side, id, print): the rows of each shard (kind, shard, n, id, print) by the cells they are compared in.

    A shard of up to PART rows is one cell. A larger one is divided into rings around its least id;
    rows meet within their ring and with the next one, in parts of PART rows of either.
    """
    small = shards.where(F.col("n") <= PART).select("kind", F.xxhash64("kind", "shard").alias("cell"), F.lit(0).alias("side"), "id", "print")
    hot = materialise(shards.where(F.col("n") > PART), "hot")
    if hot.isEmpty():
        return small
    key = ["kind", "shard"]
    hint = lambda d: F.broadcast(d) if d.count() <= BROADCAST_SHARDS else d
    vantage = hint(materialise(hot.groupBy(key).agg(F.min(F.struct("id", "print")).alias("v")), "vantages"))
    around = hot.join(vantage, key).withColumn("ring", (_distance(F.col("print"), F.col("v.print")) / (limit + 1)).cast("int")).select(*key, "ring", "id", "print")
    around = materialise(around, "around")
    parts = materialise(around.groupBy(*key, "ring").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")), "rings")
    beside = lambda by, name: parts.select(*key, (F.col("ring") + by).alias("ring"), F.col("parts").alias(name))
    rings = hint(parts.join(beside(-1, "after"), [*key, "ring"], "left").join(beside(1, "before"), [*key, "ring"], "left").fillna(0, ["after", "before"]))
    rows = around.join(rings, [*key, "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    # a cell is named after its two parts, the one of the lower ring or number first
    own = F.transform(upto(F.col("parts")), lambda o: F.struct(F.col("ring").alias("r"), F.least("part", o).alias("p"), F.col("ring").alias("s"), F.greatest("part", o).alias("q"), (F.col("part") > o).cast("int").alias("side")))
    up = F.transform(upto(F.col("after")), lambda o: F.struct(F.col("ring").alias("r"), F.col("part").alias("p"), (F.col("ring") + 1).alias("s"), o.alias("q"), F.lit(0).alias("side")))
    down = F.transform(upto(F.col("before")), lambda o: F.struct((F.col("ring") - 1).alias("r"), o.alias("p"), F.col("ring").alias("s"), F.col("part").alias("q"), F.lit(1).alias("side")))
    met = rows.withColumn("c", F.explode(F.concat(own, up, down)))
    # cells of two parts hold rows of both sides only; one without a partner gives nothing
    large = met.select("kind", F.xxhash64("kind", "shard", "c.r", "c.p", "c.s", "c.q").alias("cell"), (F.col("c.side") + F.when((F.col("c.r") == F.col("c.s")) & (F.col("c.p") == F.col("c.q")), 0).otherwise(2)).alias("side"), "id", "print")
    return small.unionByName(large)


def _close_pairs(shards: DataFrame, limit: int) -> DataFrame:
    """(kind, a, b) of all records that share a shard and are within the limit, each pair once."""
    flat = _cells(shards, limit).select("kind", "cell", "side", "id", *(F.get("print", F.lit(i)).alias(f"p{i}") for i in range(WORDS)))
    ordered = flat.repartition("cell").sortWithinPartitions("cell", "id")
    return ordered.mapInPandas(_close(limit), "kind string, a string, b string").distinct()


class NearDuplicates:
    """Classes of equal sets and the links between their representatives.

    members: (kind, id, class); links: (kind, class_a, class_b, similarity) with class_a < class_b,
    where a class is named after its least id.
    """

    def __init__(self, members: DataFrame, links: DataFrame) -> None:
        self.members, self.links = members, links

    def pairs(self) -> DataFrame:
        """All pairs of records (kind, id_a, id_b), copies written out."""
        m = self.members
        a, b = m.select("kind", F.col("id").alias("x"), F.col("class").alias("class_a")), m.select("kind", F.col("id").alias("y"), F.col("class").alias("class_b"))
        across = self.links.join(a, ["kind", "class_a"]).join(b, ["kind", "class_b"]).select("kind", "x", "y")
        within = a.join(b.withColumnRenamed("class_b", "class_a"), ["kind", "class_a"]).where("x < y").select("kind", "x", "y")
        return across.unionByName(within).select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))

    def groups(self) -> DataFrame:
        """One row per record: (kind, id, class, copies, links), links counted between classes."""
        links = materialise(self.links, "links")
        ends = links.select("kind", F.col("class_a").alias("class")).unionByName(links.select("kind", F.col("class_b").alias("class")))
        degree = ends.groupBy("kind", "class").agg(F.count("*").alias("links"))
        copies = self.members.groupBy("kind", "class").agg(F.count("*").alias("copies"))
        return self.members.join(copies, ["kind", "class"]).join(degree, ["kind", "class"], "left").select("kind", "id", "class", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicates(records: DataFrame, run: int = 5, threshold: float = 0.8) -> NearDuplicates:
    """Finds records whose sets of ``run`` consecutive words have at least ``threshold`` Jaccard similarity.

    ``records`` has kind, id and text; records are compared within a kind. Repeated ids count once,
    null texts and texts with fewer than ``run`` words have no set and no links.
    """
    records = records.select("kind", "id", "text").where(F.col("text").isNotNull() & F.col("id").isNotNull())
    limit = radius(threshold)
    signed = spread(records).mapInPandas(_signed(run), "kind string, id string, set_a long, set_b long, bands array<long>, print array<long>")
    signed = materialise(signed, "signed")
    classes = signed.groupBy("kind", "set_a", "set_b").agg(F.min("id").alias("class"))
    members = materialise(signed.select("kind", "id", "set_a", "set_b").distinct().join(classes, ["kind", "set_a", "set_b"]).select("kind", "id", "class"), "members")
    leaders = signed.join(members.where("id = class").select("kind", "id"), ["kind", "id"], "left_semi").dropDuplicates(["kind", "id"])
    leaders = materialise(leaders.select("kind", "id", "bands", "print"), "leaders")
    keyed = leaders.select("kind", "id", F.posexplode("bands").alias("band", "key")).select("kind", F.xxhash64("band", "key").alias("shard"), "id")
    shared = keyed.groupBy("kind", "shard").agg(F.count("*").alias("n")).where("n > 1")
    crowded = keyed.join(shared, ["kind", "shard"])
    shards = materialise(crowded.join(leaders.select("kind", "id", "print"), ["kind", "id"]), "prints")
    pairs = materialise(_close_pairs(shards, limit), "pairs")
    # exact similarity: the sets of candidates are made again from their texts
    ends = pairs.select("kind", F.col("a").alias("id")).unionByName(pairs.select("kind", F.col("b").alias("id"))).distinct()
    few = ends.count() <= BROADCAST_ROWS
    texts = records.join(F.broadcast(ends) if few else ends, ["kind", "id"], "left_semi")
    sets = materialise(texts.mapInPandas(_shingle_sets(run), "kind string, id string, shingles array<long>").dropDuplicates(["kind", "id"]), "sets")
    both = pairs.join(sets.select("kind", F.col("id").alias("a"), F.col("shingles").alias("sa")), ["kind", "a"]).join(sets.select("kind", F.col("id").alias("b"), F.col("shingles").alias("sb")), ["kind", "b"])
    common = F.size(F.array_intersect("sa", "sb"))
    similarity = common / (F.size("sa") + F.size("sb") - common)
    links = both.select("kind", F.col("a").alias("class_a"), F.col("b").alias("class_b"), similarity.alias("similarity")).where(F.col("similarity") >= threshold)
    return NearDuplicates(members, links)


def corpus_records(chunks: DataFrame, parsed: DataFrame) -> DataFrame:
    """Child chunks by text and parsed documents by markdown, as records."""
    a = chunks.where("kind = 'child'").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id"), "text")
    return a.unionByName(parsed.select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.col("markdown").alias("text")))
