"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has as many segments, in a ring, as there may be differing bits, plus one. If two fingerprints differ in at most t
bits, then from some segment on every chain of l consecutive segments differs in at most l * t / (t + 1) bits: none in
the first, one at most in the first two, and so on. The first two links of the chain make the join key: a fingerprint
is filed under each segment with its successor, and looked up there with every single bit of the successor flipped. What
meets goes through the longer chains before the full Hamming distance. Work is on different fingerprints, so copies cost nothing. Beforehand, fingerprints
that are filed under one key are compared with the next in order; what these links connect needs no more of them, so only pairs of different components
meet, and a group of very many near copies costs about as much as it has rows. A task gives the links of its buckets as a spanning forest, never as all pairs of a group.

Defined results: null and wordless texts have fingerprint zero, linked like any other; texts with fewer words than a
shingle are one shingle; repeated rows keep a row each; rows with a null id get the component of their fingerprint;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import whole_keys
from .common import materialised
from .components import components


def shingle_hashes(text: str | None, words: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text, repeats included. bytes.split() cuts at just the six ASCII blanks."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([hashed(joined, seed)], np.uint64)
    ends = np.cumsum([*map(len, parts)]) + np.arange(len(parts))
    starts = np.concatenate([[0], ends[:-words] + 1])
    return np.array([hashed(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.ascontiguousarray(hashes[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, print: the fingerprint's 64 bits as a signed long."""

    def run(batches):
        for batch in batches:
            prints = np.array([simhash(shingle_hashes(x, shingle, seed)) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64), pa.int64())], names=["doc_id", "print"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, print long")


class Ring:
    """The segments of a fingerprint, and what chains of them may differ in."""

    def __init__(self, distance: int, bits: int = 64):
        self.distance, self.n = distance, distance + 1
        cuts = [bits * i // self.n for i in range(self.n + 1)]
        self.low, self.width = cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:])]
        mask = [((1 << w) - 1) << s for w, s in zip(self.width, self.low)]
        # chains[i][l - 1]: the bits of l segments from segment i on
        self.chains = np.array([[sum(mask[(i + j) % self.n] for j in range(n)) for n in range(1, self.n + 1)] for i in range(self.n)], np.uint64)
        self.budget = [n * distance // self.n for n in range(1, self.n + 1)]

    def segment(self, prints: np.ndarray, i: int) -> np.ndarray:
        i %= self.n
        return (prints >> np.uint64(self.low[i])) & np.uint64((1 << self.width[i]) - 1)

    def keys(self, prints: np.ndarray, i: int, flip: int = 0) -> np.ndarray:
        """Segment i and its successor, of which the bits in flip are changed; the start of the chain is in the top bits."""
        return (np.uint64(i) << np.uint64(58)) | (self.segment(prints, i) << np.uint64(29)) | (self.segment(prints, i + 1) ^ np.uint64(flip))

    def near(self, x: np.ndarray, y: np.ndarray, start: int) -> np.ndarray:
        """Which pairs keep every chain's budget from segment start on; the last chain is the whole ring."""
        keep, differing = np.arange(len(x)), x ^ y
        for mask, most in zip(self.chains[start], self.budget):
            inside = np.bitwise_count(differing & mask) <= most
            keep, differing = keep[inside], differing[inside]
        return keep


def links(prints: DataFrame, distance: int = 4, block: int = 1 << 20) -> DataFrame:
    """a, b: links between different fingerprints (column print) that connect all that differ in at most `distance` bits."""
    ring = Ring(distance)
    as_links = lambda a, b: pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], names=["a", "b"])

    def filed(batches, looked_up: bool):
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for i in range(ring.n):
                for flip in [0, *(1 << b for b in range(ring.width[(i + 1) % ring.n]))] if looked_up else [0]:
                    yield pa.RecordBatch.from_arrays([pa.array(ring.keys(x, i, flip).view(np.int64)), *batch.columns, pa.array(np.full(len(x), flip != 0))], names=["key", *batch.schema.names, "lookup"])

    def adjacent(batches):
        for keys, prints, _ in whole_keys(batches):
            near = (keys[1:] == keys[:-1]) & (np.bitwise_count(prints[1:].view(np.uint64) ^ prints[:-1].view(np.uint64)) <= distance)
            yield as_links(prints[:-1][near], prints[1:][near])

    def met(batches):
        for keys, prints, roots, lookup in whole_keys(batches):
            if found := _linked(ring, keys, prints.view(np.uint64), roots, lookup.astype(bool), block):
                yield as_links(*zip(*found))

    exact = prints.select("print").mapInArrow(lambda x: filed(x, False), "key long, print long, lookup boolean")
    near = materialised(exact.repartition("key").sortWithinPartitions("key", "print").mapInArrow(adjacent, "a long, b long").distinct())
    rooted = prints.select("print").join(components(near).withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("root", "print").alias("root"))
    dealt = rooted.mapInArrow(lambda x: filed(x, True), "key long, print long, root long, lookup boolean")
    return near.unionAll(dealt.repartition("key").sortWithinPartitions("key", "lookup").mapInArrow(met, "a long, b long"))


def _linked(ring: Ring, keys: np.ndarray, prints: np.ndarray, roots: np.ndarray, lookup: np.ndarray, block: int) -> list[tuple[int, int]]:
    """The links between different roots in whole buckets (sorted by key, filed before looked up), as a spanning forest."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([first, [len(keys)]]))
    filed = np.add.reduceat((~lookup).astype(np.int64), first)
    busy = np.flatnonzero((filed > 0) & (np.minimum.reduceat(roots, first) != np.maximum.reduceat(roots, first)))
    root: dict[int, int] = {}
    out: list[tuple[int, int]] = []

    def find(x: int) -> int:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    def join(left: np.ndarray, right: np.ndarray) -> None:
        keep = roots[left] != roots[right]
        left, right = left[keep], right[keep]
        chain = (keys[left].view(np.uint64) >> np.uint64(58)).astype(np.int64)
        for i in range(ring.n):
            here = np.flatnonzero(chain == i)
            near = here[ring.near(prints[left[here]], prints[right[here]], i)]
            for n, m in zip(left[near].tolist(), right[near].tolist()):
                x, y = find(int(roots[n])), find(int(roots[m]))
                if x != y:
                    root[max(x, y)] = min(x, y)
                    out.append((int(prints[n : n + 1].view(np.int64)[0]), int(prints[m : m + 1].view(np.int64)[0])))

    pairs = filed[busy] * size[busy]
    small = busy[pairs <= block]
    ends = np.cumsum(filed[small] * size[small])
    for some in np.split(small, np.flatnonzero(np.diff(ends // block)) + 1):  # many small buckets at once
        per = filed[some] * size[some]
        bucket = np.repeat(np.arange(len(some)), per)
        place = np.arange(len(bucket)) - np.repeat(np.cumsum(per) - per, per)
        left, right = first[some][bucket] + place // size[some][bucket], first[some][bucket] + place % size[some][bucket]
        join(left[left < right], right[left < right])
    for b in busy[pairs > block].tolist():  # a large one root by root, with what is of another
        rows, own = np.arange(first[b], first[b] + size[b]), np.arange(first[b], first[b] + filed[b])
        for r in np.unique(roots[own]).tolist():
            mine, other = own[roots[own] == r], rows[roots[rows] != r]
            for a in range(0, len(mine), max(1, block // max(1, len(other)))):
                part = mine[a : a + max(1, block // max(1, len(other)))]
                join(np.repeat(part, len(other)), np.tile(other, len(part)))
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, distance: int = 4) -> DataFrame:
    """doc_id, fingerprint (hexadecimal), component_id (the smallest doc_id reachable over links) of every row."""
    marked = materialised(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed))
    prints = materialised(marked.groupBy("print").agg(F.min("doc_id").alias("least")))
    found = components(links(prints, distance))
    rooted = prints.join(found.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(heads, "root").select("print", "component_id")
    return marked.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
