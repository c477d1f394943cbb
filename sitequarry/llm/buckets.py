"""Linking what shares a bucket, without all pairs of a bucket.

First each member of a bucket is checked with its neighbour in order; then, where a bucket holds several components still, all pairs of different
components are compared by their sketches where they lie, and what the sketches allow is checked. So a bucket of many members that are near each other costs about
as many checks as it has members, and what is only similar makes no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import whole_keys
from .common import materialised
from .components import components


def candidates(filed: DataFrame, least: float) -> DataFrame:
    """a < b: neighbours by size in a bucket (rows of key, print, size, root) with different roots whose sizes allow for a similarity of `least`."""

    def met(batches):
        for key, mark, size, root in whole_keys(batches):
            near = (key[:-1] == key[1:]) & (size[:-1] >= least * size[1:] - 1e-9) & (root[:-1] != root[1:])  # by size: the second is the larger
            a, b = mark[:-1][near], mark[1:][near]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    dealt = filed.select("key", "print", "size", "root").repartition("key").sortWithinPartitions("key", "size", "print")
    return dealt.mapInArrow(met, "a long, b long").distinct()


def plausible(filed: DataFrame, sketches: DataFrame, least: float, accept: Callable[[np.ndarray, np.ndarray], np.ndarray], exact: bool = False, block: int = 8192) -> DataFrame:
    """a < b: of all pairs of a bucket with different roots whose sizes allow for a similarity of `least`, those that accept() takes by their sketches (print, sketch: bytes of one length; accept is given two
    arrays of rows). Sketches only meet the rows of buckets that hold several components. Where accept() is exact, a task gives its pairs as a spanning forest: what a pair
    connects needs no more of them."""

    def several(batches):
        for key, mark, size, root in whole_keys(batches):
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            mixed = np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first)
            keep = np.repeat(mixed, np.diff(np.append(first, len(key))))
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (key, mark, size, root)], names=["key", "print", "size", "root"])

    def met(batches):
        for key, mark, size, root, sketch in whole_keys(batches):
            sketch = np.frombuffer(b"".join(sketch), np.uint8).reshape(len(key), -1)
            at, d, up = np.arange(len(key)), 0, {}
            while len(at):
                d += 1
                at = at[at + d < len(key)]
                at = at[(key[at] == key[at + d]) & (size[at] >= least * size[at + d] - 1e-9)]
                some = at[root[at] != root[at + d]]
                for part in np.split(some, range(block, len(some), block)) if len(some) else []:
                    near = part[accept(sketch[part], sketch[part + d])]
                    if exact and len(near):
                        near = near[_joining(root[near].tolist(), root[near + d].tolist(), up)]
                        different, of = np.unique(root, return_inverse=True)
                        root = np.array([_root(up, r) for r in different.tolist()], np.int64)[of]
                    if len(near):
                        a, b = mark[near], mark[near + d]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    columns = "key long, print long, size long, root long"
    busy = filed.select("key", "print", "size", "root").repartition("key").sortWithinPartitions("key").mapInArrow(several, columns)
    dealt = busy.join(sketches, "print").select("key", "print", "size", "root", "sketch").repartition("key").sortWithinPartitions("key", "size", "print")
    return dealt.mapInArrow(met, "a long, b long").distinct()


def _root(up: dict[int, int], x: int) -> int:
    while (y := up.get(x, x)) != x:
        up[x] = x = up.get(y, y)
    return x


def _joining(left: list[int], right: list[int], up: dict[int, int]) -> np.ndarray:
    """Which pairs of roots join what wasn't joined yet; up learns of them."""
    out = []
    for x, y in zip(left, right):
        x, y = _root(up, x), _root(up, y)
        out.append(x != y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return np.array(out, bool)


def shared_keys(keyed: DataFrame) -> DataFrame:
    """The rows (key, print) whose key another has too."""

    def run(batches):
        for key, mark in whole_keys(batches):
            same = key[1:] == key[:-1]
            shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            yield pa.RecordBatch.from_arrays([pa.array(key[shared]), pa.array(mark[shared])], names=["key", "print"])

    return materialised(keyed.repartition("key").sortWithinPartitions("key", "print").mapInArrow(run, "key long, print long"))


def connected(keyed: DataFrame, sketches: DataFrame, accept: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """print, root: the nodes of sketches (print, sketch) with the smallest node reachable over pairs that share a key (rows of key, print) and that accept() takes."""

    def taken(pairs: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                rows = [np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.uint8) for i in (2, 3)]
                yield batch.select(["a", "b"]).filter(pa.array(accept(*rows), pa.bool_()))

        side = lambda n: sketches.select(F.col("print").alias(n), F.col("sketch").alias(f"sketch_{n}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long")

    nodes = sketches.select("print")
    rooted = lambda links: materialised(nodes.join(components(links).withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print")))
    one = F.lit(1).cast("long").alias("size")
    linked = materialised(taken(candidates(keyed.select("key", "print", one, F.col("print").alias("root")), 0.0)))
    found = rooted(linked)
    more = materialised(plausible(keyed.join(found, "print").select("key", "print", one, "root"), sketches, 0.0, accept, exact=True))
    return found if more.isEmpty() else rooted(linked.unionAll(more))
