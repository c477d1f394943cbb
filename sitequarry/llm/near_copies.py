"""One document of each group of near copies: texts whose sets of word shingles have a Jaccard similarity of `least` or more, and what such pairs connect.

Texts are compared by their SimHashes. First the 64-bit SimHash of each set of shingles goes through the pigeonring (`simhash.links`): what
differs in at most `ring` bits is linked. At similarity 0.8 about 10 bits of 64 differ and often 17, and at that distance a ring's segments have three or
four bits, so every pair would meet. So a wider SimHash, of 512 bits, tells the rest: it is compared where texts lie in one bucket (they agree in a band of minima of
their shingles' hashes, as 1 - (1 - 0.8^5)^24 = 0.9999 of pairs at 0.8 do), and at most as many bits may differ as do at `least`, and five standard deviations. Every link is checked by the
shingles themselves. Equal sets are one before they meet.

Only texts of different components meet, and no step makes a row for each pair: a task gives what SimHashes allow as a spanning forest, which says only
which components lie in one cluster; the texts of a cluster then meet with their shingles, and the links that hold are a spanning forest again. So a group of many texts
that are near each other, or only nearly so, makes about as many rows as it has texts; a cluster of more than `tile` texts is dealt as pairs of its parts.

Defined results: texts of fewer words than a shingle are one shingle; null and wordless texts are one group; of a group, the row
with the smallest id stays, nulls last, ties by a hash of the row: one row, also of repeated ids; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import whole_keys
from .buckets import plausible, shared_keys
from .common import materialised
from .components import components
from .simhash import links, shingle_hashes, simhash

WIDE = 8  # SimHashes of 64 bits in a wide one


class Minima:
    """Band keys of a set of hashes: each band hashes `rows` minima."""

    def __init__(self, bands: int, rows: int, seed: int):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.times = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.flip = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def keys(self, hashes: np.ndarray) -> list[int]:
        """None of the empty set, whose equals are one already."""
        if not len(hashes):
            return []
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 1024):
            np.minimum(least, ((hashes[at : at + 1024, None] ^ self.flip) * self.times).min(0), out=least)
        return [xxhash.xxh64_intdigest(x.tobytes(), i) - (1 << 63) for i, x in enumerate(least.reshape(self.bands, -1))]


def bins_of(hashes: np.ndarray, bins: int = 512) -> np.ndarray:
    """A sketch of a set of sorted hashes: of the least hash in each of `bins` equal ranges a byte, 0 where there is none."""
    place = (hashes >> np.uint64(64 - bins.bit_length() + 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    out = np.zeros(bins, np.uint8)
    out[place[first]] = hashes[first] % np.uint64(255) + np.uint64(1)
    return out


def may_reach(x: np.ndarray, y: np.ndarray, least: float, sigmas: float = 3.5) -> np.ndarray:
    """Whether sets with these sketches (rows) may have a similarity of `least`. The least hashes in the used bins are a sample, without replacement, of the united sets,
    whose number follows from how many bins are used; so the share of equal bins errs with a standard deviation of sqrt(least (1 - least) / used (1 - used / united)), which
    is next to nothing for short texts. What is more than `sigmas` of them beneath is out (one pair in 4,000 at the limit itself)."""
    bins = x.shape[1]
    used = np.maximum(1, ((x | y) != 0).sum(1))
    equal = ((x == y) & (x != 0)).sum(1)
    united = -bins * np.log1p(-np.minimum(used, bins - 0.5) / bins)
    error = np.sqrt(least * (1 - least) / used * np.maximum(0, 1 - used / united)) + 1 / used / sigmas  # one bin more, for its roundness
    return equal >= (least - sigmas * error) * used


def wide_simhash(hashes: np.ndarray) -> np.ndarray:
    """SimHashes of a set of hashes, one for each way of mixing them; the first is of the hashes as they are."""
    mixed = hashes[:, None] + np.arange(WIDE, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(times)
    mixed ^= mixed >> np.uint64(31)
    mixed[:, 0] = hashes
    counts = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(mixed), 255):  # so many fit a byte
        counts += np.unpackbits(mixed[at : at + 255].view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


def most_bits(size: np.ndarray, least: float, sigmas: float = 5.0) -> np.ndarray:
    """How many bits of wide SimHashes may differ where sets have a similarity of `least`, the larger of them having `size` members. A bit differs as often as the angle between sets is a part of a
    half-turn, and (counted for all sizes at 0.8) at most 0.2 / size more, since few votes are often close."""
    part = np.arccos(2 * least / (1 + least)) / np.pi + 0.2 / np.maximum(1, size)
    return 64 * WIDE * part + sigmas * np.sqrt(64 * WIDE * part * (1 - part))


def sketch_of(hashes: np.ndarray) -> bytes:
    """The wide SimHash of a set of sorted hashes, its size and its bins."""
    return wide_simhash(hashes).tobytes() + np.uint64(len(hashes)).tobytes() + bins_of(hashes).tobytes()


def may_link(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether sets with these sketches (rows of sketch_of) may have a similarity of `least`: by their SimHashes, and what these allow by the bins."""
    words = lambda a: np.ascontiguousarray(a[:, : 8 * WIDE + 8]).view(np.uint64)
    a, b = words(x), words(y)
    near = np.bitwise_count(a[:, :WIDE] ^ b[:, :WIDE]).sum(1) <= most_bits(np.maximum(a[:, WIDE], b[:, WIDE]).astype(float), least)
    at = np.flatnonzero(near)
    near[at] = may_reach(x[at, 8 * WIDE + 8 :], y[at, 8 * WIDE + 8 :], least, sigmas=5.0)
    return near


def cluster_links(mark: np.ndarray, root: np.ndarray, hashes: list[bytes], sketch: np.ndarray, least: float, part: np.ndarray | None = None) -> list[tuple[int, int]]:
    """The links between different roots of a cluster's sets that have a similarity of `least` or more, as a spanning forest. part: only sets of different parts are compared, if there are two."""
    sets = [np.frombuffer(x, np.uint64) for x in hashes]
    size = np.array([*map(len, sets)], np.int64)
    order = np.argsort(size, kind="stable")
    mark, root, size, sketch, sets = mark[order], root[order].copy(), size[order], sketch[order], [sets[i] for i in order]
    part = part[order] if part is not None and len(np.unique(part)) > 1 else None
    known = np.unique(np.concatenate(sets))
    placed = [np.searchsorted(known, x) for x in sets]
    mine, out = np.zeros(len(known), bool), []
    for i in range(len(sets) - 1):
        other = np.arange(i + 1, np.searchsorted(size * least - 1e-9, size[i], "right"))
        other = other[(root[other] != root[i]) & (size[other] > 0)]
        if part is not None:
            other = other[part[other] != part[i]]
        other = other[may_link(np.broadcast_to(sketch[i], (len(other), sketch.shape[1])), sketch[other], least)] if len(other) else other
        if not len(other):
            continue
        mine[placed[i]] = True
        both = np.add.reduceat(mine[np.concatenate([placed[j] for j in other])].astype(np.int64), np.cumsum(size[other]) - size[other])
        mine[placed[i]] = False
        for j in other[both >= least * (size[i] + size[other] - both) - 1e-9].tolist():
            if root[j] != root[i]:
                out.append((int(min(mark[i], mark[j])), int(max(mark[i], mark[j]))))
                root[root == root[j]] = root[i]
    return out


def _joined(clusters: DataFrame, sets: DataFrame, least: float, tile: int) -> DataFrame:
    """a < b: links of each cluster (rows of cluster, root, print), as a spanning forest of each tile of it."""

    def run(batches):
        for _, cluster, x, y, mark, root, part, hashes, sketch in whole_keys(batches):
            cuts = np.flatnonzero((cluster[1:] != cluster[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1
            for at in np.split(np.arange(len(cluster)), cuts):
                rows = np.frombuffer(b"".join(sketch[at]), np.uint8).reshape(len(at), -1)
                if found := cluster_links(mark[at], root[at], [*hashes[at]], rows, least, part[at]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    parts = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("print"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least(p, F.col("part")).alias("x"), F.greatest(p, F.col("part")).alias("y")))
    tiles = clusters.join(parts, "cluster").withColumn("part", own).select("cluster", "print", "root", "part", F.explode(others).alias("t"))
    dealt = tiles.join(sets, "print").select(F.xxhash64("cluster", "t").alias("tile"), "cluster", "t.x", "t.y", "print", "root", "part", "hashes", "sketch")
    return dealt.repartition("tile").sortWithinPartitions("tile", "cluster", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _checked(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs whose sets have a similarity of `least` or more."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda n: sets.select(F.col("print").alias(n), F.col("hashes").alias(f"set_{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, ring: int = 4, bands: int = 24, rows: int = 5, tile: int = 2048, seed: int = 42) -> DataFrame:
    """The rows of docs that stay, with their columns."""
    minima = Minima(bands, rows, seed)
    distinct = lambda text: np.unique(shingle_hashes(text, shingle, seed))
    # A row is known by two hashes of it; equal rows are one, by partial aggregates, before they meet what stays.
    marked = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(*docs.columns).alias("tie"), F.xxhash64(F.lit(1), *docs.columns).alias("tie2"))

    def sketch(batches):
        for batch in batches:
            found = [distinct(x) for x in batch.column(3).to_pylist()]
            marks = [xxhash.xxh64_intdigest(x.tobytes(), seed) - (1 << 63) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(marks, pa.int64()), pa.array(map(len, found), pa.int64()), pa.array(np.array([simhash(x) for x in found], np.uint64).view(np.int64)), pa.array([minima.keys(x) for x in found], pa.list_(pa.int64()))], names=["id", "tie", "tie2", "print", "size", "simhash", "keys"])

    texts = marked.select(F.col(f"doc.{id_col}").cast("long").alias("id"), "tie", "tie2", F.col(f"doc.{text_col}").cast("string").alias("text"))
    sketches = texts.mapInArrow(sketch, "id long, tie long, tie2 long, print long, size long, simhash long, keys array<long>")
    order = F.struct(F.col("id").isNull().alias("no_id"), "id", "tie", "tie2")
    prints = materialised(sketches.groupBy("print").agg(F.min(order).alias("least"), F.first("size").alias("size"), F.first("simhash").alias("simhash"), F.first("keys").alias("keys")))

    def sets_of(wanted: DataFrame) -> DataFrame:
        """print, hashes, sketch of texts."""

        def run(batches):
            for batch in batches:
                found = [distinct(x) for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([sketch_of(x) for x in found], pa.binary())], names=["print", "hashes", "sketch"])

        heads = prints.join(wanted, "print").select("print", "least.tie", "least.tie2")
        heads = texts.select("tie", "tie2", "text").join(heads, ["tie", "tie2"]).groupBy("print").agg(F.first("text").alias("text"))
        return heads.mapInArrow(run, "print long, hashes binary, sketch binary")

    shared = shared_keys(prints.select(F.explode("keys").alias("key"), "print"))
    heads = prints.groupBy("simhash").agg(F.min("print").alias("head"))  # sets of one SimHash meet one of them, which goes through the ring
    head = lambda n: heads.select(F.col("simhash").alias(n), F.col("head").alias(f"head_{n}"))
    ringed = links(heads.select(F.col("simhash").alias("print")), ring).distinct().join(head("a"), "a").join(head("b"), "b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))
    equal = prints.join(heads, "simhash").where("print <> head").select(F.col("head").alias("a"), F.col("print").alias("b"))
    near = materialised(ringed.unionAll(equal))
    met = shared.select("print").unionAll(near.select("a")).unionAll(near.select("b"))
    sets = materialised(sets_of(met.distinct()))
    linked = materialised(_checked(near, sets, least))
    rooted = lambda links: materialised(prints.join(components(links).withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print")))
    found = rooted(linked)
    filed = shared.join(found.select("print", "size", "root"), "print")
    allowed = materialised(plausible(filed, sets.select("print", "sketch"), least, lambda x, y: may_link(x, y, least), exact=True))
    if not allowed.isEmpty():
        root = lambda n: found.select(F.col("print").alias(n), F.col("root").alias(f"root_{n}"))
        over = components(allowed.join(root("a"), "a").join(root("b"), "b"), "root_a", "root_b").select(F.col("node").alias("root"), F.col("root").alias("cluster"))
        clusters = materialised(found.select("print", "root").join(over, "root").join(shared.select("print").distinct(), "print", "left_semi"))
        found = rooted(linked.unionAll(_joined(clusters, sets, least, tile)))
    kept = found.groupBy("root").agg(F.min("least").alias("least")).select("least.tie", "least.tie2")
    return marked.dropDuplicates(["tie", "tie2"]).join(kept, ["tie", "tie2"]).select("doc.*")
