"""Ranked lexical search by norm buckets, after LEMP.

The weight of a term times its damped frequency in a document is the document's impact on that term's coordinate, an integer; an item's vector has how often it
holds each term, and the score is their inner product. Of the documents only coordinates that some item has are kept. Impact vectors are range-partitioned and sorted by length (their norm), longest
first, and searched in buckets of neighbours:

* Cauchy-Schwarz: an item skips a bucket if its norm times that of the longest vector in it is below the item's threshold;
* coordinates: the highest impact of the bucket on each coordinate bounds what the item can reach there. The coordinates whose bounds together stay below the threshold
  can't make a result alone; only documents on the lists of the others are candidates, and their partial score, with the rest bounded by coordinates and by Cauchy-Schwarz, must reach
  the threshold;
* what survives is scored exactly, in integers.

Thresholds are the k-th score among the bucket of the longest vectors, found beforehand; a task raises its own as it goes. The smallest norm that could still reach
any item's threshold is a filter on the scan, so Parquet skips what is shorter. Each task keeps k results an item; these are merged by rank.

Items are taken in blocks of about block_bytes of their texts, so that the vocabulary and the thresholds that tasks hold are bounded; each block is a pass over all documents.

Defined results: null texts have no terms; items without terms, or whose terms no document has, have no rows; each row of either table is a row of its own, so rows of one id are ranked each, and an id can
stand twice in a ranking; equal scores go by ascending doc_id, null ids last; an empty table on either side gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, materialised

#: Between terms: ASCII characters other than letters and digits.
BETWEEN = {c: " " for c in range(128) if not chr(c).isalnum()} | str.maketrans(UPPER, LOWER)
FOUND = "item long, item_id long, doc_id long, row long, score long"
NO_ID = 2**63 - 1  # where a null id stands among equal scores


def terms_of(text: str | None) -> list[str]:
    """Terms of a text, with repeats."""
    return [t for t in (text or "").translate(BETWEEN).split(" ") if t]


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def length_factor(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """By how much each document's length damps its frequencies."""
    if int(n.max(initial=0)) * 75 * documents < 2**63:
        return 25 + 75 * n * documents // terms
    return np.array([25 + 75 * int(x) * documents // terms for x in n], np.int64)


@dataclass
class Items:
    """The items of a block in compressed rows: those of item i are starts[i] to starts[i + 1]."""

    ids: list
    starts: np.ndarray
    terms: np.ndarray
    counts: np.ndarray

    @property
    def norms(self) -> np.ndarray:
        return np.sqrt(np.add.reduceat(self.counts.astype(float) ** 2, self.starts[:-1]))


def items_of(rows) -> tuple[Items, dict[str, int]]:
    """Items (item_id, text) that have terms, and the number of each term."""
    vocabulary: dict[str, int] = {}
    ids, starts, terms, counts = [], [0], [], []
    for item_id, text in rows:
        own, n = np.unique([vocabulary.setdefault(t, len(vocabulary)) for t in terms_of(text)], return_counts=True)
        if len(own):
            ids.append(item_id)
            terms.append(own.astype(np.int64))
            counts.append(n)
            starts.append(starts[-1] + len(own))
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return Items(ids, np.array(starts), join(terms), join(counts)), vocabulary


@dataclass
class Bucket:
    """Impact vectors in compressed rows, with their norms."""

    keys: np.ndarray
    rows: np.ndarray
    norms: np.ndarray
    starts: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray


class Search:
    """The k best of each item so far, bucket by bucket. floors: scores that the k best of each item reach, as far as known."""

    def __init__(self, items: Items, vocabulary: int, k: int, floors: np.ndarray, prune: bool = True):
        self.items, self.vocabulary, self.k, self.prune = items, vocabulary, k, prune
        self.floors, self.norms = np.maximum(floors, 1), items.norms
        self.best: dict[int, np.ndarray] = {}  # item: score, key, row of its best, best first
        self.looked = self.scored = 0  # buckets that items looked into, documents scored whole

    def add(self, b: Bucket) -> None:
        if not len(b.terms):
            return
        floors = self.floors if self.prune else np.ones(len(self.floors), np.int64)
        alive = self.norms * b.norms.max() * (1 + 1e-9) >= floors
        if not alive.any():
            return
        order = np.argsort(b.terms, kind="stable")
        docs = np.repeat(np.arange(len(b.keys)), np.diff(b.starts))[order]
        impacts = b.impacts[order]
        ends = np.searchsorted(b.terms[order], np.arange(self.vocabulary + 1))
        have = np.flatnonzero(np.diff(ends))
        highest = np.zeros(self.vocabulary, np.int64)
        highest[have] = np.maximum.reduceat(impacts, ends[have])
        most = self.items.counts * highest[self.items.terms]
        alive &= np.add.reduceat(most, self.items.starts[:-1]) >= floors
        for i in np.flatnonzero(alive).tolist():
            s = slice(self.items.starts[i], self.items.starts[i + 1])
            self._one(i, b, self.items.terms[s], self.items.counts[s], most[s], docs, impacts, ends)

    def _one(self, i, b, terms, counts, most, docs, impacts, ends) -> None:
        floor = int(self.floors[i]) if self.prune else 1
        by_bound = np.argsort(most, kind="stable")
        terms, counts, most = terms[by_bound], counts[by_bound], most[by_bound]
        rest = int(np.searchsorted(np.cumsum(most), floor))  # so many coordinates stay below the floor together
        self.looked += 1
        partial = np.zeros(len(b.keys), np.int64)

        def add(places):
            for t, n in zip(terms[places].tolist(), counts[places].tolist()):
                at = slice(ends[t], ends[t + 1])
                partial[docs[at]] += n * impacts[at]

        add(slice(rest, None))
        bound = np.minimum(float(most[:rest].sum()), math.sqrt(float((counts[:rest].astype(float) ** 2).sum())) * b.norms * (1 + 1e-9))
        alive = np.flatnonzero((partial > 0) & (partial + bound * (1 + 1e-9) >= floor))
        if not len(alive):
            return
        self.scored += len(alive)
        add(slice(0, rest))
        found = np.stack([partial[alive], b.keys[alive], b.rows[alive]])
        found = found[:, found[0] >= floor]
        if i in self.best:
            found = np.concatenate([self.best[i], found], axis=1)
        self.best[i] = found = found[:, np.lexsort((found[2], found[1], -found[0]))[: self.k]]
        if found.shape[1] == self.k:
            self.floors[i] = max(floor, int(found[0, -1]))

    def found(self) -> pa.RecordBatch:
        cols = [[], [], [], [], []]
        for i, (scores, keys, rows) in self.best.items():
            ids = [None if x == NO_ID else x for x in keys.tolist()]
            for c, v in zip(cols, ([i] * len(ids), [self.items.ids[i]] * len(ids), ids, rows.tolist(), scores.tolist())):
                c.extend(v)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in FOUND.split(", ")])


def term_counts(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, row, n (terms), ids and tfs (of terms in the vocabulary): one row for each document with terms."""

    def counted(batches):
        for batch in batches:
            n, ids, tfs = [], [], []
            for value in batch.column(2):
                words = terms_of(value.as_py())
                own, count = np.unique(np.array([v for v in map(vocabulary.get, words) if v is not None], np.int32), return_counts=True)
                n.append(len(words))
                ids.append(own)
                tfs.append(count.astype(np.int32))
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "row", "n", "ids", "tfs"])

    return docs.mapInArrow(counted, "doc_id long, row long, n long, ids array<int>, tfs array<int>").where("n > 0")


def impact_vectors(batch: pa.RecordBatch, weights: np.ndarray, documents: int, terms: int):
    """(starts, terms, impacts, norms) of the rows of a batch with columns n, ids and tfs."""
    flat = lambda name: batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = batch.column("ids").value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    ids, tfs = flat("ids"), flat("tfs")
    factor = np.repeat(length_factor(batch.column("n").to_numpy(zero_copy_only=False), documents, terms), lengths)
    impacts = weights[ids] * (1_000_000_000 * tfs // (1000 * tfs + 8 * factor))
    squares = np.concatenate([[0.0], np.cumsum(impacts.astype(float) ** 2)])
    own = np.maximum(squares[starts[1:]] - squares[starts[:-1]], 0.0)
    return starts, ids, impacts, np.sqrt(own + 1e-12 * squares[-1])  # a margin for what the running sum rounds


def rank_block(docs: DataFrame, rows, *, k: int, bucket_bytes: int, prune: bool = True) -> DataFrame | None:
    """FOUND: at least the k best documents (doc_id, row, text) of each item among rows (item_id, text)."""
    items, vocabulary = items_of(rows)
    if not items.ids:
        return None
    counts = materialised(term_counts(docs, vocabulary))
    documents, terms, coordinates = counts.agg(F.count("*"), F.sum("n"), F.sum(F.size("ids"))).first()
    if not coordinates:
        return None
    having = {r.t: r["count"] for r in counts.select(F.explode("ids").alias("t")).groupBy("t").count().collect()}
    weights = np.array([weight(documents, having.get(t, 0)) for t in range(len(vocabulary))], np.int64)

    def with_norms(batches):
        for batch in batches:
            norms = impact_vectors(batch, weights, documents, terms)[3]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(norms)], names=[*batch.schema.names, "norm"])

    lengths = counts.where(F.size("ids") > 0).mapInArrow(with_norms, "doc_id long, row long, n long, ids array<int>, tfs array<int>, norm double")
    order = [F.desc("norm"), F.col("row")]
    parts = max(1, -(-coordinates * 8 // bucket_bytes))
    by_norm = materialised(lengths.repartitionByRange(int(parts), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    n_terms, each = len(vocabulary), max(1, bucket_bytes // 8)

    def searched(floors: np.ndarray):
        def search(batches):
            run = Search(items, n_terms, k, floors, prune)
            for batch in batches:
                starts, ids, impacts, _ = impact_vectors(batch, weights, documents, terms)
                keys = batch.column("doc_id").fill_null(NO_ID).to_numpy()
                number, norms = batch.column("row").to_numpy(), batch.column("norm").to_numpy()
                a = 0
                while a < len(keys):  # neighbours by norm, in buckets of bounded size
                    z = max(a + 1, int(np.searchsorted(starts, starts[a] + each, "right")) - 1)
                    run.add(Bucket(keys[a:z], number[a:z], norms[a:z], starts[a : z + 1] - starts[a], ids[starts[a] : starts[z]], impacts[starts[a] : starts[z]]))
                    a = z
            yield run.found()

        return search

    nothing = np.ones(len(items.ids), np.int64)
    if not prune:
        return by_norm.mapInArrow(searched(nothing), FOUND)
    first = by_norm.where("part = 0").mapInArrow(searched(nothing), FOUND).groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k)
    floors = nothing.copy()
    for r in first.collect():  # a number for each item of the block
        floors[r["item"]] = r.least
    least = float((floors / (items.norms * (1 + 1e-9))).min())
    return by_norm.where(F.col("norm") >= least).mapInArrow(searched(floors), FOUND)


def rank(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", k: int = 10, bucket_bytes: int = 8 << 20, block_bytes: int = 8 << 20, prune: bool = True) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each row of items."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    asked = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))
    blocks = max(1, -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    found = docs.sparkSession.createDataFrame([], f"block int, {FOUND}")
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("item_id", "text").collect()  # about block_bytes
        part = rank_block(read, own, k=k, bucket_bytes=bucket_bytes, prune=prune)
        if part is not None:
            found = found.unionByName(materialised(part).withColumn("block", F.lit(b)))
    best = Window.partitionBy("block", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
