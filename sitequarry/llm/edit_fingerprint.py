"""Document fingerprints by randomised edit embedding.

All texts take the same random walk: at step j the walk stays on its character or goes on to the next, as a function of j
and the character that every text shares. Texts that differ by few edits fall into step again soon after each, so their
embeddings (the character at each step) differ in few places: edit distance becomes Hamming distance. The fingerprint
samples the embedding: each slot has a fixed series of steps of growing distance and takes the last one inside the
embedding, so texts of near lengths sample the same steps. A slot is one byte of a hash of (slot, step, character).

near_classes() cuts fingerprints into bands of sampled slots, and links the fingerprints that share a band and agree in enough slots.

Defined results: null texts are empty; empty texts have the fingerprint of zeros; equal texts have equal fingerprints; a
text shorter than four characters is its own edited text; rows with equal ids follow each other in the order of their texts' hashes;
a null id comes first; a table of one row is its own next row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .buckets import connected, shared_keys
from .common import materialised

RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


class EditWalk:
    """The shared randomness: how long the walk stays on a character, and which steps each slot samples."""

    def __init__(self, slots: int = 64, period: int = 4096, classes: int = 256, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.slots, self.period, self.classes = slots, period, classes
        goes = rng.random((classes, period)) < 0.5
        goes[:, -1] = True  # a stay ends with the period
        step = np.where(goes, np.arange(period), period)
        leave = np.minimum.accumulate(step[:, ::-1], axis=1)[:, ::-1] + 1  # the step after the one at which it goes on
        self.stays = [row.tolist() for row in leave - np.arange(period)]
        self.salt = rng.integers(1, 1 << 62, size=slots, dtype=np.uint64) | np.uint64(1)
        self.series: list[list[int]] = []
        draws = rng.random((slots, 64))
        for row in draws:
            at, steps = 1, [0]
            for u in row:
                at = int(at / max(u, 1e-9)) + 1
                if at > 1 << 48:
                    break
                steps.append(at - 1)
            self.series.append(steps)

    def walk(self, text: str, starts: list[int] | None = None) -> list[int]:
        """For each character, the step at which the walk comes to it; last, the step after the end. starts: those of a prefix."""
        starts = starts or [0]
        stays, mask, modulus = self.stays, self.period - 1, self.classes
        j, add = starts[-1], starts.append
        for c in map(ord, text[len(starts) - 1 :]):
            j += stays[c % modulus][j & mask]
            add(j)
        return starts

    def sample(self, text: str, starts: list[int]) -> np.ndarray:
        """The fingerprint: a byte for each slot."""
        n = len(text)
        if not n:
            return np.zeros(self.slots, np.uint8)
        steps = [s[bisect_right(s, 2 * n - 1) - 1] for s in self.series]
        chars = [ord(text[i]) + 1 if (i := bisect_right(starts, s) - 1) < n else 0 for s in steps]
        mixed = (np.array(steps, np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array(chars, np.uint64)) * self.salt
        mixed ^= mixed >> np.uint64(29)
        return ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(56)).astype(np.uint8)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


ORDER = ["id", "digest", "salt"]
DEALT = "range int, doc_id long, id long, digest long, salt long, text string"
LEAST_ID = -(1 << 63)  # stands for null


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Every row with what orders it: its id, a hash of its text, a number of the row. So rows of one id, or all equal, can be parted."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    return read.select("doc_id", F.coalesce("doc_id", F.lit(LEAST_ID)).alias("id"), "text", F.xxhash64("row").alias("salt"))


def digest_of(text: str) -> int:
    return int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big") >> 4


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = 64, seed: int = 42, samples: int = 50) -> DataFrame:
    """Fingerprints of every text and of its edited text (see RESULT).

    Rows are dealt to ranges of (id, hash of the text, row), of which there are eight for each shuffle partition; a sample of about `samples` rows a range decides
    where they are cut, and only that. A task walks over its rows in order and holds one; the first and the last row of each range are put aside, and meet afterwards."""
    spark = docs.sparkSession
    texts = ordered(docs, id_col, text_col)
    ranges = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, texts.count() // (samples * ranges))

    def keys(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(digest_of, batch.column(1).to_pylist()), pa.int64()), batch.column(2)], names=ORDER)

    seen = texts.where(F.pmod(F.xxhash64("salt"), F.lit(share)) == 0).select("id", "text", "salt").mapInArrow(keys, "id long, digest long, salt long").toArrow()
    sample = sorted(zip(*(seen.column(c).to_pylist() for c in ORDER)))
    cuts = [sample[len(sample) * i // ranges] for i in range(1, ranges)] if sample else []

    def dealt(batches):
        for batch in batches:
            doc_id, id_, text, salt = (c.to_pylist() for c in batch.columns)
            digest = [*map(digest_of, text)]
            at = [bisect_right(cuts, x) for x in zip(id_, digest, salt)]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(0), batch.column(1), pa.array(digest, pa.int64()), batch.column(3), batch.column(2)], names=[x.split()[0] for x in DEALT.split(", ")])

    sorted_ = texts.mapInArrow(dealt, DEALT).repartition(max(1, ranges // 4), "range").sortWithinPartitions("range", *ORDER).select("range", "doc_id", "text")
    names = [x.split()[0] for x in RESULT.split(", ")] + ["range", "edge", "text"]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.string())
    as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)
    edge = lambda at, which, doc_id, text: (doc_id, *[None] * 6, at, which, text)

    def run(batches):
        walk = EditWalk(slots, seed=seed)
        held = None  # the row whose next one is awaited
        for batch in batches:
            rows = []
            for at, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                starts = walk.walk(text)
                mark = walk.sample(text, starts)
                if held is not None and held[0] == at:
                    rows.append((*edited(walk, *held[1:], text, mark), at, 0, None))
                else:
                    if held is not None:
                        rows.append(edge(held[0], 2, held[1], held[2]))
                    rows.append(edge(at, 1, doc_id, text))
                held = (at, doc_id, text, starts, mark)
            yield as_batch(rows)
        if held is not None:
            yield as_batch([edge(held[0], 2, held[1], held[2])])

    found = materialised(sorted_.mapInArrow(run, RESULT + ", range int, edge int, text string"))
    used = sorted(r["range"] for r in found.where("edge = 1").select("range").collect())  # a number for each range
    following = spark.createDataFrame([(r, n) for r, n in zip(used, [*used[1:], *used[:1]])], "range int, next int")
    firsts = found.where("edge = 1").select(F.col("range").alias("next"), F.col("text").alias("next_text"))
    ends = found.where("edge = 2").select("range", "doc_id", "text").join(F.broadcast(following), "range").join(firsts, "next").select("doc_id", "text", "next_text")

    def over_the_edge(batches):
        walk = EditWalk(slots, seed=seed)
        for batch in batches:
            rows = []
            for doc_id, text, other in zip(*(c.to_pylist() for c in batch.columns)):
                starts = walk.walk(text)
                rows.append((*edited(walk, doc_id, text, starts, walk.sample(text, starts), other, walk.sample(other, walk.walk(other))), None, 0, None))
            yield as_batch(rows).select(names[:7])

    return found.where("edge = 0").select(*names[:7]).unionAll(ends.mapInArrow(over_the_edge, RESULT))


def edited(walk: EditWalk, doc_id, text: str, starts: list[int], mark: np.ndarray, following: str, next_mark: np.ndarray) -> tuple:
    n = len(text)
    kept = n - n // 4
    other = text[:kept] + following[: n // 4]
    other_mark = walk.sample(other, walk.walk(other, starts[: kept + 1]))
    return doc_id, n, hashlib.sha256(other.encode()).hexdigest(), mark.tobytes().hex(), other_mark.tobytes().hex(), likeness(mark, other_mark), likeness(mark, next_mark)


def near_classes(prints: DataFrame, *, id_col: str = "doc_id", print_col: str = "fingerprint", bands: int = 20, width: int = 8, least: float = 0.8, seed: int = 42) -> DataFrame:
    """prints with class_id: the smallest id of those that are reached over links; two fingerprints are linked if they share a band (`width` sampled slots) and agree in
    `least` of all slots. A pair that agrees in 0.8 of them shares one of 20 bands of 8 with probability 0.97, in 0.9 with 0.99999. Equal fingerprints are one before they meet;
    rows without an id have the class of their fingerprint (null if no row of the class has an id), rows without a fingerprint none."""
    marks = materialised(prints.where(F.col(print_col).isNotNull()).groupBy(F.xxhash64(print_col).alias("print")).agg(F.min(id_col).alias("id"), F.min(print_col).alias("mark")))

    def filed(batches):
        picks = None
        for batch in batches:
            rows = np.frombuffer(bytes.fromhex("".join(batch.column(1).to_pylist())), np.uint8).reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, 1), np.uint8)
            if picks is None:
                picks = [np.sort(np.random.default_rng((seed, b)).choice(rows.shape[1], min(width, rows.shape[1]), replace=False)) for b in range(bands)]
            for b, pick in enumerate(picks if batch.num_rows else []):
                keys = [xxhash.xxh64_intdigest(x.tobytes(), b) - (1 << 63) for x in np.ascontiguousarray(rows[:, pick])]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), batch.column(0)], names=["key", "print"])

    alike = lambda x, y: (x == y).mean(1) >= least if len(x) else np.zeros(0, bool)
    keyed = marks.select("print", "mark").mapInArrow(filed, "key long, print long")
    root = connected(shared_keys(keyed), marks.select("print", F.unhex("mark").alias("sketch")), alike)
    heads = marks.join(root, "print").groupBy("root").agg(F.min("id").alias("class_id"))
    named = root.join(heads, "root").select(F.col("print").alias("_print"), "class_id")
    return prints.join(named, F.xxhash64(print_col) == F.col("_print"), "left").drop("_print")
