"""Packing along a space-filling curve.

A document's token ids are hashed to a damped count vector, projected to a few dimensions and cut into cells at quantiles;
the Hilbert index of the cells, with a hash of the row beneath it so that equal documents spread, is its place on the
curve. Documents are range-partitioned and sorted by that key, and neighbours along the curve are packed one after the other
into sequences: cut wherever a sequence is full, and at a partition's end into powers of two, which need no padding.

The quantiles and the range bounds come from a hashed sample of about `sample` rows; they decide balance and
neighbourhood only, and every document is packed. There are as many ranges as the texts have bytes for; between sampled keys, bounds lie evenly. Each task holds one document and one sequence at a time.

Defined results: null texts are empty; an empty text is the end id alone; repeated rows are packed each; rows with a null id, or of one id, spread like
others and keep their id; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import give_back
from .tokens import ByteBpe, public_path

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, place long"


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Index of each row of cells (n x dims, values under 2**bits) on the Hilbert curve: cells to Gray code bit plane by bit plane, then interleaved."""
    x = [cells[:, d].astype(np.uint64) for d in range(cells.shape[1])]
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        q, below = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[d]) & below)
            x[0] = np.where(on, x[0] ^ below, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, dims):
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] & np.uint64(1 << b)) != 0, flip ^ np.uint64((1 << b) - 1), flip)
    out = np.zeros_like(flip)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << np.uint64(1)) | (((x[d] ^ flip) >> np.uint64(b)) & np.uint64(1))
    return out.astype(np.int64)


class Curve:
    """Places on the curve. edges: for each dimension, the cuts between cells."""

    def __init__(self, dims: int, bits: int, features: int, seed: int, edges: np.ndarray | None = None):
        self.bits, self.features, self.edges = bits, features, edges
        self.lines = np.random.default_rng(seed).standard_normal((features, dims))

    def point(self, ids: np.ndarray) -> np.ndarray:
        hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        counts = np.sqrt(np.bincount((hashed % np.uint64(self.features)).astype(np.int64), minlength=self.features))
        return counts @ self.lines / (np.sqrt(counts @ counts) or 1.0)

    def place(self, points: np.ndarray) -> np.ndarray:
        cells = np.stack([np.searchsorted(self.edges[d], points[:, d]) for d in range(points.shape[1])], axis=1)
        return hilbert_index(cells, self.bits)


class SequencePacker:
    """Cuts documents into pieces. Holds the pieces of one sequence until it is full."""

    def __init__(self, size: int, first_id: int):
        self.size, self.next_id, self.used = size, first_id, 0
        self.held: list[tuple] = []  # (doc_id, start, ids of the piece, doc_tokens, place)

    def add(self, doc_id, ids: np.ndarray, place: int):
        at, n = 0, len(ids)
        while at < n:
            take = min(n - at, self.size - self.used)
            self.held.append((doc_id, at, ids[at : at + take], n, place))
            self.used, at = self.used + take, at + take
            if self.used == self.size:
                yield from self._sequence(self.held)
                self.held, self.used = [], 0

    def finish(self):
        """What is left, in sequences whose lengths are powers of two."""
        while self.used:
            room, part, rest = 1 << (self.used.bit_length() - 1), [], []
            for doc_id, start, ids, n, place in self.held:
                take = min(room, len(ids))
                if take:
                    part.append((doc_id, start, ids[:take], n, place))
                if take < len(ids):
                    rest.append((doc_id, start + take, ids[take:], n, place))
                room -= take
            yield from self._sequence(part)
            self.held, self.used = rest, sum(len(x[2]) for x in rest)

    def _sequence(self, pieces):
        offset = 0
        for doc_id, start, ids, n, place in pieces:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next_id, offset, place
            offset += len(ids)
        self.next_id += 1


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, size: int = 1024, dims: int = 4, bits: int = 8, features: int = 1024, sample: int = 4000, part_bytes: int = 16 << 20, seed: int = 42) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, place (the document's index on the curve)."""
    path = tokenizer or public_path("byte_bpe_50k.json")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    texts = texts.select("doc_id", "text", F.xxhash64("doc_id", "text", "row", F.lit(seed)).bitwiseAND(0x7FFFFFFF).alias("salt"))
    rows, total = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, -(-total // part_bytes))

    def encoded(batches, curve: Curve):
        bpe = ByteBpe(path)
        last = np.array([end_id], dtype=bpe.kind).tobytes()
        for whole in batches:
            for batch in (whole.slice(at, 1024) for at in range(0, whole.num_rows, 1024)):
                packed = bpe.packed_column(batch.column(1), last)
                yield batch, packed, np.array([curve.point(np.frombuffer(x.as_buffer(), bpe.kind)) for x in packed]).reshape(-1, dims)
        del bpe
        give_back()

    def sampled(batches):
        for batch, _, points in encoded(batches, Curve(dims, bits, features, seed)):
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(list(points), pa.list_(pa.float64()))], names=["salt", "point"])

    share = max(1, rows // sample)
    seen = texts.where(F.pmod(F.xxhash64("salt"), F.lit(share)) == 0).mapInArrow(sampled, "salt long, point array<double>").toPandas()
    points = np.array(seen["point"].tolist()).reshape(-1, dims)
    edges = np.quantile(points, np.arange(1, 1 << bits) / (1 << bits), axis=0).T if len(points) else np.zeros((dims, (1 << bits) - 1))
    key = lambda curve, p, salt: (curve.place(p) << 31) | salt
    curve = Curve(dims, bits, features, seed, edges)
    keys = np.sort(key(curve, points, seen["salt"].to_numpy(dtype=np.int64))).astype(float)
    ranks = (np.arange(len(keys)) + 0.5) / max(1, len(keys))

    def placed(batches):
        for batch, packed, points in encoded(batches, curve):
            at = key(curve, points, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)) if len(points) else np.zeros(0, np.int64)
            part = np.interp(at, keys, ranks) * parts if len(keys) else np.zeros(len(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(part, parts - 1).astype(np.int32), pa.int32()), pa.array(at, pa.int64()), batch.column(0), packed.cast(pa.binary())], names=["part", "place", "doc_id", "ids"])

    def packed(batches):
        kind = ByteBpe(path, 1).kind
        packer = SequencePacker(size, TaskContext.get().partitionId() << 40)
        names = [x.split()[0] for x in PIECE.split(", ")]
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=names)
        for batch in batches:
            got = zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist())
            if rows := [r for doc_id, ids, place in got for r in packer.add(doc_id, np.frombuffer(ids.as_buffer(), kind), place >> 31)]:
                yield as_batch(rows)
        if rows := [*packer.finish()]:
            yield as_batch(rows)

    on_curve = texts.mapInArrow(placed, "part int, place long, doc_id long, ids binary")
    ranged = on_curve.repartitionById(parts, F.col("part")).sortWithinPartitions("place", "doc_id")
    return ranged.select("doc_id", "ids", "place").mapInArrow(packed, PIECE)
