"""Blocks of documents, and what they ask of ranges of keys.

Some operators need to know of every key in a document what the whole corpus says about it. Documents are dealt to blocks of a
few megabytes by a hash of their id and text, so that rows without an id, or of one id, spread. A block asks once for each different key (so a key that is in a third of all documents
comes once from each block), in sorted arrays, one for each range of keys; a range answers each block. There are as many ranges as the corpus has bytes for, like blocks,
so that neither grows with it. The exchange of
the texts by block is the same subtree in every pass over them, so Spark writes it once and reads it again.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def by_block(docs: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """docs (doc_id, text, others) dealt to blocks of about block_bytes of text, and the number of blocks."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // block_bytes))
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int").alias("block")
    return docs.select(block, "*").repartition(int(n), "block"), int(n)


def ranges_of(blocks: int, block_bytes: int, range_bytes: int) -> int:
    """How many ranges give each the keys of about range_bytes of text, however large the corpus is."""
    return max(1, -(-blocks * block_bytes // range_bytes))


def by_range(asked: DataFrame, ranges: int) -> DataFrame:
    """What blocks ask, with as many partitions as there are ranges: a task holds one range after another."""
    return asked.repartition(ranges, "range")


def split_ranges(keys: np.ndarray, ranges: int, bits: int):
    """(range, slice) for sorted keys of so many bits."""
    cuts = [((r << bits) + ranges - 1) // ranges for r in range(1, ranges)]
    at = [0, *np.searchsorted(keys, np.array(cuts, np.uint64)).tolist(), len(keys)] if len(keys) else []
    return [(r, slice(a, b)) for r, (a, b) in enumerate(zip(at, at[1:])) if b > a]


def whole_keys(batches):
    """The columns of batches that are sorted by their first column, as arrays; no two pieces share a key."""
    held: list[list[np.ndarray]] = []
    join = lambda parts: [np.concatenate(c) for c in zip(*parts)]
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        keys = columns[0]
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
        if held and (cut or held[-1][0][-1] != keys[0]):
            if cut:
                held.append([c[:cut] for c in columns])
            yield join(held)
            held = []
        elif cut:
            yield [c[:cut] for c in columns]
        held.append([c[cut:] for c in columns])
    if held:
        yield join(held)


def planes(values: np.ndarray) -> bytes:
    """Values byte plane by byte plane: what sorted or small values have in common then lies together, and Spark's codec packs it."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes() if len(values) else b""


def from_planes(data: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def pack48(keys: np.ndarray) -> bytes:
    """Keys of 48 bits in six bytes each."""
    return planes(keys)[: 6 * len(keys)]


def unpack48(data: bytes) -> np.ndarray:
    return from_planes(data + bytes(len(data) // 3), np.uint64)


def give_back() -> None:
    """Returns freed memory to the system, since several workers share what an executor has."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
