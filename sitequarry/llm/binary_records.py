"""Token ids as length-delimited binary records, with an offset index for shuffled reads.

A record frames one serialized document: eight bytes of length, a masked CRC-32C of these, the payload, a masked CRC-32C of the payload (the
framing that TFRecord readers know). The payload is the id of the document (signed, eight bytes), the width of a token
id (two or four bytes), whether the document's id is null (four bytes each), and the token ids; all little-endian. Beside each file lies its index: the offset and
length of each frame, sixteen bytes a record, so that a record is one read at a known place, in any order.

Documents are range-partitioned and sorted by (id, hash of the text, row), so that one id, or one text, of any number of rows spreads; each task encodes its
range and streams it to a file of its own, one document at a time. A file's name is unique to the attempt that wrote it; the table `files` names
those of the attempts that counted, with their records and token ids, so a retried or doubled task leaves no record twice. Where a file's
documents start in the corpus is a running sum over that table, one row a file. Files are reached by their URI, by pyarrow's file systems.

Readers check lengths and both checksums, and raise with the file and offset where they differ.

Defined results: null texts are empty; an empty text is the end id alone; repeated rows are records each; null ids come first; rows of one id stand by
the hash of their text, equal rows are interchangeable; an empty table gives no files and no records; other columns are ignored.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array
from collections import OrderedDict
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import public_path

FILES = "part int, file string, records long, tokens long, bytes long"
HEAD, LENGTH = 16, 12  # bytes of a payload before its token ids, of a frame before its payload
FRAME = LENGTH + 4
ENTRY = 16  # bytes of an index entry: offset and length of a frame
MASK = 0xFFFFFFFF


class LibraryBpe:
    """Ids by the tokenizers library alone. A single space between two other characters always begins a piece, so the words of many texts are
    encoded once each, those of plain letters, a piece by themselves, by the library's model without its other steps, and kept; texts with runs of white space or special strings,
    and all texts if the file isn't of a byte-level tokenizer, are encoded whole. Of the words kept, those that the last `cached` / 2 new or used ones don't include go first."""

    def __init__(self, path: str, cached: int = 1_000_000, batch_chars: int = 2 << 20):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the tasks
        self.cached, self.batch_chars = cached, batch_chars
        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() < 65536 else "<u4")
        self.code = "HI"[self.kind.itemsize == 4]
        self.by_words = type(self.library.pre_tokenizer).__name__ == "ByteLevel" and self.library.normalizer is None
        self.words: dict[str, bytes] = {}  # in use
        self.before: dict[str, bytes] = {}  # in use before that

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [array(self.code, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[str]) -> list[bytes]:
        """Words of ASCII letters after a space, which byte-level vocabularies write as Ġ."""
        tokenize = self.library.model.tokenize
        return [array(self.code, [t.id for t in tokenize("Ġ" + w)]).tobytes() for w in words]

    def _some(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") if self.by_words and not any(s in t for s in self.specials) else [t] for t in texts]
        after = lambda: set().union(*(s[1:] for s in split)).difference(self.words)
        new = after()
        odd = {w for w in new if not w or w[:1].isspace() or w[-1:].isspace()}  # a space beside white space doesn't begin a piece
        ends = [len(s) > 1 and (not s[0] or s[0][-1:].isspace()) for s in split]
        if odd or any(ends):
            split = [[t] if end or not odd.isdisjoint(s[1:]) else s for s, end, t in zip(split, ends, texts)]
            new = after()
        if again := new & self.before.keys():
            self.words.update((w, self.before[w]) for w in again)
            new -= again
        plain = [w for w in new if w.isascii() and w.isalpha()]
        words = [*new.difference(plain)]
        got = self._encoded([" " + w for w in words] + [s[0] for s in split])
        self.words.update(zip(words, got))
        self.words.update(zip(plain, self._plain(plain)))
        known = self.words.__getitem__
        out = [b"".join((first, *map(known, s[1:]))) for first, s in zip(got[len(words) :], split)]
        if len(self.words) > self.cached // 2:
            self.words, self.before = {}, self.words
        return out

    def packed(self, texts):
        """The ids of each text, as little-endian integers of self.kind."""
        held, size = [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= self.batch_chars:
                yield from self._some(held)
                held, size = [], 0
        yield from self._some(held) if held else ()


class Crc32c:
    """CRC-32C of bytes. The checksum is linear, so each byte adds what its value gives at its distance from a chunk's end; chunks follow one another by a shift."""

    def __init__(self, chunk: int = 512, polynomial: int = 0x82F63B78):
        table = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            table = np.where(table & 1, (table >> 1) ^ np.uint32(polynomial), table >> 1)
        self.byte = table.tolist()
        at = np.empty((chunk, 256), np.uint32)
        at[-1] = table
        for i in range(chunk - 2, -1, -1):
            at[i] = (at[i + 1] >> 8) ^ table[at[i + 1] & 0xFF]
        self.chunk, self.flat, self.start = chunk, at.reshape(-1), np.arange(chunk, dtype=np.int64) * 256
        self.shift = [at[k].tolist() for k in range(4)]  # what a byte of the state is worth a chunk later: the state stands in a chunk's first four bytes

    def __call__(self, data: bytes) -> int:
        if len(data) < 64:
            state = MASK
            for b in data:
                state = (state >> 8) ^ self.byte[(state ^ b) & 0xFF]
            return state ^ MASK
        n = -(-len(data) // self.chunk) * self.chunk
        padded = np.zeros(n, np.uint8)  # zeros before the data change nothing, since the state that they meet is zero
        padded[n - len(data) :] = np.frombuffer(data, np.uint8)
        padded[n - len(data) : n - len(data) + 4] ^= 0xFF
        state, s = 0, self.shift
        parts = padded.reshape(-1, self.chunk)
        for a in range(0, len(parts), 2048):
            places = parts[a : a + 2048].astype(np.intp)
            places += self.start
            for own in np.bitwise_xor.reduce(self.flat.take(places), axis=1).tolist():
                state = own ^ s[0][state & 0xFF] ^ s[1][state >> 8 & 0xFF] ^ s[2][state >> 16 & 0xFF] ^ s[3][state >> 24]
        return state ^ MASK

    def several(self, parts: list[bytes]) -> list[int]:
        """Of each of some records, by one pass over the chunks of all; one that is large by itself, or very short, goes alone."""
        lengths = np.array([len(x) for x in parts])
        if len(parts) < 2 or lengths.min() < 64 or lengths.sum() > 4 << 20:
            return [self(x) for x in parts]
        chunks = -(-lengths // self.chunk)
        ends = np.cumsum(chunks) * self.chunk
        padded = np.zeros(ends[-1], np.uint8)
        for data, start, end in zip(parts, (ends - lengths).tolist(), ends.tolist()):
            padded[start:end] = np.frombuffer(data, np.uint8)
        padded[((ends - lengths)[:, None] + np.arange(4)).ravel()] ^= 0xFF
        places = padded.reshape(-1, self.chunk).astype(np.intp)
        places += self.start
        own = iter(np.bitwise_xor.reduce(self.flat.take(places), axis=1).tolist())
        s, out = self.shift, []
        for n in chunks.tolist():
            state = 0
            for x in islice(own, n):
                state = x ^ s[0][state & 0xFF] ^ s[1][state >> 8 & 0xFF] ^ s[2][state >> 16 & 0xFF] ^ s[3][state >> 24]
            out.append(state ^ MASK)
        return out


def masked(crc: int) -> int:
    """Rotated and shifted, so that a checksum of data that holds checksums stays a good one."""
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & MASK


def framed(payloads: list[bytes], crc: Crc32c) -> list[bytes]:
    lengths = [struct.pack("<Q", len(p)) for p in payloads]
    return [b"".join((n, struct.pack("<I", masked(crc(n))), p, struct.pack("<I", masked(own)))) for n, p, own in zip(lengths, payloads, crc.several(payloads))]


def payload_length(head: bytes, crc: Crc32c) -> int | None:
    """The length that a frame begins with, or None where it isn't to be trusted."""
    whole = len(head) == LENGTH and struct.unpack_from("<I", head, 8)[0] == masked(crc(head[:8]))
    return struct.unpack_from("<Q", head)[0] if whole else None


def unframed(frames: list[bytes], crc: Crc32c, where: list[str]) -> list[bytes]:
    """The payloads of whole frames."""
    for frame, place in zip(frames, where):
        if payload_length(frame[:LENGTH], crc) != len(frame) - FRAME:
            raise ValueError(f"bad length of the record at {place}")
    payloads = [frame[LENGTH:-4] for frame in frames]
    for own, frame, place in zip(crc.several(payloads), frames, where):
        if struct.pack("<I", masked(own)) != frame[-4:]:
            raise ValueError(f"bad checksum of the record at {place}")
    return payloads


def grouped(rows, size_of, rows_each: int = 256, bytes_each: int = 1 << 20):
    """Lists of a few rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += size_of(row)
        if len(held) == rows_each or size >= bytes_each:
            yield held
            held, size = [], 0
    if held:
        yield held


def entries(offset: int, frames: list[bytes]) -> bytes:
    """The places of frames that follow one another, as the index has them."""
    lengths = np.array([len(f) for f in frames], "<i8")
    return np.stack([offset + np.cumsum(lengths) - lengths, lengths], axis=1).tobytes()


def serialized(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return struct.pack("<qII", doc_id or 0, width, doc_id is None) + ids


def parsed(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, width, null = struct.unpack_from("<qII", payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=HEAD)


def frames(path: str, crc: Crc32c):
    """(offset, frame) of each record of a file, read from its start to its end."""
    system, place = fs.FileSystem.from_uri(path)
    with system.open_input_stream(place, buffer_size=4 << 20) as f:
        offset = 0
        while head := f.read(LENGTH):
            length = payload_length(head, crc)
            frame = head if length is None else head + f.read(length + 4)
            yield offset, frame
            offset += len(frame)


def _batches(rows, kinds: dict, rows_each: int = 4096, bytes_each: int = 8 << 20):
    """Record batches of rows, of bounded size."""
    held, size = [], 0
    schema = pa.schema([*kinds.items()])
    as_batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) == rows_each or size >= bytes_each:
            yield as_batch()
            held, size = [], 0
    if held:
        yield as_batch()


def _ids(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


@dataclass
class RecordFiles:
    """Files that write() has made in a folder."""

    spark: SparkSession
    folder: str

    def files(self) -> DataFrame:
        """part, file, records, tokens, bytes: one row for each file, parts in the order of their documents."""
        return self.spark.read.schema(FILES).parquet(f"{self.folder}/files")

    def _dealt(self, files: DataFrame) -> DataFrame:
        parts = (files.agg(F.max("part")).first()[0] or 0) + 1
        return files.repartitionById(parts, F.col("part"))

    def records(self, with_ids: bool = False) -> DataFrame:
        """doc_id, start (token ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (little-endian unsigned 32-bit), read from the files."""
        before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})

        def read(batches):
            crc = Crc32c()

            def rows():
                for batch in batches:
                    for path, start, count in zip(*[c.to_pylist() for c in batch.columns]):
                        n = 0
                        for some in grouped(frames(path, crc), lambda x: len(x[1])):
                            for doc_id, ids in map(parsed, unframed([f for _, f in some], crc, [f"{path}:{at}" for at, _ in some])):
                                wide = _ids(ids)
                                yield (doc_id, start, len(ids), zlib.crc32(wide), wide)[: len(kinds)]
                                start, n = start + len(ids), n + 1
                        if n != count:
                            raise ValueError(f"{path} has {n} records, {count} were written")

            yield from _batches(rows(), kinds)

        schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
        return self._dealt(self.files().withColumn("start", before)).select("file", "start", "records").mapInArrow(read, schema)

    def index(self) -> DataFrame:
        """part, file, number (of the record in it), offset, length: one row for each record, from the indexes alone."""
        kinds = {"part": pa.int32(), "file": pa.string(), "number": pa.int64(), "offset": pa.int64(), "length": pa.int64()}

        def read(batches):
            for batch in batches:
                for part, path in zip(*[c.to_pylist() for c in batch.columns]):
                    system, place = fs.FileSystem.from_uri(f"{path}.index")
                    with system.open_input_stream(place, buffer_size=1 << 20) as f:
                        number = 0
                        while entries := f.read(ENTRY << 14):
                            at = np.frombuffer(entries, "<i8").reshape(-1, 2)
                            n = len(at)
                            yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([path] * n), pa.array(np.arange(number, number + n)), pa.array(at[:, 0]), pa.array(at[:, 1])], schema=pa.schema([*kinds.items()]))
                            number += n

        return self._dealt(self.files()).select("part", "file").mapInArrow(read, "part int, file string, number long, offset long, length long")

    def shuffled(self, seed: int = 42, open_files: int = 64) -> DataFrame:
        """doc_id, ids of every record, in an order that the seed draws: each record is one read at its offset. Partitions, one after the other, have the order; place counts upwards in it."""

        def fetch(batches):
            opened: OrderedDict = OrderedDict()
            crc = Crc32c()

            def rows():
                for batch in batches:
                    for path, offset, length in zip(*[c.to_pylist() for c in batch.columns]):
                        if path not in opened:
                            system, place = fs.FileSystem.from_uri(path)
                            opened[path] = system.open_input_file(place)
                            if len(opened) > open_files:
                                opened.popitem(last=False)[1].close()
                        opened.move_to_end(path)
                        doc_id, ids = parsed(unframed([opened[path].read_at(length, offset)], crc, [f"{path}:{offset}"])[0])
                        yield doc_id, _ids(ids)

            yield from _batches(rows(), {"doc_id": pa.int64(), "ids": pa.binary()})

        drawn = self.index().withColumn("draw", F.xxhash64(F.lit(seed), "part", "number"))
        dealt = drawn.repartitionByRange("draw").sortWithinPartitions("draw", "part", "number")
        return dealt.select("file", "offset", "length").mapInArrow(fetch, "doc_id long, ids binary").withColumn("place", F.monotonically_increasing_id())


def write(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0, part_bytes: int = 64 << 20) -> RecordFiles:
    """Encodes docs and writes them in ascending order of their ids, about part_bytes of text a file."""
    path = tokenizer or public_path("byte_bpe_50k.json")
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("print"), F.monotonically_increasing_id().alias("row"))
    parts = max(1, -(-(read.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    where = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "", 1)

    def written(batches):
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        bpe, crc, part = LibraryBpe(path), Crc32c(), TaskContext.get().partitionId()
        last = np.array([end_id], bpe.kind).tobytes()
        file = f"{where}/part-{part:07d}-{uuid.uuid4().hex}"
        system, place = fs.FileSystem.from_uri(file)
        system.create_dir(place.rsplit("/", 1)[0], recursive=True)
        offset = records = tokens = 0
        with system.open_output_stream(place, buffer_size=4 << 20) as out, system.open_output_stream(f"{place}.index", buffer_size=1 << 20) as index:
            batch = first
            while batch is not None:
                texts = (value.as_py() for value in batch.column(1))
                payloads = (serialized(doc_id.as_py(), ids + last, bpe.kind.itemsize) for doc_id, ids in zip(batch.column(0), bpe.packed(texts)))
                for some in grouped(payloads, len):
                    own = framed(some, crc)
                    out.write(b"".join(own))
                    index.write(entries(offset, own))
                    offset, records = offset + sum(map(len, own)), records + len(own)
                    tokens += sum(len(p) - HEAD for p in some) // bpe.kind.itemsize
                batch = next(batches, None)
        yield pa.RecordBatch.from_pylist([{"part": part, "file": file, "records": records, "tokens": tokens, "bytes": offset}], schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("records", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())]))

    order = ["doc_id", "print", "row"]
    dealt = read.repartitionByRange(int(parts), *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "text").mapInArrow(written, FILES).write.parquet(f"{folder}/files")
    return RecordFiles(spark, folder)
