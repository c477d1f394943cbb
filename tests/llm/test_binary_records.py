import os
import struct
import uuid
import zlib

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from sitequarry.llm import binary_records as records
from sitequarry.llm.tokens import public_path


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path("byte_bpe_50k.json"))


def folder(tmp_path):
    return f"{tmp_path}/records-{uuid.uuid4().hex}"


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def brute_force(rows, library):
    """doc_id, start, n_tokens, ids_crc32 in ascending order of doc_id, where no two rows share an id."""
    out, start = [], 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        out.append((r.doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    return out


@pytest.mark.parametrize("part_bytes", [1 << 30, 30_000])
def test_round_trip_equals_the_library(spark, documents, library, tmp_path, part_bytes):
    got = records.write(documents, folder(tmp_path), part_bytes=part_bytes)
    rows = [tuple(r) for r in got.records().collect()]
    assert sorted(rows) == brute_force(documents.collect(), library)
    assert (got.files().count() > 5) == (part_bytes == 30_000)
    starts = [r[1] for r in got.records().orderBy("doc_id").collect()]
    assert starts == sorted(starts)


def test_odd_rows(spark, odd, none, library, tmp_path):
    """Nulls, empties, long texts, special strings, repeated rows, null ids, clashing columns; an empty table."""
    more = odd.withColumns({c: F.lit("x") for c in ("print", "row", "part", "file", "ids", "start")})
    got = records.write(more, folder(tmp_path), part_bytes=5000).records(with_ids=True).collect()
    want = sorted((str(r.doc_id), crc([*library.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in odd.collect())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want and all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    order, at = sorted(got, key=lambda r: r.start), 0
    assert [r.doc_id is not None for r in order] == sorted(r.doc_id is not None for r in order)
    for r in order:
        assert r.start == at
        at += r.n_tokens
    empty = records.write(none, folder(tmp_path))
    assert empty.records().count() == empty.index().count() == empty.shuffled().count() == 0


def test_ids_of_any_characters_are_the_librarys(library):
    """Words encoded by themselves give what whole texts do: random code points, white space of all kinds, contractions, special strings."""
    tool, rng = records.LibraryBpe(public_path("byte_bpe_50k.json"), cached=500, batch_chars=400), np.random.default_rng(5)
    alphabet = [*" \t\n\r\x0b\x0c\x1c\x85\xa0\u2003\u200b\u3000", *"abcXYZ09'.,!", "é", "ß", "中", "й", "ا", "𝄞", "\u0301", " ", " ", " ", "'s", " 're", "<|endoftext|>", " the", " and"]
    texts = ["".join(rng.choice(alphabet, int(rng.integers(0, 30)))) for _ in range(5000)]
    for text, ids in zip(texts, tool.packed(texts), strict=True):
        assert np.frombuffer(ids, tool.kind).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_of_the_tables_and_other_tokenizers(documents, library):
    """Every text of a table word by word, and a file of another kind, which is encoded whole."""
    texts = [r.text or "" for r in documents.collect()]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tool = records.LibraryBpe(public_path(name))
        assert tool.by_words == (name == "byte_bpe_50k.json")
        whole = tool.library.encode_batch(texts, add_special_tokens=False)
        assert [np.frombuffer(x, tool.kind).tolist() for x in tool.packed(texts)] == [e.ids for e in whole]


def test_one_id_and_one_text_spread(spark, tmp_path):
    docs = spark.range(2000).select(F.lit(5).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    got = records.write(docs, folder(tmp_path), part_bytes=2000)
    assert got.files().count() > 4 and got.files().agg(F.max("records")).first()[0] < 1000
    rows = got.records().collect()
    assert sorted(r.start for r in rows) == [i * rows[0].n_tokens for i in range(2000)]


def test_index_and_shuffled_reads(spark, documents, tmp_path):
    """An index entry is a frame's place; a shuffled read has each record once, in an order that the seed alone decides."""
    got = records.write(documents, folder(tmp_path), part_bytes=50_000)
    e = got.index().where("number = 1").first()
    with open(e.file, "rb") as f:
        f.seek(e.offset)
        doc_id, ids = records.parsed(records.unframed([f.read(e.length)], records.Crc32c(), ["here"])[0])
    assert crc(ids) == {r.doc_id: r.ids_crc32 for r in got.records().collect()}[doc_id]
    orders = [[r.doc_id for r in got.shuffled(seed).orderBy("place").collect()] for seed in (1, 1, 2)]
    assert orders[0] == orders[1] != orders[2] and sorted(orders[0]) == sorted(orders[2]) == sorted(r.doc_id for r in documents.collect()) != orders[0]


@pytest.mark.parametrize("at", [0, 9, 30, -1])
def test_changed_bytes_are_found(spark, odd, tmp_path, at):
    got = records.write(odd, folder(tmp_path))
    name = got.files().first().file
    with open(name, "r+b") as f:
        place = at % os.path.getsize(name)
        f.seek(place)
        old = f.read(1)
        f.seek(place)
        f.write(bytes([old[0] ^ 1]))
    for read in (got.records(), got.shuffled()):
        with pytest.raises(PythonException, match="of the record at"):
            read.count()
            read.collect()


def test_a_cut_file_is_found(spark, odd, tmp_path):
    got = records.write(odd, folder(tmp_path))
    name = got.files().first().file
    last = max(r.offset for r in got.index().collect())
    os.truncate(name, last)
    with pytest.raises(PythonException, match="records, "):
        got.records().collect()
    os.truncate(name, last - 3)
    with pytest.raises(PythonException, match="of the record at"):
        got.records().collect()


def test_checksum_and_framing():
    """The published check values of CRC-32C, any length against the plain loop, and the frame's layout."""
    crc32c, rng = records.Crc32c(), np.random.default_rng(3)
    assert crc32c(b"123456789") == 0xE3069283 and crc32c(bytes(32)) == 0x8A9136AA
    for n in (0, 1, 63, 64, 511, 512, 513, 5000, 70_000):
        data, state = rng.bytes(n), 0xFFFFFFFF
        for b in data:
            state = (state >> 8) ^ crc32c.byte[(state ^ b) & 0xFF]
        assert crc32c(data) == state ^ 0xFFFFFFFF
    parts = [rng.bytes(n) for n in (64, 4000, 511, 512, 100)]
    assert crc32c.several(parts) == [crc32c(p) for p in parts] and crc32c.several([b"a", b""]) == [crc32c(b"a"), 0]
    frame = records.framed([b"abc"], crc32c)[0]
    assert frame[:8] == struct.pack("<Q", 3) and frame[12:15] == b"abc" and len(frame) == records.FRAME + 3 and records.unframed([frame], crc32c, [""]) == [b"abc"]
