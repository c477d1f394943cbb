"""Suffix-array dedup by prefix-free parsing.

A byte is removed if it lies in a string of `length` bytes that also starts in a document with a smaller id.

Parse: every text is cut into phrases by a rolling hash. The trigger of a window of `length` bytes is its k-byte string
with the least hash; windows with the same trigger in a row make a phrase, which reaches from the first byte of its first
window to the last byte of its last, so phrases overlap by length - 1 bytes and each suffix of `length` bytes lies in just
one. Equal suffixes have equal triggers, at equal places. So a phrase whose trigger is in no other document holds no
repeated suffix, and equal phrases hold equal suffixes: copies are settled phrase by phrase, by the smallest document that
has the phrase. Dictionary: the different phrases, told apart by their bytes. Where a trigger stands in different phrases
with the same string on a side of it (at the borders of what is shared), the suffixes of these phrases are sorted by their
bytes into a suffix array, whose runs of equal suffixes take the smallest document among their phrases. Combining both gives
each occurrence in the parse its removed suffixes, and these give the spans.

The work is done in three passes over blocks of documents (see blocks.py): which triggers are shared, what the dictionary
says of a block's phrases, which bytes go. The phrases of a trigger meet in one range. A trigger that stands in more than `busy` different
phrases of a block could bring a range without bound, so everywhere its phrases are cut to single suffixes, which are dealt by their bytes.
Hashes (48 bits of a trigger, 64 of a phrase) only choose what is compared and what is cut; bytes decide.

Defined results: null texts are empty; an empty text has no bytes and no spans; rows with equal ids don't remove from each
other; a null id counts as the smallest; texts of any length are read whole, a piece at a time; an empty table gives no rows; columns
named in `carry` come along, others are ignored.
"""

from __future__ import annotations

import hashlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import by_block, by_range, from_planes, give_back, pack48, planes, ranges_of, split_ranges, unpack48

CHUNK = 1 << 18  # bytes that are parsed at once
NO_ID = -(1 << 63)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Phrases(NamedTuple):
    """Phrases in text order. The bytes of one are data[at : at + windows + length - 1]."""

    data: bytes
    trigger: np.ndarray  # 48 bits of the hash
    mark: np.ndarray  # a hash of the phrase
    doc: np.ndarray
    start: np.ndarray  # in the text
    windows: np.ndarray
    before: np.ndarray  # bytes before the trigger
    at: np.ndarray


class Parser:
    """Phrases of texts. The rolling hash of any string is a difference of running sums, scaled back to its start."""

    def __init__(self, length: int, k: int, chunk: int = CHUNK, seed: int = 42):
        self.length, self.k, self.chunk = length, k, chunk
        rng = np.random.default_rng(seed)
        self.value = rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
        n = chunk + 2 * length
        base = 0x9E3779B97F4A7C15 | 1
        back = pow(base, -1, 1 << 64)
        self.up = np.cumprod(np.full(n, base, np.uint64))
        self.down = np.cumprod(np.full(n, back, np.uint64))

    def chunks(self, texts: list[bytes]):
        """(buffer, doc, begin, first) of joined texts: buffer, and for each piece its document, its place in the buffer and in the text."""
        parts, doc, begin, first, used = [], [], [], [], 0
        for d, text in enumerate(texts):
            for at in range(0, max(0, len(text) - self.length + 1), self.chunk):
                piece = text[at : at + self.chunk + self.length - 1]
                if used + len(piece) > self.chunk + self.length - 1 and parts:
                    yield b"".join(parts), doc, begin, first
                    parts, doc, begin, first, used = [], [], [], [], 0
                parts.append(piece)
                doc.append(d)
                begin.append(used)
                first.append(at)
                used += len(piece)
        if parts:
            yield b"".join(parts), doc, begin, first

    def phrases(self, texts: list[bytes]) -> Phrases:
        found: list[tuple] = []
        whole, base = [], 0
        for data, doc, begin, first in self.chunks(texts):
            buffer = np.frombuffer(data, np.uint8)
            n, length, k = len(buffer), self.length, self.k
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(self.value[buffer] * self.up[:n], out=sums[1:])
            grams = _mixed((sums[k:] - sums[:-k]) * self.down[: n - k + 1])
            place = np.uint64((1 << 20) - 1)
            least = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
            span, want = 1, length - k + 1
            while span * 2 <= want:
                least = np.minimum(least[:-span], least[span:])
                span *= 2
            if want > span:
                least = np.minimum(least[: span - want], least[want - span :])
            trigger_at = (least & place).astype(np.int32)
            begins = np.array(begin)
            edge = np.zeros(n + 1, np.int8)
            edge[begins] += 1
            np.add.at(edge, np.append(begins[1:], n) - length + 1, -1)  # every piece has a window at least
            inside = np.cumsum(edge, dtype=np.int8)[: len(trigger_at)] > 0
            other = trigger_at[1:] != trigger_at[:-1]
            starts, stops = inside.copy(), inside
            starts[1:] &= ~inside[:-1] | other
            stops = inside.copy()
            stops[:-1] &= ~inside[1:] | other
            lo, hi = np.flatnonzero(starts), np.flatnonzero(stops)
            at = trigger_at[lo]
            piece = np.searchsorted(begins, lo, side="right") - 1
            # the least of hashes is small: hashed again, triggers spread evenly over ranges
            mark = _mixed((sums[hi + length] - sums[lo]) * self.down[lo])
            found.append((_mixed(grams[at]) >> np.uint64(16), mark, np.array(doc)[piece], lo - begins[piece] + np.array(first)[piece], hi - lo + 1, at - lo, lo + base))
            whole.append(data)
            base += n
        if not found:
            none = np.zeros(0, np.int64)
            return Phrases(b"", none.astype(np.uint64), none.astype(np.uint64), none, none, none, none, none)
        return Phrases(b"".join(whole), *[np.concatenate(x) for x in zip(*found)])


def big_endian(data: np.ndarray, at: np.ndarray, size: int) -> list[np.ndarray]:
    """The `size` bytes from each place on as numbers that sort like them; data ends with seven bytes more than are asked."""
    eights = np.lib.stride_tricks.sliding_window_view(data, 8)
    load = lambda x: np.ascontiguousarray(eights[x]).view(">u8")[:, 0].astype(np.uint64)
    if size < 8:
        return [load(at) >> np.uint64(64 - 8 * size)] if size else [np.zeros(len(at), np.uint64)]
    out = [load(at + j) for j in range(0, size - 7, 8)]
    return out + [load(at + size - 8)] * bool(size % 8)


def runs_of(order: np.ndarray, keys: list[np.ndarray]) -> np.ndarray:
    """Which rows, in that order, differ from the one before."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for key in keys:
            sorted_ = key[order]
            new[1:] |= sorted_[1:] != sorted_[:-1]
    return new


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (count[0] numbers), first[1], ..."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _ordered(table: pa.Table) -> tuple[pa.Table, np.ndarray, list[bytes]]:
    """A block by id and text, so that every pass meets its phrases in one order; its ids and texts."""
    ids = np.array([NO_ID if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
    texts = [b"" if x is None else x.encode() for x in table.column("text").to_pylist()]
    order = np.lexsort((np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64), ids))
    return table.take(pa.array(order)), ids[order], [texts[i] for i in order.tolist()]


def _rows(names: str, rows: list[tuple]) -> pa.Table:
    give_back()
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in names.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[n for n, _ in fields])


TRIGGERS = "range int, block int, keys binary, busy binary"
PHRASES = "range int, block int, keys binary, sizes binary, phrases binary, docs binary, before binary"
#: kind 0: the triggers that other blocks have too (data) and those that are busy (docs); 1: bits of the dictionary (data, suffixes), smallest documents (docs)
ANSWER = "block int, range int, kind int, data binary, suffixes binary, docs binary"


class Dictionary(NamedTuple):
    """A block's different phrases whose trigger may be in another document, by key, and where they occur."""

    key: np.ndarray
    phrase: pa.BinaryArray
    doc: np.ndarray  # the smallest of the block that has the phrase
    before: np.ndarray
    of: np.ndarray  # of each occurrence, in text order, the place in the dictionary
    occurs: np.ndarray  # the document of each occurrence
    start: np.ndarray
    windows: np.ndarray


class Passes:
    """What is done with a block or a range of keys in each pass."""

    def __init__(self, length: int, k: int, ranges: int, busy: int, chunk: int):
        self.parser, self.length, self.k, self.ranges, self.busy = Parser(length, k, chunk), length, k, ranges, busy
        self.left = (length - k) // 2
        self.right = length - k - max(0, self.left - 1)

    def ask_triggers(self, docs: pa.Table) -> pa.Table:
        block = docs.column("block")[0].as_py()
        _, _, texts = _ordered(docs)
        found = self.parser.phrases(texts)
        order = np.lexsort((found.mark, found.trigger))
        keys, count = np.unique(found.trigger[order[runs_of(order, [found.trigger, found.mark])]], return_counts=True)
        busy = count > self.busy
        return _rows(TRIGGERS, [(r, block, pack48(keys[s]), pack48(keys[s][busy[s]])) for r, s in split_ranges(keys, self.ranges, 48)])

    def shared_triggers(self, asked: pa.Table) -> pa.Table:
        """To each block, those of its triggers that another block has too, and those that are busy in any block."""
        blocks = asked.column("block").to_pylist()
        keys = [unpack48(x) for x in asked.column("keys").to_pylist()]
        busy = np.unique(np.concatenate([unpack48(x) for x in asked.column("busy").to_pylist()]))
        joined = np.sort(np.concatenate(keys))
        shared = np.unique(joined[1:][joined[1:] == joined[:-1]])
        own = asked.column("range")[0].as_py()
        among = lambda x, some: pack48(x[np.isin(x, some, assume_unique=True)])
        return _rows(ANSWER, [(b, own, 0, among(x, shared), b"", among(x, busy)) for b, x in zip(blocks, keys)])

    def _dictionary(self, ids: np.ndarray, found: Phrases, answers: pa.Table) -> Dictionary:
        first = answers.filter(pc.equal(answers.column("kind"), 0))
        told = lambda name: np.concatenate([np.zeros(0, np.uint64), *map(unpack48, first.column(name).to_pylist())])
        doc = ids[found.doc]
        order = np.lexsort((doc, found.trigger))
        t, d = found.trigger[order], doc[order]
        several = np.unique(t[1:][(t[1:] == t[:-1]) & (d[1:] != d[:-1])])
        some = np.flatnonzero(np.isin(found.trigger, np.union1d(told("data"), several)))
        busy = np.isin(found.trigger[some], told("docs"))
        times = np.where(busy, found.windows[some], 1)  # a busy trigger's phrases are cut to single suffixes
        at, start, before = spread(found.at[some], times), spread(found.start[some], times), np.repeat(found.before[some], times) - spread(np.zeros(len(some), np.int64), times)
        windows, doc, key = np.repeat(np.where(busy, 1, found.windows[some]), times), np.repeat(found.doc[some], times), np.repeat(found.trigger[some], times)
        data, size = found.data, self.length - 1
        bytes_of = [data[a : a + n + size] for a, n in zip(at.tolist(), windows.tolist())]
        if busy.any():
            cut = np.flatnonzero(np.repeat(busy, times))
            key[cut] = np.array([xxhash.xxh64_intdigest(bytes_of[i]) >> 16 for i in cut.tolist()], np.uint64)
        encoded = pa.array(bytes_of, pa.binary()).dictionary_encode()
        code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        first_of = np.unique(code, return_index=True)[1]  # documents are in order, so it is the smallest that has the phrase
        order = np.argsort(key[first_of], kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        one = first_of[order]
        return Dictionary(key[one], encoded.dictionary.take(pa.array(order)), ids[doc[one]], before[one], place[code] if len(code) else code, doc, start, windows)

    def ask_phrases(self, docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(PHRASES, [])
        block = docs.column("block")[0].as_py()
        _, ids, texts = _ordered(docs)
        known = self._dictionary(ids, self.parser.phrases(texts), answers)
        n = len(known.key)
        ends = np.frombuffer(known.phrase.buffers()[1], np.int32, n + 1) if n else np.zeros(1, np.int32)
        data = known.phrase.buffers()[2] if n else b""
        two = lambda x: x.astype("<u2")
        return _rows(PHRASES, [(r, block, pack48(known.key[s]), planes(two(np.diff(ends[s.start : s.stop + 1]))), data[int(ends[s.start]) : int(ends[s.stop])].to_pybytes(), planes(known.doc[s]), planes(two(known.before[s]))) for r, s in split_ranges(known.key, self.ranges, 48)])

    def _contested(self, key: np.ndarray, data: np.ndarray, at: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Which of different phrases share a trigger and the string left or right of it with another: two suffixes at one place of
        their triggers are equal only if what lies left of the triggers is, or what lies right."""
        out = np.zeros(len(key), bool)
        order = np.argsort(key, kind="stable")
        new = runs_of(order, [key])
        several = order[np.repeat(np.diff(np.append(np.flatnonzero(new), len(order))) > 1, np.diff(np.append(np.flatnonzero(new), len(order))))]
        for from_trigger, length, there in ((-self.left, self.left, before >= self.left), (self.k, self.right, size - before - self.k >= self.right)):
            some = several[there[several]]
            words = [key[some], *big_endian(data, (at + before)[some] + from_trigger, length)]
            by = np.lexsort(words[::-1])
            same = ~runs_of(by, words)[1:]
            out[some[by[1:][same]]] = True
            out[some[by[:-1][same]]] = True
        return out

    def _suffix_array(self, data: np.ndarray, at: np.ndarray, count: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Of each suffix of phrases (at, count suffixes each), whether a phrase with a smaller document has it."""
        words = big_endian(data, spread(at, count), self.length)
        order = np.lexsort(words[::-1])
        firsts = np.flatnonzero(runs_of(order, words))
        doc = np.repeat(least, count)
        smallest = np.minimum.reduceat(doc[order], firsts)
        out = np.empty(len(doc), bool)
        out[order] = np.repeat(smallest, np.diff(np.append(firsts, len(order)))) < doc[order]
        return out

    def settled_phrases(self, asked: pa.Table, at_once: int = 1 << 18) -> pa.Table:
        """To each block, for its phrases in the order asked: whether there is something to tell, the smallest document with the phrase, and, where the
        phrase is contested and the block has that document, which of its suffixes a smaller document has in another phrase."""
        blocks, own = asked.column("block").to_pylist(), asked.column("range")[0].as_py()
        column = lambda name: asked.column(name).to_pylist()
        parts = [unpack48(x) for x in column("keys")]
        key, doc = np.concatenate(parts), np.concatenate([from_planes(x, np.int64) for x in column("docs")])
        size, before = (np.concatenate([from_planes(x, "<u2") for x in column(name)]).astype(np.int64) for name in ("sizes", "before"))
        joined = b"".join(column("phrases"))
        ends = np.concatenate([[0], np.cumsum(size)])
        code = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(key), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(joined)]).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        data = np.frombuffer(joined + bytes(8), np.uint8)
        _, one, times = np.unique(code, return_index=True, return_counts=True)
        least = np.full(len(one), np.iinfo(np.int64).max)
        np.minimum.at(least, code, doc)
        contested = self._contested(key[one], data, ends[one], size[one], before[one])
        # suffix arrays of the contested phrases, as many whole triggers at once as have about at_once suffixes
        some = np.flatnonzero(contested)
        some = some[np.argsort(key[one[some]], kind="stable")]
        count = size[one[some]] - self.length + 1
        borders = np.flatnonzero(runs_of(np.arange(len(some)), [key[one[some]]]))
        cuts = borders[np.unique(np.cumsum(count)[borders] // at_once, return_index=True)[1]] if len(borders) else borders
        smaller = [self._suffix_array(data, ends[one[some[a:b]]], count[a:b], least[some[a:b]]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(some)])]
        smaller = np.concatenate([np.zeros(0, bool), *smaller])
        first = np.zeros(len(one), np.int64)
        first[some] = np.cumsum(count) - count
        told, from_here = (contested | (times > 1))[code], contested[code] & (doc == least[code])
        out, a = [], 0
        for b, part in zip(blocks, parts):
            here = slice(a, a + len(part))
            with_suffixes = np.flatnonzero(from_here[here]) + a
            bits = smaller[spread(first[code[with_suffixes]], size[with_suffixes] - self.length + 1)]
            flags = np.packbits(told[here]).tobytes() + np.packbits(from_here[here]).tobytes()
            out.append((b, own, 1, flags, np.packbits(bits).tobytes(), planes(least[code[here][told[here]]])))
            a += len(part)
        return _rows(ANSWER, out)

    def spans(self, ids: np.ndarray, texts: list[bytes], answers: pa.Table) -> list[np.ndarray]:
        """The removed spans of each text: rows of first and end."""
        known = self._dictionary(ids, self.parser.phrases(texts), answers)
        least, has_suffixes, first = known.doc.copy(), np.zeros(len(known.key), bool), np.zeros(len(known.key), np.int64)
        size = np.diff(np.frombuffer(known.phrase.buffers()[1], np.int32, len(known.key) + 1)).astype(np.int64) if len(known.key) else np.zeros(0, np.int64)
        parts, smaller, base = dict(split_ranges(known.key, self.ranges, 48)), [np.zeros(0, bool)], 0
        for r in answers.filter(pc.equal(answers.column("kind"), 1)).to_pylist():
            s = parts[r["range"]]
            n = s.stop - s.start
            told, flagged = (np.flatnonzero(np.unpackbits(x, count=n)) + s.start for x in np.split(np.frombuffer(r["data"], np.uint8), 2))
            least[told] = from_planes(r["docs"], np.int64)
            has_suffixes[flagged] = True
            count = size[flagged] - self.length + 1
            first[flagged] = base + np.cumsum(count) - count
            smaller.append(np.unpackbits(np.frombuffer(r["suffixes"], np.uint8), count=int(count.sum())).astype(bool))
            base += int(count.sum())
        smaller = np.concatenate(smaller)
        doc = ids[known.occurs]
        whole = np.flatnonzero(least[known.of] < doc)
        # suffixes that are set, in runs within their phrase
        part = np.flatnonzero(has_suffixes[known.of] & (least[known.of] == doc))
        count = known.windows[part]
        on = np.flatnonzero(smaller[spread(first[known.of[part]], count)])
        of, offset = np.repeat(part, count)[on], spread(np.zeros(len(part), np.int64), count)[on]
        a = np.concatenate([known.start[whole], known.start[of] + offset])
        z = np.concatenate([known.start[whole] + known.windows[whole], known.start[of] + offset + 1]) + self.length - 1
        d = np.concatenate([known.occurs[whole], known.occurs[of]])
        order = np.lexsort((a, d))
        a, z, d = a[order], z[order], d[order]
        new = np.ones(len(a), bool)
        new[1:] = (d[1:] != d[:-1]) | (a[1:] > z[:-1])  # suffixes are in order, so ends are too
        begins = np.flatnonzero(new)
        merged = np.stack([a[begins], z[np.append(begins[1:], len(a))[: len(begins)] - 1]], axis=1)
        return np.split(merged, np.searchsorted(d[begins], np.arange(1, len(texts)))) if texts else []


def kept_bytes(text: bytes, spans: np.ndarray) -> bytes:
    cuts = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), length: int = 50, k: int = 20, block_bytes: int = 3 << 20, range_bytes: int = 12 << 20, busy: int = 64, chunk_bytes: int = CHUNK, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, with carried columns; with_text also spans and text
    (what is kept; a character that a span cuts in two is left out)."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    blocks, n_blocks = by_block(read, block_bytes)
    ranges = ranges_of(n_blocks, block_bytes, range_bytes)
    passes = Passes(length, k, ranges, busy, chunk_bytes)
    asked = blocks.groupBy("block").applyInArrow(lambda t: passes.ask_triggers(t), TRIGGERS)
    shared = by_range(asked, ranges).groupBy("range").applyInArrow(lambda t: passes.shared_triggers(t), ANSWER)
    phrases = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lambda a, b: passes.ask_phrases(a, b), PHRASES)
    settled = by_range(phrases, ranges).groupBy("range").applyInArrow(lambda t: passes.settled_phrases(t), ANSWER)

    kinds = {f.name: f.dataType.simpleString() for f in read.schema}
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + "".join(f", carried_{c} {kinds[f'carried_{c}']}" for c in carry) + (", spans array<struct<first:long,end:long>>, text string" if with_text else "")

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        left, ids, texts = _ordered(left)
        removed = passes.spans(ids, texts, right)
        give_back()
        kept = [kept_bytes(x, s) if len(s) else x for x, s in zip(texts, removed)]
        long = lambda x: pa.array(x, pa.int64())
        columns = {
            "doc_id": left.column("doc_id"),
            "n_bytes": long([len(x) for x in texts]),
            "n_removed": long([len(x) - len(y) for x, y in zip(texts, kept)]),
            "n_spans": long([len(s) for s in removed]),
            "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()),
        } | {f"carried_{c}": left.column(f"carried_{c}") for c in carry}
        if with_text:
            columns["spans"] = pa.array([[{"first": a, "end": b} for a, b in s.tolist()] for s in removed], pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])))
            columns["text"] = pa.array([x.decode(errors="ignore") for x in kept], pa.string())
        return pa.table(columns)

    out = blocks.groupBy("block").cogroup(shared.unionByName(settled).groupBy("block")).applyInArrow(remove, result)
    return out.withColumnsRenamed({f"carried_{c}": c for c in carry})
