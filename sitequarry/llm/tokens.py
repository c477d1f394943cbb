"""Byte-level BPE ids with a cache of pieces, equal to those of the `tokenizers` library on the same file."""

from __future__ import annotations

import base64
import json
import re
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed values of byte-level BPE: how texts are cut into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BESIDE_BLANK = re.compile(r" \s|\s ")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_char() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A single space between two other characters always begins a piece, so words can be encoded, and cached, one by one.

    Texts with runs of white space are encoded whole; texts that hold a special token's string by the library itself."""

    def __init__(self, path: str, cached: int = 400_000):
        import tiktoken

        self.path, self.cached = path, cached
        if path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                ranks = {base64.b64decode(piece): int(i) for piece, i in map(bytes.split, f)}
            self.specials = []
        else:
            with open(path, encoding="utf-8") as f:
                model = json.load(f)
            self.specials = [x["content"] for x in model["added_tokens"]]
            byte = byte_of_char()
            ranks = {bytes(byte[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in self.specials}
        self.lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)  # bytes of each id
        for piece, i in ranks.items():
            self.lengths[i] = len(piece)
        self.kind = np.dtype("<u2" if len(ranks) + len(self.specials) < 65536 else "<u4")
        self.encode = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words: dict[str, bytes] = {}
        self.library = None

    def _bytes(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype=self.kind).tobytes()

    def _learned(self, words: list[str]) -> list[bytes]:
        """The ids of words, none with white space at an end, encoded in one call; a space before each keeps their pieces apart, and the bytes of ids say where a word ends."""
        ids = np.array(self.encode(" " + " ".join(words)), dtype=self.kind)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * self.kind.itemsize
        data, at = ids.tobytes(), [0, *cuts.tolist()]
        return [data[a:b] for a, b in zip(at, at[1:])]

    def packed_all(self, texts: list[str]) -> list[bytes]:
        """packed() of each text, with the words that are new in them encoded together."""
        return self.packed_column(pa.array(texts, pa.string())).to_pylist()

    def packed_column(self, texts: pa.Array, end: bytes = b"", at_once: int = 500) -> pa.Array:
        """packed() of each text of a column (null: empty) and end, as large_binary. Arrow numbers the words, so each different one is looked up once, what is new is encoded together, and
        the ids are put together by number."""
        if not len(texts):
            return pa.array([], pa.large_binary())
        split = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), " ")
        coded = split.flatten().dictionary_encode()
        at, number, found = np.array(split.offsets, np.int64), np.array(coded.indices, np.int64), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        first, last = at[:-1], at[1:] - 1
        got, new = [*map(self.words.get, found)], []
        before, behind = np.zeros(len(found), bool), np.zeros(len(found), bool)  # words with white space at that end, which isn't cached
        for i in [i for i, ids in enumerate(got) if ids is None]:
            w = found[i]
            if not w or w[0].isspace() or w[-1].isspace():
                before[i], behind[i], got[i] = not w or w[0].isspace(), w[-1:].isspace(), self._bytes(" " + w)
            else:
                new.append(i)
        for start in range(0, len(new), at_once):
            some = new[start : start + at_once]
            for i, ids in zip(some, self._learned([found[i] for i in some])):
                got[i] = ids
        begins, ends = before[number], behind[number]
        begins[first], ends[last] = False, False
        whole = np.logical_or.reduceat(begins | ends, first)
        for s in self.specials:
            whole |= pc.match_substring(texts, s).fill_null(False).to_numpy(zero_copy_only=False)
        # The first words have no space before them; a text that is encoded whole stands where its first word does.
        firsts = [self._bytes(found[i]) for i in number[first].tolist()]
        for i in np.flatnonzero(whole).tolist():
            firsts[i] = self.packed(texts[i].as_py())
        none = len(found) + len(firsts)
        number[np.repeat(whole, last - first + 1)] = none
        number[first] = len(found) + np.arange(len(firsts))
        number, at = np.insert(number, at[1:], none + 1), at + np.arange(len(at))
        ids = pa.array([*got, *firsts, b"", end], pa.large_binary()).take(pa.array(number))
        self.words.update((found[i], got[i]) for i in new if len(found[i]) < 32)
        self._forget()
        _, bounds, data = ids.buffers()
        cuts = np.frombuffer(bounds, np.int64)[at + ids.offset]
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(cuts), data or pa.py_buffer(b"")])

    def _forget(self) -> None:
        """Words that came late go, since what is common came early."""
        if len(self.words) > self.cached:
            for w in [*islice(self.words, self.cached // 2, None)]:
                del self.words[w]

    def packed(self, text: str) -> bytes:
        """The ids of a text, as little-endian integers of self.kind."""
        if any(s in text for s in self.specials):
            if self.library is None:
                from tokenizers import Tokenizer

                self.library = Tokenizer.from_file(self.path)
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()
        if BESIDE_BLANK.search(text) or text[:1] == " " or text[-1:] == " ":
            return self._bytes(text)
        first, *rest = text.split(" ")
        words, got = self.words, [self._bytes(first)]
        for w in rest:
            ids = words.get(w)
            if ids is None:
                ids = self._bytes(" " + w)
                if len(w) < 32 and not w[-1].isspace():
                    words[w] = ids
            got.append(ids)
        self._forget()
        return b"".join(got)
