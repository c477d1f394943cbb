"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model with Dirichlet smoothing: p(w | h) = (c(hw) + mass * p(w | h')) / (c(h) + mass), where h' is h without
its first token and the last resort is p(w) = (c(w) + 1) / (N + V + 1). As an automaton: a state is a context that was
seen in training; an arc is a seen n-gram with its smoothed log-probability, and leads to the longest seen context that
ends there; a failure arc leads to the next shorter context and weighs log(mass / (c(h) + mass)). The root has an arc for
every token, seen or not. A text is read once from left to right: the traversal carries its state, takes failure arcs until an arc for
the token is found, and adds up the weights.

Counts are over all training documents. They grow with the corpus, so they are never in one place: each block of
documents asks the ranges of n-gram keys for the totals of its own different n-grams (see blocks.py), handing in its own
training counts with the question, and builds the part of the automaton that its texts can reach.

n-grams are known by 64-bit hashes, chained from those of their words. Tokens: words of the text with A-Z lower-cased, then one end.

Defined results: null texts are empty (the end alone); a null id is hashed as the empty text; repeated rows each
train and score; an empty training set gives every token 1 / (N + V + 1) with N = V = 0; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import by_block, by_range, from_planes, give_back, planes, ranges_of, split_ranges

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
BEGIN, END = 0, 1  # token numbers; words follow
ASKED = "range int, block int, keys binary, counts binary"
TOLD = "block int, range int, counts binary, tokens long, words long"


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Grams:
    """The tokens of a block and its n-grams. At a place, gram m is that of the m tokens that end there."""

    def __init__(self, texts: list[str | None], order: int):
        number: dict[bytes, int] = {}
        tokens, self.length = [], []
        for text in texts:
            words = (text or "").encode().lower().split()
            tokens.append(BEGIN)
            tokens += [number.setdefault(w, len(number) + 2) for w in words]
            tokens.append(END)
            self.length.append(len(words) + 1)
        self.tokens, self.order = np.array(tokens, np.int64), order
        self.doc = np.repeat(np.arange(len(texts)), np.array(self.length, np.int64) + 1)
        first = np.flatnonzero(self.tokens == BEGIN)
        self.depth = np.arange(len(self.tokens)) - first[self.doc] if len(texts) else np.zeros(0, np.int64)
        words = np.array([11, 13, *(xxhash.xxh64_intdigest(w) for w in number)], np.uint64)
        self.kinds = len(words)
        hashed = _mixed(words)[self.tokens]
        # kind[m][i]: the number of gram m at place i among the different ones (-1 where the text is shorter); key[m]: their keys, whose last two bits tell the order (0: begin)
        self.kind, self.key, self.at = [], [], []
        chained, place = hashed, np.arange(len(self.tokens))
        for m in range(1, order + 1):
            there = self.depth >= m - 1
            if m > 1:
                prefix = np.concatenate([[np.uint64(0)], chained[:-1]])
                chained = _mixed(prefix * np.uint64(0x9FB21C651E98DF25) + hashed + np.uint64(m))
            low = np.where(self.depth == 0, 0, 1) if m == 1 else min(m, 3)
            keys = (chained & ~np.uint64(3)) | np.asarray(low).astype(np.uint64)
            unique, at, inverse = np.unique(keys[there], return_index=True, return_inverse=True)
            kind = np.full(len(self.tokens), -1)
            kind[there] = inverse
            self.kind.append(kind)
            self.key.append(unique)
            self.at.append(place[there][at])

    def all_keys(self) -> tuple[np.ndarray, np.ndarray]:
        """All keys in one sorted array, and where each order's keys went."""
        joined = np.concatenate(self.key)
        order = np.argsort(joined)
        return joined[order], order

    def counts(self, trained: np.ndarray) -> np.ndarray:
        """How often each key occurs in the documents that are trained on, in the order of the joined keys."""
        used = trained[self.doc] if len(self.doc) else np.zeros(0, bool)
        return np.concatenate([np.bincount(kind[used & (kind >= 0)], minlength=len(key)) for kind, key in zip(self.kind, self.key)])


class BackoffAutomaton:
    """The part of the automaton that a block's texts can reach. count: for each order, the totals of its grams."""

    def __init__(self, grams: Grams, count: list[np.ndarray], tokens: int, words: int, mass: float):
        order = grams.order
        n = len(grams.tokens)
        first_state = np.cumsum([1, *map(len, grams.key[: order - 1])])  # root is 0
        seen = [(grams.kind[m] >= 0) & (count[m][grams.kind[m]] > 0) for m in range(order)]

        def state(at: np.ndarray, longest: int) -> np.ndarray:
            """The longest seen context of at most so many tokens that ends at each place."""
            out = np.zeros(len(at), np.int64)
            for m in range(min(longest, order - 1)):
                out = np.where(seen[m][at], first_state[m] + grams.kind[m][at], out)
            return out

        self.stride = grams.kinds
        self.failure_to = np.zeros(first_state[-1], np.int64)
        self.failure = np.zeros(first_state[-1])
        keys, weights, leads = [], [], []
        p = (count[0] + 1.0) / (tokens + words + 1.0)
        for m in range(order):
            at = grams.at[m]
            if m:
                context = grams.kind[m - 1][at - 1]
                p = (count[m] + mass * p[grams.kind[m - 1][at]]) / (count[m - 1][context] + mass)
                some = np.flatnonzero(count[m] > 0)
                source = first_state[m - 1] + context[some]
            else:
                some, source = np.arange(len(at)), 0
            keys.append(source * self.stride + grams.tokens[at[some]])
            weights.append(np.log10(p[some]))
            leads.append(state(at[some], m + 1))
            if m < order - 1:
                here = slice(first_state[m], first_state[m + 1])
                self.failure_to[here] = state(at, m)
                self.failure[here] = np.log10(mass / (count[m] + mass))
        keys = np.concatenate(keys)
        self.arcs = dict(zip(keys.tolist(), range(len(keys))))
        self.weight, self.lead = np.concatenate(weights).tolist(), np.concatenate(leads).tolist()
        self.failure, self.failure_to = self.failure.tolist(), self.failure_to.tolist()
        self.start = int(state(np.flatnonzero(grams.tokens == BEGIN)[:1], 1)[0]) if n else 0

    def score(self, tokens: list[int]) -> float:
        """Log-probability of tokens, in one traversal."""
        arcs, weight, lead, failure, failure_to, stride = self.arcs.get, self.weight, self.lead, self.failure, self.failure_to, self.stride
        state, total = self.start, 0.0
        for t in tokens:
            arc = arcs(state * stride + t)
            while arc is None:
                total += failure[state]
                state = failure_to[state]
                arc = arcs(state * stride + t)
            total += weight[arc]
            state = lead[arc]
        return total


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 2, mass: float = 100.0, block_bytes: int = 5 << 20, range_bytes: int = 12 << 20) -> DataFrame:
    """Scores of every text under a model of the texts that aren't held out."""
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks, n_blocks = by_block(read, block_bytes)
    ranges = ranges_of(n_blocks, block_bytes, range_bytes)

    def ask(table: pa.Table) -> pa.Table:
        grams = Grams(table.column("text").to_pylist(), order)
        keys, place = grams.all_keys()
        counts = grams.counts(np.array([not held_out(i) for i in table.column("doc_id").to_pylist()]))[place].astype("<u4")
        parts = dict(split_ranges(keys, ranges, 64))
        none = slice(0, 0)  # every range is asked, so that each block learns the totals of all
        slices = [parts.get(r, none) for r in range(ranges)]
        block = table.column("block")[0].as_py()
        return pa.table([pa.array(range(ranges), pa.int32()), pa.array([block] * ranges, pa.int32()), pa.array([planes(keys[s]) for s in slices], pa.binary()), pa.array([planes(counts[s]) for s in slices], pa.binary())], names=["range", "block", "keys", "counts"])

    def tell(table: pa.Table) -> pa.Table:
        keys = [from_planes(x, np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([from_planes(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.int64)
        unique, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(unique), np.int64)
        np.add.at(total, inverse, counts)
        words = (unique & np.uint64(3)) == 1
        own, n, v = table.column("range")[0].as_py(), int(total[words].sum()), int((total[words] > 0).sum())
        told = total[inverse].astype("<u4" if not len(total) or total.max() < 1 << 32 else "<u8")
        cuts = np.cumsum([0, *map(len, keys)])
        m = len(keys)
        return pa.table([table.column("block"), pa.array([own] * m, pa.int32()), pa.array([planes(told[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()), pa.array([n] * m, pa.int64()), pa.array([v] * m, pa.int64())], names=["block", "range", "counts", "tokens", "words"])

    def read_through(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("doc_id").to_pylist()
        grams = Grams(left.column("text").to_pylist(), order)
        keys, place = grams.all_keys()
        parts, total = dict(split_ranges(keys, ranges, 64)), np.zeros(len(keys), np.int64)
        for r, told in zip(right.column("range").to_pylist(), right.column("counts").to_pylist()):
            if r in parts:
                n = parts[r].stop - parts[r].start
                total[parts[r]] = from_planes(told, "<u4" if len(told) == 4 * n else "<u8")
        by_order = np.empty(len(keys), np.int64)
        by_order[place] = total
        count = np.split(by_order, np.cumsum([*map(len, grams.key)])[:-1])
        tokens, words = sum(right.column("tokens").to_pylist()), sum(right.column("words").to_pylist())
        automaton = BackoffAutomaton(grams, count, tokens, words, mass)
        seen = count[0][grams.kind[0]]
        read = grams.depth > 0
        ends = np.array(grams.length, np.int64)
        known = np.bincount(grams.doc[read], seen[read] > 0, len(ids)).astype(np.int64)
        base = np.bincount(grams.doc[read], np.log10(seen[read] + 1.0), len(ids)) - ends * np.log10(tokens + words + 1.0)
        begin = np.cumsum(ends + 1) - ends
        all_tokens = grams.tokens.tolist()
        scores = [automaton.score(all_tokens[a : a + n]) for a, n in zip(begin.tolist(), grams.length)]
        del automaton, all_tokens, keys, place, by_order
        give_back()
        return pa.table([left.column("doc_id"), pa.array([held_out(i) for i in ids], pa.bool_()), pa.array(grams.length, pa.int64()), pa.array(known), pa.array([tokens] * len(ids), pa.int64()), pa.array(base, pa.float64()), pa.array(scores, pa.float64())], names=[x.split()[0] for x in RESULT.split(", ")])

    asked = blocks.groupBy("block").applyInArrow(lambda t: ask(t), ASKED)
    told = by_range(asked, ranges).groupBy("range").applyInArrow(lambda t: tell(t), TOLD)
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(read_through, RESULT)
