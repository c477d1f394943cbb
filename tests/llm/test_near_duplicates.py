import hashlib

import numpy as np
import pytest
import xxhash

from sitequarry.llm import simhash, suffix_dedup
from sitequarry.llm.components import components


def fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_simhash_components_equal_brute_force(request, name):
    docs = request.getfixturevalue(name)
    got = simhash.near_duplicates(docs).collect()
    rows = [(r.doc_id, fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    prints = sorted({f for _, f in rows})
    up = roots(prints, [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4])
    least = {}
    for d, f in rows:
        if d is not None:
            least[up[f]] = min(least.get(up[f], d), d)
    want = sorted([(d, f"{f:016x}", least.get(up[f])) for d, f in rows], key=str)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == want


def test_pigeonring_loses_no_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    prints = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(8):
            x = b
            for bit in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), 4, block=500).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 4 for r in found)
    want = roots(prints, [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4])
    got = roots(prints, [(r.a & mask, r.b & mask) for r in found])
    assert got == want


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_a_bucket_of_many_near_fingerprints(spark, block):
    """Thousands of different fingerprints that share segments, in clusters that are near, and not so near, to each other."""
    rng = np.random.default_rng(8)
    base = int(rng.integers(0, 1 << 63))
    prints = set()
    for c in range(12):
        centre = base ^ sum(1 << int(b) for b in rng.choice(26, c % 7, replace=False))
        for _ in range(120):
            prints.add(centre ^ sum(1 << int(b) for b in rng.choice(np.arange(30, 64), rng.integers(0, 4), replace=False)))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.links(spark.createDataFrame([(p,) for p in signed], "print long"), 4, block=block).collect()
    mask = (1 << 64) - 1
    assert all(((r.a ^ r.b) & mask).bit_count() <= 4 for r in found) and len(found) < 9 * len(prints)
    x = np.array(prints, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(x[:, None] ^ x[None]) <= 4, 1))
    assert roots(prints, [(r.a & mask, r.b & mask) for r in found]) == roots(prints, [(prints[i], prints[j]) for i, j in near.tolist()])


def test_pieces_of_batches_hold_whole_keys():
    import pyarrow as pa

    from sitequarry.llm.blocks import whole_keys

    rng = np.random.default_rng(2)
    keys = np.sort(np.concatenate([rng.integers(0, 40, 300), np.full(200, 50), np.full(3, 60)]))
    for cuts in ([], [5, 5, 40], [*range(0, 503, 7)], [290, 310, 350, 420, 500, 501]):
        batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], names=["k", "v"]) for k, v in zip(np.split(keys, cuts), np.split(np.arange(503), cuts))]
        pieces = [*whole_keys(batches)]
        assert np.concatenate([p[1] for p in pieces]).tolist() == [*range(503)]
        seen = [k for p in pieces for k in set(p[0].tolist())]
        assert len(seen) == len(set(seen))


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}}


def spans_by_force(rows, length=50):
    first = {}
    for i, t in rows:
        for k in range(len(t) - length + 1):
            first[t[k : k + length]] = min(first.get(t[k : k + length], i), i)
    for i, t in rows:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if first[t[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        yield i, len(t), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("name,block,k", [("documents", 60_000, 20), ("documents", 1 << 22, 32), ("odd", 2000, 20), ("odd", 1 << 20, 8)])
def test_removed_suffixes_equal_brute_force(request, name, block, k):
    docs = request.getfixturevalue(name)
    rows = [(-(1 << 63) if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in docs.select("doc_id", "text").collect()]
    got = suffix_dedup.dedup(docs, block_bytes=block, k=k, with_text=True, carry=("lang",)).collect()
    have = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert have == sorted(spans_by_force(rows))
    assert all(sum(s.end - s.first for s in r.spans) == r.n_removed for r in got)


def random_text(rng, words, n):
    return " ".join(words[i] for i in rng.integers(0, len(words), n).tolist())


@pytest.mark.parametrize("chunk,busy", [(1 << 10, 64), (200, 1), (1 << 18, 0)])
def test_texts_longer_than_a_chunk_and_busy_triggers(spark, chunk, busy):
    """Passages that lie across the borders of pieces, in every place; triggers whose phrases are cut to single suffixes."""
    rng = np.random.default_rng(1)
    words = ["".join(map(chr, rng.integers(97, 107, 6))) for _ in range(400)]
    text, shared = random_text(rng, words, 700), random_text(rng, words, 40)
    rows = [(1, text), (2, "zz " + text[300:4200] + " yy"), (3, text[::-1]), (4, "q" * 3000), (5, "p" * 90 + "q" * 2100), (6, "a" * 5000), (6, "a" * 5000)]
    rows += [(10 + i, random_text(rng, words, i) + shared + random_text(rng, words, 60 + i)) for i in range(40)] + [(None, shared * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_dedup.dedup(docs, block_bytes=9000, range_bytes=20_000, busy=busy, chunk_bytes=chunk).collect()
    have = sorted((-(1 << 63) if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert have == sorted(spans_by_force([(-(1 << 63) if i is None else i, t.encode()) for i, t in rows]))


def test_suffixes_of_a_slice_are_sorted_by_their_bytes():
    passes = suffix_dedup.Passes(50, 20, 3, 64, 1 << 18)
    rng = np.random.default_rng(5)
    phrases = [bytes(rng.integers(0, 3, 60).astype(np.uint8)) for _ in range(30)]
    phrases += [phrases[0][5:] + b"xyz", b"\0" * 55, b"\0" * 60]
    joined = np.frombuffer(b"".join(phrases) + bytes(8), np.uint8)
    size = np.array([len(p) for p in phrases])
    at, count, least = np.cumsum(size) - size, size - 49, np.arange(len(phrases))[::-1].copy()
    flat = [(p[i : i + 50], d) for p, d in zip(phrases, least.tolist()) for i in range(len(p) - 49)]
    words = suffix_dedup.big_endian(joined, suffix_dedup.spread(at, count), 50)
    assert [flat[i][0] for i in np.lexsort(words[::-1])] == sorted(s for s, _ in flat)
    want = [any(s == x and e < d for x, e in flat) for s, d in flat]
    assert passes._suffix_array(joined, at, count, least).tolist() == want


def test_nothing(none):
    assert simhash.near_duplicates(none).count() == 0
    assert suffix_dedup.dedup(none).count() == 0
