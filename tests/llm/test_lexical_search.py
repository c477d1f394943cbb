import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitequarry.llm import lexical_search as search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_force(docs, items, k=10):
    """(item_id, rank, doc_id, score) from rows (id, text), every document scored for every item."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    having = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * having[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def ranked(docs, items, **kw):
    return sorted(map(tuple, search.rank(docs, items, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def benchmark(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


@pytest.mark.parametrize("kw", [{}, {"bucket_bytes": 4000, "k": 3}, {"block_bytes": 2000, "bucket_bytes": 20_000}, {"prune": False}])
def test_equals_brute_force(spark, documents, benchmark, kw):
    """Whatever the size of buckets and blocks, and with bounds or without."""
    want = brute_force([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in benchmark.collect()], kw.get("k", 10))
    assert ranked(documents, benchmark, **kw) == want


def test_odd_rows(spark, odd, none, benchmark):
    """Nulls, empties, blanks, long texts, repeated rows and items, null ids, clashing columns; empty tables on either side."""
    more = odd.withColumns({c: F.lit("x") for c in ("row", "n", "ids", "tfs", "norm", "part", "item", "item_id", "score")})
    asked = [(1, "alpha Beta alpha"), (1, "alpha Beta alpha"), (2, None), (3, ""), (None, "ÜBER über tail"), (4, "nowhere at all"), (5, "é" * 70), (6, "x the " * 300)]
    items = spark.createDataFrame([(*r, 0) for r in asked], "item_id long, text string, doc_id int")
    assert ranked(more, items) == brute_force([(r.doc_id, r.text) for r in odd.collect()], asked)
    assert ranked(none, benchmark) == [] and ranked(odd, items.limit(0)) == []
    assert ranked(odd, spark.createDataFrame([(1, "nowhere")], "item_id long, text string")) == []


def test_copies_are_ranked_by_id(spark):
    """A text that a third of all rows have: ties go by id, at every place of the ranking."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "common words here").otherwise(F.concat(F.lit("other text number "), F.col("id"))).alias("text"))
    items = spark.createDataFrame([(1, "words"), (2, "text 7"), (3, "here text")], "item_id long, text string")
    got = ranked(docs, items, bucket_bytes=3000)
    assert got == brute_force([(r.doc_id, r.text) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert [r[2] for r in sorted(got) if r[0] == 1] == [*range(0, 30, 3)]


def vectors(rng, n, vocabulary, most):
    """Sparse impact vectors, sorted by norm, longest first."""
    rows = [np.sort(rng.choice(vocabulary, int(rng.integers(1, most)), replace=False)) for _ in range(n)]
    impacts = [rng.integers(1, 1000, len(r)) * (1 + int(rng.integers(0, 30)) ** 2) for r in rows]
    norms = np.array([math.sqrt(float((x.astype(float) ** 2).sum())) for x in impacts])
    order = np.argsort(-norms)
    return [rows[i] for i in order], [impacts[i] for i in order], norms[order]


def run(items, vocabulary, data, size, prune):
    out = search.Search(items, vocabulary, 5, np.ones(len(items.ids), np.int64), prune)
    rows, impacts, norms = data
    for a in range(0, len(rows), size):
        own = rows[a : a + size]
        starts = np.concatenate([[0], np.cumsum([len(r) for r in own])])
        places = np.arange(a, a + len(own))
        out.add(search.Bucket(places, places, norms[a : a + size], starts, np.concatenate(own), np.concatenate(impacts[a : a + size])))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_bounds_lose_nothing_and_prune(seed):
    """Bounds give the rows of a search without any, and look into fewer buckets and score fewer documents."""
    rng = np.random.default_rng(seed)
    items, _ = search.items_of([(i, " ".join(f"t{x}" for x in rng.integers(0, 200, 6))) for i in range(20)])
    data = vectors(rng, 2000, 200, 40)
    runs = [run(items, 200, data, 100, prune) for prune in (True, False)]
    assert runs[0].found().to_pylist() == runs[1].found().to_pylist()
    assert runs[0].looked < 0.75 * runs[1].looked and runs[0].scored < 0.3 * runs[1].scored


def test_large_counts_are_exact():
    n = np.array([3, 10**9, 5 * 10**10])
    assert search.length_factor(n, 10**10, 10**12).tolist() == [25 + 75 * int(x) * 10**10 // 10**12 for x in n]
