import random

import numpy as np
import pytest
from test_pipeline import heads_by_force, shingles

from sitequarry.llm import near_copies
from sitequarry.llm.common import materialised
from sitequarry.llm.simhash import simhash


def pair_of_sets(rng, n, both):
    pool = np.unique(rng.integers(0, 1 << 64, 2 * n + 8, dtype=np.uint64))
    pool = pool[rng.permutation(len(pool))]
    return np.sort(pool[:n]), np.sort(pool[n - both : 2 * n - both])


def test_wide_simhashes_tell_what_may_be_near():
    rng = np.random.default_rng(5)
    for n in (5, 9, 45, 300, 2000):
        for both, near in ((-(-8 * n // 9), True), (n // 2, False)):  # similarities of 0.8 and a third
            bits = []
            for _ in range(200):
                a, b = map(near_copies.wide_simhash, pair_of_sets(rng, n, both))
                bits.append(int(np.bitwise_count(a ^ b).sum()))
            most = near_copies.most_bits(np.array([n]), 0.8)[0]
            assert max(bits) <= most if near else np.mean(bits) > most or n < 40, (n, near, max(bits), most)
    a = pair_of_sets(rng, 700, 0)[0]
    assert near_copies.wide_simhash(a)[0] == simhash(a) and not near_copies.wide_simhash(a[:0]).any()


def nearly_similar(n):
    """Texts with one or two words of a common text changed: some pairs have a similarity of 0.8, most of 0.65 to 0.75."""
    rng, out = random.Random(11), []
    common = [f"w{rng.randrange(5000)}" for _ in range(100)]
    for i in range(n):
        words = [*common]
        for at in rng.sample(range(4, 96), 1 if i % 5 == 0 else 2):
            words[at] = f"changed{i}"
        out.append(" ".join(words))
    return out


@pytest.mark.parametrize("tile", [None, 16])
def test_a_group_of_nearly_similar_texts_makes_no_more_rows_than_texts(spark, monkeypatch, tile):
    texts = nearly_similar(120)
    sets, made = [shingles(x) for x in texts], []
    grades = [len(x & y) / len(x | y) for n, x in enumerate(sets) for y in sets[:n]]
    assert sum(j >= 0.8 for j in grades) > 100 and sum(j < 0.8 for j in grades) > 3000

    def counted(step):
        def run(*args, **kwargs):
            out = materialised(step(*args, **kwargs))
            made.append(out.count())
            return out

        return run

    monkeypatch.setattr(near_copies, "plausible", counted(near_copies.plausible))
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    kept = near_copies.one_of_each(docs, **({"tile": tile} if tile else {})).collect()
    assert sorted(r.doc_id for r in kept) == heads_by_force([*enumerate(texts)])
    assert made and max(made) < 4 * len(texts)  # a forest in each of a few tasks, of 7,000 pairs


def test_links_of_a_cluster_are_a_forest_that_connects_what_all_pairs_do():
    rng = np.random.default_rng(2)
    least, common = 0.8, np.sort(rng.integers(0, 1 << 64, 90, dtype=np.uint64))
    sets = [np.unique(np.concatenate([rng.permutation(common)[: rng.integers(78, 90)], rng.integers(0, 1 << 64, rng.integers(0, 8), dtype=np.uint64)])) for _ in range(90)]
    like = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))

    def groups(links):
        root = [*range(len(sets))]
        for a, b in links:
            root = [root[a] if r == root[b] else r for r in root]
        return {frozenset(i for i, r in enumerate(root) if r == k) for k in root}

    every = [(i, j) for i in range(len(sets)) for j in range(i) if like(sets[i], sets[j]) >= least - 1e-9]
    marks = np.arange(len(sets))
    sketch = np.stack([np.frombuffer(near_copies.sketch_of(x), np.uint8) for x in sets])
    found = near_copies.cluster_links(marks, marks, [x.tobytes() for x in sets], sketch, least)
    assert 1 < len(groups(every)) < len(sets) < len(every)
    assert groups(found) == groups(every) and len(found) == len(sets) - len(groups(every))
