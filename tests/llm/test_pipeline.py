import random

import numpy as np

import corpus_pipeline
from sitequarry.llm import near_copies, quality, suffix_dedup
from sitequarry.llm.common import materialised


def shingles(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def heads_by_force(rows, least=0.8) -> list:
    """rows of (id, text): the smallest id of each group that pairs of similar five-word shingles connect."""
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in ids if root[i] == i)


def test_stages_follow_each_other(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["quality classifier", "SimHash near-dedup", "suffix-array dedup", "mixing sources to target weights", "packing"]

    good = materialised(stages["quality classifier"](spark, docs, sf))
    assert good.columns == docs.columns
    kept = {r.doc_id for r in quality.classify(docs, labels).where("keep").collect()}
    assert {r.doc_id for r in good.collect()} == kept

    single = materialised(stages["SimHash near-dedup"](spark, good, sf))
    assert sorted(r.doc_id for r in single.collect()) == heads_by_force([(r.doc_id, r.text) for r in good.collect()])

    cut = materialised(stages["suffix-array dedup"](spark, single, sf))
    assert cut.columns == docs.columns
    removed = {r.doc_id: r for r in suffix_dedup.dedup(single, with_text=True).collect()}
    assert all(r.text == removed[r.doc_id].text and r.n_chars == len(r.text) for r in cut.collect())
    assert cut.count() == sum(r.n_removed == 0 or bool(r.text) for r in removed.values())

    mixed = materialised(stages["mixing sources to target weights"](spark, cut, sf))
    assert mixed.columns == docs.columns
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert all(line in texts[r.doc_id] for r in mixed.collect() for line in r.text.split("\n"))

    pieces = stages["packing"](spark, mixed, sf).toPandas()
    assert set(pieces.doc_id) == {r.doc_id for r in mixed.collect()}


def test_stages_take_odd_rows(spark, sf, odd, none):
    for docs in (odd, none):
        docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            docs = materialised(stage(spark, docs, sf))
        docs.count()


def test_near_copies_against_brute_force(spark, sf):
    """Texts with a few words changed, as pairs and as a chain, at similarities around 0.8 to 0.95."""
    rng = random.Random(7)
    texts = []
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        texts.append(words)
        for _ in range(4 if i % 10 == 0 else 1):
            words = [*words]
            for at in rng.sample(range(len(words)), max(1, round(len(words) * rng.uniform(0.004, 0.03)))):
                words[at] = "changed" + str(rng.randrange(1000))
            texts.append(words)
    rows = [(i * 3, " ".join(x), "en", "s", 1) for i, x in enumerate(texts)]
    rng.shuffle(rows)
    sets = [shingles(r[1]) for r in rows]
    grades = [len(x & y) / len(x | y) for n, x in enumerate(sets) for y in sets[:n]]
    assert sum(0.8 <= j < 0.95 for j in grades) > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_each_group(spark, docs, sf).collect()
    assert sorted(r.doc_id for r in kept) == heads_by_force([r[:2] for r in rows])


def test_rows_go_by_their_own_verdict_and_draw(spark, sf):
    """Null and repeated ids: each row is judged, grouped and drawn for itself."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    whole = quality.classify(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    verdict = {r.doc_id: r.keep for r in whole.select("doc_id", "keep").collect()}
    assert {*verdict.values()} == {True, False}
    texts = {r.doc_id: r.text for r in docs.collect()}
    # doc_id of a third is null, of another third 5; n_chars tells the rows apart. The labelled rows are copies with no id.
    odd = docs.selectExpr("case doc_id % 3 when 0 then null when 1 then 5 else doc_id end as doc_id", "text", "lang", "source", "doc_id as n_chars")
    good = corpus_pipeline.keep_good(spark, odd, sf)
    judged = quality.classify(odd, spark.read.parquet(f"{sf}/labels.parquet"), carry=("n_chars",))
    assert sorted(r.n_chars for r in good.collect()) == sorted(r.n_chars for r in judged.where("keep").collect())
    assert all(r.text == texts[r.n_chars] for r in good.collect())

    rng = random.Random(3)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    rows = [(None if i % 2 else 7, words(64), "en", f"s{i % 3}", 1) for i in range(90)]
    one = words(80)
    copies = [(None, one, "en", "s0", 1)] * 3 + [(9, one, "en", "s0", 1)] * 2
    made = spark.createDataFrame(rows + copies, "doc_id long, text string, lang string, source string, n_chars long")
    single = corpus_pipeline.one_of_each_group(spark, made, sf).collect()
    assert sorted(r.text for r in single) == sorted([one, *(r[1] for r in rows)])
    assert [r.doc_id for r in single if r.text == one] == [9]

    drawn = corpus_pipeline.mixed(spark, made.limit(90), sf).collect()
    most = {}
    for r in drawn:
        most[r.text.split("\n")[0].split(" ")[0]] = most.get(r.text.split("\n")[0].split(" ")[0], 0) + 1
    assert len(drawn) <= 3 * 90 and max(most.values()) <= 6  # at most 3 times each, in two blocks
    assert abs(sum(len(r.text.split()) for r in drawn) - 64 * 90) <= 64 * 9


def test_sketches_let_similar_sets_through_and_few_others():
    rng = np.random.default_rng(12)
    for n in (12, 60, 300, 1500, 9000):
        kept = {}
        for like in (0.8, 0.7, 0.6):
            x, y, exact = [], [], []
            for _ in range(400):
                both = round(n * 2 * like / (1 + like))  # of sets of n each
                pool = np.unique(rng.integers(0, 1 << 64, 2 * n, dtype=np.uint64))[rng.permutation(2 * n)]
                a, b = pool[:n], pool[n - both : 2 * n - both]
                exact.append(len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
                x.append(near_copies.bins_of(np.sort(a)))
                y.append(near_copies.bins_of(np.sort(b)))
            got = near_copies.may_reach(np.stack(x), np.stack(y), 0.8)
            kept[like] = got.mean(), np.mean(got[np.array(exact) >= 0.8]) if max(exact) >= 0.8 else 1.0
        assert kept[0.8][1] >= 0.99 and kept[0.6][0] < 0.02, (n, kept)
        assert kept[0.7][0] < 0.15 or n < 20, (n, kept)
