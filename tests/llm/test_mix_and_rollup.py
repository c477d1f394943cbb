import random
import uuid
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sitequarry.llm import source_mix, token_rollup
from sitequarry.llm.common import materialised, shared_folder, words_of
from sitequarry.llm.tokens import ByteBpe, public_path


def targets(sizes, weights=(5, 2, 1), cap=3):
    """Excess reshared by weight until none is above, source by source."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(cap * sizes[s] for s in full)
        open_ = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in full else share[s] for s in names}
        full |= over


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_mix_meets_its_targets(request, name):
    docs = request.getfixturevalue(name)
    rows = source_mix.mix(docs, shard_words=2000).collect()
    texts = docs.select("doc_id", "text", "source").collect()
    assert sorted(r["size"] for r in rows) == sorted(len(words_of(t.text)) for t in texts)
    sizes = defaultdict(int)
    for t in texts:
        sizes[t.source] += len(words_of(t.text))
    want = targets(sizes)
    assert {round(r.target, 6) for r in rows} <= {round(x, 6) for x in want.values()}
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    if name == "documents":
        source = {t.doc_id: t.source for t in texts}
        taken = Counter()
        for r in rows:
            taken[source[r.doc_id]] += r.taken
            assert r.target == pytest.approx(want[source[r.doc_id]])
        assert all(taken[s] == pytest.approx(want[s], abs=1) for s in want)


def test_capped_sources_and_reruns(spark):
    rows = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 10), ("b", 5000), ("b", 40), ("c", 3000), ("d", 2), (None, 700)])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = sorted(map(tuple, source_mix.mix(docs).select("doc_id", "target", "taken").collect()))
    assert first == sorted(map(tuple, source_mix.mix(docs.repartition(3)).select("doc_id", "target", "taken").collect()))
    want = targets({"a": 10, "b": 5040, "c": 3000, "d": 2, None: 700})
    assert [t for _, t, _ in first] == pytest.approx([want[s] for s in ("a", "b", "b", "c", "d", None)])
    assert first[0][2] <= 30 and first[4][2] <= 6


def test_seats_are_those_of_the_highest_quotients():
    rng = random.Random(1)
    for _ in range(50):
        votes, seats = [rng.randint(1, 500) for _ in range(rng.randint(1, 8))], rng.randint(0, 60)
        best = sorted(((v / (2 * s + 1), -i) for i, v in enumerate(votes) for s in range(seats)), reverse=True)[:seats]
        assert source_mix.seats_by_quotient(votes, seats) == [sum(-i == k for _, i in best) for k in range(len(votes))]


def test_source_seats_agree_with_quotients(spark):
    rng = random.Random(2)
    for _ in range(3):
        votes = [float(rng.randint(1, 40) * 10) for _ in range(9)]
        df = spark.createDataFrame([(f"s{i}", v) for i, v in enumerate(votes)], "source_key string, target double")
        got = [r.seats for r in source_mix.source_seats(df, 101).orderBy("source_key").collect()]
        assert got == source_mix.seats_by_quotient(votes, 101)


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_drawn_texts_hold_the_words_taken(request, name):
    docs = materialised(request.getfixturevalue(name).select("doc_id", "text", "lang", "source").withColumn("row", F.monotonically_increasing_id()))
    rows = source_mix.mix(docs, row_col="row", shard_words=3000)
    texts = source_mix.mixed_texts(docs, rows)
    count = lambda x: sorted((str(k), n) for k, n in x.items() if n)
    got, want = Counter(), Counter()
    for r in texts.collect():
        got[r.doc_id] += len(words_of(r.text))
        assert r.n_chars == len(r.text)
    for r in rows.collect():
        want[r.doc_id] += r.taken
    assert count(got) == count(want)


def test_small_sources_meet_their_targets(spark):
    """A hundred sources of about twenty words and a large one: each within a word of its target, or of three times its size."""
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(1, 12), f"s{i % 100:03}") for i in range(300)] + [(1000 + i, "w " * 60, "big") for i in range(100)]
    out = source_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), shard_words=500).collect()
    source, taken, sizes = {i: s for i, _, s in rows}, Counter(), Counter()
    for r in out:
        taken[source[r.doc_id]] += r.taken
        sizes[source[r.doc_id]] += r["size"]
        assert r.taken <= 3 * r["size"]
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sum(taken.values()) == sum(sizes.values())


def test_rows_without_an_id_are_drawn_each_for_itself(spark):
    rows = [(None, " ".join(f"d{i}w{k}" for k in range(200 + i)), "en", "s" if i % 3 else "t") for i in range(60)]
    docs = materialised(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("row", F.monotonically_increasing_id()))
    mix = source_mix.mix(docs, row_col="row", shard_words=2000)
    texts = [words_of(r.text) for r in source_mix.mixed_texts(docs, mix).collect()]
    assert sum(map(len, texts)) == mix.agg(F.sum("taken")).first()[0] == sum(200 + i for i in range(60))
    assert all(len({w.split("w")[0] for w in t}) == 1 for t in texts)
    assert max(Counter(w for t in texts for w in t).values()) <= 3


@pytest.mark.parametrize("words,quota,block", [(100, 0, 32), (100, 37, 32), (100, 99, 32), (100, 100, 32), (100, 250, 32), (100, 300, 32), (7, 5, 32), (64, 33, 32), (1000, 977, 10)])
def test_a_draw_takes_its_quota_in_whole_blocks(words, quota, block):
    for offset in range(max(1, words // block)):
        times = source_mix.times_taken(0, words, quota, words, offset, block)
        assert times.sum() == quota and times.max() - times.min() <= 1
        assert [*times[40:60]] == [*source_mix.times_taken(40, 20, quota, words, offset, block)][: max(0, words - 40)] or words < 60
        extra = times - times.min()
        whole = extra[: words // block * block].reshape(-1, block).sum(1)
        assert ((whole != 0) & (whole != block)).sum() <= 1


def test_mix_of_nothing(none):
    assert source_mix.mix(none).count() == 0


def test_rollup_equals_a_recount(spark, documents):
    path = public_path("byte_bpe_50k.json")
    rows = token_rollup.counted(documents, {"v1": path}).cache()
    rollup = token_rollup.TokenRollup(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    assert rollup.totals().count() == 0
    assert rollup.commit("1", token_rollup.inserts(rows))
    changed = rows.where("tokens <> revised_tokens")
    assert rollup.commit("2", token_rollup.revisions(changed, changed, "tokens", "revised_tokens"))
    assert not rollup.commit("2", token_rollup.revisions(changed, changed, "tokens", "revised_tokens"))
    assert rollup.commit("3", token_rollup.copies(rows, "revised_tokens"))
    assert rollup.commit("4", token_rollup.deletes(rows.where("doc_id = 0"), "revised_tokens"))
    bpe, want, seen = ByteBpe(path), defaultdict(lambda: [0, 0]), set()
    for r in documents.orderBy("doc_id").collect():
        if r.text in seen or seen.add(r.text) or r.doc_id == 0:
            continue
        want[(r.source, r.lang)][0] += 1
        want[(r.source, r.lang)][1] += len(bpe.packed(token_rollup.without_repeated_lines(r.text or ""))) // bpe.kind.itemsize
    assert {(r.source, r.lang): [r.docs, r.tokens] for r in rollup.totals().collect()} == dict(want)


def test_rollup_of_odd_rows(spark, odd, none):
    path = public_path("byte_bpe_50k.json")
    rollup = token_rollup.TokenRollup(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    rollup.commit("none", token_rollup.inserts(token_rollup.counted(none, {"v1": path})))
    rows = token_rollup.counted(odd, {"v1": path})
    rollup.commit("in", token_rollup.inserts(rows))
    assert rollup.totals().agg(F.sum("docs")).first()[0] == odd.count()
    rollup.commit("out", token_rollup.deletes(rows))
    assert rollup.totals().count() == 0
