import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitequarry.llm import curve_packing, edit_fingerprint, tokens


def edited_texts(rows):
    rows = sorted(rows, key=lambda r: (-(1 << 63) if r[0] is None else r[0], hashlib.sha256((r[1] or "").encode()).hexdigest()))
    out = []
    for n, (i, t) in enumerate(rows):
        t, following = t or "", rows[(n + 1) % len(rows)][1] or ""
        q = len(t) // 4
        out.append((i, len(t), hashlib.sha256((t[: len(t) - q] + following[:q]).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_edited_texts_equal_brute_force(request, name):
    docs = request.getfixturevalue(name)
    got = edit_fingerprint.fingerprints(docs).collect()
    want = edited_texts([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)


def test_likeness_tells_edits_from_other_texts(documents):
    rows = edit_fingerprint.fingerprints(documents).toPandas()
    long = rows[rows.n_chars > 200]
    assert long.near_edited.mean() > 0.65 and long.near_next.mean() < 0.2
    assert (long.near_edited > long.near_next).mean() > 0.97


def test_equal_texts_have_equal_fingerprints_and_empty_tables_none(documents, none):
    by_text = documents.join(edit_fingerprint.fingerprints(documents), "doc_id").groupBy("text").agg(F.countDistinct("fingerprint").alias("n"))
    assert by_text.where("n > 1").count() == 0
    assert edit_fingerprint.fingerprints(none).count() == 0


def test_walk_finds_its_way_back_after_an_insertion():
    walk = edit_fingerprint.EditWalk()
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(4000))
    other = text[:700] + "XYZ" + text[700:2500] + text[2510:]
    a, b = (walk.sample(t, walk.walk(t)) for t in (text, other))
    c = walk.sample(text[::-1], walk.walk(text[::-1]))
    assert edit_fingerprint.likeness(a, b) > 0.6 > 0.3 > edit_fingerprint.likeness(a, c)


def classes_by_force(rows, least=0.8):
    """rows of (doc_id, fingerprint): the smallest id reachable over pairs that agree in enough slots."""
    prints = sorted({p for _, p in rows if p is not None})
    marks = np.array([[*bytes.fromhex(p)] for p in prints])
    up = [*range(len(prints))]

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    links = 0
    for i in range(len(prints)):
        for j in np.flatnonzero((marks[i] == marks[:i]).mean(1) >= least).tolist():
            links += 1
            x, y = find(i), find(j)
            up[max(x, y)] = min(x, y)
    of = {p: find(i) for i, p in enumerate(prints)}
    head = {}
    for d, p in rows:
        if p is not None and d is not None:
            head[of[p]] = min(head.get(of[p], d), d)
    return sorted([(d, p, head.get(of[p]) if p is not None else None) for d, p in rows], key=str), links


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_classes_equal_brute_force(request, name):
    prints = edit_fingerprint.fingerprints(request.getfixturevalue(name)).select("doc_id", "fingerprint")
    got = edit_fingerprint.near_classes(prints).collect()
    want, links = classes_by_force([(r.doc_id, r.fingerprint) for r in prints.collect()])
    assert sorted([(r.doc_id, r.fingerprint, r.class_id) for r in got], key=str) == want and links


def test_recall_of_bands(spark):
    """Pairs that agree in 0.8 to 0.95 of their slots, at random places: nine tenths and more share a band; a large group of near ones is one class."""
    rng = np.random.default_rng(9)
    rows, agree = [], []
    for i in range(1500):
        a = rng.integers(0, 256, 64, dtype=np.uint8)
        b = a.copy()
        at = rng.choice(64, rng.integers(3, 13), replace=False)
        b[at] ^= np.uint8(1)
        rows += [(2 * i, a.tobytes().hex()), (2 * i + 1, b.tobytes().hex())]
        agree.append(1 - len(at) / 64)
    hub = rng.integers(0, 256, 64, dtype=np.uint8)
    for i in range(800):
        x = hub.copy()
        x[rng.choice(64, 4, replace=False)] = rng.integers(0, 256, 4)
        rows.append((10_000 + i, x.tobytes().hex()))
    rows += [(None, rows[0][1]), (7_000_000, None)]
    found = {r.doc_id: r.class_id for r in edit_fingerprint.near_classes(spark.createDataFrame(rows, "doc_id long, fingerprint string")).collect()}
    caught = np.array([found[2 * i + 1] == 2 * i for i in range(1500)])
    assert min(agree) < 0.82 and caught.mean() > 0.98 and caught[np.array(agree) < 0.83].mean() > 0.9
    assert all(found[10_000 + i] == 10_000 for i in range(800))
    assert found[None] == 0 and found[7_000_000] is None


def test_rows_of_one_id_spread_over_ranges(spark, documents):
    """A third without an id, a third all equal, and the rest: edited texts as by brute force, whatever the ranges."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, "the same text in many rows" if i % 3 == 1 else r.text) for i, r in enumerate(documents.orderBy("doc_id").collect())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = edit_fingerprint.fingerprints(docs, samples=4).collect()
    assert sorted([(r.doc_id, r.n_chars, r.edited_sha256) for r in got], key=str) == edited_texts(rows)


def test_cached_pieces_give_the_library_s_ids(documents, odd):
    from tokenizers import Tokenizer

    path = tokens.public_path("byte_bpe_50k.json")
    bpe, library = tokens.ByteBpe(path, cached=500), Tokenizer.from_file(path)
    texts = [r.text or "" for d in (documents, odd) for r in d.select("text").collect()] + [" a", "a ", "a  b", "a\n b", "don't 12 34!", "a  b", "x\u0085y z"]
    for t in texts:
        assert np.frombuffer(bpe.packed(t), bpe.kind).tolist() == library.encode(t, add_special_tokens=False).ids, t[:80]


@pytest.mark.parametrize("name", ["documents", "odd"])
def test_packing_is_an_exact_round_trip(request, name):
    docs = request.getfixturevalue(name)
    bpe = tokens.ByteBpe(tokens.public_path("byte_bpe_50k.json"))
    want = sorted((str(r.doc_id), zlib.crc32(np.append(np.frombuffer(bpe.packed(r.text or ""), bpe.kind), 0).astype("<u4").tobytes())) for r in docs.collect())
    rows = curve_packing.pack(docs).toPandas().sort_values(["sequence_id", "offset"])
    by = rows.groupby("sequence_id")
    sizes = by.length.sum()
    assert (sizes <= 1024).all() and ((sizes & (sizes - 1)) == 0).all()
    assert (rows.offset == by.length.cumsum() - rows.length).all()
    if name == "documents":  # ids are unique here, so pieces can be put together
        at = rows.sort_values(["doc_id", "start"])
        assert (at.start == at.groupby("doc_id").length.cumsum() - at.length).all()
        assert (at.groupby("doc_id").length.sum() == at.groupby("doc_id").doc_tokens.first()).all()
        whole = at[at.length == at.doc_tokens]
        assert {(str(d), c) for d, c in zip(whole.doc_id, whole.ids_crc32)} <= set(want)
    assert rows.length.sum() == sum(len(np.frombuffer(bpe.packed(r.text or ""), bpe.kind)) + 1 for r in docs.collect())


def test_pieces_follow_the_curve_and_rows_without_ids_spread(spark, documents):
    docs = documents.selectExpr("cast(null as long) as doc_id", "text").unionAll(documents.selectExpr("7 as doc_id", "'one text of many rows, all of one id' as text"))
    total = docs.selectExpr("sum(octet_length(text))").first()[0]
    rows = curve_packing.pack(docs, part_bytes=total // 8, sample=200).toPandas().sort_values(["sequence_id", "offset"])
    part = rows.sequence_id // (1 << 40)
    assert rows.place.diff().fillna(0).min() >= 0  # parts are ranges of the curve, and documents lie along it
    tokens_of = rows.groupby(part).length.sum()
    assert len(tokens_of) >= 7 and tokens_of.max() < 0.4 * tokens_of.sum()
    assert rows[rows.doc_id == 7].groupby(part).length.sum().size > 1  # the copies share a place, but not a task


def test_neighbours_on_the_curve_are_more_alike(documents):
    rows = curve_packing.pack(documents).toPandas().drop_duplicates("doc_id").sort_values(["sequence_id", "offset"])
    texts = {r.doc_id: set((r.text or "").lower().split()) for r in documents.collect()}
    like = lambda ids: np.mean([len(a & b) / max(1, len(a | b)) for a, b in ((texts[x], texts[y]) for x, y in zip(ids, ids[1:]))])
    along = rows.doc_id.tolist()
    assert like(along) > 1.3 * like(np.random.default_rng(1).permutation(along).tolist())


def test_packing_nothing(none):
    assert curve_packing.pack(none).count() == 0


def test_hilbert_neighbours_touch():
    cells = np.array([[x, y, z] for x in range(8) for y in range(8) for z in range(8)])
    order = cells[np.argsort(curve_packing.hilbert_index(cells, 3))]
    assert sorted(curve_packing.hilbert_index(cells, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()
