import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sitequarry.llm import merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(r, text):
    return sha(*map(encoded, (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(nodes, arity):
    """The root, and for each node the text left and right of it in its run, level by level."""
    paths, at = [[] for _ in nodes], [*range(len(nodes))]
    while len(nodes) > 1:
        for i, own in enumerate(at):
            s = own - own % arity
            paths[i].append(("".join(nodes[s:own]), "".join(nodes[own + 1 : s + arity])))
        at, nodes = [x // arity for x in at], [sha(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
    return nodes[0], paths


def brute_force(rows, arity=3):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of every row, sorted."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    groups = [sorted(by[k], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text))) for k in sorted(by, key=lambda k: (k is not None, (k or "").encode()))]
    trees = [tree([leaf(r, r.text) for r in g], arity) for g in groups]
    root, crown = tree([t[0] for t in trees], arity) if trees else (None, [])
    out = []
    for g, (subroot, paths), above in zip(groups, trees, crown):
        for r, path in zip(g, paths):
            text = r.text.replace("\n", "") if r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 else r.text
            node = leaf(r, text)
            for left, right in path + above:
                node = sha(left, node, right)
            out.append((r.doc_id, leaf(r, r.text), subroot, root, sha(*[a + b for a, b in path + above]), node, node == root))
    return sorted(out, key=str)


def checked(docs, **kw):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return sorted(map(tuple, merkle.tamper_check(docs, even, F.replace("text", F.lit("\n"), F.lit("")), **kw).collect()), key=str)


def test_query_equals_brute_force(spark, documents):
    assert checked(documents) == brute_force(documents.collect())


@pytest.mark.parametrize("arity, every", [(2, 1), (3, 2), (5, 3)])
def test_other_shapes(spark, documents, arity, every):
    assert checked(documents, arity=arity, every=every) == brute_force(documents.collect(), arity)


def test_odd_rows(spark, odd, none):
    """Nulls, empties, long texts, rows of one id, equal rows, clashing columns; an empty table."""
    more = odd.withColumns({c: F.lit(1) for c in ("grp", "idx", "node", "row", "at", "member", "path", "root")})
    got, rows = checked(more), odd.collect()
    want = brute_force(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want] and {g[4] for g in got} == {w[4] for w in want}
    assert got == want
    assert checked(none) == [] and merkle.build(none).root().count() == 0


def test_one_row_and_one_group(spark):
    docs = spark.createDataFrame([(1, "a\nb", "en", "s", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert checked(docs) == brute_force(docs.collect())
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("x\n").alias("text"), F.lit(None).cast("string").alias("lang"), F.when(F.col("id") > 0, "hot").alias("source"), F.lit(2).cast("long").alias("n_chars"))
    assert checked(many) == brute_force(many.collect())


def test_equal_rows_in_number(spark):
    """Rows that are equal in all columns are leaves each, and every one of them has its own place."""
    docs = spark.range(300).select(F.lit(7).cast("long").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    assert checked(docs) == brute_force(docs.collect())


def test_stored_levels_and_proofs_of_some(spark, documents):
    """Only every fourth level is stored; a manifest can be opened again; proofs of some rows are those of all."""
    built = merkle.build(documents)
    again = merkle.opened(spark, built.folder)
    most = documents.groupBy("source").count().agg(F.max("count")).first()[0]
    assert len(again.groups) == (1 if most <= 81 else 2) and again.groups[0].select(F.max(F.size("members"))).first()[0] <= 81
    plain = lambda df: sorted((r.member.id, r.member.node, tuple(map(tuple, r.path)), r.root) for r in df.collect())
    ids = documents.where("doc_id % 9 = 0").select(F.col("doc_id").alias("id"))
    wanted = {r.id for r in ids.collect()}
    every = plain(built.proofs())
    assert plain(again.proofs(ids)) == [x for x in every if x[0] in wanted] and {again.root().first()[0]} == {x[3] for x in every}
    assert sorted(map(tuple, again.subroots().collect())) == sorted({(r.group, r.subroot) for r in built.proofs().collect()})
