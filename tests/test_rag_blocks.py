import glob
import os

import numpy as np
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitequarry.operators import retrieval
from sitequarry.sources import shared


def test_chunks_are_dealt_once_however_many_ask(spark):
    """9,000 questions of few words: their blocks go by bytes, so a chunk's vector is not copied for each 4,096 of them. The neighbours are those of brute force."""
    rng = np.random.default_rng(8)

    def vectors(n: int, some: int) -> np.ndarray:
        x = np.zeros((n, 256))
        np.put_along_axis(x, rng.integers(0, 256, (n, some)), rng.random((n, some)), axis=1)
        return x

    q, c = vectors(9000, 3), vectors(1500, 120)
    rows = lambda x, key: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{key} long, vector array<double>")
    gateway = spark.sparkContext._gateway
    stages = lambda: spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    total = lambda s: sum(s.apply(i).shuffleWriteRecords() for i in range(s.size()))
    begin = total(stages())
    got = retrieval.nearest(rows(q, "query_id"), rows(c, "chunk_id"), 5).where("query_id % 100 = 0").collect()
    assert 0 < total(stages()) - begin < 9000 + 1500 + 9000 * 5 + 100  # each question and chunk once, and the neighbours
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    distance = 1 - unit(q) @ unit(c).T
    by = {(r.query_id, r["rank"]): r for r in got}
    for i in range(0, 9000, 100):
        order = np.argsort(np.round(distance[i], 9), kind="stable")[:5]
        assert all(abs(by[i, n + 1].distance - distance[i, x]) < 2e-9 for n, x in enumerate(order))


def test_texts_are_not_written_again(spark, sf):
    """rag_search keeps vectors, not the documents beside them."""
    folder = lambda: set(glob.glob(f"{shared.shared_folder(spark).removeprefix('file:')}/table-*"))
    before = folder()
    got = entry.queries()["rag_search"](spark, sf).collect()
    kept = {f: spark.read.parquet(f).columns for f in folder() - before}
    texts = [f for f, c in kept.items() if "text" in c and spark.read.parquet(f).count() == spark.read.parquet(f"{sf}/documents.parquet").count()]
    assert got and not texts and all(os.path.isdir(f) for f in kept)


def test_a_long_block_is_cut_as_if_it_were_whole(spark):
    """A context of one block: the first that doesn't fit, cut at its last line break."""
    text = "\n".join(f"riga {i} " + "x" * 50 for i in range(500))
    chunks = spark.createDataFrame([(1, [1.0, 0.0], text, "T", "u", "h")], "chunk_id int, vector array<double>, text string, title string, url string, hash string")
    queries = spark.createDataFrame([(7, "riga", [1.0, 0.0])], "query_id int, query string, vector array<double>")
    block = chunks.select(F.lit(7).alias("query_id"), F.lit(1).alias("rank"), retrieval.block_text(F.col("title"), F.col("url"), F.col("text")).alias("block"))
    want = retrieval.pack_context(block, "query_id", "rank", "block").first().context
    assert len(want) > 15000 and retrieval.retrieve(queries, chunks).first().context == want
