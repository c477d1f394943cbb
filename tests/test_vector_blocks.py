import tracemalloc

import numpy as np

from sitequarry.operators import retrieval


def written(spark) -> int:
    """Rows that all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_a_search_shuffles_one_short_list_a_query(spark, tmp_path):
    """Not one for each cell that the query asks: those are as many rows as there are queries times cells times the short list."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(3000)]
    c = spark.createDataFrame(rows, "chunk_id long, vector array<double>")
    q = c.where("chunk_id % 10 = 0").withColumnRenamed("chunk_id", "query_id")
    index = retrieval.VectorIndex.build(c, f"{tmp_path}/index", cells=30, parts=4)
    before = written(spark)
    found = index.short_lists(q, 20, probes=0.75).groupBy("query_id").count().collect()
    assert len(found) == 300 and {r["count"] for r in found} == {20}
    assert 0 < written(spark) - before < 300 * 20


def test_neighbours_in_blocks_are_those_of_the_whole_product():
    """With equal distances, rows without numbers, marked rows and fewer rows than neighbours; the matrix of all pairs (260 MB) is never held."""
    rng = np.random.default_rng(6)
    rows = np.round(rng.normal(size=(16384, 4)), 1)
    rows[5000:9000] = rows[4999]
    rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    asked = np.concatenate([rows[::40], rows[5000:6600]])
    some = lambda x: lambda a, z: x[a:z]
    tracemalloc.start()
    best, at = retrieval.least_of(len(asked), len(rows), 10, some(asked), some(rows))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200e6
    for i in range(0, len(asked), 50):
        distance = np.round(1 - asked[i] @ rows.T, 9)
        order = np.argsort(distance, kind="stable")[:10]
        assert np.allclose(best[i], distance[order], atol=2e-9) and (abs(distance[at[i]] - distance[order]) < 2e-9).all()
    assert (at[410:, 0] == 4999).all() and (at[410:] == np.arange(4999, 5009)).all()
    few, at = retrieval.least_of(2, 3, 5, some(np.array([[1.0, 0], [np.nan, 0]])), some(np.array([[0, 1.0], [1.0, 0], [1.0, 0]])))
    assert at.tolist() == [[1, 2, 0, -1, -1], [0, 1, 2, -1, -1]] and few[0, :3].tolist() == [0, 0, 1] and np.isinf(few[1]).all()
    _, at = retrieval.least_of(1, 3, 5, some(np.array([[1.0, 0]])), some(np.array([[0, 1.0], [1.0, 0], [1.0, 0]])), lambda a, z, c, d: np.array([[False, True, False]]))
    assert at.tolist() == [[2, 0, -1, -1, -1]]
