"""Exact top-k search: columnar branch-and-bound over integer vectors.

Vectors are quantised to integers and laid out vertically: one array for each dimension. Blocks of queries
meet blocks of candidates. In a block pair, inner products grow dimension block by dimension block; after each,
the remaining mass (product of the norms of the dimensions still to come, by Cauchy-Schwarz) bounds every
candidate from above and below, the k-th best lower bound is the threshold, and the candidates whose upper bound
is beneath it are compacted away. Queries meet the first candidate block beforehand, and carry its k-th score as the threshold
that they begin with everywhere. What is left at the end is scored exactly. Block winners are merged by rank.

Bounds are doubles with a margin for their rounding; scores are exact integers, of Python where doubles can't hold them.

Defined results: null vectors and vectors with null or non-finite components (or whose components are not finite once scaled)
take no part, nor do rows without an id; vectors of another length than the query's are no candidates for it; every row is a row of its own, so rows of
one id, equal or not, are each other's candidates, and each that is a query has ranks of its own; scores beyond the range of long
are given as its end, but ranked as they are up to 38 digits; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialised

FOUND = "query long, query_id long, vec_id long, row long, exact decimal(38,0)"
MOST = 10**38 - 1
EXACT = 2.0**53


def branch_and_bound(queries: np.ndarray, query_rows: np.ndarray, floors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int, dim_block: int):
    """For each query, yields (places of its k best candidates, their scores); ties go to smaller ids, then rows.

    vectors is vertical: vectors[d] holds dimension d of every candidate. floors: scores that the k best reach or pass, as far as known."""
    dims, n = vectors.shape
    most = [float(np.abs(x).max(initial=0)) for x in (queries, vectors)]
    exact = most[0] * most[1] * dims < EXACT
    scale = [1.0 if exact else 2.0 ** -np.frexp(m)[1] for m in most]  # exact; products then don't overflow
    scaled, columns = queries * scale[0], vectors * scale[1]
    cuts = [*range(0, dims, dim_block), dims]
    mass = np.zeros((len(cuts), n))  # norm of what comes from each cut on
    for c in range(len(cuts) - 2, -1, -1):
        mass[c] = np.sqrt(mass[c + 1] ** 2 + (columns[cuts[c] : cuts[c + 1]] ** 2).sum(0))
    for place, (q, row) in enumerate(zip(scaled, query_rows)):
        alive = np.flatnonzero(rows != row)
        score = np.zeros(len(alive))
        rounding = 0.0 if exact else dims * 2.0**-50 * float(np.sqrt((q**2).sum())) * mass[0] + 1e-280
        floor = float(floors[place]) * scale[0] * scale[1]
        floor -= abs(floor) * 1e-15  # it was rounded
        for c in range(len(cuts) - 1):
            part = slice(cuts[c], cuts[c + 1])
            score = score + (q[part] @ columns[part] if len(alive) == n else q[part] @ columns[part][:, alive])
            slack = float(np.sqrt((q[cuts[c + 1] :] ** 2).sum())) * mass[c + 1][alive] * (1 + 1e-9) + (rounding if exact else rounding[alive])
            if len(alive) > k:
                floor = max(floor, np.partition(score - slack, len(alive) - k)[len(alive) - k])
            keep = score + slack >= floor
            alive, score = alive[keep], score[keep]
        if exact:
            best = np.lexsort((rows[alive], ids[alive], -score))[:k]
            yield alive[best], score[best].astype(np.int64).tolist()
        else:
            whole = [*map(int, queries[place].tolist())]
            scores = [sum(a * int(b) for a, b in zip(whole, vectors[:, i].tolist())) for i in alive.tolist()]
            best = sorted(range(len(alive)), key=lambda i: (-scores[i], ids[alive[i]], rows[alive[i]]))[:k]
            yield alive[best], [scores[i] for i in best]


def _matrix(table: pa.Table) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def top_k(df: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10, scale: int = 1024, candidate_bytes: int = 4 << 20, query_bytes: int = 4 << 20, dim_block: int = 16) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query row of df."""
    read = df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("e"), is_query.alias("is_query"), F.monotonically_increasing_id().alias("row"))
    scaled = read.where("id is not null and e is not null").select("id", "row", F.coalesce("is_query", F.lit(False)).alias("is_query"), F.transform("e", lambda x: x.cast("double") * scale).alias("e"))
    fit = scaled.where(F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    # as doubles: floor() of a double gives a long, which large ones don't fit; those are whole numbers already
    whole = F.transform("e", lambda x: F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x))
    clean = materialised(fit.select("id", "row", "is_query", F.size("e").alias("dims"), whole.alias("v")))
    sizes = clean.agg(F.coalesce(F.sum(8 * F.col("dims")), F.lit(0)), F.coalesce(F.sum(F.when(F.col("is_query"), 8 * F.col("dims"))), F.lit(0))).first()
    n_blocks, n_queries = -(-sizes[0] // candidate_bytes) or 1, -(-sizes[1] // query_bytes) or 1
    block = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = clean.where("is_query").select("id", "row", "v", "dims", block(n_queries, 1).alias("qb"))
    vectors = clean.select("id", "row", "v", "dims", block(n_blocks, 2).alias("vb"))

    def meet(left: pa.Table, right: pa.Table, floors: np.ndarray):
        rows, ids, v = _column(right, "row"), _column(right, "id"), np.ascontiguousarray(_matrix(right).T)
        for place, (best, scores) in enumerate(branch_and_bound(_matrix(left), _column(left, "row"), floors, v, ids, rows, k, dim_block)):
            yield place, ids[best], rows[best], scores

    def seed(left: pa.Table, right: pa.Table) -> pa.Table:
        """The queries with the k-th score among the first candidates."""
        floors = np.full(left.num_rows, -np.inf)
        if left.num_rows and right.num_rows:
            for place, _, _, scores in meet(left, right, floors):
                if len(scores) == k and abs(scores[-1]) < 10**300:
                    floors[place] = scores[-1]
        return left.append_column("floor", pa.array(floors, pa.float64()))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [], [])
        if left.num_rows and right.num_rows:
            query_rows, query_ids = _column(left, "row"), _column(left, "id")
            for place, ids, rows, scores in meet(left, right, _column(left, "floor")):
                for column, values in zip(out, (np.full(len(ids), query_rows[place]), np.full(len(ids), query_ids[place]), ids, rows, [Decimal(max(-MOST, min(MOST, s))) for s in scores])):
                    column.append(values)
        columns = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out[:4]] + [pa.array([s for x in out[4] for s in x], pa.decimal128(38, 0))]
        return pa.table(columns, names=[x.split()[0] for x in FOUND.split(", ")])

    first = vectors.where("vb = 0").select("id", "row", "v", "dims").withColumn("qb", every(n_queries))
    seeded = queries.groupBy("dims", "qb").cogroup(first.groupBy("dims", "qb")).applyInArrow(seed, "id long, row long, v array<double>, dims int, qb int, floor double")
    key = ["dims", "qb", "vb"]
    met = materialised(seeded).withColumn("vb", every(n_blocks)).groupBy(*key).cogroup(vectors.withColumn("qb", every(n_queries)).groupBy(*key))
    found = met.applyInArrow(pair, FOUND)
    by_score = Window.partitionBy("query").orderBy(F.desc("exact"), "vec_id", "row")
    ends = [F.lit(str(x)).cast("decimal(38,0)") for x in (-(1 << 63), (1 << 63) - 1)]
    score = F.least(F.greatest("exact", ends[0]), ends[1]).cast("long")
    return found.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", score.alias("score"))
