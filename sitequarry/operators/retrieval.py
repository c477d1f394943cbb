"""Vector search, reranking, citations and context packing over whole batches of queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import HashingTF, IDF, Normalizer, Tokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from ..functions.scoring import LICENCE, boost_of, closeness, length_bonus, low_confidence, navigation_penalty, rerank_score
from ..functions.urls import let
from ..sources.shared import materialised, new_folder
from .dedup import best_of
from .totals import within


def unit(vector: Column) -> Column:
    """A vector of length one; null if it's null or zero. The norm is bound before the division, or every component would compute it again."""
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    divided = lambda p: F.when(p["n"] > 0, F.transform(p["v"], lambda x: x / p["n"]))
    return let(let(F.transform(vector, lambda x: x.cast("double")), lambda v: F.struct(v.alias("v"), norm(v).alias("n"))), divided)


def cosine_distance(a: Column, b: Column) -> Column:
    """Of unit vectors."""
    return 1 - F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest_native(queries: DataFrame, chunks: DataFrame, k: int, blocks: int = 8) -> DataFrame:
    """JOI6 in built-in functions, the plain form that nearest() is tested against: query_id, chunk_id, distance, rank."""
    return _ranked(_pairs(queries, chunks, blocks).select("query_id", "chunk_id", F.round(cosine_distance(F.col("q"), F.col("v")), 9).alias("distance")), k)


def _pairs(queries: DataFrame, chunks: DataFrame, blocks: int) -> DataFrame:
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    q = queries.select("query_id", unit(F.col("vector")).alias("q")).where("q is not null").withColumn("block", every)
    c = chunks.select("chunk_id", unit(F.col("vector")).alias("v")).where("v is not null").withColumn("block", F.pmod(F.xxhash64("chunk_id"), F.lit(blocks)).cast("int"))
    return q.join(c, "block")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@F.pandas_udf(BinaryType())
def compact(vec: pd.Series) -> pd.Series:
    """Vectors as bytes: all components, or the values and places of those that aren't zero if that is shorter."""

    def one(v):
        v, at = np.asarray(v, float), np.flatnonzero(v)
        return v.tobytes() if 12 * len(at) >= 8 * len(v) else v[at].tobytes() + at.astype(np.int32).tobytes()

    return vec.map(one)


def units(rows: DataFrame, key: str) -> DataFrame:
    """key, dims, vec: the unit vectors of rows (key, vector) by compact(), kept as Parquet; without those that are null or zero."""
    return materialised(rows.select(key, unit(F.col("vector")).alias("vec")).where("vec is not null").select(key, F.size("vec").alias("dims"), compact("vec").alias("vec")))


def loosened(packed, dims: int) -> np.ndarray:
    """The vectors of compact(), a row each."""
    out = np.zeros((len(packed), dims))
    for row, b in zip(out, packed):
        if len(b) == 8 * dims:
            row[:] = np.frombuffer(b)
        else:
            n = len(b) // 12
            row[np.frombuffer(b, np.int32, n, 8 * n)] = np.frombuffer(b, float, n)
    return out


def least_of(queries: int, rows: int, k: int, vectors, facing, far=None, step: int = 8192, slice_: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The k least distances of each query to rows, to nine digits, and the rows' numbers (-1: none), equal ones by number. vectors(a, z) and facing(a, z) are matrices of some queries and rows;
    rows that far(a, z, c, d) marks don't count. Some queries meet some rows in a matrix product and what is among a query's k so far stays: memory holds that, not the pairs."""
    best, at = np.full((queries, k), np.inf), np.full((queries, k), -1)
    for c in range(0, rows, step):
        d = min(c + step, rows)
        right = facing(c, d)
        for a in range(0, queries, slice_):
            z = min(a + slice_, queries)
            left = vectors(a, z)
            distance = 1 - left @ right.T
            if not (np.isfinite(left).all() and np.isfinite(right).all()):
                np.nan_to_num(distance, copy=False, nan=np.inf, posinf=np.inf, neginf=np.inf)
            if far is not None:
                distance[far(a, z, c, d)] = np.inf
            worst = best[a:z, -1]
            least = worst - 4.99e-10  # what rounds to the worst of a full list comes later, so it isn't better
            few = np.flatnonzero(at[a:z, -1] < 0)
            if len(few):
                least[few] = np.partition(distance[few], k - 1, axis=1)[:, k - 1] + 1e-9 if d - c > k else np.inf
            row, column = np.nonzero(distance <= least[:, None])
            value = np.round(distance[row, column], 9)
            if far is not None:
                some = np.isfinite(value)
                row, column, value = row[some], column[some], value[some]
            if not len(row):
                continue
            own, row = np.unique(row, return_inverse=True)
            held = at[a + own] >= 0
            row, value, number = (np.concatenate(x) for x in ((np.nonzero(held)[0], row), (best[a + own][held], value), (at[a + own][held], column + c)))
            order = np.lexsort((number, value, row))
            row, value, number = row[order], value[order], number[order]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            row, value, number, place = (x[place < k] for x in (row, value, number, place))
            best[a + own[row], place], at[a + own[row], place] = value, number
    return best, at


def dealt(x: DataFrame, n: int, *keys: str) -> DataFrame:
    """By key to n partitions, which adaptive execution leaves as they are: their work grows with pairs, not bytes."""
    return x.repartition(n, *keys)


def nearest(queries: DataFrame, chunks: DataFrame, k: int, blocks: int | None = None, query_rows: int | None = None, block_mb: int = 64) -> DataFrame:
    """JOI6, TOP3: the k nearest chunks of every query by cosine distance. Blocks of queries meet blocks of chunks in matrix
    products, each keeps its k best, and these are ranked: no pair leaves its task, and neither side is broadcast. A block is `block_mb` of vectors at most (of queries half as much), or `query_rows` queries."""
    q, c = units(queries, "query_id"), units(chunks, "chunk_id")
    (rows, size), (asked, q_size) = (x.agg(F.count("*"), F.coalesce(F.sum(F.length("vec")), F.lit(0))).first() for x in (c, q))
    vb = blocks or max(1, min(32, -(-rows // 8192)), -(-size // (block_mb << 20)))
    qb = max(1, -(-asked // query_rows) if query_rows else -(-q_size // (block_mb << 19)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int")).withColumn("vb", every(vb))
    c = c.withColumn("vb", F.pmod(F.xxhash64("chunk_id"), F.lit(vb)).cast("int")).withColumn("qb", every(qb))
    return _ranked(_met(q, c, ["qb", "vb"], k, min(2048, 2 * qb * vb)), k)


def _met(q: DataFrame, c: DataFrame, key: list[str], k: int, tasks: int) -> DataFrame:
    """The k nearest in each pair of groups with equal keys and dimensions, by matrix products: query_id, chunk_id, distance."""
    id_kinds = [x.schema[n].dataType.simpleString() for x, n in ((q, "query_id"), (c, "chunk_id"))]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []})
        right, dims = right.sort_values("chunk_id", ignore_index=True), int(left["dims"].iloc[0])
        of = lambda x: lambda a, z: loosened(x["vec"].iloc[a:z], dims)
        best, at = least_of(len(left), len(right), k, of(left), of(right))
        row, place = np.nonzero(at >= 0)
        distance = best[row, place]
        return pd.DataFrame({"query_id": left["query_id"].to_numpy()[row], "chunk_id": right["chunk_id"].to_numpy()[at[row, place]], "distance": np.where(np.isinf(distance), np.nan, distance)})

    key = ["dims", *key]
    q, c = (dealt(x, tasks, *key) for x in (q, c))
    return q.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(meet, f"query_id {id_kinds[0]}, chunk_id {id_kinds[1]}, distance double")


def codebook(values: np.ndarray, size: int, rounds: int = 12, seed: int = 42) -> np.ndarray:
    """The means that a few rounds of k-means leave, as many as there are different values at most."""
    values = np.unique(values, axis=0)
    means = values[np.random.default_rng(seed).permutation(len(values))[:size]]
    for _ in range(rounds):
        own = np.argmax(values @ means.T - 0.5 * (means**2).sum(1), axis=1)
        sums = np.stack([np.bincount(own, values[:, d], len(means)) for d in range(values.shape[1])], axis=1)
        count = np.bincount(own, minlength=len(means))[:, None]
        means = np.where(count > 0, sums / np.maximum(count, 1), means)
    return means


class VectorIndex:
    """RET4: inverted lists of product-quantised residuals, in a folder of Parquet.

    Unit vectors lie in the cell of their nearest centre; what the centre leaves of a vector is cut into `parts` slices, and each becomes the number of the nearest entry of that slice's codebook: a byte. A query
    makes one table of what each entry is worth to it, so a row costs `parts` look-ups; the rows that look best to it are scored by their vectors. Codes and vectors are partitioned by
    cell: a search reads the files of the cells that its queries ask, and vectors only of the short list.

    Centres and codebooks are fitted on a hashed sample of about `sample` rows (a documented bound), a codebook in a task of its own; every row is indexed. append() places more rows by the same centres and codebooks."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        model = spark.read.parquet(f"{folder}/model").orderBy("part", "number").collect()  # centres, and 256 entries a slice at most
        of = lambda part: np.array([r.values for r in model if r.part == part])
        self.centres = of(-1)
        self.books = [of(m) for m in range(max(r.part for r in model) + 1)]

    @classmethod
    def build(cls, chunks: DataFrame, folder: str, cells: int | None = None, parts: int = 16, entries: int = 256, sample: int = 20_000, seed: int = 42) -> VectorIndex:
        """The index of chunks (chunk_id, vector), which need one row at least that isn't null or zero; all vectors have one length."""
        rows = chunks.select("chunk_id", unit(F.col("vector")).alias("vec")).where("vec is not null")
        n, dims = rows.agg(F.count("*"), F.max(F.size("vec"))).first()
        cells, parts = cells or max(1, min(1024, round(n**0.5 / 1.5))), min(parts, dims)
        some = materialised(rows.where(F.pmod(F.xxhash64("chunk_id", F.lit(seed)), F.lit(max(1, n // sample))) == 0))
        model = KMeans(k=cells, seed=seed, maxIter=15, distanceMeasure="cosine").fit(some.select(array_to_vector("vec").alias("features")))
        centres = np.stack(model.clusterCenters())
        cuts = [m * dims // parts for m in range(parts + 1)]

        def residuals(batches):
            for batch in batches:
                v = np.stack(batch["vec"]) if len(batch) else np.zeros((0, dims))
                left = v - centres[np.argmax(v @ centres.T, axis=1)]
                for m in range(parts):
                    yield pd.DataFrame({"part": m, "values": list(left[:, cuts[m] : cuts[m + 1]])})

        def fitted(group: pd.DataFrame) -> pd.DataFrame:
            means = codebook(np.stack(group["values"]), entries, seed=seed)
            return pd.DataFrame({"part": group["part"].iloc[0], "number": range(len(means)), "values": list(means)})

        kind = "part int, number int, values array<double>"
        books = some.mapInPandas(residuals, "part int, values array<double>").groupBy("part").applyInPandas(fitted, kind)
        books.unionByName(chunks.sparkSession.createDataFrame([(-1, i, c.tolist()) for i, c in enumerate(centres)], kind)).write.parquet(f"{folder}/model")
        index = cls(chunks.sparkSession, folder)
        index.append(chunks)
        return index

    def append(self, chunks: DataFrame, rows_each: int = 1 << 20) -> None:
        """More rows, at the centres and codebooks that there are."""
        centres, books = self.centres, self.books
        cuts = np.cumsum([0, *[b.shape[1] for b in books]])

        @F.pandas_udf("cell int, code binary")
        def placed(vec: pd.Series) -> pd.DataFrame:
            v = np.stack(vec) if len(vec) else np.zeros((0, cuts[-1]))
            cell = np.argmax(v @ centres.T, axis=1).astype(np.int32)
            left = v - centres[cell]
            near = lambda x, b: np.argmax(x @ b.T - 0.5 * (b**2).sum(1), axis=1)
            codes = np.stack([near(left[:, cuts[m] : cuts[m + 1]], b) for m, b in enumerate(books)], axis=1).astype(np.uint8)
            return pd.DataFrame({"cell": cell, "code": [c.tobytes() for c in codes]})

        rows = chunks.select("chunk_id", unit(F.col("vector")).alias("vec")).where("vec is not null").withColumn("at", placed("vec"))
        rows = materialised(rows.select("chunk_id", compact("vec").alias("vec"), F.col("at.cell").alias("cell"), F.col("at.code").alias("code")))
        spread = F.pmod(F.xxhash64("chunk_id"), F.lit(max(1, rows.count() // (len(centres) * rows_each)))).cast("int")  # a crowded cell is many files
        for name, column in (("codes", "code"), ("vectors", "vec")):
            rows.select("chunk_id", column, "cell", spread.alias("spread")).repartition("cell", "spread").drop("spread").write.mode("append").partitionBy("cell").parquet(f"{self.folder}/{name}")

    def lists(self, name: str, cells: list[int] | None = None) -> DataFrame:
        """The codes or the vectors of some cells: files of others are not read."""
        rows = self.spark.read.parquet(f"{self.folder}/{name}")
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def asked(self, queries: DataFrame) -> DataFrame:
        """query_id, q: the queries' unit vectors by compact(), of those that have the index's length."""
        return units(queries, "query_id").where(F.col("dims") == self.centres.shape[1]).select("query_id", F.col("vec").alias("q"))

    def short_lists(self, queries: DataFrame, shortlist: int, probes: float = 0.75) -> DataFrame:
        """query_id, cell, chunk_id: for each query the rows of its nearest cells (a share `probes` of all) that look best by their codes."""
        return self._short(self.asked(queries), shortlist, probes)

    def _short(self, queries: DataFrame, shortlist: int, probes: float, block_rows: int = 1 << 20, query_rows: int = 2048) -> DataFrame:
        """Blocks of queries meet blocks of codes, and each keeps a short list of each query."""
        centres, books, n = self.centres, self.books, max(1, round(probes * len(self.centres)))
        cuts, dims = np.cumsum([0, *[b.shape[1] for b in books]]), centres.shape[1]

        def own_cells(packed) -> np.ndarray:
            return np.argsort(-(loosened(packed, dims) @ centres.T), axis=1, kind="stable")[:, :n]

        @F.pandas_udf("array<int>")
        def nearest_cells(packed: pd.Series) -> pd.Series:
            return pd.Series(list(own_cells(packed).astype(np.int32)))

        cells = [r.cell for r in queries.select(F.explode(nearest_cells("q")).alias("cell")).distinct().collect()]  # numbers of cells, of which there are few
        codes = self.lists("codes", cells)
        blocks, q_blocks = (max(1, -(-x.count() // each)) for x, each in ((codes, block_rows), (queries, query_rows)))
        kinds = [x.schema[c].dataType.simpleString() for x, c in ((queries, "query_id"), (codes, "chunk_id"))]

        def look(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query_id": [], "cell": [], "chunk_id": [], "far": []})
            right = right.sort_values("chunk_id", ignore_index=True)
            cell, codes_ = right["cell"].to_numpy(), right["code"]
            asks = np.zeros((len(left), len(centres)), bool)
            for a in range(0, len(left), 1024):
                np.put_along_axis(asks[a : a + 1024], own_cells(left["q"].iloc[a : a + 1024]), True, axis=1)

            def decoded(a: int, z: int) -> np.ndarray:
                code = np.frombuffer(b"".join(codes_.iloc[a:z]), np.uint8).reshape(z - a, -1)
                out = centres[cell[a:z]]
                for m, b in enumerate(books):
                    out[:, cuts[m] : cuts[m + 1]] += b[code[:, m]]
                return out

            best, at = least_of(len(left), len(right), shortlist, lambda a, z: loosened(left["q"].iloc[a:z], dims), decoded, lambda a, z, c, d: ~asks[a:z, cell[c:d]])
            row, place = np.nonzero(at >= 0)
            number = at[row, place]
            return pd.DataFrame({"query_id": left["query_id"].to_numpy()[row], "cell": cell[number], "chunk_id": right["chunk_id"].to_numpy()[number], "far": best[row, place]})

        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        tasks, key = min(2048, 2 * blocks * q_blocks), ("block", "q_block")
        left = dealt(queries.withColumn("q_block", part("query_id", q_blocks)).withColumn("block", every(blocks)), tasks, *key)
        right = dealt(codes.select("chunk_id", "code", "cell", part("chunk_id", blocks).alias("block")).withColumn("q_block", every(q_blocks)), tasks, *key)
        found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(look, f"query_id {kinds[0]}, cell int, chunk_id {kinds[1]}, far double")
        w = Window.partitionBy("query_id").orderBy("far", "chunk_id")
        found = found if blocks == 1 else found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= shortlist)
        return found.select("query_id", "cell", "chunk_id")

    def nearest(self, queries: DataFrame, k: int, probes: float = 0.75, shortlist: int | None = None, block_rows: int = 1 << 16) -> DataFrame:
        """query_id, chunk_id, distance, rank, scored (how many rows were scored by their vectors for the query). Vectors lie in blocks; a query
        goes to those where its short list has rows, with their ids, so neither its vector nor theirs is copied for each pair."""
        q, dims = self.asked(queries), self.centres.shape[1]
        short = materialised(self._short(q, shortlist or 20 * k, probes))
        cells = [r.cell for r in short.select("cell").distinct().collect()]
        vectors = self.lists("vectors", cells)
        blocks, q_blocks = (max(1, -(-x.count() // block_rows)) for x in (vectors, q))
        kinds = [short.schema[c].dataType.simpleString() for c in ("query_id", "chunk_id")]

        def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            out = [pd.DataFrame({"query_id": [], "chunk_id": [], "distance": []})]
            places = right[["cell", "chunk_id"]].assign(row=np.arange(len(right)))
            for a in range(0, len(left) if len(right) else 0, 512):
                some = left.iloc[a : a + 512]
                size = [len(x) for x in some["ids"]]
                pairs = pd.DataFrame({"asked": np.repeat(np.arange(len(some)), size), "cell": np.concatenate(some["cells"].to_list()), "chunk_id": np.concatenate(some["ids"].to_list())}).merge(places, on=["cell", "chunk_id"])
                asked, row, vec = pairs["asked"].to_numpy(), pairs["row"].to_numpy(), loosened(some["q"], dims)
                for c in range(0, len(pairs), 16384):
                    own = asked[c : c + 16384]
                    distance = np.round(1 - np.einsum("ij,ij->i", vec[own], loosened(right["vec"].iloc[row[c : c + 16384]], dims)), 9)
                    out.append(pd.DataFrame({"query_id": some["query_id"].to_numpy()[own], "chunk_id": pairs["chunk_id"].to_numpy()[c : c + 16384], "distance": distance}))
            return pd.concat(out[1:] or out)

        part = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
        tasks, key = min(2048, 2 * blocks * q_blocks), ("block", "q_block")
        lists = short.groupBy("query_id", part("chunk_id", blocks).alias("block")).agg(F.collect_list(F.struct("cell", "chunk_id")).alias("l"))
        left = lists.join(q, "query_id").select("query_id", "q", "block", part("query_id", q_blocks).alias("q_block"), F.col("l.cell").alias("cells"), F.col("l.chunk_id").alias("ids"))
        right = vectors.select("cell", "chunk_id", "vec", part("chunk_id", blocks).alias("block")).withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
        met = dealt(left, tasks, *key).groupBy(*key).cogroup(dealt(right, tasks, *key).groupBy(*key)).applyInPandas(score, f"query_id {kinds[0]}, chunk_id {kinds[1]}, distance double")
        return _ranked(met.withColumn("scored", F.count("*").over(Window.partitionBy("query_id"))), k)


def nearest_approximate(queries: DataFrame, chunks: DataFrame, k: int, exact_below: int = 256, probes: float = 0.75, cells: int | None = None, scored_share: float = 0.1) -> DataFrame:
    """RET4: neighbours by a VectorIndex made for the occasion; exact for tables of fewer than `exact_below` rows (0: never). Three quarters of the lists' codes, and twenty vectors for each neighbour, or a
    tenth of all if that is less, give a recall above 0.9 even on vectors without any clusters; clustered ones need far fewer lists."""
    rows = chunks.where("vector is not null").count()
    if rows < max(1, exact_below):
        return nearest(queries, chunks, k).withColumn("scored", F.lit(rows).cast("long"))
    index = VectorIndex.build(chunks, new_folder(chunks.sparkSession, "index"), cells)
    return index.nearest(queries, k, probes, max(k, min(20 * k, int(scored_share * rows))))


def embedded(texts: DataFrame, corpus: DataFrame, text_col: str = "text", dims: int = 512) -> DataFrame:
    """RET5: hashed TF-IDF vectors; the weights come from corpus. Any other function from text to vector can stand in."""
    tok, tf = Tokenizer(inputCol=text_col, outputCol="_words"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dims)
    weights = IDF(inputCol="_tf", outputCol="_idf").fit(tf.transform(tok.transform(corpus.na.fill("", [text_col]))))
    out = Normalizer(inputCol="_idf", outputCol="_unit").transform(weights.transform(tf.transform(tok.transform(texts.na.fill("", [text_col])))))
    return out.withColumn("vector", vector_to_array("_unit")).drop("_words", "_tf", "_idf", "_unit")


def scored(candidates: DataFrame) -> DataFrame:
    """SCO10: candidates (query_id, query, chunk_id, text, title, url, hash, distance) with score and key, their hash or that of their text; without the text."""
    score = rerank_score(F.col("query"), F.col("text"), F.col("title"), F.col("distance"))
    return candidates.withColumns({"score": score, "key": chunk_key()}).drop("text")


def chunk_key() -> Column:
    """SET3: chunks of one key are equal."""
    return F.coalesce(F.nullif(F.col("hash"), F.lit("")), F.md5(F.coalesce("text", F.lit(""))))


def prepared(chunks: DataFrame) -> DataFrame:
    """What ranking needs of a chunk whatever the question: lower-cased sides, whether it is about licences, what its length and its look give, its key."""
    low = chunks.withColumns({"body": F.lower(F.coalesce("text", F.lit(""))), "head": F.lower(F.coalesce("title", F.lit(""))), "bonus": length_bonus(F.col("text")), "penalty": navigation_penalty(F.col("text")), "key": chunk_key()})
    return low.withColumn("licence", F.col("body").rlike(LICENCE) | F.col("head").rlike(LICENCE)).select("chunk_id", "title", "url", "key", "body", "head", "bonus", "penalty", "licence")


def best_chunks(rows: DataFrame, k: int) -> DataFrame:
    """SET3, TOP3: of rows with score and key the k best different chunks of each question, with rank. Only sides of fixed size are shuffled. Scores
    count to nine digits, so that rounding decides no tie."""
    order = (F.round("score", 9).desc(), F.col("chunk_id"))
    unique = best_of(rows, ("query_id", "key"), *order)
    w = Window.partitionBy("query_id").orderBy(*order)
    return unique.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("key")


def reranked(candidates: DataFrame, k: int) -> DataFrame:
    """SCO10, SET3, TOP3: candidates (query_id, query, chunk_id, text, title, url, hash, distance) -> the k best different chunks with score and rank, without the text."""
    return best_chunks(scored(candidates), k)


def block_text(title: Column, url: Column, text: Column) -> Column:
    """FUN5: a chunk as it stands in a context."""
    part = lambda name, c: F.concat(F.lit(f"[{name}]\n"), F.coalesce(c, F.lit("")))
    return F.concat(F.lit("\n"), part("TITOLO", title), F.lit("\n\n"), part("URL", url), F.lit("\n\n"), part("CONTENUTO", text), F.lit("\n\n" + "─" * 28 + "\n"))


def pack_context(rows: DataFrame, key: str, order: str, block: str, most: int = 16000, least_rest: int = 200, few: bool = False) -> DataFrame:
    """WIN8: for each key, the blocks that fit in order; the first that doesn't is cut at its last line break if more than
    least_rest characters are left; then it ends. Columns: key, context, blocks. few: see totals.within."""
    sized = within(rows.select(key, order, block), key, order, block, most, few=few)  # those that fit, and the first that doesn't
    over = F.coalesce(F.col("_before") + F.length(block) > most, F.lit(False))
    rest = most - F.col("_before")
    partial = F.substring(F.col(block), F.lit(1), rest.cast("int"))
    up_to_break = F.when(partial.contains("\n"), F.regexp_replace(partial, r"\n[^\n]*\z", "")).otherwise("")
    kept = F.when(~over, F.col(block)).when(rest > least_rest, up_to_break).otherwise("")
    parts = F.array_sort(F.collect_list(F.struct("_before", F.col(order).alias("o"), kept.alias("t"))))
    grouped = sized.groupBy(key).agg(parts.alias("_parts"), F.count_if(~over & F.col(block).isNotNull()).alias("blocks"))
    return grouped.select(key, F.regexp_replace(F.array_join(F.transform("_parts", lambda p: p["t"]), ""), r"^\s+|\s+$", "").alias("context"), "blocks")


def citations(ranked: DataFrame, most: int = 3) -> DataFrame:
    """AGG9, TOP4: the best chunk of each url, the best urls of each query."""
    best = ranked.where("url is not null and url <> ''").groupBy("query_id", "url").agg(F.max("score").alias("score"), F.max_by("title", F.struct("score", F.negate(F.col("rank")))).alias("title"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "url")
    return best.withColumn("title", F.coalesce(F.nullif(F.col("title"), F.lit("")), "url")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def confidences(queries: DataFrame, cited: DataFrame) -> DataFrame:
    """AGG10: query_id, confidence (the best citation's score, 0 where there is none), cited (how many)."""
    best = cited.groupBy("query_id").agg(F.max("score").alias("confidence"), F.count("*").alias("cited"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("cited", F.lit(0)).alias("cited"))


def retrieve(queries: DataFrame, chunks: DataFrame, k: int = 10, overfetch: int = 5, most: int = 16000) -> DataFrame:
    """RET1, RET2: queries (query_id, query, vector) over chunks (chunk_id, vector, text, title, url, hash) -> one row for each
    query: context, citations, confidence, empty, low_confidence. Candidates carry ids and scores; texts meet them by chunk, and again for the k that stay."""
    near = nearest(queries, chunks, k * overfetch).select("query_id", "chunk_id", "distance")
    asked = near.join(queries.select("query_id", "query"), "query_id")
    score = closeness(F.col("distance")) + boost_of(F.col("query"), F.col("body"), F.col("head"), F.col("licence")) + F.col("bonus") - F.col("penalty")
    rows = asked.join(prepared(chunks), "chunk_id").select("query_id", "chunk_id", "title", "url", "key", score.alias("score"))
    ranked = materialised(best_chunks(rows, k))
    block = F.substring(block_text(F.col("title"), F.col("url"), F.col("text")), 1, most + 1)  # a longer one doesn't fit either way, and is cut before that
    blocks = ranked.select("query_id", "rank", "chunk_id").join(chunks.select("chunk_id", block.alias("block")), "chunk_id")
    context = pack_context(blocks, "query_id", "rank", "block", most, few=True)
    best = citations(ranked)
    cited = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "title", "url", "score"))).alias("citations"))
    out = queries.select("query_id", "query").join(context, "query_id", "left").join(cited, "query_id", "left").join(confidences(queries, best).drop("cited"), "query_id")
    return out.select("query_id", "query", "context", "citations", "confidence", F.col("context").isNull().alias("empty"), low_confidence(F.size("citations"), F.col("confidence")).alias("low_confidence"))


def with_fallback(answers: DataFrame, live: DataFrame) -> DataFrame:
    """RET3: where the knowledge base gave nothing, the live context with confidence 0."""
    out = answers.join(live.select("query_id", F.col("context").alias("_live")), "query_id", "left")
    return out.withColumns({"context": F.coalesce("context", "_live"), "from_live": F.col("empty") & F.col("_live").isNotNull()}).drop("_live")


def similar_contents(queries: DataFrame, chunks: DataFrame, k: int = 4) -> DataFrame:
    """RET6: the contents of the nearest chunks, without reranking."""
    near = nearest(queries, chunks, k).join(chunks.select("chunk_id", "text"), "chunk_id")
    return near.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("contents"))
