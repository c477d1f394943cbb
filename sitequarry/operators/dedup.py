"""Versions, content dedup, idempotent chunk writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_version(rows: DataFrame, key: str = "url", at: str = "fetched_at", *tie: str) -> DataFrame:
    """WIN14, SNK5: the newest row of each key. One grouped maximum, so a key with very many versions is reduced before the shuffle."""
    newest = F.max_by(F.struct(*rows.columns), F.struct(at, *tie) if tie else F.col(at))
    return rows.groupBy(key).agg(newest.alias("_row")).select("_row.*")


def upsert(old: DataFrame, new: DataFrame, key: str = "url", at: str = "fetched_at") -> DataFrame:
    """SNK5: new content replaces old and waits for ingest again."""
    return latest_version(old.unionByName(new.withColumn("ingest_status", F.lit("pending")), allowMissingColumns=True), key, at)


def first_writers(docs: DataFrame, hash_col: str = "content_hash", canonical: str = "canonical_url", at: str = "fetched_at") -> DataFrame:
    """WIN4: docs with `duplicate_of`: the first canonical url with the same content, where it is another. The first writer is
    a grouped minimum joined back, so one content in a third of the rows is no single task."""
    first = docs.groupBy(hash_col).agg(F.min_by(canonical, F.struct(at, canonical)).alias("_first"))
    joined = docs.join(first, hash_col, "left")
    return joined.withColumn("duplicate_of", F.when(F.col("_first") != F.col(canonical), F.col("_first"))).drop("_first")


def fresh_chunks(chunks: DataFrame, indexed: DataFrame, keys: tuple[str, ...] = ("hash",)) -> DataFrame:
    """JOI3, SET4: chunks whose hash isn't indexed yet, each once."""
    return chunks.dropDuplicates([*keys]).join(indexed.select(*keys), [*keys], "left_anti")


def without_urls(chunks: DataFrame, changed: DataFrame, url_col: str = "url") -> DataFrame:
    """SNK2, JOI12: the chunk table after all chunks of changed urls are deleted."""
    return chunks.join(changed.select(F.col(url_col)).distinct(), url_col, "left_anti")


def best_of(rows: DataFrame, keys: tuple[str, ...], *order) -> DataFrame:
    """SET3, SET7, AGG9: the first row of each key in an order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def cached_embeddings(texts: DataFrame, stored: DataFrame, key: str = "text") -> tuple[DataFrame, DataFrame]:
    """JOI11: (texts with their stored vector or null, the different texts that have none)."""
    joined = texts.join(stored, key, "left")
    return joined, joined.where(F.col("vector").isNull()).select(key).distinct()
