"""Sinks: partitioned chunk tables with dynamic overwrite, run logs, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import fresh_chunks, without_urls
from .shared import materialised


def _path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def append_chunks(chunks: DataFrame, path: str) -> None:
    """SNK1."""
    chunks.write.mode("append").partitionBy("kb_id").parquet(path)


def append_fresh(chunks: DataFrame, path: str) -> None:
    """SNK1 after JOI3: writing the same chunks again adds nothing."""
    spark = chunks.sparkSession
    if _path_exists(spark, path):
        # a join on the partition column with the few bases at hand lets Spark read only their partitions
        bases = chunks.select("kb_id").distinct()
        indexed = spark.read.parquet(path).select("kb_id", "hash").join(bases, "kb_id", "left_semi")
        chunks = fresh_chunks(chunks, indexed, ("kb_id", "hash"))
    else:
        chunks = chunks.dropDuplicates(["kb_id", "hash"])
    append_chunks(chunks, path)


def rewrite_bases(spark: SparkSession, path: str, rows_of, bases: DataFrame) -> None:
    """Writes the partitions of some bases (kb_id) anew in place, with rows_of(their rows); other partitions' files stay as they are. The new rows are
    written beside the table before any partition is replaced, since Spark can't read what it overwrites; a base without rows left loses its partition."""
    table = spark.read.parquet(path)
    touched = [r.kb_id for r in bases.select("kb_id").distinct().join(table.select("kb_id").distinct(), "kb_id", "left_semi").collect()]  # names of bases that change
    if not touched:
        return
    new = materialised(rows_of(table.where(F.col("kb_id").isin(touched))))
    left = {r.kb_id for r in new.select("kb_id").distinct().collect()}
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("kb_id").parquet(path)
    for kb_id in touched:
        if kb_id not in left:
            drop_base(spark, path, kb_id)


def delete_urls(spark: SparkSession, path: str, changed: DataFrame) -> None:
    """SNK2, JOI12: the chunks of changed urls go from the table at path, in place: only the partitions that hold some of them are read whole and written."""
    held = spark.read.parquet(path).join(changed.select("url").distinct(), "url", "left_semi").select("kb_id")
    rewrite_bases(spark, path, lambda rows: without_urls(rows, changed), held)


def upsert_chunks(spark: SparkSession, path: str, chunks: DataFrame) -> None:
    """SNK5: the rows of chunks replace those of their urls in their bases, in place."""
    keys = chunks.select("kb_id", "url").distinct()
    columns = spark.read.parquet(path).columns
    rewrite_bases(spark, path, lambda rows: rows.join(keys, ["kb_id", "url"], "left_anti").select(*columns).unionByName(chunks.select(*columns)), keys)
    new = chunks.join(spark.read.parquet(path).select("kb_id").distinct(), "kb_id", "left_anti")
    append_chunks(new.select(*columns), path)


def drop_base(spark: SparkSession, path: str, kb_id: str) -> None:
    """SNK4: a base's partition goes, in place."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/kb_id={kb_id}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def rows_by_base(chunks: DataFrame) -> DataFrame:
    """SNK3."""
    return chunks.groupBy("kb_id").agg(F.count("*").alias("chunks"))


def without_base(chunks: DataFrame, kb_id: str) -> DataFrame:
    """SNK4."""
    return chunks.where(F.col("kb_id") != kb_id)


def append_run(runs: DataFrame, path: str) -> None:
    """SNK7."""
    runs.write.mode("append").parquet(path)


def progress_row(jobs: DataFrame, now: Column) -> DataFrame:
    """SNK9: a snapshot of each job that isn't at its end."""
    return jobs.where(~F.col("phase").isin("ready", "empty", "failed", "legacy")).withColumn("seen_at", now)
