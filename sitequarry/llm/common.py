"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TO_LOWER = str.maketrans(UPPER, LOWER)
BLANKS = str.maketrans("\t\n\x0b\x0c\r", "     ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str | None) -> list[str]:
    """Words of a text: maximal runs without space, tab, line feed, vertical tab, form feed, carriage return."""
    return [w for w in (text or "").translate(BLANKS).split(" ") if w]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs on one machine."""
    sc = spark.sparkContext
    set_already = sc._jsc.sc().getCheckpointDir()
    if set_already.isEmpty():
        if spark.conf.get("spark.checkpoint.dir", None) is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        set_already = sc._jsc.sc().getCheckpointDir()
    return set_already.get()


def materialised(df: DataFrame) -> DataFrame:
    """df, computed once and kept as Parquet in the shared folder, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def column_or_null(df: DataFrame, name: str, kind: str):
    """df[name] cast to kind, or nulls where df has no such column."""
    return (df[name] if name in df.columns else F.lit(None)).cast(kind)
