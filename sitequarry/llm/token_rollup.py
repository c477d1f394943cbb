"""Token counts as delta-maintained rollups.

A rollup is a folder of committed batches. A batch holds signed changes, summed by source, language and tokenizer version:
an insert adds a document and its tokens, a delete takes them away, a revision takes the old row away and adds the new one.
Totals are the sum over batches, so they follow changes without a recount. A batch is committed once: its id names its
folder, which counts only when Spark has marked it as written; committing the id again changes nothing, and a batch that was cut off is
written anew.

Defined results: null texts have no tokens; a null source or language is a group of its own; repeated rows count each;
changes of nothing commit an empty batch; groups whose totals are zero in both columns are left out; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import ByteBpe

KEYS = ("source", "lang", "tokenizer_version")
CHANGES = "source string, lang string, tokenizer_version string, docs long, tokens long"


def without_repeated_lines(text: str) -> str:
    """A revision of a text: of equal lines, the first stays."""
    return "\n".join(dict.fromkeys(text.split("\n")))


def counted(docs: DataFrame, tokenizers: dict[str, str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and tokenizer version: doc_id, source, lang, tokenizer_version, tokens, revised_tokens, text_hash."""

    def run(batches):
        tools = {name: ByteBpe(path, 200_000) for name, path in tokenizers.items()}
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            revised = [without_repeated_lines(x) for x in texts]
            hashes = pa.array([hashlib.sha256(x.encode()).digest() for x in texts], pa.binary())
            for name, tool in tools.items():
                width = tool.kind.itemsize
                tokens = [len(tool.packed(x)) // width for x in texts]
                after = [n if x == y else len(tool.packed(y)) // width for n, x, y in zip(tokens, texts, revised)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array([name] * len(texts)), pa.array(tokens, pa.int64()), pa.array(after, pa.int64()), hashes], names=["doc_id", "source", "lang", "tokenizer_version", "tokens", "revised_tokens", "text_hash"])

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"))
    return read.mapInArrow(run, "doc_id long, source string, lang string, tokenizer_version string, tokens long, revised_tokens long, text_hash binary")


def inserts(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), F.col(tokens).alias("tokens"))


def deletes(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col(tokens)).alias("tokens"))


def revisions(old: DataFrame, new: DataFrame, old_tokens: str = "tokens", new_tokens: str = "tokens") -> DataFrame:
    """Old rows out, new rows in: they may differ in source, language or version as well as in tokens."""
    return deletes(old, old_tokens).unionByName(inserts(new, new_tokens))


def copies(rows: DataFrame, tokens: str = "tokens") -> DataFrame:
    """The deletes of all documents whose text another with a smaller id has too (of rows with equal ids one stays). Rows of one
    text are summed by group before its groups meet, so a text in a third of all rows is a few rows."""
    summed = rows.groupBy("text_hash", *KEYS).agg(F.count("*").alias("n"), F.sum(tokens).alias("t"), F.min(F.struct("doc_id", tokens)).alias("first"))
    least = summed.groupBy("text_hash", "tokenizer_version").agg(F.min(F.struct(F.col("first.doc_id"), "source", "lang")).alias("head"))
    joined = summed.join(least, ["text_hash", "tokenizer_version"])
    heads = F.struct(F.col("first.doc_id"), "source", "lang").eqNullSafe(F.col("head"))
    out = joined.select(*KEYS, (F.when(heads, 1).otherwise(0) - F.col("n")).alias("docs"), (F.when(heads, F.col("first")[tokens]).otherwise(0) - F.col("t")).alias("tokens"))
    return out.where("docs <> 0")


class TokenRollup:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _batches(self) -> list[str]:
        """Folders of committed batches."""
        jvm = self.spark.sparkContext._jvm
        found = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/batch=*/_SUCCESS")
        files = found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(found)
        return [f.getPath().getParent().toString() for f in files or []]

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Commits signed changes under an id; False if the id is committed already."""
        path = f"{self.folder}/batch={batch}"
        if any(x.endswith(f"/batch={batch}") for x in self._batches()):
            return False
        summed = changes.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        summed.write.mode("overwrite").parquet(path)
        return True

    def totals(self) -> DataFrame:
        paths = self._batches()
        if not paths:
            return self.spark.createDataFrame([], CHANGES)
        rows = self.spark.read.schema(CHANGES).parquet(*paths)
        return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).where("docs <> 0 or tokens <> 0")
