"""Documents to training sequences: quality, near-duplicates, repeated passages, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next
stage. All but the last return the columns of documents. The mixture repeats a document as rows of the same doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitequarry.llm import curve_packing, near_copies, quality, source_mix, suffix_dedup
from sitequarry.llm.common import materialised, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier doesn't reject, each row by its own verdict."""
    return quality.classify(docs, table(spark, sf_dir, "labels"), carry=COLUMNS[1:]).where("keep").select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (0.8 of their five-word shingles or more), the document with the smallest id: one row."""
    return near_copies.one_of_each(docs, shingle=5, least=0.8).select(*COLUMNS)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without what smaller ids have already; those of which nothing is left go."""
    out = suffix_dedup.dedup(docs, carry=("lang", "source"), with_text=True)
    return out.where("n_removed = 0 or length(text) > 0").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources in their target shares: texts cut to the blocks that are drawn, and repeated as often as they are."""
    numbered = materialised(docs.withColumn("row", F.monotonically_increasing_id()))
    return source_mix.mixed_texts(numbered, source_mix.mix(numbered, row_col="row")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences."""
    return curve_packing.pack(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", one_of_each_group),
    ("suffix-array dedup", without_repeated_passages),
    ("mixing sources to target weights", mixed),
    ("packing", packed),
]

#: SQL can't express the classifier, the fingerprints or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
