"""Running totals of text lengths within keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import materialised

BEFORE = Window.unboundedPreceding, -1


def within(rows: DataFrame, key: str, order: str, text: str, most: int, between: int = 0, few: bool = False) -> DataFrame:
    """rows (key, order, text, others) with `_before`, the characters of the texts before each in its key, `between` more for each: those where it is `most` or less.

    Totals are on two levels: lengths alone are range-partitioned by (key, order), each range adds up its own, and a number is carried from the ranges before it; so a key
    of any size is many tasks. Texts meet the rows that stay. Rows of one place go by a hash of their text. few: keys have few rows by
    what made them (the k best of a question), and are added up in one window each."""
    size = F.coalesce(F.length(text), F.lit(0)) + between
    if few:
        before = F.coalesce(F.sum(size).over(Window.partitionBy(key).orderBy(order, F.xxhash64(text)).rowsBetween(*BEFORE)), F.lit(0))
        return rows.withColumn("_before", before).where(F.col("_before") <= most)
    lengths = rows.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.xxhash64(text).alias("_tie"), size.alias("_n"))
    place = ("_key", "_order", "_tie")
    ranged = materialised(lengths.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_range", F.spark_partition_id()))
    sums = ranged.groupBy(F.col("_range").alias("_r"), F.col("_key").alias("_k")).agg(F.sum("_n").alias("_sum"))
    carried = sums.withColumn("_carried", F.coalesce(F.sum("_sum").over(Window.partitionBy("_k").orderBy("_r").rowsBetween(*BEFORE)), F.lit(0))).where(F.col("_carried") <= most)
    met = ranged.join(carried, (F.col("_range") == F.col("_r")) & F.col("_key").eqNullSafe(F.col("_k")))
    local = F.coalesce(F.sum("_n").over(Window.partitionBy("_range", "_key").orderBy("_order", "_tie").rowsBetween(*BEFORE)), F.lit(0))
    kept = met.withColumn("_before", local + F.col("_carried")).where(F.col("_before") <= most)
    kept = materialised(kept.select(*place, "_before", _copy(place, "_before").alias("_copy")))
    same = F.col(key).eqNullSafe(F.col("_key")) & F.col(order).eqNullSafe(F.col("_order")) & (F.xxhash64(text) == F.col("_tie"))
    some = rows.join(kept.where("_copy = 1"), same, "left_semi").withColumn("_number", _copy((key, order, F.xxhash64(text)), F.lit(0)))
    return some.join(kept, same & (F.col("_number") == F.col("_copy"))).select(*rows.columns, "_before")


def _copy(place, order) -> Column:
    """The number of a row among those of one place: equal texts of one key and order."""
    return F.row_number().over(Window.partitionBy(*place).orderBy(order))
