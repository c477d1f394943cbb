"""Mixing sources to target weights by Sainte-Lague apportionment.

Sizes are counted in words. A source's target is its weighted share of all words, at most `cap` times its size, the
excess reshared by weight. Seats go to sources by the highest quotients target / (2 s + 1), but no more than `cap` times a source's size: the divisor
that gives the right number of seats is found by narrowing an interval, each
round one grouped sum over the sources. A seat is one word, the smallest equal block, so that sources of a few words meet their targets too. The seats of a source
go to its shards in the same way, which gives each shard an integer quota. Within a shard, documents lie in seeded order as one stream of words. The whole stream is taken
as often as the quota holds it; the rest is drawn from it in equal blocks of `block` words, systematically from a seeded start, the last of them cut to the quota. How many
words a document gives follows in closed form from running sums, so no row is made for a block.

Defined results: null texts and texts without words have size 0 and give 0 words; a null source is a source of its own, after the others; repeated rows are documents of their own; rows without an id, or of
one id, are drawn each for itself; an empty table gives an empty mix; other columns are ignored.
A shard holds at most about `shard_words` words until a source has `max_shards` shards, so that no task gets a whole source.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, materialised


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seats_by_quotient(votes: list[float], seats: int) -> list[int]:
    """Sainte-Lague: seats for votes by the highest quotients v / (2 s + 1); ties go to the earlier party."""
    total = float(sum(votes))
    if not seats or total <= 0:
        return [0] * len(votes)
    won = [max(0, int(v * seats / total - 1)) for v in votes]  # no party gets fewer than its share less one and a half, of which this is the safe part
    given = sum(won)
    heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, won)) if v > 0]
    heapq.heapify(heap)
    while given < seats:
        _, i = heapq.heappop(heap)
        won[i] += 1
        given += 1
        heapq.heappush(heap, (-votes[i] / (2 * won[i] + 1), i))
    while given > seats:
        i = min((i for i in range(len(won)) if won[i]), key=lambda i: (votes[i] / (2 * won[i] - 1), -i))
        won[i] -= 1
        given -= 1
    return won


def water_level(sources: DataFrame, total: int, cap: int) -> tuple[int, int]:
    """(a, b): a source's target is the lesser of weight * a / b and cap * size. One grouped sum for each round."""
    a, b = total, sources.agg(F.sum("weight")).first()[0]
    while True:
        full = F.col("size").cast("decimal(38,0)") * cap * b <= F.col("weight").cast("decimal(38,0)") * a
        held, left = sources.agg(F.coalesce(F.sum(F.when(full, F.col("size") * cap)), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if left is None or (total - held, left) == (a, b):
            return a, b
        a, b = total - held, left


def source_seats(sources: DataFrame, seats: int, rounds: int = 14, wide: int = 32) -> DataFrame:
    """sources (target and, if there is one, limit) with seats by Sainte-Lague on target, at most limit: the divisor's interval is narrowed, then what is left goes by quotient."""
    n, votes, most = sources.agg(F.count("*"), F.sum("target"), F.max("target")).first()
    if not seats or not votes:
        return sources.withColumn("seats", F.lit(0).cast("long"))
    limit = F.col("limit") if "limit" in sources.columns else F.lit(1 << 62)
    won = lambda d: F.least(F.floor(F.col("target") / F.lit(d) + 0.5), limit)
    low, high = votes / seats / (2 * n + 2), 2 * most + 1  # at low, seats or more are won; at high, none
    for _ in range(rounds):
        tried = [low * (high / low) ** (i / wide) for i in range(1, wide)] if high > 2 * low else [low + (high - low) * i / wide for i in range(1, wide)]
        counts = sources.agg(*[F.sum(won(d)).alias(f"c{i}") for i, d in enumerate(tried)]).first()
        enough = [d for d, c in zip(tried, counts) if c >= seats]
        fewer = [d for d, c in zip(tried, counts) if c < seats]
        low, high = max([low, *enough]), min([high, *fewer])
        if low in enough and counts[tried.index(low)] == seats:
            return sources.withColumn("seats", won(low).cast("long"))
    given = sources.agg(F.sum(won(high))).first()[0]
    close = sources.where(won(low) > won(high)).select("source_key", (F.col("target") / (2 * won(high) + 1)).alias("quotient")).orderBy(F.desc("quotient"), "source_key").limit(int(seats - given))
    return sources.join(close, "source_key", "left").withColumn("seats", (won(high) + F.col("quotient").isNotNull().cast("int")).cast("long")).drop("quotient")


def numbered(sources: DataFrame) -> DataFrame:
    """sources with their place in the order of source_key. Ranges of keys are numbered each for itself; one row a range is added up."""
    spark = sources.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    within = sources.repartitionByRange(parts, "source_key").sortWithinPartitions("source_key").withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()})
    within = materialised(within.withColumn("at", F.col("at") - F.shiftleft(F.col("part").cast("long"), 33)))
    before = {r["part"]: r["n"] for r in within.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row for each range
    firsts = spark.createDataFrame([(p, sum(n for q, n in before.items() if q < p)) for p in before], "part int, first long")
    return within.join(F.broadcast(firsts), "part").withColumn("place", F.col("first") + F.col("at")).drop("part", "at", "first")


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int = 32, shard_words: int = 100_000, max_shards: int = 4096, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken and, for what is cut from the text: shard, start (words of the shard
    before the document), quota and words (of the shard), offset (the draw's seeded start). With row_col, a number of each row, row as well."""
    sized = materialised(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("t")).alias("source_key"),  # a null source sorts last
            word_count(F.col(text_col)).alias("size"),
            F.xxhash64(id_col, text_col, F.lit(seed)).alias("draw"),
            *([] if row_col is None else [F.col(row_col).alias("row")]),
        ).withColumn("cell", F.pmod(F.xxhash64("draw"), F.lit(max_shards)).cast("int"))
    )
    sources = numbered(sized.groupBy("source_key").agg(F.sum("size").alias("size")))
    sources = materialised(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")))
    total = sources.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    a, b = water_level(sources, total, cap) if total else (0, 1)
    target = F.least(F.col("weight") * F.lit(float(a)) / F.lit(float(b)), (F.col("size") * cap).cast("double"))
    sources = source_seats(sources.withColumns({"target": target, "limit": F.col("size") * cap}), total)
    sources = sources.withColumn("shards", F.greatest(F.lit(1), F.least(F.lit(max_shards), F.ceil(F.col("size") / shard_words))).cast("int"))

    # What documents learn of their source they learn by cell, of which a source has max_shards at most: no join has a hot key.
    cells = sized.groupBy("source_key", "cell").agg(F.sum("size").alias("cell_size"))
    cells = cells.join(sources.select("source_key", F.col("size").alias("source_size"), "target", "seats", "shards"), "source_key").withColumn("shard", F.pmod("cell", "shards"))
    cells = materialised(cells)
    shard_sizes = cells.groupBy("source_key", "shard").agg(F.sum("cell_size").alias("words"), F.first("seats").alias("seats"))

    def quotas(group: pd.DataFrame) -> pd.DataFrame:  # at most max_shards rows
        group = group.sort_values("shard", ignore_index=True)
        return group.assign(quota=seats_by_quotient(group["words"].tolist(), int(group["seats"].iloc[0])))[["source_key", "shard", "words", "quota"]]

    shards = shard_sizes.groupBy("source_key").applyInPandas(quotas, "source_key string, shard int, words long, quota long")
    shards = shards.withColumn("offset", F.pmod(F.xxhash64("source_key", "shard", F.lit(seed)), F.greatest(F.floor(F.col("words") / block), F.lit(1))))
    stream = Window.partitionBy("source_key", "shard").orderBy("draw", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    told = cells.join(shards, ["source_key", "shard"]).drop("cell_size", "seats", "shards")
    placed = sized.join(told, ["source_key", "cell"]).withColumn("start", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    taken = taken_before(F.col("start") + F.col("size"), block) - taken_before(F.col("start"), block)
    return placed.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(F.lit(0)).cast("long").alias("taken"), "shard", "start", "quota", "words", "offset", *["row"] * (row_col is not None))


def taken_before(at: Column, block: int) -> Column:
    """Words that the draw takes, repeats counted, from the words before `at` in a shard's stream. Of the stream, `times` whole copies are taken and
    `rest` words more: from the first of its whole blocks, then from what is behind them."""
    words, quota = F.col("words"), F.col("quota")
    times = F.floor(quota / words)
    rest, blocks = quota - times * words, F.floor(words / block)
    drawn_blocks = F.least(F.ceil(rest / block), blocks)
    drawn = lambda k: F.when(blocks > 0, F.floor((k * drawn_blocks + F.col("offset")) / blocks) - F.floor(F.col("offset") / blocks)).otherwise(0)
    k = F.least(F.floor(at / block), blocks)
    inside = F.when(k < blocks, (drawn(k + 1) - drawn(k)) * (at - k * block)).otherwise(0)
    extra = F.least(rest, drawn(k) * block + inside) + F.greatest(F.lit(0), F.least(at, rest) - blocks * block)
    return F.when(words > 0, times * at + F.least(rest, extra)).otherwise(F.lit(0))


def times_taken(start: int, n: int, quota: int, words: int, offset: int, block: int) -> np.ndarray:
    """How often each of n words from `start` on is taken: taken_before, word by word."""
    at = np.arange(start, start + n + 1)
    times, rest = divmod(quota, words)
    blocks = words // block
    drawn_blocks = min(-(-rest // block), blocks)
    drawn = (lambda k: (k * drawn_blocks + offset) // blocks - offset // blocks) if blocks else (lambda k: 0 * k)
    k = np.minimum(at // block, blocks)
    inside = np.where(k < blocks, (drawn(k + 1) - drawn(k)) * (at - k * block), 0)
    extra = np.minimum(rest, drawn(k) * block + inside) + np.maximum(0, np.minimum(at, rest) - blocks * block)
    return np.diff(times * at + np.minimum(rest, extra))


def drawn_texts(text: str | None, start: int, quota: int, words: int, offset: int, block: int) -> list[str]:
    """The text as often as the mix takes it: each time what is left of it when only the words taken that often stay."""
    spans = [m.span() for m in re.finditer(WORD, text or "")]
    if not spans or not words:
        return []
    times = times_taken(start, len(spans), quota, words, offset, block)
    out = []
    for r in range(1, int(times.max()) + 1):
        on = np.concatenate([[False], times >= r, [False]])
        if on[1:-1].all():
            out.append(text)
            continue
        first, end = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
        out.append("\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in zip(first.tolist(), end.tolist())))
    return out


def mixed_texts(docs: DataFrame, mix_rows: DataFrame, *, block: int = 32) -> DataFrame:
    """The columns of documents, a row for each time that a document is taken. Rows pair by row, the number that mix() was given as row_col."""
    draw = mix_rows.where("taken > 0").select("row", "start", "quota", "words", "offset")
    joined = docs.select("doc_id", "text", "lang", "source", "row").join(draw, "row")

    def run(batches):
        for batch in batches:
            rows = [(d, t, lang, source) for d, text, lang, source, *draw in zip(*(c.to_pylist() for c in batch.columns)) for t in drawn_texts(text, *draw, block)]
            columns = [*zip(*rows)] or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["doc_id", "text", "lang", "source"])

    out = joined.select("doc_id", "text", "lang", "source", "start", "quota", "words", "offset").mapInArrow(run, "doc_id long, text string, lang string, source string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
