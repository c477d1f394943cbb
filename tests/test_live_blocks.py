import glob

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sitequarry.operators import livesearch
from sitequarry.sources import shared


def written(spark, what: str) -> int:
    """What all stages so far have written to shuffles."""
    gateway = spark.sparkContext._gateway
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), None)
    return sum(getattr(stages.apply(i), what)() for i in range(stages.size()))


def test_a_word_of_all_pages_is_not_a_row_for_each_question_and_page(spark):
    """A word that all pages of a root have, asked by all questions; in blocks of few pages and questions, the best pages are those of all pairs."""
    rows = [(f"r{i % 2}", f"https://x.it/{i % 700}", f"comune numero{i % 9}" + (" contatti" if i % 11 == 0 else "")) for i in range(3000)]
    links = spark.createDataFrame(rows, "root string, url string, anchor string")
    asked = [(i, f"r{i % 2}", ["comune", f"numero{i % 9}", "comune"] if i % 5 else []) for i in range(200)]
    asked = spark.createDataFrame(asked, "query_id int, root string, tokens array<string>")
    index = livesearch.PageIndex.build(links, livesearch.new_folder(spark, "index"))
    every = asked.join(links, "root").withColumn("score", livesearch.S.link_score(F.col("tokens"), F.col("anchor"), F.col("url")))
    w = livesearch.Window.partitionBy("query_id").orderBy(F.desc("score"), "url")
    key = lambda df: [(r.query_id, r.score, r.url) for r in df.withColumn("n", F.row_number().over(w)).where("n <= 10").orderBy("query_id", "n").collect()]
    want = key(every)
    begin = written(spark, "shuffleWriteRecords")
    assert key(index.best(asked, 10)) == want
    assert 0 < written(spark, "shuffleWriteRecords") - begin < 60_000  # of 300,000 pairs
    if hasattr(index, "matches"):
        assert key(index.best(asked, 10, block_pages=400, block_queries=30)) == want


def test_pages_are_kept_once_and_without_what_nothing_reads(spark, sf):
    """live_search parses pages into one table, of the columns that contexts are made of."""
    folder = lambda: set(glob.glob(f"{shared.shared_folder(spark).removeprefix('file:')}/*"))
    before = folder()
    got = {r.query_id: r for r in entry.queries()["live_search"](spark, sf).collect()}
    kept = [set(spark.read.parquet(f).columns) for f in folder() - before if f.rsplit("/", 1)[1].startswith("table-")]
    assert len([c for c in kept if "raw_text" in c]) == 1 and not any(c & {"links", "text", "named_links"} for c in kept)
    assert got and any(r.pages > 0 for r in got.values())
