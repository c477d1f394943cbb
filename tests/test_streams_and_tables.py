import os
import tempfile

from pyspark.sql import functions as F

from sitequarry.operators import conversations
from sitequarry.sources import writers
from sitequarry.streaming import streams


def folder():
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


def as_stream(spark, df, files=3):
    path = folder() + "/in"
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_stream_ingest_equals_batch_and_repeats_nothing(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("url", "html")
    table = folder() + "/chunks"
    for _ in range(2):  # a second run over the same pages, from another checkpoint, adds nothing
        streams.ingest(as_stream(spark, pages), table, folder()).awaitTermination()
    got = sorted(r.hash for r in spark.read.parquet(table).select("hash").collect())
    assert got == sorted({r.hash for r in streams.page_chunks(pages).select("hash").collect()})
    assert os.path.isdir(f"{table}/kb_id=kb")


def test_stream_sessions_are_those_of_the_batch(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).orderBy("ts").coalesce(1)
    q = streams.sessions(as_stream(spark, events, 1)).writeStream.format("memory").queryName("got").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.user_id, r.first_at, r.events) for r in spark.table("got").collect()}
    batch = {(r.user_id, r.first_at, r.events) for r in conversations.sessions(events).collect()}
    assert got <= batch and len(got) > 0.9 * len(batch)  # the last ones are still open


def test_latest_state_of_a_stream(spark):
    schema = "url string, fetched_at int, text string"
    newest = lambda t: {(r.url, r.text) for r in streams.latest(spark, t, schema).collect()}
    rows = [("a", 1, "x"), ("b", 5, "y"), ("a", 3, "z"), ("a", 2, "w")]
    table, gathered, state = folder(), folder() + "/g", folder()
    stream = as_stream(spark, spark.createDataFrame(rows, schema), 4)
    for _ in range(2):  # the second time there is nothing new
        streams.upsert_latest(stream, table, state).awaitTermination()
    assert newest(table) == {("a", "z"), ("b", "y")}
    later = as_stream(spark, spark.createDataFrame([("b", 4, "old"), ("c", 1, "n"), ("a", 9, "new")], schema), 1)
    streams.upsert_latest(later, table, folder()).awaitTermination()  # a new checkpoint on an old table
    assert newest(table) == {("a", "new"), ("b", "y"), ("c", "n")}
    streams.compact(spark, table, gathered, schema)
    assert newest(gathered) == newest(table) and spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(gathered).count() == 3


def test_cache_with_a_time_to_live(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts")).orderBy("ts").coalesce(1)
    for seconds in (60, 3600, 40_000):
        out = folder() + "/hits"
        streams.ttl_cache(as_stream(spark, events, 1), seconds).writeStream.format("parquet").option("path", out).option("checkpointLocation", folder()).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        fetched, want = {}, []
        for r in events.collect():
            hit = r.key in fetched and (r.ts - fetched[r.key]).total_seconds() <= seconds
            if not hit:
                fetched[r.key] = r.ts
            want.append((r.key, r.ts, hit))
        assert sorted(map(tuple, spark.read.parquet(out).select("key", "ts", "hit").collect())) == sorted(want)
        assert len({h for _, _, h in want}) == 2


def test_cache_forgets_what_is_too_old(spark):
    """State follows the keys of a time to live: read through the state data source after each of three days, a hundred keys a day."""
    source, checkpoint, out = folder(), folder(), folder()
    os.makedirs(source, exist_ok=True)
    stream = spark.readStream.schema("key string, ts timestamp").parquet(source)
    sizes = []
    for day in range(3):
        rows = spark.range(100).select(F.concat(F.lit(f"d{day}-"), "id").alias("key"), F.timestamp_seconds(F.lit(86400 * (day + 1)) + F.col("id")).alias("ts"))
        rows.unionByName(rows.limit(10).select("key", (F.col("ts") + F.expr("interval 30 minutes")).alias("ts"))).write.mode("append").parquet(source)
        streams.ttl_cache(stream, 3600).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
        sizes.append(spark.read.format("statestore").option("stateVarName", "fetched").load(checkpoint).count())
    assert sizes == [100, 100, 100]
    got = spark.read.parquet(out)
    assert got.count() == 330 and got.where("hit").count() == 30


def test_alerts_of_streams_are_those_of_the_batch(spark):
    calls = spark.createDataFrame([(1, 6000, True, "GET", "/a"), (2, 10, False, "GET", "/b"), (3, 10, True, "GET", "/c"), (4, 9000, False, "POST", "/d")], "ts int, response_time int, success boolean, method string, endpoint string")
    errors, health = spark.createDataFrame([(5, "boom")], "ts int, error string"), spark.createDataFrame([(6, "healthy"), (7, "down")], "ts int, status string")
    want = sorted(map(tuple, streams.alerts(calls, errors, health).collect()))
    out = folder() + "/alerts"
    live = streams.alerts(*[as_stream(spark, x) for x in (calls, errors, health)])
    live.writeStream.format("parquet").option("path", out).option("checkpointLocation", folder()).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want and len(want) == 5


def test_content_dedup_in_a_stream(spark):
    df = spark.createDataFrame([("h", "u1"), ("h", "u2"), ("g", "u3")], "content_hash string, url string")
    q = streams.first_of_content(as_stream(spark, df)).writeStream.format("memory").queryName("firsts").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 2


def test_chunk_tables(spark):
    chunks = spark.createDataFrame([("k", "u1", "h1"), ("k", "u2", "h2"), ("m", "u1", "h1")], "kb_id string, url string, hash string")
    path = folder() + "/t"
    for _ in range(2):
        writers.append_fresh(chunks, path)
    assert {r.kb_id: r.chunks for r in writers.rows_by_base(spark.read.parquet(path)).collect()} == {"k": 2, "m": 1}
    writers.delete_urls(spark, path, spark.createDataFrame([("u1",)], "url string"))
    assert [r.url for r in spark.read.parquet(path).collect()] == ["u2"]
    assert writers.without_base(chunks, "k").count() == 1


def test_bases_change_in_place(spark):
    """Deletes, upserts and drops touch the files of their bases only; a base whose rows all go has no partition left; nothing to change changes nothing."""
    path = folder() + "/t"
    rows = [(f"k{b}", f"u{u}", f"h{b}{u}") for b in range(4) for u in range(5)]
    writers.append_chunks(spark.createDataFrame(rows, "kb_id string, url string, hash string").coalesce(1), path)
    files = lambda: {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    table = lambda: {(r.kb_id, r.url, r.hash) for r in spark.read.parquet(path).collect()}
    before, urls = files(), lambda *u: spark.createDataFrame([(x,) for x in u], "url string")
    writers.delete_urls(spark, path, urls("nowhere"))
    assert files() == before
    extra = spark.createDataFrame([("k1", "only", "x")], "kb_id string, url string, hash string")
    writers.append_chunks(extra, path)
    writers.delete_urls(spark, path, urls("only"))
    assert table() == set(rows) and {f: t for f, t in files().items() if "kb_id=k1" not in f} == {f: t for f, t in before.items() if "kb_id=k1" not in f}
    writers.upsert_chunks(spark, path, spark.createDataFrame([("k2", "u0", "new"), ("k2", "u9", "new"), ("k9", "u0", "new")], "kb_id string, url string, hash string"))
    assert table() == (set(rows) - {("k2", "u0", "h20")}) | {("k2", "u0", "new"), ("k2", "u9", "new"), ("k9", "u0", "new")}
    assert {f: t for f, t in files().items() if "kb_id=k0" in f or "kb_id=k3" in f} == {f: t for f, t in before.items() if "kb_id=k0" in f or "kb_id=k3" in f}
    writers.delete_urls(spark, path, urls("u9", *[f"u{u}" for u in range(5)]))
    assert not files()
    writers.append_chunks(extra, path)
    writers.drop_base(spark, path, "k1")
    assert not files()
