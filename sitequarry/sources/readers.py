"""Sources: captured pages, sitemaps, robots files, feeds, registries, messages. All are Spark readers or
column expressions over what Spark read, so any store that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialised


def captured_pages(spark: SparkSession, path: str, streaming: bool = False, schema: str = "page_id long, url string, html string") -> DataFrame:
    """SRC1: captured pages that have html."""
    rows = spark.readStream.schema(schema).parquet(path) if streaming else spark.read.parquet(path)
    return rows.where("html is not null and html <> ''")


def sitemap_urls(sitemaps: DataFrame, body: str = "body") -> DataFrame:
    """SRC2: sitemap bodies -> loc, lastmod; the other columns stay."""
    rows = sitemaps.withColumn("_u", F.explode(F.regexp_extract_all(body, F.lit(r"(?is)<url\b[^>]*>(.*?)</url>"), F.lit(1))))
    return rows.select(*[c for c in sitemaps.columns if c != body], _tag("_u", "loc").alias("loc"), _tag("_u", "lastmod").alias("lastmod")).where("loc is not null")


def sitemap_files(spark: SparkSession, path: str) -> DataFrame:
    """SRC2 from files, with Spark's XML reader."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)


def child_sitemaps(sitemaps: DataFrame, body: str = "body") -> DataFrame:
    """The sitemaps that an index names."""
    found = F.regexp_extract_all(body, F.lit(r"(?is)<sitemap\b[^>]*>(.*?)</sitemap>"), F.lit(1))
    rows = sitemaps.select("*", F.posexplode(found).alias("n", "_s"))
    return rows.select(*[c for c in sitemaps.columns if c != body], "n", _tag("_s", "loc").alias("child"))


def expanded_sitemaps(roots: DataFrame, captured: DataFrame, depth: int = 5, most: int = 50, urls_most: int = 50_000) -> DataFrame:
    """SRC3: roots (site, url) with captured sitemaps (url, body): the pages of all sitemaps reached, with the site's caps on
    sitemaps and urls."""
    level = roots.select("site", "url").distinct()
    reached = level.withColumn("level", F.lit(0))
    for n in range(1, depth + 1):
        children = child_sitemaps(level.join(captured, "url").select("site", "url", "body"))
        level = materialised(children.select("site", F.col("child").alias("url")).distinct().join(reached.select("site", "url"), ["site", "url"], "left_anti"))
        if level.isEmpty():
            break
        reached = reached.unionByName(level.withColumn("level", F.lit(n)))
    first = Window.partitionBy("site").orderBy("level", "url")
    kept = reached.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= most)
    urls = sitemap_urls(kept.join(captured, "url").select("site", "level", "body"))
    order = Window.partitionBy("site").orderBy("level", "loc")
    return urls.groupBy("site", "loc").agg(F.min("level").alias("level"), F.max("lastmod").alias("lastmod")).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= urls_most).drop("_n")


def _tag(column: str, name: str) -> Column:
    value = F.trim(F.regexp_extract(column, rf"(?is)<{name}\b[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{name}>", 1))
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        value = F.replace(value, F.lit(entity), F.lit(char))
    return F.nullif(value, F.lit(""))


def feed_updated(body: str = "body") -> Column:
    """SRC5: the time a feed says it changed; null for what is no feed."""
    is_feed = F.col(body).rlike(r"(?i)<(rss|feed|rdf:RDF)\b")
    return F.when(is_feed, F.coalesce(_tag(body, "lastBuildDate"), _tag(body, "pubDate"), _tag(body, "updated")))


def registry(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC6: a JSON array of loosely typed objects; missing keys are null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def history(files: DataFrame, body: str = "value") -> DataFrame:
    """SRC7: JSON maps of id to runs -> a row for each run."""
    kind = "map<string,struct<knowledgeBaseId:string,clientUrl:string,lastRunAt:timestamp,lastRunOutcome:string,runs:array<struct<startedAt:timestamp,finishedAt:timestamp,outcome:string,pagesChecked:int,pagesChanged:int,error:string>>>>"
    rows = files.select(F.explode(F.from_json(body, kind)).alias("demo_id", "h"))
    runs = rows.select("demo_id", F.col("h.knowledgeBaseId").alias("knowledge_base_id"), F.col("h.clientUrl").alias("client_url"), F.explode_outer("h.runs").alias("r"))
    return runs.select("demo_id", "knowledge_base_id", "client_url", F.col("r.startedAt").alias("started_at"), F.col("r.finishedAt").alias("finished_at"), F.col("r.outcome").alias("outcome"), F.col("r.pagesChecked").alias("pages_checked"), F.col("r.pagesChanged").alias("pages_changed"), F.col("r.error").alias("error"))


def attachments(spark: SparkSession, path: str, chars: int = 8000) -> DataFrame:
    """SRC8: path, text of plain-text files; null for other types."""
    rows = spark.read.format("binaryFile").load(path)
    plain = F.lower(F.col("path")).rlike(r"\.(txt|md|csv|json|html?|xml|log)$")
    return rows.select("path", F.when(plain, F.substring(F.decode("content", "UTF-8"), 1, chars)).alias("text"))


def indexed_hashes(spark: SparkSession, path: str, kb_id: str | None = None) -> DataFrame:
    """SRC10: the hash column of a chunk table, of one knowledge base if it's named."""
    rows = spark.read.parquet(path)
    return (rows.where(F.col("kb_id") == kb_id) if kb_id else rows).select("kb_id", "hash")


def inbound_messages(raw: DataFrame, body: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """SRC11: JSON payloads of messengers and mail -> channel, sender, subject, message, media, received_at, and the columns named in keep."""
    get = lambda *names: F.coalesce(*[F.nullif(F.get_json_object(body, f"$.{n}"), F.lit("")) for n in names])
    sender = get("From", "from")
    media = F.when(get("MediaUrl0").isNotNull(), F.struct(get("MediaUrl0").alias("url"), get("MediaContentType0").alias("type")))
    return raw.select(
        *keep, F.when(sender.startswith("whatsapp:"), "whatsapp").otherwise("email").alias("channel"), F.regexp_replace(F.coalesce(sender, F.lit("")), "^whatsapp:", "").alias("sender"),
        F.coalesce(get("Subject", "subject"), F.lit("")).alias("subject"), F.coalesce(get("Body", "text"), F.lit("")).alias("message"), get("html").alias("html"), media.alias("media"), F.try_to_timestamp(get("timestamp")).alias("received_at"),
    )
