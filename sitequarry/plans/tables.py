"""Registered queries over sources, sinks, the frontier and the registry. What a crawl would have captured (sitemaps, robots files, feeds, JSON files)
is derived from the given tables, piece by piece, so that it grows with them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..functions import urls as U
from ..operators import conversations, dedup, freshness, frontier, monitoring, registry
from ..sources import readers, writers
from ..sources.shared import new_folder
from .queries import FRONTIER_SQL, JOBS_SQL, PARSED_URL, frontier_rows, job_rows, metric_rows, query, table


def text(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def joined(*parts) -> F.Column:
    return F.concat(*[text(p) if not isinstance(p, str) else F.lit(p) for p in parts])


@query("""SELECT page_id, url, length(html)::INTEGER AS chars FROM pages WHERE html IS NOT NULL AND html <> ''""")
def captured_pages(spark, sf_dir):
    """SRC1."""
    return readers.captured_pages(spark, f"{sf_dir}/pages.parquet").select("page_id", "url", F.length("html").alias("chars"))


def sitemap_rows(spark, sf_dir) -> DataFrame:
    """A sitemap for every 16 pages: map, body. Every third page has no date."""
    p = table(spark, sf_dir, "pages")
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd")
    dated = F.when(F.col("page_id") % 3 != 0, joined("<lastmod>", day, "</lastmod>")).otherwise("")
    entry = joined("<url>\n <loc>", F.replace("url", F.lit("&"), F.lit("&amp;")), "</loc>", dated, "</url>\n")
    return p.groupBy(F.floor(F.col("page_id") / 16).alias("map")).agg(F.array_join(F.array_sort(F.collect_list(entry)), "").alias("entries")).select("map", joined('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">', F.col("entries"), "</urlset>").alias("body"))


LASTMOD_SQL = "CASE WHEN page_id % 3 <> 0 THEN strftime(DATE '2024-01-01' + (page_id % 300)::INTEGER, '%Y-%m-%d') END"


@query(f"""SELECT page_id // 16 AS map, url AS loc, {LASTMOD_SQL} AS lastmod FROM pages""")
def sitemap_scan(spark, sf_dir):
    """SRC2."""
    return readers.sitemap_urls(sitemap_rows(spark, sf_dir))


@query(f"""SELECT url AS loc, {LASTMOD_SQL} AS lastmod FROM pages""")
def sitemap_file_scan(spark, sf_dir):
    """SRC2 from files, with Spark's XML reader."""
    path = new_folder(spark, "sitemaps")
    sitemap_rows(spark, sf_dir).repartition("map").write.partitionBy("map").text(path)
    return readers.sitemap_files(spark, path).select("loc", "lastmod")


@query("""WITH m AS (SELECT DISTINCT page_id // 16 AS map FROM pages), i AS (SELECT DISTINCT map // 8 AS site FROM m),
s AS (SELECT site, map, row_number() OVER (PARTITION BY site ORDER BY printf('map-%06d.xml', map)) AS n FROM i JOIN m ON map // 8 = site),
u AS (SELECT site, url, row_number() OVER (PARTITION BY site ORDER BY url) AS n FROM s JOIN pages ON page_id // 16 = map WHERE s.n <= 5 GROUP BY site, url)
SELECT site, url AS loc FROM u WHERE n <= 60""")
def sitemap_expansion(spark, sf_dir):
    """SRC3: an index for every eight sitemaps, which names itself too; caps of six sitemaps and sixty urls bite (limits are the feature)."""
    maps = sitemap_rows(spark, sf_dir)
    name = F.format_string("map-%06d.xml", "map")
    site = F.floor(F.col("map") / 8)
    entry = joined("<sitemap><loc>", name, "</loc></sitemap>")
    body = joined("<sitemapindex>", F.array_join(F.array_sort(F.collect_list(entry)), ""), "<sitemap><loc>index-", F.first(site), "</loc></sitemap></sitemapindex>")
    index = maps.groupBy(site.alias("site")).agg(body.alias("body")).select("site", joined("index-", F.col("site")).alias("url"), "body")
    captured = index.select("url", "body").unionByName(maps.select(name.alias("url"), "body"))
    return readers.expanded_sitemaps(index.select("site", "url"), captured, most=6, urls_most=60).select("site", "loc")


ROBOTS_SQL = f"""{PARSED_URL}, r AS (SELECT host, max(path) AS no, min(path) AS yes, min(page_id) AS first_id FROM p GROUP BY host)"""


def robots_rows(spark, sf_dir) -> DataFrame:
    """A robots file for each host: its last path is disallowed, its first allowed; another agent may see nothing."""
    p = table(spark, sf_dir, "pages").select("page_id", U.host_of(F.col("url")).alias("host"), U.part(F.col("url"), 4).alias("path"))
    r = p.groupBy("host").agg(F.max("path").alias("no"), F.min("path").alias("yes"), F.min("page_id").alias("first_id"))
    body = joined("User-agent: other\nDisallow: /\n\nUser-Agent: *\nDisallow: ", F.col("no"), " # the last\nAllow: ", F.col("yes"), "\nSitemap: https://", F.col("host"), "/map-", F.col("first_id"), ".xml\n")
    return r.select("host", body.alias("body"), F.timestamp_seconds(1700000000 + F.col("first_id") * 3600).alias("fetched_at"))


@query(f"""WITH {ROBOTS_SQL} SELECT host, 'other' AS agent, false AS allow, '/' AS pattern FROM r UNION ALL SELECT host, '*', false, no FROM r WHERE no <> '' UNION ALL SELECT host, '*', true, yes FROM r WHERE yes <> ''""")
def robots_rules(spark, sf_dir):
    """SRC4."""
    return frontier.robots_rules(robots_rows(spark, sf_dir))


@query(f"""WITH {ROBOTS_SQL} SELECT host, 'https://' || host || '/map-' || first_id || '.xml' AS sitemap FROM r UNION SELECT host, 'https://' || host || '/sitemap.xml' FROM r""")
def sitemap_seeds(spark, sf_dir):
    """SET5, SRC4: sitemaps that robots files name, and the default ones."""
    return frontier.robots_sitemaps(robots_rows(spark, sf_dir))


@query(f"""WITH {ROBOTS_SQL} SELECT page_id, (no = '' OR NOT starts_with(CASE WHEN path = '' THEN '/' ELSE path END, no) OR (yes <> '' AND starts_with(path, yes) AND length(yes) >= length(no))) AS allowed FROM p JOIN r USING (host)""")
def robots_verdicts(spark, sf_dir):
    """FLT2: the longest pattern decides, and of equal ones the one that allows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return frontier.robots_allowed(pages, frontier.robots_rules(robots_rows(spark, sf_dir)), "bot").select("page_id", "allowed")


@query(rf"""WITH {PARSED_URL}, r AS (SELECT host, 1700000000 + page_id * 7919 % 400000 AS fetched_at, max('Disallow: /' || page_id) AS body FROM p GROUP BY ALL), a AS (SELECT page_id, host, 1700000000 + page_id * 104729 % 500000 AS asked_at FROM p)
SELECT page_id, CASE WHEN asked_at - fetched_at < 86400 THEN body END AS body FROM a ASOF LEFT JOIN r ON a.host = r.host AND a.asked_at >= r.fetched_at""")
def robots_as_of(spark, sf_dir):
    """JOI8: every page is a capture of its host's robots file, and a fetch at another time: it goes by the newest capture before it, of the same day."""
    at = lambda step, span: F.timestamp_seconds(1700000000 + F.col("page_id") * step % span)
    p = table(spark, sf_dir, "pages").select("page_id", "url", U.host_of(F.col("url")).alias("host"))
    robots = p.select("host", at(7919, 400000).alias("fetched_at"), joined("Disallow: /", F.col("page_id")).alias("body"))
    return frontier.robots_as_of(p.select("page_id", "url", at(104729, 500000).alias("at")), robots, F.col("at")).select("page_id", "body")


@query(f"""WITH {ROBOTS_SQL} SELECT page_id, 1700000000 + first_id * 3600 > 1700180000 - 86400 AS usable FROM p JOIN r USING (host)""")
def robots_cache(spark, sf_dir):
    """JOI8: a host's robots file counts for a day."""
    urls = table(spark, sf_dir, "pages").select("page_id", "url")
    return frontier.fresh_robots(urls, robots_rows(spark, sf_dir), F.timestamp_seconds(F.lit(1700180000))).select("page_id", F.col("body").isNotNull().alias("usable"))


@query("""SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'Mon, 01 Jan 2024' WHEN 1 THEN url WHEN 2 THEN '2024-02-02T00:00:00Z' END AS updated FROM pages""")
def feed_times(spark, sf_dir):
    """SRC5: each page with a feed: a build date, a publication date, an Atom update, or no feed."""
    n = F.col("page_id") % 4
    body = F.when(n == 0, "<?xml version='1.0'?><rss><channel><pubDate>x</pubDate><lastBuildDate>Mon, 01 Jan 2024</lastBuildDate></channel></rss>").when(n == 1, joined("<rss><channel><lastBuildDate></lastBuildDate><pubDate><![CDATA[", F.col("url"), "]]></pubDate></channel></rss>")).when(n == 2, "<feed><updated> 2024-02-02T00:00:00Z </updated></feed>").otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", body.alias("body")).select("page_id", readers.feed_updated().alias("updated"))


def demo_rows(spark, sf_dir) -> DataFrame:
    """Customers as demos: every field of the registry, with odd values among them."""
    k = F.col("c_custkey")
    every = lambda n, value, other=None: F.when(k % n == 0, value).otherwise(F.lit(other) if not isinstance(other, F.Column) else other)
    style = F.struct(
        F.struct(text(k % 50).alias("window"), every(3, "x", "8").alias("bubble")).alias("borderRadius"), F.element_at(F.array(*map(F.lit, ("top-left", "middle", "bottom-right"))), (k % 3 + 1).cast("int")).alias("position"),
        every(2, "large", "huge").alias("sizePreset"), F.struct(text(k % 60).alias("blur"), text(k % 400).alias("saturate"), text((k % 10) / 10).alias("opacity")).alias("glass"),
    )
    return table(spark, sf_dir, "customer").select(
        text(k).alias("id"), F.timestamp_seconds(1700000000 + k).alias("created_at"), joined("user", k % 7).alias("created_by"), F.col("c_mktsegment").alias("product"), joined("https://www.", F.lower("c_mktsegment"), "-", k % 5, ".it/x").alias("client_url"),
        F.array(joined("https://a", k % 4, ".it"), F.lit("https://b.it")).alias("search_urls"), every(3, "live", "crawling").alias("search_mode"), every(4, None, joined("kb", k)).alias("knowledge_base_id"), every(5, False, every(7, None, True).cast("boolean")).alias("enabled"),
        text(k % 14).alias("crawl_max_depth"), every(2, joined(k, ".5"), text(k)).alias("crawl_max_pages"), joined("  ", F.col("c_name"), "\n").alias("welcome"), F.array(joined(" q", k, " "), F.lit("  "), F.lit(None).cast("string"), F.lit("x" * 130)).alias("questions"),
        every(2, joined("/uploads/", k, ".png"), "/uploads/../x").alias("logo"), F.create_map(F.lit("main"), F.col("c_name")).alias("colors"), style.alias("style"), (k % 30).cast("int").alias("recrawl_interval_days"),
    )


@query("""SELECT c_custkey::VARCHAR AS id, 'user' || c_custkey % 7 AS created_by, CASE WHEN c_custkey % 5 = 0 THEN false WHEN c_custkey % 7 = 0 THEN NULL ELSE true END AS enabled, 2::INTEGER AS urls, (c_custkey % 50)::VARCHAR AS radius FROM customer""")
def registry_scan(spark, sf_dir):
    """SRC6: JSON arrays of a hundred demos each."""
    path = new_folder(spark, "registry")
    rows = demo_rows(spark, sf_dir).groupBy(F.floor(F.col("id").cast("long") / 100).alias("part")).agg(F.to_json(F.collect_list(F.struct(*[c.split(" ")[0] for c in ("id", "created_by", "enabled", "search_urls", "style")]))).alias("value"))
    rows.repartition("part").write.partitionBy("part").text(path)
    return readers.registry(spark, path, registry.SCHEMA).select("id", "created_by", "enabled", F.size("search_urls").alias("urls"), F.col("style.borderRadius.window").alias("radius"))


@query("""SELECT o_custkey::VARCHAR AS demo_id, 'kb' || o_custkey AS knowledge_base_id, o_orderstatus AS outcome, (o_orderkey % 100)::INTEGER AS pages_checked, epoch(o_orderdate)::BIGINT AS finished FROM orders""")
def history_scan(spark, sf_dir):
    """SRC7: a JSON map for each customer and month, whose orders are the runs."""
    run = F.struct(F.col("o_orderdate").alias("finishedAt"), F.col("o_orderstatus").alias("outcome"), (F.col("o_orderkey") % 100).cast("int").alias("pagesChecked"))
    grouped = table(spark, sf_dir, "orders").groupBy("o_custkey", F.date_trunc("month", "o_orderdate").alias("month")).agg(F.collect_list(run).alias("runs"))
    files = grouped.select(F.to_json(F.create_map(text("o_custkey"), F.struct(joined("kb", F.col("o_custkey")).alias("knowledgeBaseId"), F.col("runs").alias("runs")))).alias("value"))
    return readers.history(files).select("demo_id", "knowledge_base_id", "outcome", "pages_checked", F.unix_seconds("finished_at").alias("finished"))


@query("""WITH g AS (SELECT doc_id // 32 AS part, string_agg(text || chr(10), '' ORDER BY doc_id) AS t FROM documents GROUP BY 1)
SELECT part, sha256(substr(t, 1, 8000)) AS hash FROM g UNION ALL SELECT -1, NULL""")
def attachment_scan(spark, sf_dir):
    """SRC8: files of 32 documents each; of a text, its first 8,000 characters count (the limit is the feature), of another type nothing."""
    path = new_folder(spark, "attachments")
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 32).alias("part"), "doc_id", "text")
    docs.repartition("part").sortWithinPartitions("part", "doc_id").drop("doc_id").write.partitionBy("part").text(path)
    table(spark, sf_dir, "region").limit(1).select(F.lit(b"\x00\x01").alias("r")).repartition(1).write.parquet(f"{path}/part=-1")  # an attachment of a type that isn't text
    rows = readers.attachments(spark, f"{path}/*/*.*")
    return rows.select(F.regexp_extract("path", r"part=(-?\d+)", 1).cast("long").alias("part"), F.sha2("text", 256).alias("hash"))


@query(f"""WITH {JOBS_SQL} SELECT job_id AS id, epoch_us(started_at) AS created FROM j WHERE job_id % 5 = 2""")
def jobs_of_a_status(spark, sf_dir):
    """SRC9, TOP9."""
    status = F.element_at(F.array(*map(F.lit, ("queued", "running", "completed", "paused", "failed"))), (F.col("job_id") % 5 + 1).cast("int"))
    jobs = job_rows(spark, sf_dir).select(F.col("job_id").alias("id"), F.col("started_at").alias("created_at"), status.alias("status"))
    return monitoring.jobs_listed(jobs, "completed").select("id", F.unix_micros("created_at").alias("created"))


@query(f"""WITH {JOBS_SQL} SELECT job_id AS id, CASE WHEN job_id % 3 <> 0 THEN job_id * 10 END AS demo_id FROM j""")
def jobs_with_demos(spark, sf_dir):
    """JOI10: the demo that uses a job's knowledge base."""
    jobs = job_rows(spark, sf_dir).select(F.col("job_id").alias("id"))
    demos = jobs.where("id % 3 <> 0").select((F.col("id") * 10).alias("id"), F.col("id").alias("knowledge_base_id"))
    return monitoring.jobs_with_demos(jobs, demos)


@query("""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'whatsapp' ELSE 'email' END AS channel, 'u' || conv_id AS sender, CASE WHEN turn % 2 = 0 THEN '' ELSE role END AS subject, sha256(text) AS message, CASE WHEN turn % 4 = 0 THEN 'image/png' END AS media FROM conversations""")
def inbound_messages(spark, sf_dir):
    """SRC11: messages as payloads of a messenger and of mail."""
    phone = F.struct(joined("whatsapp:u", F.col("conv_id")).alias("From"), F.col("text").alias("Body"), F.when(F.col("turn") % 4 == 0, "https://x.it/m").alias("MediaUrl0"), F.when(F.col("turn") % 4 == 0, "image/png").alias("MediaContentType0"), "conv_id", "turn")
    mail = F.struct(joined("u", F.col("conv_id")).alias("from"), F.col("role").alias("subject"), "text", "conv_id", "turn")
    raw = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, F.to_json(phone)).otherwise(F.to_json(mail)).alias("value"))
    key = [F.get_json_object("value", f"$.{c}").cast("long").alias(c) for c in ("conv_id", "turn")]
    out = readers.inbound_messages(raw.withColumns({"conv_id": key[0], "turn": key[1]}), keep=("conv_id", "turn"))
    return out.select("conv_id", "turn", "channel", "sender", "subject", F.sha2("message", 256).alias("message"), F.col("media.type").alias("media"))


def chunk_rows(spark, sf_dir) -> DataFrame:
    """Documents as chunk rows; their source is the knowledge base."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("kb_id"), "doc_id", joined("u", F.col("doc_id")).alias("url"), T.content_hash(F.col("text")).alias("hash"))


def chunk_table(spark, sf_dir) -> str:
    """A chunk table that was written in two steps, of which the second repeats half of the first."""
    path, rows = new_folder(spark, "chunks"), chunk_rows(spark, sf_dir)
    writers.append_fresh(rows.where("doc_id % 3 < 2"), path)
    writers.append_fresh(rows.where("doc_id % 3 > 0"), path)
    return path


@query("""SELECT source AS kb_id, count(DISTINCT sha256(text)) AS chunks FROM documents GROUP BY 1""")
def chunk_appends(spark, sf_dir):
    """SNK1, SNK3: what is written twice is there once; rows of each knowledge base."""
    return writers.rows_by_base(spark.read.parquet(chunk_table(spark, sf_dir)))


@query("""SELECT DISTINCT source AS kb_id, sha256(text) AS hash FROM documents WHERE source = 'src1'""")
def indexed_hashes(spark, sf_dir):
    """SRC10: the hash column of one knowledge base."""
    return readers.indexed_hashes(spark, chunk_table(spark, sf_dir), "src1")


@query("""SELECT source AS kb_id, count(*) AS chunks FROM documents WHERE doc_id % 4 <> 0 GROUP BY 1""")
def chunk_deletes(spark, sf_dir):
    """SNK2, JOI12: the table without the chunks of changed urls, in place."""
    path, rows = new_folder(spark, "chunks"), chunk_rows(spark, sf_dir)
    writers.append_chunks(rows, path)
    writers.delete_urls(spark, path, rows.where("doc_id % 4 = 0").select("url"))
    return writers.rows_by_base(spark.read.parquet(path))


@query("""SELECT source AS kb_id, count(*) AS chunks FROM documents WHERE source <> 'src0' GROUP BY 1""")
def dropped_base(spark, sf_dir):
    """SNK4."""
    return writers.rows_by_base(writers.without_base(chunk_rows(spark, sf_dir), "src0"))


@query("""SELECT url, max(n) AS n_chars, CASE WHEN max(n) FILTER (new) >= coalesce(max(n) FILTER (NOT new), -1) THEN 'pending' ELSE 'done' END AS ingest_status
FROM (SELECT source || '/' || doc_id % 50 AS url, n_chars * 2 + (doc_id % 3 = 0)::INTEGER AS n, doc_id % 3 = 0 AS new FROM documents) GROUP BY url""")
def page_upserts(spark, sf_dir):
    """SNK5: new versions of pages replace older ones and wait for ingest again."""
    new = F.col("doc_id") % 3 == 0
    rows = table(spark, sf_dir, "documents").select(joined(F.col("source"), "/", F.col("doc_id") % 50).alias("url"), (F.col("n_chars") * 2 + new.cast("int")).alias("n_chars"), new.alias("new"))
    old = rows.where("not new").drop("new").withColumn("ingest_status", F.lit("done"))
    return dedup.upsert(old, rows.where("new").drop("new"), "url", "n_chars").select("url", "n_chars", "ingest_status")


def link_rows(spark, sf_dir) -> DataFrame:
    """The hrefs of pages as a crawl finds them: page_id, parent_url, pos, url (absolute, in the characters that the page has)."""
    p = table(spark, sf_dir, "pages")
    hrefs = p.select("page_id", F.col("url").alias("parent_url"), F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    return hrefs.withColumn("url", U.normalize_url(F.col("href"), F.col("parent_url"), coded=False)).where("url is not null").drop("href")


LINKS_SQL = rf"""{PARSED_URL}, h AS (SELECT page_id, url AS parent_url, scheme, host, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM p),
e AS (SELECT page_id, parent_url, host, scheme, unnest(hs) AS href, generate_subscripts(hs, 1) - 1 AS pos FROM h),
l AS (SELECT page_id, parent_url, host, pos, scheme || '://' || host || CASE WHEN length(href) > 1 THEN regexp_replace(href, '/$', '') ELSE href END AS url FROM e)"""


@query(f"""WITH {LINKS_SQL}, f AS (SELECT url FROM l WHERE page_id % 2 = 0), n AS (SELECT url, parent_url, page_id % 4 AS depth, row_number() OVER (PARTITION BY url ORDER BY page_id % 4, parent_url, pos) AS k FROM l WHERE page_id % 2 = 1 AND url NOT IN (SELECT url FROM f))
SELECT url, parent_url, depth FROM n WHERE k = 1""")
def new_urls(spark, sf_dir):
    """SNK6, JOI13: the links that the frontier lacks, each once."""
    links = link_rows(spark, sf_dir).withColumn("depth", F.col("page_id") % 4)
    return frontier.insert_absent(links.where("page_id % 2 = 0").select("url").distinct(), links.where("page_id % 2 = 1")).select("url", "parent_url", "depth")


@query(f"""WITH {LINKS_SQL}, f AS (SELECT DISTINCT url FROM l WHERE page_id % 2 = 0) SELECT page_id, count(*) FILTER (f.url IS NOT NULL) AS known, count(*) FILTER (f.url IS NULL) AS unknown FROM l LEFT JOIN f ON l.url = f.url GROUP BY page_id""")
def known_urls(spark, sf_dir):
    """JOI14: which links the frontier has."""
    links = link_rows(spark, sf_dir)
    out = frontier.with_membership(links, links.where("page_id % 2 = 0"))
    return out.groupBy("page_id").agg(F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("unknown"))


@query(f"""WITH {LINKS_SQL}, s AS (SELECT DISTINCT regexp_replace(host, '^www\\.', '') AS site FROM p WHERE page_id % 3 = 0) SELECT l.page_id, count(*) AS links FROM l JOIN s ON regexp_replace(l.host, '^www\\.', '') = site GROUP BY 1""")
def links_in_scope(spark, sf_dir):
    """FLT1, JOI4: links to the sites of every third page."""
    seeds = table(spark, sf_dir, "pages").where("page_id % 3 = 0").select(F.col("url").alias("seed_url"))
    return frontier.in_scope(link_rows(spark, sf_dir), seeds).groupBy("page_id").agg(F.count("*").alias("links"))


@query(f"""WITH {LINKS_SQL} SELECT page_id % 7 + 1 AS depth, count(*) AS links FROM l WHERE page_id % 7 + 1 <= 5 GROUP BY 1""")
def expanded_links(spark, sf_dir):
    """FLT3: links of pages whose children are no deeper than five."""
    pages = table(spark, sf_dir, "pages").select("url", (F.col("page_id") % 7).alias("depth"), F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)).alias("links"))
    return frontier.expand(pages, 5).groupBy("depth").agg(F.count("*").alias("links"))


@query("""SELECT page_id, s = 200 AND page_id % 3 < 2 AS ok, s >= 500 OR s = 429 AS retryable, CASE WHEN s >= 400 THEN 'http ' || s WHEN page_id % 3 = 2 THEN 'not html' END AS error FROM (SELECT page_id, [200, 404, 429, 503][(page_id % 4 + 1)::INTEGER] AS s FROM pages)""")
def page_acceptance(spark, sf_dir):
    """FLT5."""
    n = F.col("page_id")
    status = F.element_at(F.array(*map(F.lit, (200, 404, 429, 503))), (n % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, ("Text/HTML; charset=utf-8", "application/xhtml+xml", "application/pdf"))), (n % 3 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", frontier.acceptance(status, kind).alias("a")).select("page_id", "a.ok", "a.retryable", "a.error")


@query(f"""WITH {FRONTIER_SQL} SELECT page_id FROM f WHERE page_id % 5 = 3 ORDER BY due, url LIMIT 30""")
def pages_to_ingest(spark, sf_dir):
    """TOP2: the next thirty to ingest (the limit is the feature)."""
    pages = frontier_rows(spark, sf_dir).select("page_id", "url", F.when(F.col("page_id") % 5 == 3, "pending").otherwise("done").alias("ingest_status"), F.col("next_attempt_at").alias("fetched_at"))
    return frontier.claim_pages(pages, 30).select("page_id")


@query(f"""WITH {FRONTIER_SQL}, r AS (SELECT page_id, page_id % 6 AS job, row_number() OVER (PARTITION BY page_id % 6 ORDER BY priority DESC, depth, url) AS n FROM f) SELECT job, page_id FROM r WHERE n <= 25""")
def page_budgets(spark, sf_dir):
    """WIN11: twenty-five pages of each job (the limit is the feature)."""
    return frontier.within_budget(frontier_rows(spark, sf_dir).withColumn("job", F.col("page_id") % 6), "job", 25).select("job", "page_id")


@query("""SELECT count(*) FILTER (page_id % 6 = 0) AS pending, 0::BIGINT AS leased, count(*) FILTER (page_id % 6 = 1) AS done, count(*) FILTER (page_id % 6 = 2) AS failed, count(*) FILTER (page_id % 6 = 3) AS skipped FROM pages""")
def ingest_counts(spark, sf_dir):
    """AGG2: a state that no page is in counts zero."""
    state = F.element_at(F.array(*map(F.lit, ("pending", "done", "failed", "skipped", "other", "other"))), (F.col("page_id") % 6 + 1).cast("int"))
    return frontier.counts_by(table(spark, sf_dir, "pages").select(state.alias("ingest_status")), "ingest_status", frontier.INGEST_STATES)


@query("""SELECT event_type AS name, sum(user_id % 5 - 1)::BIGINT AS value FROM events GROUP BY 1""")
def counters(spark, sf_dir):
    """AGG4."""
    return monitoring.counters(table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), (F.col("user_id") % 5 - 1).alias("delta")))


@query("""SELECT o_custkey AS demo_id, count(*) AS runs, epoch(max(o_orderdate))::BIGINT AS last_run FROM orders GROUP BY 1""")
def run_log(spark, sf_dir):
    """SNK7: runs appended in two goes, and the latest of each demo."""
    path = new_folder(spark, "runs")
    runs = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("demo_id"), F.col("o_orderdate").alias("finished_at"), F.col("o_orderstatus").alias("outcome"))
    for n in range(2):
        writers.append_run(runs.where(F.col("o_orderkey") % 2 == n), path)
    return freshness.run_summary(spark.read.parquet(path)).select("demo_id", "runs", F.unix_seconds(F.col("last_run_at").cast("timestamp")).alias("last_run"))


@query("""SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 9 = 0 OR c_custkey % 5 = 0 THEN false WHEN c_custkey % 7 = 0 THEN NULL ELSE true END AS enabled FROM customer""")
def disabled_demos(spark, sf_dir):
    """SNK8: the registry with every ninth demo switched off."""
    demos = demo_rows(spark, sf_dir)
    return registry.disabled(demos, demos.where("id % 9 = 0")).select("id", "enabled")


@query("""SELECT c_custkey::VARCHAR AS id FROM customer WHERE NOT (c_custkey % 4 = 0 AND c_custkey % 7 = 3)""")
def deleted_demos(spark, sf_dir):
    """SNK11: a user asks for every fourth demo to go; their own do."""
    demos = demo_rows(spark, sf_dir)
    return registry.without(demos, demos.where("id % 4 = 0"), "user3").select("id")


@query("""SELECT c_custkey::VARCHAR AS id FROM customer WHERE c_custkey % 7 = 2""")
def demos_of_a_user(spark, sf_dir):
    """FLT9."""
    return registry.visible_to(demo_rows(spark, sf_dir), "user2", False).select("id")


@query("""SELECT c_custkey::VARCHAR AS id FROM customer WHERE contains(lower(c_mktsegment), 'furni')""")
def demos_by_term(spark, sf_dir):
    """FLT11: no id is that term, so a part of any column will do."""
    return registry.matching(demo_rows(spark, sf_dir), "FURNI").select("id")


@query("""SELECT c_custkey::VARCHAR AS id, c_custkey % 2 = 0 AND c_custkey % 3 <> 0 AND c_custkey % 4 <> 0 AS kept FROM customer""")
def reused_bases(spark, sf_dir):
    """FLT20, URL15: drafts of all demos, of which every other has its urls in another order."""
    demos = demo_rows(spark, sf_dir)
    drafts = demos.withColumn("search_urls", F.when(F.col("id") % 2 == 0, F.col("search_urls")).otherwise(F.reverse("search_urls")))
    out = registry.knowledge_base(drafts, demos)
    return out.select("id", F.coalesce((F.col("knowledge_base_id") == joined("kb", F.col("id"))) & (F.col("search_mode") == "crawling"), F.lit(False)).alias("kept"))


@query("""SELECT c_custkey::VARCHAR AS id, greatest(0.0, least(32.0, c_custkey % 50))::DOUBLE AS window_radius, CASE WHEN c_custkey % 3 = 0 THEN 32.0 ELSE 8.0 END::DOUBLE AS bubble_radius, ['top-left', 'bottom-right', 'bottom-right'][(c_custkey % 3 + 1)::INTEGER] AS position, CASE WHEN c_custkey % 2 = 0 THEN 'large' ELSE 'standard' END AS size,
 least(40.0, c_custkey % 60)::DOUBLE AS blur, least(300.0, greatest(100.0, c_custkey % 400))::DOUBLE AS saturate, least(0.4, (c_custkey % 10) / 10.0)::DOUBLE AS opacity, c_name AS welcome, 'q' || c_custkey || '|' || repeat('x', 120) AS questions, CASE WHEN c_custkey % 2 = 0 THEN '/uploads/' || c_custkey || '.png' ELSE '' END AS logo,
 CASE WHEN c_custkey % 14 BETWEEN 1 AND 10 THEN (c_custkey % 14)::INTEGER END AS depth, CASE WHEN c_custkey % 2 = 1 AND c_custkey <= 5000 THEN c_custkey::INTEGER END AS pages FROM customer""")
def clean_demos(spark, sf_dir):
    """FLT15, FLT16."""
    s = F.col("style")
    return registry.cleaned(demo_rows(spark, sf_dir)).select(
        "id", s["borderRadius"]["window"].alias("window_radius"), s["borderRadius"]["bubble"].alias("bubble_radius"), s["position"].alias("position"), s["sizePreset"].alias("size"), s["glass"]["blur"].alias("blur"), s["glass"]["saturate"].alias("saturate"),
        s["glass"]["opacity"].alias("opacity"), "welcome", F.array_join("questions", "|").alias("questions"), "logo", F.col("crawl_max_depth").alias("depth"), F.col("crawl_max_pages").alias("pages"),
    )


@query("""SELECT c_custkey::VARCHAR AS id, lower(c_mktsegment) || '-' || c_custkey % 5 || '.it' AS site_name, c_name AS welcome, 2::INTEGER AS questions FROM customer WHERE c_custkey % 5 <> 0""")
def demo_pages(spark, sf_dir):
    """FLT19, FLT10, URL13 on cleaned demos."""
    out = registry.public_view(registry.cleaned(demo_rows(spark, sf_dir)))
    return out.select("id", "site_name", "welcome", F.size("questions").alias("questions"))


@query("""SELECT conv_id, turn, CASE WHEN (conv_id * 10 + turn) % 11 < 8 THEN 'p' || (conv_id * 10 + turn) % 11 END AS product FROM conversations WHERE (conv_id * 10 + turn) % 11 <> 5""")
def turns_with_demos(spark, sf_dir):
    """JOI9: turns with the demo they came through, without those of a demo that is off; unknown ones stay."""
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", ((F.col("conv_id") * 10 + F.col("turn")) % 11).alias("demo_id"))
    demos = log.select(F.col("demo_id").alias("id")).distinct().where("id < 8").select("id", joined("p", F.col("id")).alias("product"), (F.col("id") != 5).alias("enabled"))
    return conversations.turns_with_demo(log, demos).select("conv_id", "turn", F.col("demo_product").alias("product"))


@query("""SELECT conv_id, count(*) AS messages FROM conversations WHERE conv_id % 3 <> 1 GROUP BY 1""")
def cleared_conversations(spark, sf_dir):
    """SNK12."""
    log = table(spark, sf_dir, "conversations")
    return conversations.without_sessions(log, log.where("conv_id % 3 = 1").select("conv_id").distinct()).groupBy("conv_id").agg(F.count("*").alias("messages"))


@query("""SELECT event_id AS id, user_id % 2 = 0 OR event_id % 3 = 0 AS acknowledged FROM events WHERE value > 50""")
def acknowledged_alerts(spark, sf_dir):
    """SNK10."""
    alerts = metric_rows(spark, sf_dir)[3]
    return monitoring.acknowledge(alerts, alerts.where("id % 3 = 0")).select("id", "acknowledged")


@query(f"""WITH {JOBS_SQL} SELECT job_id, CASE WHEN job_id % 2 = 0 THEN 'crawling' ELSE 'indexing' END AS phase FROM j WHERE job_id % 5 = 1""")
def running_jobs(spark, sf_dir):
    """SNK9: a snapshot of the jobs that aren't at their end."""
    ended = F.element_at(F.array(*map(F.lit, ("ready", "", "empty", "failed", "legacy"))), (F.col("job_id") % 5 + 1).cast("int"))
    jobs = job_rows(spark, sf_dir).select("job_id", F.when(F.col("job_id") % 5 != 1, ended).when(F.col("job_id") % 2 == 0, "crawling").otherwise("indexing").alias("phase"))
    return writers.progress_row(jobs, F.current_timestamp()).select("job_id", "phase")


@query(f"""WITH {JOBS_SQL} SELECT job_id, epoch(TIMESTAMP '2024-03-01')::BIGINT - epoch(date_trunc('second', finished_at))::BIGINT AS age, job_id % 2 = 0 AND epoch(TIMESTAMP '2024-03-01')::BIGINT - epoch(date_trunc('second', finished_at))::BIGINT > 3000000 AS stale, strftime(finished_at, '%Y%m%d') AS day FROM j""")
def job_heartbeats(spark, sf_dir):
    """FUN8, FUN9."""
    now = F.lit("2024-03-01").cast("timestamp")
    jobs = job_rows(spark, sf_dir).withColumn("status", F.when(F.col("job_id") % 2 == 0, "running").otherwise("paused"))
    return jobs.select("job_id", T.age_seconds(F.col("finished_at"), now).alias("age"), T.is_stale(F.col("status"), F.col("finished_at"), now, 3_000_000).alias("stale"), T.yyyymmdd(F.col("finished_at")).alias("day"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE regexp_extract(props, '"k": ([0-9]+)', 1)::INTEGER END AS k, md5(props) AS md5, sha256(props) AS sha FROM events""")
def parsed_props(spark, sf_dir):
    """FUN1, FUN10: every third text isn't JSON."""
    props = F.when(F.col("event_id") % 3 == 0, F.lit("{not json")).otherwise(F.col("props"))
    k = T.parsed_json(props, "k int", F.lit(None).cast("struct<k:int>"))["k"]
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(k, F.lit(-1)).alias("k"), F.md5("props").alias("md5"), T.content_hash(F.col("props")).alias("sha"))


@query("""SELECT event_id, event_type || '/' || CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR ELSE 'base' END || '/' || (event_id % 9) AS shown FROM events""")
def option_maps(spark, sf_dir):
    """FUN6, FUN11: defaults overlaid by what isn't null."""
    base = F.create_map(F.lit("kind"), F.lit("none"), F.lit("user"), F.lit("base"), F.lit("n"), text(F.col("event_id") % 9))
    over = F.create_map(F.lit("kind"), F.col("event_type"), F.lit("user"), F.when(F.col("user_id") % 2 == 0, text("user_id")))
    m = T.overlaid(base, over)
    return table(spark, sf_dir, "events").select("event_id", joined(m["kind"], "/", m["user"], "/", m["n"]).alias("shown"))


@query("""SELECT o_custkey AS site, count(*) FILTER (o_orderstatus <> 'P') AS pages_checked, CASE WHEN count(*) FILTER (o_orderstatus <> 'P') = 0 THEN 'no page could be reached' END AS error FROM orders GROUP BY 1""")
def pages_checked(spark, sf_dir):
    """AGG16: a customer's open orders as pages that could not be reached."""
    pages = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey")).alias("url"))
    return freshness.checked(pages)


PLAN_SQL = """c AS (SELECT o_custkey AS site, o_orderkey, o_orderdate > TIMESTAMP '1998-01-01' AND o_orderstatus <> 'P' AS changed FROM orders)"""


def recrawl(spark, sf_dir) -> dict[str, DataFrame]:
    o = table(spark, sf_dir, "orders")
    url = joined("https://s", F.col("o_custkey"), ".it/", F.col("o_orderkey"))
    pages = o.select(F.col("o_custkey").alias("site"), url.alias("url"), F.lit(None).cast("string").alias("canonical_url"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("last_modified"))
    sites = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("site"), F.lit("1998-01-01").cast("timestamp_ntz").alias("since"))
    known = o.where("o_orderkey % 2 = 0").select(url.alias("url"), F.when(F.col("o_orderkey") % 4 == 0, "queued").otherwise("fetched").alias("status"), F.lit(3).alias("attempts"), F.lit(0).alias("priority"))
    chunks = o.select(url.alias("url"), F.col("o_orderstatus").alias("kb_id"))
    return freshness.recrawl_plan(sites, pages, known, chunks, F.lit("2024-01-01").cast("timestamp"))


@query(f"""WITH {PLAN_SQL}, n AS (SELECT site, count(*) AS pages_checked, count(*) FILTER (changed) AS pages_changed FROM c GROUP BY 1)
SELECT c_custkey AS site, coalesce(pages_checked, 0) AS pages_checked, coalesce(pages_changed, 0) AS pages_changed, CASE WHEN pages_checked IS NULL THEN 'error' WHEN pages_changed > 0 THEN 'updated' ELSE 'no-changes' END AS outcome FROM customer LEFT JOIN n ON site = c_custkey""")
def recrawl_runs(spark, sf_dir):
    """FRE2: the run record of each site, orders as its pages."""
    return recrawl(spark, sf_dir)["runs"].select("site", "pages_checked", "pages_changed", "outcome")


@query(f"""WITH {PLAN_SQL} SELECT o_orderstatus AS kb_id, count(*) AS chunks FROM orders JOIN c USING (o_orderkey) WHERE changed IS NOT TRUE GROUP BY 1""")
def recrawl_chunks(spark, sf_dir):
    """FRE2, SNK2, JOI12: the chunks that stay."""
    return recrawl(spark, sf_dir)["chunks"].groupBy("kb_id").agg(F.count("*").alias("chunks"))


@query(f"""WITH {PLAN_SQL} SELECT status, attempts, priority, count(*) AS n FROM (SELECT CASE WHEN changed OR o_orderkey % 4 = 0 THEN 'queued' ELSE 'fetched' END AS status, CASE WHEN changed AND o_orderkey % 4 <> 0 THEN 0 ELSE 3 END AS attempts, CASE WHEN changed AND o_orderkey % 4 <> 0 THEN 1000 ELSE 0 END AS priority FROM c WHERE o_orderkey % 2 = 0
 UNION ALL SELECT 'queued', 0, 1000 FROM c WHERE o_orderkey % 2 = 1 AND changed) GROUP BY 1, 2, 3""")
def recrawl_frontier(spark, sf_dir):
    """FRE2, SET6: changed urls are queued again, or for the first time."""
    return recrawl(spark, sf_dir)["frontier"].groupBy("status", "attempts", "priority").agg(F.count("*").alias("n"))
