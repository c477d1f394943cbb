"""Site trees, freshness and targeted re-ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import urls as U
from ..sources.shared import materialised
from .dedup import without_urls
from .frontier import requeue


def first_turns(links: DataFrame, per_parent: int, room: int) -> DataFrame:
    """WIN6, WIN7: links (parent_pos, pos, link) of a level -> each link once, where it is found first, at most per_parent of a parent, and `turn`, the place when parents
    take turns, up to `room`. A level may have links without number, so the cut is a top-k before the turns are counted."""
    first = Window.partitionBy("link").orderBy("parent_pos", "pos")
    unique = links.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    own = Window.partitionBy("parent_pos").orderBy("pos")
    capped = unique.withColumn("rn", F.row_number().over(own)).where(F.col("rn") <= min(per_parent, room))
    few = capped.orderBy("rn", "parent_pos").limit(room)
    return few.withColumn("turn", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("rn", "parent_pos")))  # at most `room` rows


def site_tree(root: DataFrame, links: DataFrame, max_depth: int = 5, level_most: int = 100, pages_most: int = 90, per_parent: int = 6) -> DataFrame:
    """FRE1's tree, WIN5: root (url) and links (url, pos, link) -> url, depth, parent_url, position, a level at a time, each with
    its caps. A tree is at most pages_most rows, so its order is kept in one small table."""
    tree = root.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url"), F.lit(0).alias("position"))
    level, count = tree, 1
    for depth in range(1, max_depth + 1):
        room = min(level_most, pages_most - count)
        if room <= 0:
            break
        out = level.join(links, "url").select(F.col("url").alias("parent_url"), F.col("position").alias("parent_pos"), "pos", "link")
        new = out.join(tree.select(F.col("url").alias("link")), "link", "left_anti")
        picked = first_turns(new, per_parent if depth > 1 else 1 << 30, room)
        level = picked.select(F.col("link").alias("url"), F.lit(depth).alias("depth"), "parent_url", (F.col("turn") + count - 1).cast("int").alias("position"))
        level = materialised(level)
        found = level.count()
        if not found:
            break
        count += found
        tree = tree.unionByName(level)
    return tree


def breadcrumbs(tree: DataFrame) -> DataFrame:
    """JOI5: tree (url, parent_url, title, one row a url) with `breadcrumb`, the titles from the root down, of any depth; a cycle ends it.

    By doubling: each row has the stretch of its line that is known, nearest first, and the page above it. That page's own stretch is put on top in
    each round, so a depth of 1,000 takes ten rounds; a row whose line has reached its end, or a page that it has already, waits for the others."""
    none = F.lit(None).cast("string")
    state = materialised(tree.select("url", F.array("url").alias("line"), F.array("title").alias("titles"), F.nullif(F.col("parent_url"), F.col("url")).alias("above")))
    while not state.where("above is not null").isEmpty():
        up = state.select(F.col("url").alias("_u"), F.col("line").alias("_line"), F.col("titles").alias("_titles"), F.col("above").alias("_above"))
        met = state.where("above is not null").join(up, F.col("above") == F.col("_u"), "left")
        again = F.filter(F.transform("_line", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: F.array_contains("line", p["x"]))
        met = met.withColumn("_n", F.when(F.col("_u").isNull(), 0).when(F.size(again) > 0, F.element_at(again, 1)["i"]).otherwise(F.size("_line")))
        more = lambda own, new: F.when(F.col("_n") > 0, F.concat(own, F.slice(new, F.lit(1), F.col("_n")))).otherwise(F.col(own)).alias(own)
        on = F.when((F.col("_n") > 0) & (F.col("_n") == F.size("_line")), F.col("_above")).otherwise(none).alias("above")
        state = materialised(met.select("url", more("line", "_line"), more("titles", "_titles"), on).unionByName(state.where("above is null")))
    return tree.join(state.select("url", F.reverse("titles").alias("breadcrumb")), "url")


def grouped_links(links: DataFrame) -> DataFrame:
    """AGG13: the links of each parent in the order found."""
    return links.groupBy("parent_url").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "link"))), lambda x: x["link"]).alias("links"))


def anchor_texts(links: DataFrame, named: DataFrame) -> DataFrame:
    """JOI7: links with the text of their last anchor."""
    return links.join(named.groupBy("url").agg(F.max_by("text", "pos").alias("anchor")), "url", "left")


def parsed_time(text: Column) -> Column:
    """Dates as sites write them: ISO with or without time, or that of HTTP and feeds."""
    rfc = F.regexp_replace(text, r"^[A-Za-z]{3}, *", "")
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss z")), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z")))


def last_modified(pages: DataFrame, sitemap: DataFrame) -> DataFrame:
    """JOI1, TOP8: pages (url, depth, position, visible_date, header_modified, meta_modified) with last_modified and its source: the date
    on the page, else the sitemap's, else the header's, else the meta tag's."""
    lastmod = sitemap.groupBy(F.col("url").alias("_u")).agg(F.max("lastmod").alias("lastmod"))
    joined = pages.join(lastmod, U.light_normalize(F.col("url")) == U.light_normalize(F.col("_u")), "left").drop("_u")
    order = {"page": F.col("visible_date").cast("timestamp"), "sitemap": parsed_time(F.col("lastmod")), "header": parsed_time(F.col("header_modified")), "meta": parsed_time(F.col("meta_modified"))}
    return joined.withColumns({"last_modified": F.coalesce(*order.values()), "last_modified_source": F.coalesce(*[F.when(c.isNotNull(), k) for k, c in order.items()])})


def analyze_site(root: DataFrame, links: DataFrame, pages: DataFrame, sitemap: DataFrame, feeds: DataFrame, **caps: int) -> DataFrame:
    """FRE1: the tree of a site's pages from its root (url), with what is known of each: root and links (url, pos, link) give the tree with its caps; pages
    (url, title, visible_date, header_modified, meta_modified), the sitemap (url, lastmod) and feeds (url, updated) give title, breadcrumb, last_modified and
    its source. What has no date of its own takes the feed's, if the feed names it. Rows come in the order of depth and discovery (TOP8)."""
    tree = site_tree(root, links, **caps)
    titled = tree.join(pages, "url", "left").withColumn("title", F.coalesce(F.nullif(F.col("title"), F.lit("")), "url"))
    crumbs = breadcrumbs(titled.select("url", "parent_url", "title")).select("url", "breadcrumb")
    dated = last_modified(titled, sitemap).join(crumbs, "url").join(feeds.groupBy("url").agg(F.max("updated").alias("_feed")), "url", "left")
    feed = parsed_time(F.col("_feed"))
    by_feed = F.col("last_modified").isNull() & feed.isNotNull()
    out = dated.withColumns({"last_modified_source": F.when(by_feed, "feed").otherwise(F.col("last_modified_source")), "last_modified": F.coalesce("last_modified", feed)})
    return out.select("url", "depth", "parent_url", "position", "title", "breadcrumb", "last_modified", "last_modified_source").orderBy("depth", "position")


def changed_pages(pages: DataFrame, since: DataFrame, key: str = "site") -> DataFrame:
    """FLT6: pages changed after the site's last run. What has no date is never changed."""
    return pages.join(since.select(key, "since"), key).where(F.col("last_modified") > F.col("since"))


def due(registry: DataFrame, runs: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """FLT7, FLT8, JOI2: crawling demos with a knowledge base that were never checked, or whose interval is over."""
    mine = registry.where("search_mode = 'crawling' and knowledge_base_id is not null")
    joined = mine.join(runs.groupBy("demo_id").agg(F.max("finished_at").alias("last_run_at")), F.col("id") == F.col("demo_id"), "left").drop("demo_id")
    every = F.make_interval(days=F.coalesce(F.col("recrawl_interval_days"), F.lit(days)))
    return joined.where(F.col("last_run_at").isNull() | (F.col("last_run_at") + every <= now))


def run_summary(runs: DataFrame) -> DataFrame:
    """AGG15, SNK7: runs of each demo: how many, the latest's time and outcome."""
    return runs.groupBy("demo_id").agg(F.count("*").alias("runs"), F.max("finished_at").alias("last_run_at"), F.max_by("outcome", "finished_at").alias("last_outcome"))


def outcome_counts(runs: DataFrame) -> DataFrame:
    """AGG14."""
    return runs.groupBy("outcome").agg(F.count("*").alias("n"))


def checked(pages: DataFrame, key: str = "site") -> DataFrame:
    """AGG16: pages reached of each site; none is an error, not `no-changes`."""
    return pages.groupBy(key).agg(F.count("url").alias("pages_checked")).withColumn("error", F.when(F.col("pages_checked") == 0, "no page could be reached"))


def recrawl_plan(sites: DataFrame, pages: DataFrame, frontier: DataFrame, chunks: DataFrame, now: Column) -> dict[str, DataFrame]:
    """FRE2: sites (site, since), their analysed pages, the frontier and the chunk table -> what a run leaves: changed urls, chunks without
    theirs, the frontier with them queued again, and a run record for each site."""
    changed = changed_pages(pages, sites).select("site", U.normalize_url(F.coalesce("canonical_url", "url")).alias("url")).where("url is not null").distinct()
    seen = pages.groupBy("site").agg(F.count("url").alias("pages_checked"))
    counted = changed.groupBy("site").agg(F.count("*").alias("pages_changed"))
    log = sites.join(seen, "site", "left").join(counted, "site", "left").na.fill(0, ["pages_checked", "pages_changed"])
    outcome = F.when(F.col("pages_checked") == 0, "error").when(F.col("pages_changed") > 0, "updated").otherwise("no-changes")
    return {"changed": changed, "chunks": without_urls(chunks, changed), "frontier": requeue(frontier, changed), "runs": log.select("site", "pages_checked", "pages_changed", outcome.alias("outcome"), now.alias("finished_at"))}


def register_tree_view(spark: SparkSession, tree: DataFrame, name: str = "site_tree") -> None:
    tree.createOrReplaceTempView(name)
