"""The URL frontier: scope, robots, priorities, expansion, claims, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions import urls as U
from ..functions.scoring import frontier_priority
from ..sources.shared import materialised

STATES = ("queued", "leased", "fetched", "failed", "skipped")
INGEST_STATES = ("pending", "leased", "done", "failed", "skipped")


def in_scope(links: DataFrame, seeds: DataFrame, url_col: str = "url", seed_col: str = "seed_url", on: bool = True) -> DataFrame:
    """FLT1, JOI4: links of a seed's site."""
    if not on:
        return links
    sites = seeds.select(U.site_of(F.col(seed_col)).alias("_site")).distinct()
    return links.join(sites, U.site_of(F.col(url_col)) == F.col("_site"), "left_semi")


def robots_rules(robots: DataFrame) -> DataFrame:
    """SRC4: host, body -> host, agent, allow, pattern; agents of a group share its rules."""
    lines = robots.select("host", F.posexplode(F.split("body", "\r?\n")).alias("n", "line"))
    lines = lines.select("host", "n", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("k"), F.trim(F.regexp_replace(F.regexp_replace("line", "^[^:]*:", ""), "#.*$", "")).alias("v")).where(F.col("k").isin("user-agent", "allow", "disallow"))
    by_line = Window.partitionBy("host").orderBy("n")
    begins = (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(by_line), F.lit("")) != "user-agent")
    grouped = lines.withColumn("g", F.sum(begins.cast("int")).over(by_line))
    agents = grouped.where("k = 'user-agent'").select("host", "g", F.lower("v").alias("agent"))
    rules = grouped.where("k <> 'user-agent' and v <> ''").select("host", "g", (F.col("k") == "allow").alias("allow"), F.col("v").alias("pattern"))
    return agents.join(rules, ["host", "g"]).drop("g")


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """SRC4, SET5: host, sitemap: those named, and the default one."""
    named = robots.select("host", F.explode(F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), F.lit(1))).alias("sitemap"))
    return named.unionByName(robots.select("host", F.concat(F.lit("https://"), "host", F.lit("/sitemap.xml")).alias("sitemap"))).distinct()


def robots_allowed(urls: DataFrame, rules: DataFrame, agent: str = "*", url_col: str = "url") -> DataFrame:
    """FLT2: urls with `allowed`: the longest pattern that the path begins with decides; no rule allows.

    Rules are an index by (host, literal prefix, up to the first wildcard). A path is cut to the lengths that its host's prefixes have, so urls meet the rules that they
    begin with by a hash join, not all rules of their host; only rules with wildcards are matched as patterns then."""
    own = rules.where((F.col("agent") == agent.lower()) | (F.col("agent") == "*"))
    best_agent = Window.partitionBy("host")
    own = own.withColumn("_mine", F.max((F.col("agent") == agent.lower()).cast("int")).over(best_agent)).where((F.col("_mine") == 0) | (F.col("agent") == agent.lower()))
    regex = F.concat(F.lit("^"), F.replace(F.regexp_replace("pattern", r"([.+?^{}()|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")))
    index = own.select(F.col("host").alias("_h"), F.regexp_extract("pattern", "^[^*$]*", 0).alias("_prefix"), "pattern", "allow", F.when(F.col("pattern").rlike("[*$]"), regex).alias("_regex"))
    lengths = index.groupBy("_h").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))  # different lengths, as many as the longest pattern has characters at most
    keyed = urls.withColumn("_host", U.host_of(F.col(url_col))).withColumn("_path", F.coalesce(F.nullif(U.part(F.col(url_col), 4), F.lit("")), F.lit("/")))
    cut = keyed.select(F.col(url_col).alias("_url"), "_host", "_path").distinct().join(lengths, F.col("_host") == F.col("_h")).drop("_h")
    prefixes = cut.select("_url", "_host", "_path", F.explode(F.filter("_lengths", lambda n: n <= F.length("_path"))).alias("_n")).withColumn("_begins", F.substring("_path", F.lit(1), F.col("_n")))
    hits = prefixes.join(index, (F.col("_host") == F.col("_h")) & (F.col("_begins") == F.col("_prefix"))).where(F.col("_regex").isNull() | F.regexp_like("_path", F.col("_regex")))
    verdict = hits.groupBy("_url").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("_allow"))
    return keyed.join(verdict, F.col(url_col) == F.col("_url"), "left").withColumn("allowed", F.coalesce("_allow", F.lit(True))).drop("_host", "_path", "_url", "_allow")


def fresh_robots(urls: DataFrame, robots: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """JOI8: the host's newest robots row, if it is younger than a day: one row for each row of urls, however many captures a host has."""
    cache = robots.groupBy(F.col("host").alias("_h")).agg(F.max_by(F.struct("body", "fetched_at"), F.struct("fetched_at", "body")).alias("_r")).where(F.col("_r.fetched_at") > now - F.make_interval(hours=F.lit(hours)))
    return urls.join(cache, U.host_of(F.col("url")) == F.col("_h"), "left").select(*[urls[c] for c in urls.columns], "_r.body", "_r.fetched_at")


def robots_as_of(urls: DataFrame, robots: DataFrame, at: Column, hours: int = 24, salts: int = 8) -> DataFrame:
    """JOI8 at other times than now: an as-of join of each row of urls with the newest robots row of its host (body, fetched_at) that isn't newer than `at`, a column of urls, if it is younger than `hours`.

    Times of both sides are put in order and the last robots time is carried on, within a host's stretch of `hours`: a robots time counts in its own stretch and the next one. Rows of urls
    are dealt to `salts` groups a stretch, so a busy host is many tasks; times alone are sorted, bodies join the rows that they answer."""
    size = hours * 3_600_000_000
    stretch = F.floor(F.col("_at") / size)
    asked = urls.select(F.struct(*urls.columns).alias("_row"), U.host_of(F.col("url")).alias("_host"), F.unix_micros(at).alias("_at"), F.pmod(F.xxhash64("url"), F.lit(salts)).cast("int").alias("_salt"))
    times = robots.select(F.col("host").alias("_host"), F.unix_micros("fetched_at").alias("_at")).distinct()
    every = times.select("_host", "_at", F.explode(F.array(stretch, stretch + 1)).alias("_stretch")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    both = asked.withColumn("_stretch", stretch).withColumn("_own", F.lit(None).cast("long")).unionByName(every.withColumn("_own", F.col("_at")), allowMissingColumns=True)
    w = Window.partitionBy("_host", "_stretch", "_salt").orderBy("_at", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_last", F.last("_own", ignorenulls=True).over(w)).where(F.col("_row").isNotNull())
    found = found.withColumn("_last", F.when(F.col("_at") - F.col("_last") < size, F.col("_last")))
    bodies = robots.groupBy(F.col("host").alias("_h"), "fetched_at").agg(F.max("body").alias("body"))
    return found.join(bodies, (F.col("_host") == F.col("_h")) & (F.col("_last") == F.unix_micros("fetched_at")), "left").select("_row.*", "body", "fetched_at")


def is_ready(now: Column) -> Column:
    """FLT4."""
    return (F.col("status") == "queued") & (F.coalesce(F.col("next_attempt_at"), now) <= now)


def acceptance(status: Column, content_type: Column) -> Column:
    """FLT5 as a struct ok, retryable, error."""
    html = F.coalesce(F.lower(content_type).rlike("text/html|application/xhtml"), F.lit(False))
    error = F.when((status >= 400) | status.isNull(), F.concat(F.lit("http "), F.coalesce(status.cast("string"), F.lit("none")))).when(~html, "not html")
    return F.struct(error.isNull().alias("ok"), (F.coalesce(status, F.lit(503)) >= 500).__or__(F.coalesce(status == 429, F.lit(False))).alias("retryable"), error.alias("error"))


def expand(pages: DataFrame, max_depth: int = 5) -> DataFrame:
    """FLT3, HTM10: pages (url, depth, links) -> url, depth, parent_url, pos of the pages one level down."""
    return pages.where(F.col("depth") + 1 <= max_depth).select(F.col("url").alias("parent_url"), (F.col("depth") + 1).alias("depth"), F.posexplode("links").alias("pos", "url"))


def insert_absent(frontier: DataFrame, found: DataFrame, key: str = "url") -> DataFrame:
    """SNK6, JOI13: the rows of found whose url is new, one for each."""
    first = Window.partitionBy(key).orderBy("depth", "parent_url", "pos")
    return found.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").join(frontier.select(key), key, "left_anti")


def with_membership(urls: DataFrame, frontier: DataFrame, key: str = "url") -> DataFrame:
    """JOI14: urls with `known`: whether the frontier has them."""
    known = frontier.select(F.col(key).alias("_known")).distinct()
    return urls.join(known, F.col(key) == F.col("_known"), "left").withColumn("known", F.col("_known").isNotNull()).drop("_known")


def crawl_levels(seeds: DataFrame, pages: DataFrame, max_depth: int = 5) -> DataFrame:
    """JOI13: url, depth of what a crawl of captured pages (url, links) reaches, level by level."""
    reached = seeds.select("url", F.lit(0).alias("depth")).distinct()
    level = reached
    for _ in range(max_depth):
        found = expand(level.join(pages, "url"), max_depth).select("url", "depth").distinct()
        level = materialised(found.join(reached, "url", "left_anti"))
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    return reached


def with_priority(found: DataFrame, kind: str = "link") -> DataFrame:
    return found.withColumn("priority", frontier_priority(F.lit(kind), F.col("url")))


def claim(frontier: DataFrame, now: Column, n: int) -> DataFrame:
    """TOP1."""
    return frontier.where(is_ready(now)).orderBy(F.desc("priority"), "depth", "url").limit(n)


def claim_pages(pages: DataFrame, n: int) -> DataFrame:
    """TOP2."""
    return pages.where("ingest_status = 'pending'").orderBy("fetched_at", "url").limit(n)


def within_budget(claimed: DataFrame, job_col: str, most: int) -> DataFrame:
    """WIN11: the first pages of each job in claim order."""
    order = Window.partitionBy(job_col).orderBy(F.desc("priority"), "depth", "url")
    return claimed.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def counts_by(rows: DataFrame, column: str, states: tuple[str, ...]) -> DataFrame:
    """AGG1, AGG2: one row, a column for each state, zero if there is none."""
    return rows.agg(*[F.count_if(F.col(column) == s).alias(s) for s in states])


def queue_state(frontier: DataFrame, now: Column) -> DataFrame:
    """AGG3."""
    waiting = (F.col("status") == "queued") & (F.col("next_attempt_at") > now)
    return frontier.agg(F.count_if(is_ready(now)).alias("ready"), F.count_if(waiting).alias("waiting"), F.min(F.when(waiting, F.col("next_attempt_at"))).alias("next_attempt_at"), F.count_if(F.col("status") == "leased").alias("leased"))


def requeue(frontier: DataFrame, changed: DataFrame) -> DataFrame:
    """SET6: the frontier after changed urls came in: known ones queued again, new ones added."""
    urls = changed.select("url").distinct()
    again = frontier.join(urls.withColumn("_hit", F.lit(True)), "url", "left")
    flip = F.col("_hit") & (F.col("status") != "queued")
    again = again.withColumns({"status": F.when(flip, "queued").otherwise(F.col("status")), "attempts": F.when(flip, 0).otherwise(F.col("attempts")), "priority": F.when(flip, 1000).otherwise(F.col("priority"))}).drop("_hit")
    new = urls.join(frontier, "url", "left_anti").select("url", F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(1000).alias("priority"))
    return again.unionByName(new, allowMissingColumns=True)


def after_failure(rows: DataFrame, now: Column, retryable: str = "retryable", most: int = 6) -> DataFrame:
    """FUN7: failed rows wait, or end."""
    final = T.is_final(F.col(retryable), F.col("attempts"), most)
    next_at = F.timestamp_millis(F.unix_millis(now) + T.backoff_ms(F.col("attempts")))
    return rows.withColumns({"status": F.when(final, "failed").otherwise("queued"), "next_attempt_at": F.when(~final, next_at), "attempts": F.col("attempts") + 1})
