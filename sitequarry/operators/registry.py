"""The registry of demos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import urls as U

SCHEMA = (
    "id string, created_at timestamp, created_by string, product string, client_url string, search_urls array<string>, search_mode string, knowledge_base_id string, enabled boolean,"
    " crawl_max_depth string, crawl_max_pages string, welcome string, questions array<string>, logo string, colors map<string,string>,"
    " style struct<borderRadius:struct<window:string,bubble:string>,position:string,sizePreset:string,glass:struct<blur:string,saturate:string,opacity:string>>, recrawl_interval_days int"
)


def cleaned(demos: DataFrame, depth: tuple[int, int] = (1, 10), pages: tuple[int, int] = (1, 5000)) -> DataFrame:
    """FLT15, FLT16: every field sane or at its default."""
    return demos.withColumns({
        "style": S.sane_style(F.col("style")), "welcome": S.sane_welcome(F.col("welcome")), "questions": S.sane_questions(F.col("questions")), "logo": F.coalesce(S.sane_logo(F.col("logo")), F.lit("")),
        "crawl_max_depth": S.whole_in_range(F.col("crawl_max_depth"), *depth), "crawl_max_pages": S.whole_in_range(F.col("crawl_max_pages"), *pages),
        "search_mode": F.coalesce("search_mode", F.lit("live")), "enabled": is_enabled(),
    })


def is_enabled(c: str = "enabled") -> Column:
    """FLT10."""
    return F.coalesce(F.col(c), F.lit(True))


def visible_to(demos: DataFrame, user: str, is_admin: bool) -> DataFrame:
    """FLT9: all or one's own, newest first."""
    return (demos if is_admin else demos.where(F.col("created_by") == user)).orderBy(F.desc("created_at"), F.desc("id"))


def matching(demos: DataFrame, term: str, columns: tuple[str, ...] = ("id", "client_url", "product")) -> DataFrame:
    """FLT11: the exact id if there is one, else a part of any column, whatever the case."""
    exact = demos.where(F.col("id") == term)
    part = demos.where(F.greatest(*[F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns]))
    return exact.unionByName(part.join(exact.select(F.lit(1).alias("_one")).limit(1), F.lit(True), "left_anti"))


def public_view(demos: DataFrame) -> DataFrame:
    """FLT19, URL13: what anyone may see of enabled demos."""
    none = F.array().cast("array<string>")
    return demos.where(is_enabled()).select("id", F.coalesce("welcome", F.lit("")).alias("welcome"), F.coalesce("questions", none).alias("questions"), F.coalesce(U.site_of(F.col("client_url")), F.lit("")).alias("site_name"), F.coalesce("logo", F.lit("")).alias("logo"))


def knowledge_base(drafts: DataFrame, demos: DataFrame) -> DataFrame:
    """FLT20, URL15: drafts with knowledge_base_id: the old one if mode, urls and limits are unchanged, else one of the draft's own."""
    old = demos.select(F.col("id").alias("_id"), F.col("knowledge_base_id").alias("_kb"), F.col("search_mode").alias("_mode"), F.col("search_urls").alias("_urls"), F.col("crawl_max_depth").alias("_d"), F.col("crawl_max_pages").alias("_p"))
    joined = drafts.drop("knowledge_base_id").join(old, F.col("id") == F.col("_id"), "left")
    same = F.col("_kb").isNotNull() & (F.col("_mode") == "crawling") & U.urls_equal(F.col("_urls"), F.col("search_urls")) & F.col("_d").eqNullSafe(F.col("crawl_max_depth")) & F.col("_p").eqNullSafe(F.col("crawl_max_pages"))
    new = F.substring(F.sha2(F.concat_ws("|", "id", F.array_join("search_urls", " "), "crawl_max_depth", "crawl_max_pages"), 256), 1, 32)
    kb = F.when(F.col("search_mode") != "crawling", F.col("_kb")).when(same, F.col("_kb")).otherwise(new)
    return joined.withColumn("knowledge_base_id", kb).drop("_id", "_kb", "_mode", "_urls", "_d", "_p")


def run_history(runs: DataFrame, demos: DataFrame, find: str = "", outcome: str | None = None, order: str = "finished_at", descending: bool = True) -> DataFrame:
    """JOI2, FLT21: runs with their demo, filtered and sorted; nulls sort as the empty text."""
    joined = runs.join(demos.select(F.col("id").alias("demo_id"), "client_url", "product"), "demo_id")
    hit = F.contains(F.lower(F.coalesce("client_url", F.lit(""))), F.lit(find.lower())) | F.contains(F.lower(F.coalesce("product", F.lit(""))), F.lit(find.lower()))
    some = joined.where(hit)
    some = some.where(F.col("outcome") == outcome) if outcome else some
    by = F.coalesce(F.col(order).cast("string"), F.lit(""))
    return some.orderBy(by.desc() if descending else by.asc(), "demo_id")


def disabled(demos: DataFrame, ids: DataFrame) -> DataFrame:
    """SNK8: the registry with some demos switched off."""
    hit = ids.select("id").distinct().withColumn("_off", F.lit(True))
    return demos.join(hit, "id", "left").withColumn("enabled", F.when(F.col("_off"), F.lit(False)).otherwise(F.col("enabled"))).drop("_off").select(*demos.columns)


def without(demos: DataFrame, ids: DataFrame, user: str | None = None) -> DataFrame:
    """SNK11: the registry without some rows; a user who is no admin takes away only their own."""
    gone = ids.select("id").distinct()
    if user is not None:
        gone = gone.join(demos.where(F.col("created_by") == user).select("id"), "id", "left_semi")
    return demos.join(gone, "id", "left_anti")
