"""Operational metrics and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scoring import ingestion_phase


def counters(changes: DataFrame) -> DataFrame:
    """AGG4."""
    return changes.groupBy("name").agg(F.sum("delta").alias("value"))


def hourly_report(calls: DataFrame, errors: DataFrame, health: DataFrame, alerts: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """AGG6: one row on the last hour. The error rate is errors over calls, as defined; failed calls over calls stand beside it."""
    recent = F.col("ts") > now - F.make_interval(hours=F.lit(hours))
    c = calls.where(recent).agg(F.count("*").alias("total_calls"), F.count_if("success").alias("successful_calls"), F.avg("response_time").alias("_avg"))
    e = errors.where(recent).agg(F.count("*").alias("total_errors"))
    h = health.where(recent).agg(F.avg((F.col("status") == "healthy").cast("double")).alias("_healthy"))
    a = alerts.agg(F.count("*").alias("alerts"), F.count_if(~F.coalesce("acknowledged", F.lit(False))).alias("active_alerts"))
    one = c.crossJoin(e).crossJoin(h).crossJoin(a)  # four tables of one row each
    rate = lambda n: F.when(F.col("total_calls") > 0, F.round(100 * n / F.col("total_calls"), 2)).otherwise(0.0)
    return one.select("total_calls", "successful_calls", "total_errors", rate(F.col("total_errors")).alias("error_rate"), rate(F.col("total_calls") - F.col("successful_calls")).alias("failed_call_rate"), F.coalesce(F.round("_avg"), F.lit(0.0)).alias("avg_response_time"), F.round(100 * F.coalesce("_healthy", F.lit(1.0))).alias("health_score"), "alerts", "active_alerts")


def health_rollup(checks: DataFrame) -> DataFrame:
    """AGG7: checks (ts, name, ok, issue) -> status and issues of each time."""
    return checks.groupBy("ts").agg(F.when(F.bool_and("ok"), "healthy").otherwise("unhealthy").alias("status"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.coalesce("issue", "name")))).alias("issues"))


def service_metrics(calls: DataFrame, service: str = "service") -> DataFrame:
    """AGG8."""
    return calls.groupBy(service).agg(F.count("*").alias("calls"), F.sum("response_time").alias("total_time"), F.avg("response_time").alias("avg_time"))


def status_overview(families: dict[str, DataFrame], alerts: DataFrame) -> DataFrame:
    """AGG17: rows of each family of metrics, and of alerts those open."""
    tables = [df.select(F.lit(name).alias("family"), F.lit(0).alias("open")) for name, df in families.items()]
    rows = alerts.select(F.lit("alerts").alias("family"), (~F.coalesce("acknowledged", F.lit(False))).cast("int").alias("open"))
    for t in tables:
        rows = rows.unionByName(t)
    return rows.groupBy("family").agg(F.count("*").alias("rows"), F.sum("open").alias("unacknowledged"))


def last_n(rows: DataFrame, n: int, at: str = "ts", tie: str = "id", by: str | None = None) -> DataFrame:
    """WIN3: the last n rows, of each family if `by` is given."""
    if by is None:
        return rows.orderBy(F.desc(at), F.desc(tie)).limit(n)
    w = Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def alerts_of(calls: DataFrame, errors: DataFrame, health: DataFrame, slow_ms: int = 5000) -> DataFrame:
    """STR5: slow calls, failed calls, errors and unhealthy checks as alerts; stateless, so it is the same for a stream."""
    out = calls.where((F.col("response_time") > slow_ms) & F.col("success")).select("ts", F.lit("slow_response").alias("type"), F.concat_ws(" ", "method", "endpoint").alias("subject"))
    out = out.unionByName(calls.where(~F.col("success")).select("ts", F.lit("api_failure").alias("type"), F.concat_ws(" ", "method", "endpoint").alias("subject")))
    out = out.unionByName(errors.select("ts", F.lit("error").alias("type"), F.col("error").alias("subject")))
    return out.unionByName(health.where("status <> 'healthy'").select("ts", F.lit("unhealthy").alias("type"), F.col("status").alias("subject")))


def acknowledge(alerts: DataFrame, ids: DataFrame, by: str = "id") -> DataFrame:
    """SNK10."""
    hit = ids.select(F.col(by)).distinct().withColumn("_hit", F.lit(True))
    return alerts.join(hit, by, "left").withColumn("acknowledged", F.coalesce("_hit", "acknowledged", F.lit(False))).drop("_hit")


def job_stats(jobs: DataFrame, now: Column) -> DataFrame:
    """AGG5: jobs (job_id, status, started_at, finished_at, queued, leased, fetched, failed, skipped) with discovered, pages a minute,
    remaining and milliseconds to go (null while nothing was fetched)."""
    minutes = (F.unix_millis(F.coalesce("finished_at", now)) - F.unix_millis("started_at")) / 60000
    rate = F.when(minutes > 0, F.round(F.col("fetched") / minutes, 1)).otherwise(0.0)
    remaining = F.col("queued") + F.col("leased")
    discovered = remaining + F.col("fetched") + F.col("failed") + F.col("skipped")
    out = jobs.withColumns({"discovered": discovered, "pages_per_minute": rate, "remaining": remaining})
    return out.withColumn("eta_ms", F.when(F.col("pages_per_minute") > 0, F.round(F.col("remaining") / F.col("pages_per_minute") * 60000).cast("long")))


def job_phases(jobs: DataFrame) -> DataFrame:
    """SCO16 with stats as JSON; text that isn't JSON counts as no stats."""
    stats = F.from_json("stats", "crawlComplete boolean, pagesPendingIngest long, chunksIndexed long")
    return jobs.withColumn("phase", ingestion_phase(F.col("status"), stats["crawlComplete"], stats["pagesPendingIngest"], stats["chunksIndexed"]))


def jobs_listed(jobs: DataFrame, status: str | None = None, newest_first: bool = False) -> DataFrame:
    """SRC9, TOP9."""
    some = jobs.where(F.col("status") == status) if status else jobs
    return some.orderBy(F.desc("created_at") if newest_first else F.asc("created_at"), "id")


def jobs_with_demos(jobs: DataFrame, demos: DataFrame) -> DataFrame:
    """JOI10."""
    used = demos.where("knowledge_base_id is not null").select(F.col("knowledge_base_id").alias("_kb"), F.col("id").alias("demo_id"))
    return jobs.join(used, F.col("id") == F.col("_kb"), "left").drop("_kb")
