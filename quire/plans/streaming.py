"""Streaming queries: each runs over the files available now and returns the state as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.cost import Settings
from quire.plans import sqlkit as S
from quire.plans.registry import query
from quire.sources.tables import text_stream
from quire.sources.views import jobs
from quire.streaming import jobs as ops


@query("stream_usage_daily", S.cte("daily") + "select * from daily")
def stream_usage_daily(spark, root):
    return ops.changed_rows(ops.usage_by_day(ops.call_stream(spark, root)), ["day"], "usage")


@query("stream_job_progress", S.cte("jobs") + "select budget_key, day, total, done, done >= total as ready from jobs where done > 0")
def stream_job_progress(spark, root):
    """The last event of each job; a job is ready once one of its events said so."""
    totals = jobs(spark, root).select("budget_key", "day", "total")
    events = ops.run_rows(ops.job_events(ops.call_stream(spark, root), totals), "job-events")
    return events.groupBy("budget_key", "day").agg(F.max("total").alias("total"), F.max("done").alias("done"), F.bool_or("ready").alias("ready"))


@query(
    "stream_scan_pages",
    r"select regexp_extract(url, '^https?://([^/?#]+)', 1) as host, count(*) as pages, cast(sum(strlen(html)) as bigint) as bytes from pages group by 1",
)
def stream_scan_pages(spark, root):
    """The scan of raw pages as files arrive."""
    return ops.changed_rows(ops.pages_by_host(text_stream(spark, root, "pages", "page_id")), ["host"], "pages")


@query(
    "stream_progress_messages",
    S.cte("calls")
    + """select budget_key, day, '{"type":"progress","status":"completed","progress":100,"timestamp":"' || strftime(max(ts), '%Y-%m-%dT%H:%M:%S') || '"}' as message
    from calls group by all""",
)
def stream_progress_messages(spark, root):
    return ops.message_log(
        spark, ops.job_counts(ops.call_stream(spark, root)), jobs(spark, root).select("budget_key", "day", "total")
    )


@query(
    "stream_budget_alerts",
    S.cte("ok_calls")
    + """, k as (select budget_key, day, (sum(sum(cost)) over (partition by budget_key, strftime(day, '%Y-%m') order by day))::decimal(18,9) as m from ok_calls group by budget_key, day)
    select budget_key, day, 'Warning: ' || case when m * 100 / 0.50 >= 90 then '90' else '80' end || '% of monthly budget used ($' || cast(m as decimal(18,6)) || '/$0.50)' as alert from k where m * 100 / 0.50 >= 80""",
)
def stream_budget_alerts(spark, root):
    return ops.budget_alerts(
        spark, ops.usage_by_day(ops.call_stream(spark, root), "budget_key"), Settings(monthly_limit="0.50")
    )


@query(
    "stream_ingest",
    S.cte("metrics", "chapter_words")
    + "select chapter_id, w.words as raw_words, m.words, flesch_ease, tier, minutes from metrics m join (select chapter_id, words from chapter_words) w using (chapter_id)",
)
def stream_ingest(spark, root):
    return ops.ingest(spark, root).select("chapter_id", "raw_words", "words", "flesch_ease", "tier", "minutes")
