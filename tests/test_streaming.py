"""Streams over several micro-batches give what the batch gives."""

import json
import shutil
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quire.operators import cost as C
from quire.sources.tables import read_table, stream_table
from quire.sources.views import calls, jobs
from quire.streaming import jobs as J

ROOT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def root(spark):
    """The events in four files, in time order, as a folder."""
    base = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    out = base / "events.parquet"
    out.mkdir()
    events = read_table(spark, ROOT, "events")
    n = events.count()
    for i in range(4):
        part = base / f"part{i}"
        events.filter(F.floor(F.col("event_id") * 4 / n) == i).coalesce(1).write.parquet(str(part))
        shutil.copy(next(part.glob("*.parquet")), out / f"{i}.parquet")
    return str(base)


def rows(df):
    cols = sorted(df.columns)
    return sorted(map(str, df.select(cols).collect()))


def stream(spark, root):
    return J.call_stream(spark, root, max_files=1)


def test_usage_over_batches(spark, root):
    got = J.changed_rows(J.usage_by_day(stream(spark, root)), ["day"], "usage")
    assert rows(got) == rows(C.daily_usage(C.with_costs(calls(spark, ROOT))))


def delivered_twice(calls):
    """At-least-once delivery: every tenth call arrives twice."""
    copies = F.when(F.col("call_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return calls.withColumn("copy", F.explode(copies)).drop("copy")


def test_each_call_once(spark, root):
    got = J.run_rows(J.finished_once(delivered_twice(stream(spark, root))), "finished")
    ok = calls(spark, ROOT).filter("status = 'ok'")
    assert (got.count(), got.select("call_id").distinct().count()) == (ok.count(), ok.count())


def test_alerts_over_batches(spark, root):
    s = C.Settings(monthly_limit="0.05")
    got = J.budget_alerts(spark, J.usage_by_day(stream(spark, root), "budget_key"), s)
    keyed = C.month_to_date(C.daily_usage(C.with_costs(calls(spark, ROOT)), "budget_key"), "budget_key")
    text = F.array_join(C.warnings(F.lit(0), F.col("month_cost"), s), "; ")
    want = keyed.select("budget_key", "day", text.alias("alert")).filter("alert <> ''")
    assert want.count() > 0
    assert rows(got) == rows(want)


def test_messages_end_at_100(spark, root):
    totals = jobs(spark, ROOT).select("budget_key", "day", "total")
    got = J.message_log(spark, J.job_counts(stream(spark, root)), totals)
    assert got.count() == totals.count()
    assert got.filter(~F.contains("message", F.lit('"progress":100'))).count() == 0


@pytest.fixture
def arriving(spark, root, tmp_path):
    """A folder into which the files of ``root`` come one after the other."""
    events = tmp_path / "events.parquet"
    events.mkdir()
    return str(tmp_path), lambda i: shutil.copy(f"{root}/events.parquet/{i}.parquet", events / f"{i}.parquet")


def test_a_stopped_job_goes_on(spark, arriving, tmp_path):
    """Two runs with one home: the second reads only new files and the result is that of the batch."""
    root, arrive = arriving
    home = str(tmp_path / "usage")
    stream_of = lambda: J.usage_by_day(stream(spark, root))
    arrive(0), arrive(1)
    J.changed_rows(stream_of(), ["day"], "usage", home)
    arrive(2), arrive(3)
    got = J.changed_rows(stream_of(), ["day"], "usage", home)
    assert rows(got) == rows(C.daily_usage(C.with_costs(calls(spark, ROOT))))
    files = [json.loads(x)["path"] for f in (tmp_path / "usage/checkpoint/sources/0").glob("[0-9]*") for x in f.read_text().splitlines()[1:]]
    assert len(files) == len(set(files)) == 4  # each file in one batch of one run
    again = J.changed_rows(stream_of(), ["day"], "usage", home)  # nothing new
    assert rows(again) == rows(got)


def test_a_batch_that_ran_twice_counts_once(spark, tmp_path):
    log = J.Log(spark, str(tmp_path / "log"), "k bigint, v bigint", ["k"])
    put = lambda n, data: log.commit(n, log.append(spark.createDataFrame(data, "k bigint, v bigint"), n))
    put(0, [(1, 10), (2, 20)])
    log.append(spark.createDataFrame([(1, 99)], "k bigint, v bigint"), 1)  # died before its manifest
    assert rows(log.current()) == rows(spark.createDataFrame([(1, 10), (2, 20)], "k bigint, v bigint"))
    put(1, [(1, 11)])
    put(1, [(1, 11)])
    assert rows(log.current()) == rows(spark.createDataFrame([(1, 11), (2, 20)], "k bigint, v bigint"))


def test_files_read_by_a_batch_do_not_grow(spark, tmp_path):
    log = J.Log(spark, str(tmp_path / "log"), "k bigint, v bigint", ["k"], "month")
    counts = []
    for n in range(3 * J.COMPACT):
        rows_ = spark.createDataFrame([(n % 5, n)], "k bigint, v bigint").withColumn("month", F.lit(f"2024-{n % 5 + 1:02}"))
        log.commit(n, log.append(rows_, n))
        counts.append(len(log.folders(n)))
    assert max(counts) <= J.COMPACT and counts[-1] < J.COMPACT
    last = 3 * J.COMPACT - 1
    assert sum(b for _, b in log.folders()) >= 3 * J.COMPACT - J.COMPACT
    assert {r.k: r.v for r in log.current().collect()} == {n % 5: n for n in range(last - 4, last + 1)}
    assert log.current().columns == ["k", "v"]
    # a month is read from its own folders alone
    plan = log.rows([f for f, _ in log.folders()]).where("month = '2024-01'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan


def test_ready_is_sent_once_over_runs(spark, arriving, tmp_path):
    root, arrive = arriving
    home = str(tmp_path / "jobs")
    totals = jobs(spark, ROOT).select("budget_key", "day", "total")
    for i in range(4):
        arrive(i)
        got = J.run_rows(J.job_events(delivered_twice(stream(spark, root)), totals), "jobs", home)
    ok = calls(spark, ROOT).filter("status = 'ok'").groupBy("budget_key", "day").agg(F.count("*").alias("done"))
    want = {(r.budget_key, r.day): (r.done, r.total) for r in ok.join(totals, ["budget_key", "day"]).collect()}
    events = got.collect()
    assert {(r.budget_key, r.day) for r in events} == set(want)
    for job, (done, total) in want.items():
        mine = [r for r in events if (r.budget_key, r.day) == job]
        assert max(r.done for r in mine) == done and sum(r.ready for r in mine) == (done >= total)
    assert any(r.ready for r in events) and len(events) > len(want) / 2


def test_states_of_jobs_grow_with_the_days(spark, tmp_path):
    """2000 jobs of one day, every fifth with a call that is still to come."""
    schema = "call_id bigint, event_time timestamp, day date, budget_key bigint, status string"
    plan = "id call_id, timestamp'2024-01-10 10:00:00' event_time, date'2024-01-10' day, id % 2000 budget_key, 'ok' status"
    spark.range(4000).selectExpr(*plan.split(", ")).write.parquet(str(tmp_path / "calls"))
    totals = spark.range(2000).selectExpr("id budget_key", "date'2024-01-10' day", "if(id % 5 = 0, 3L, 2L) total")
    events = J.job_events(spark.readStream.schema(schema).parquet(str(tmp_path / "calls")), totals)
    progress = J.run(events.writeStream.format("parquet").option("path", str(tmp_path / "rows")), str(tmp_path / "home"), spark)
    states = [s["numRowsTotal"] for p in progress for s in p["stateOperators"] if s["operatorName"] == "applyInPandasWithState"]
    assert 0 < max(states) <= J.JOB_BUCKETS
    got = {r.budget_key: (r.done, r.total, r.ready) for r in spark.read.parquet(str(tmp_path / "rows")).collect()}
    assert got == {k: (2, 3, False) if k % 5 == 0 else (2, 2, True) for k in range(2000)}


def test_late_rows_are_counted(spark, tmp_path):
    """A row five days behind the others, in a later file than they are."""
    calls_ = tmp_path / "calls"
    calls_.mkdir()
    schema = "call_id bigint, event_time timestamp, day date, budget_key bigint, status string"

    def arrive(i, data):
        df = spark.createDataFrame(data, "call_id bigint, t string, budget_key bigint").selectExpr("call_id", "cast(t as timestamp) event_time", "cast(t as date) day", "budget_key", "'ok' status")
        df.coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        shutil.copy(next((tmp_path / f"p{i}").glob("*.parquet")), calls_ / f"{i}.parquet")

    home = str(tmp_path / "home")
    stream_of = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(calls_))
    arrive(0, [(1, "2024-01-10 10:00:00", 1), (2, "2024-01-10 11:00:00", 1)])
    arrive(1, [(3, "2024-01-11 10:00:00", 1)])
    J.run_rows(J.finished_once(stream_of()), "late", home)
    arrive(2, [(4, "2024-01-05 10:00:00", 1), (5, "2024-01-06 10:00:00", 2), (6, "2024-01-12 10:00:00", 1)])
    got = J.run_rows(J.finished_once(stream_of()), "late", home)
    assert sorted(r.call_id for r in got.collect()) == [1, 2, 3, 6]
    assert J.late_rows(spark, home).agg(F.sum("late")).first()[0] == 2


def test_days_are_those_of_the_clock_in_any_session(spark, root):
    want = rows(C.daily_usage(C.with_costs(calls(spark, ROOT))))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert rows(J.changed_rows(J.usage_by_day(stream(spark, root)), ["day"], "usage")) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_page_scan_over_triggers(spark, tmp_path):
    pages = read_table(spark, ROOT, "pages")
    folder = tmp_path / "pages.parquet"
    folder.mkdir()
    home, seen = str(tmp_path / "home"), []
    for i in range(3):
        pages.filter(F.col("page_id") % 3 == i).coalesce(1).write.parquet(str(tmp_path / f"p{i}"))
        shutil.copy(next((tmp_path / f"p{i}").glob("*.parquet")), folder / f"{i}.parquet")
        got = J.changed_rows(J.pages_by_host(stream_table(spark, str(tmp_path), "pages", 1)), ["host"], "pages", home)
        seen.append(got.agg(F.sum("pages")).first()[0])
    assert seen[0] < seen[1] < seen[2] == pages.count()
    assert rows(got) == rows(J.pages_by_host(pages))
