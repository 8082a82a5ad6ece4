"""Structured Streaming jobs over the call ledger, the pages and the documents.

A job has a ``home``: a folder of the caller with the checkpoint and the output, so that a stopped
job goes on where it ended. Without one a fresh work folder is used, for a single run.

Aggregates run in update mode and keep their output in a ``Log``: each micro-batch writes its
changed rows to a folder of its own and then a manifest that names the folders that count. Readers
follow manifests alone, so a batch that ran twice, or half, shows once or not at all. Row streams
go to the file sink, which has its own commit record. Nothing passes through the driver but
manifests. Rows dropped behind the watermark are counted for each batch (``late_rows``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions import readability as R
from quire.functions.money import COST
from quire.operators.cost import Settings, month_to_date, warnings, with_costs
from quire.operators.scale import latest_by
from quire.sources.tables import stream_table, text_stream, work_dir
from quire.sources.views import as_calls

DELAY = "1 day"
#: Folders of single batches that a log keeps before it writes them as one.
COMPACT = 8
#: States that hold the jobs of a day. Fixed for a home: its checkpoint is laid out by it.
JOB_BUCKETS = 64
MANIFEST = "folder string, batches bigint"


@dataclass
class Log:
    """Rows by batch under ``path``, the newest row per key counts.

    ``schema`` is the DDL of the rows; ``month`` names a column by which folders are partitioned.
    A batch reads the manifest before it and writes its own, and every COMPACT batches the rows
    that still count as one folder; so what a batch reads does not grow with the number of batches.
    """

    spark: SparkSession
    path: str
    schema: str
    keys: Sequence[str]
    month: str | None = None

    def folders(self, batch: int | None = None) -> list[tuple[str, int]]:
        """(folder, number of batches in it) after ``batch``, or after the last one."""
        rows = self.spark.read.schema(f"{MANIFEST}, batch bigint")
        if batch is not None:
            return [(r.folder, r.batches) for r in rows.json(f"{self.path}/manifest/batch={batch}").collect()] if batch >= 0 else []
        last = rows.json(f"{self.path}/manifest").groupBy("batch").agg(F.collect_list(F.struct("folder", "batches")).alias("live")).orderBy(F.desc("batch")).limit(1)
        return [(x.folder, x.batches) for r in last.collect() for x in r.live]

    def rows(self, folders: Sequence[str]) -> DataFrame:
        """All rows of these folders, with the number of their batch."""
        schema = f"{self.schema}, batch bigint" + (f", {self.month} string" if self.month else "")
        if not folders:
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(f"{schema}, folder string").option("basePath", f"{self.path}/rows")
        return reader.parquet(*[f"{self.path}/rows/folder={f}" for f in folders]).drop("folder")

    def current(self) -> DataFrame:
        """The newest row per key."""
        rows = latest_by(self.rows([f for f, _ in self.folders()]), self.keys, ["batch"])
        return rows.drop("batch", *([self.month] if self.month else []))

    def _put(self, rows: DataFrame, label: str) -> str:
        folder = f"{label}-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(self.month) if self.month else rows.write
        writer.parquet(f"{self.path}/rows/folder={folder}")
        return folder

    def append(self, rows: DataFrame, number: int) -> list[tuple[str, int]]:
        """Write the rows of a batch; returns the folders that count now. They are committed
        by ``commit``, so a caller may derive more from them before."""
        return [*self.folders(number - 1), (self._put(rows.withColumn("batch", F.lit(number).cast("bigint")), f"b{number}"), 1)]

    def commit(self, number: int, live: list[tuple[str, int]]) -> None:
        if sum(n == 1 for _, n in live) >= COMPACT:
            whole = latest_by(self.rows([f for f, _ in live]), self.keys, ["batch"])
            live = [(self._put(whole, f"s{number}"), sum(n for _, n in live))]
        frame = self.spark.createDataFrame(live, MANIFEST).coalesce(1)
        frame.write.mode("overwrite").json(f"{self.path}/manifest/batch={number}")


def place(spark: SparkSession, label: str, home: str | None) -> str:
    return home.rstrip("/") if home else work_dir(spark, label)


def run(writer, home: str, spark: SparkSession) -> list[dict]:
    """Run a started-now query over what is available and wait for it; the progress of its
    batches. The rows that the watermark dropped are written for each batch."""
    query = writer.option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    progress: dict[int, dict] = {}
    try:
        while not query.awaitTermination(1):
            progress |= {p["batchId"]: p for p in query.recentProgress}
        progress |= {p["batchId"]: p for p in query.recentProgress}
    finally:
        late = [(b, sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"])) for b, p in progress.items()]
        if late:
            spark.createDataFrame(late, "batch bigint, late bigint").coalesce(1).write.mode("append").parquet(f"{home}/late")
    return [progress[b] for b in sorted(progress)]


def late_rows(spark: SparkSession, home: str) -> DataFrame:
    """batch, late: what stateful steps dropped behind the watermark. An aggregate counts after
    its map-side part, so late rows of one group and task are one."""
    rows = spark.read.schema("batch bigint, late bigint").parquet(f"{home.rstrip('/')}/late")
    return rows.groupBy("batch").agg(F.max("late").alias("late"))


def run_updates(stream: DataFrame, write: Callable[[DataFrame, int], None], home: str) -> list[dict]:
    """Run an update-mode query over what is available now and wait for it."""
    return run(stream.writeStream.outputMode("update").foreachBatch(write), home, stream.sparkSession)


def run_rows(stream: DataFrame, label: str, home: str | None = None) -> DataFrame:
    """Append a row stream to parquet files and return them as a table."""
    spark = stream.sparkSession
    home = place(spark, label, home)
    run(stream.writeStream.format("parquet").option("path", f"{home}/rows"), home, spark)
    return spark.read.schema(stream.schema).parquet(f"{home}/rows")


def changed_rows(stream: DataFrame, keys: Sequence[str], label: str, home: str | None = None) -> DataFrame:
    """Current state of an aggregate: the newest row per key over all batches."""
    spark = stream.sparkSession
    home = place(spark, label, home)
    log = Log(spark, f"{home}/log", stream.schema.toDDL(), keys)
    run_updates(stream, lambda batch, number: log.commit(number, log.append(batch, number)), home)
    return log.current()


def event_time(ts: Column) -> Column:
    """The time on the clock as a point in UTC, so that a day's window is that day in any session."""
    return F.make_timestamp(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.minute(ts), F.extract(F.lit("SECOND"), ts), F.lit("UTC"))


def call_stream(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    calls = with_costs(as_calls(stream_table(spark, root, "events", max_files)))
    return calls.withColumn("event_time", event_time(F.col("ts")))


def usage_by_day(calls: DataFrame, *keys: str) -> DataFrame:
    """Day buckets of finished calls; the watermark bounds the state, late rows inside it are merged."""
    return (
        calls.filter(F.col("status") == "ok")
        .withWatermark("event_time", DELAY)
        .groupBy(*keys, F.window("event_time", "1 day"))
        .agg(
            F.max("day").alias("day"),
            F.count("*").alias("calls"),
            F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"),
            F.sum("cost").cast(COST).alias("cost"),
        )
        .select(*keys, "day", "calls", "tokens", "cost")
    )


def finished_once(calls: DataFrame) -> DataFrame:
    """Each finished call once; state is spread by call and dropped after the watermark."""
    return (
        calls.filter(F.col("status") == "ok")
        .select("call_id", "event_time", "day", "budget_key")
        .withWatermark("event_time", DELAY)
        .dropDuplicatesWithinWatermark(["call_id"])
    )


def job_events(calls: DataFrame, totals: DataFrame) -> DataFrame:
    """budget_key, day, done, total, ready: the jobs that went on in a batch.

    Calls are kept once each, then counted in the state of their job, which says too whether the
    job was reported ready: ``ready`` is true in one event of a job only, in whichever batch or
    run its last planned call ends. The state goes when no call of the day can come any more.

    A call of the Python function takes milliseconds, however few its rows: the jobs of a day share
    JOB_BUCKETS states, so that the calls grow with the days and not with the jobs.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        parts, latest = [], 0
        for rows in batches:
            parts.append(rows.groupby("budget_key").agg(new=("total", "size"), total=("total", "first")))
            latest = max(latest, int(rows["event_time"].max().timestamp() * 1000))
        changed = pd.concat(parts).groupby(level=0).agg({"new": "sum", "total": "first"})
        jobs, counts, flags = state.get if state.exists else ([], [], [])
        held = dict(zip(jobs, zip(counts, flags, strict=True), strict=True))
        events = []
        for job, new, total in zip(changed.index.tolist(), changed["new"].tolist(), changed["total"].tolist(), strict=True):
            done, sent = held.get(job, (0, False))
            done += new
            ready = done >= total and not sent
            held[job] = (done, sent or ready)
            events.append((job, key[0], done, total, ready))
        state.update((list(held), [done for done, _ in held.values()], [sent for _, sent in held.values()]))
        # two days after its last call, and in any case after the present watermark
        state.setTimeoutTimestamp(max(latest + 2 * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(events, columns=["budget_key", "day", "done", "total", "ready"])

    planned = finished_once(calls).join(totals, ["budget_key", "day"]).drop("call_id")
    planned = planned.withColumn("bucket", F.pmod(F.hash("budget_key"), F.lit(JOB_BUCKETS)))
    return planned.groupBy("day", "bucket").applyInPandasWithState(
        count, "budget_key bigint, day date, done bigint, total bigint, ready boolean", "jobs array<bigint>, done array<bigint>, sent array<boolean>", "append", GroupStateTimeout.EventTimeTimeout
    )


def job_counts(calls: DataFrame) -> DataFrame:
    """Running counts per job (key and day)."""
    return (
        calls.withWatermark("event_time", DELAY)
        .groupBy("budget_key", F.window("event_time", "1 day"))
        .agg(
            F.max("day").alias("day"),
            F.count("*").alias("done"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.max("ts").alias("at"),
        )
        .select("budget_key", "day", "done", "failed", "at")
    )


def progress_messages(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """One JSON message per changed job; ``totals`` is the table of planned calls."""
    percent = F.floor(F.col("done") * 100 / F.col("total"))
    return counts.join(totals, ["budget_key", "day"]).select(
        "budget_key",
        "day",
        F.to_json(
            F.struct(
                F.lit("progress").alias("type"),
                F.when(F.col("done") < F.col("total"), "processing").otherwise("completed").alias("status"),
                percent.alias("progress"),
                F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
            )
        ).alias("message"),
    )


def message_log(spark: SparkSession, counts: DataFrame, totals: DataFrame, home: str | None = None) -> DataFrame:
    """The newest message per job; each batch's messages are in the log."""
    home = place(spark, "messages", home)
    log = Log(spark, f"{home}/log", "budget_key bigint, day date, message string", ["budget_key", "day"])

    def write(batch: DataFrame, number: int) -> None:
        log.commit(number, log.append(progress_messages(batch, totals), number))

    run_updates(counts, write, home)
    return log.current()


def budget_alerts(spark: SparkSession, usage: DataFrame, settings: Settings, home: str | None = None) -> DataFrame:
    """Alerts at 80 and 90 percent of the month's budget, per key and day.

    The changed days go to a log with a folder for each month. A batch reads the months it
    touches, of the folders that count, and of them the keys it touches.
    """
    home = place(spark, "alerts", home)
    month = F.date_format("day", "yyyy-MM")
    state = Log(spark, f"{home}/usage", usage.schema.toDDL(), ["budget_key", "day"], "month")
    alerts = Log(spark, f"{home}/alerts", "budget_key bigint, day date, alert string", ["budget_key", "day"])

    def write(batch: DataFrame, number: int) -> None:
        live = state.append(batch.withColumn("month", month), number)
        folders = [f for f, _ in live]
        own = state.rows(folders[-1:])
        months = [r.month for r in own.select("month").distinct().collect()]  # few: a batch spans days
        days = latest_by(state.rows(folders).where(F.col("month").isin(months)), ["budget_key", "day"], ["batch"])
        touched = own.select("budget_key", "month").distinct()
        known = month_to_date(
            days.join(touched, ["budget_key", "month"], "left_semi").select("budget_key", "day", "calls", "tokens", "cost"),
            "budget_key",
        )
        texts = F.array_join(warnings(F.lit(0), F.col("month_cost"), settings), "; ")
        alerts.commit(number, alerts.append(known.select("budget_key", "day", texts.alias("alert")), number))
        state.commit(number, live)

    run_updates(usage, write, home)
    return alerts.current().filter(F.col("alert") != "")


def pages_by_host(pages: DataFrame) -> DataFrame:
    """Pages and bytes of markup per host, kept as state while files arrive."""
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    return pages.groupBy(host.alias("host")).agg(F.count("*").alias("pages"), F.sum(F.octet_length("html")).alias("bytes"))


def ingest(spark: SparkSession, root: str, home: str | None = None) -> DataFrame:
    """New documents through the same text columns as the batch."""
    docs = text_stream(spark, root, "documents", "doc_id").select(
        F.col("doc_id").alias("chapter_id"), F.col("source").alias("book_id"), F.col("text").alias("content")
    )
    rows = R.with_times(R.with_scores(R.with_counts(docs, F.col("content"))))
    return run_rows(rows.drop("content"), "ingest", home)
