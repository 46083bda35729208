"""State of background jobs over a stream of their events: progress by source, completion, cancellation, expiry."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Row, Window as W, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "job_id string, kind string, source string, n long, error string, at timestamp"
PROGRESS = "job_id string, source string, papers_fetched long, total_papers long, is_complete boolean, status string, error string"
#: What the session needs for ``progressed`` on a stream.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
ALL = "__all__"
LONGEST_ERROR = 200


def _micros(t: datetime) -> int:
    t = t if t.tzinfo else t.astimezone()
    return round((t - datetime(1970, 1, 1, tzinfo=UTC)).total_seconds() * 1e6)


class Jobs(StatefulProcessor):
    """One job's sources as a map, and its status. What a batch brings is held as one report a source, however many events repeat it."""

    def __init__(self, idle_seconds: int | None):
        self.idle = idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, wanted array<string>, total long, seen long")
        self.done = handle.getMapState("done", "source string", "n long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, wanted, total, seen = self.job.get() if self.job.exists() else ("queued", [], 0, 0)
        reports, names, cancelled = {}, set(wanted), None
        for r in rows:
            if r.at is None:
                continue
            at = _micros(r.at)
            seen = max(seen, at)
            if r.kind == "cancel":
                cancelled = at if cancelled is None else min(cancelled, at)
            elif r.source is not None and r.kind == "start":
                names.add(r.source)
            elif r.source is not None and r.kind in ("fetched", "failed"):
                report = (at, r.kind, r.n or 0, r.error or "")
                reports[r.source] = min(reports.get(r.source, report), report)
        if status in ("queued", "running"):
            for source, (at, kind, n, error) in sorted(reports.items(), key=lambda x: (x[1], x[0])):
                if self.done.containsKey((source,)) or (cancelled is not None and at > cancelled):
                    continue
                n = n if kind == "fetched" else 0
                self.done.updateValue((source,), (n,))
                status, total = "running", total + n
                yield Row(job_id=key[0], source=source, papers_fetched=n, total_papers=total, is_complete=False, status=status, error=error[:LONGEST_ERROR] if kind == "failed" else None)
            if names and all(self.done.containsKey((s,)) for s in names):
                status = "done"
            elif cancelled is not None:
                status = "cancelled"
            if status in ("done", "cancelled"):
                yield self._end(key, status, total)
        self.job.update((status, sorted(names), total, seen))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if status in ("queued", "running"):
                self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), seen // 1000) + self.idle * 1000)

    def _end(self, key, status: str, total: int) -> Row:
        return Row(job_id=key[0], source=ALL, papers_fetched=0, total_papers=total, is_complete=True, status=status, error=None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, wanted, total, seen = self.job.get()
        if status in ("queued", "running"):
            self.job.update(("expired", wanted, total, seen))
            yield self._end(key, "expired", total)

    def close(self) -> None:
        pass


def progressed(events: DataFrame, late: str = "1 hour", idle_seconds: int | None = 300) -> DataFrame:
    """Progress rows of jobs from their events (``EVENTS``): one for each source that reports, with the job's total so far, and one with source ``__all__`` when it ends.

    Kinds: ``start`` names a source the job waits for, ``fetched`` brings its number of papers, ``failed`` its error, ``cancel`` ends the job. A job is done when all named sources have reported.
    The first report of a source counts: by arrival in batches, by time and then by kind and number within one. Reports later than a cancellation, and whatever comes after a job's end, change nothing; a job whose
    last named source reports no later than a cancellation is done. Null times, and null sources of reports, are passed over; null numbers are 0. A job expires when the watermark passes its last event by ``idle_seconds``.
    Null jobs go. A table is one batch without a watermark, told by aggregates, and nothing expires. A stream needs the state store of ``STATE_STORE``.
    """
    if not events.isStreaming:
        return _settled(events.where("job_id is not null and at is not null"))
    rows = events.where("job_id is not null").withWatermark("at", late)
    mode = "EventTime" if idle_seconds is not None else "None"
    return rows.groupBy("job_id").transformWithState(statefulProcessor=Jobs(idle_seconds), outputStructType=PROGRESS, outputMode="Append", timeMode=mode)


def _settled(events: DataFrame) -> DataFrame:
    """``progressed`` of a whole table: a job's sources, not its events, meet in one window."""
    stops = events.where("kind = 'cancel'").groupBy("job_id").agg(F.min("at").alias("stop"))
    report = F.struct("at", "kind", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("error", F.lit("")).alias("error"))
    first = events.where("kind in ('fetched', 'failed') and source is not null").groupBy("job_id", "source").agg(F.min(report).alias("r"))
    kept = first.join(stops, "job_id", "left").where("stop is null or r.at <= stop")
    n = F.when(F.col("r.kind") == "fetched", F.col("r.n")).otherwise(0)
    total = F.sum(n).over(W.partitionBy("job_id").orderBy("r", "source").rowsBetween(W.unboundedPreceding, W.currentRow))
    error = F.when(F.col("r.kind") == "failed", F.left("r.error", F.lit(LONGEST_ERROR)))
    rows = kept.select("job_id", "source", n.alias("papers_fetched"), total.alias("total_papers"), F.lit(False).alias("is_complete"), F.lit("running").alias("status"), error.alias("error"))
    named = events.where("kind = 'start' and source is not null").select("job_id", "source").distinct()
    told = named.join(kept.select("job_id", "source", F.lit(True).alias("told")), ["job_id", "source"], "left")
    over = told.groupBy("job_id").agg(F.bool_and(F.coalesce("told", F.lit(False))).alias("over"))
    sums = kept.groupBy("job_id").agg(F.sum(n).alias("total"))
    ends = stops.join(over, "job_id", "full_outer").where("over or stop is not null").join(sums, "job_id", "left")
    status = F.when(F.col("over"), "done").otherwise("cancelled")
    return rows.unionByName(ends.select("job_id", F.lit(ALL).alias("source"), F.lit(0).cast("long").alias("papers_fetched"), F.coalesce("total", F.lit(0)).alias("total_papers"), F.lit(True).alias("is_complete"), status.alias("status"), F.lit(None).cast("string").alias("error")))


def job_status(progress: DataFrame) -> DataFrame:
    """(job_id, status, total_papers, failed_sources) from a table of progress rows: the ending, else running."""
    total = F.max("total_papers").alias("total_papers")
    failed = F.array_sort(F.collect_set(F.when(F.col("error").isNotNull(), F.col("source")))).alias("failed_sources")
    return progress.groupBy("job_id").agg(F.coalesce(F.max(F.when(F.col("is_complete"), F.col("status"))), F.lit("running")).alias("status"), total, failed)
