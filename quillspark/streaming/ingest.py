"""Incremental ingestion by Structured Streaming: one query a source, enrichment, upsert by batch, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quillspark.operators.models import attached_bibtex, classified, enriched
from quillspark.operators.resolve import closure_groups, merged, upserted
from quillspark.operators.store import replace_projects
from quillspark.operators.versions import Conflict, Versions
from quillspark.schemas import PAPER
from quillspark.session import stored
from quillspark.sources.normalize import SOURCES


def landed(spark: SparkSession, name: str, path: str, files_per_batch: int = 100) -> DataFrame:
    """A stream of one source's landed JSON lines as papers."""
    source = SOURCES[name]
    rows = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", files_per_batch).json(path)
    return source.normalize(rows.withColumn("ord", F.xxhash64(F.to_json(F.struct("*")))))


def prepared(papers: DataFrame) -> DataFrame:
    return attached_bibtex(enriched(classified(papers)))


def into_store(path: str, project: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """A batch sink: duplicates of the batch merge, then the batch is upserted into its projects' partitions. Running a batch again changes nothing."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        rows = merged(batch, closure_groups(batch)).drop("n_records").withColumn("project_id", project())
        try:
            old = spark.read.parquet(path).join(rows.select("project_id").distinct(), "project_id", "left_semi")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            old = rows.where(F.lit(False))
        replace_projects(upserted(old.select("project_id", *PAPER.fieldNames()), rows), path)
        batch.unpersist()

    return sink


def into_versions(store: Versions, query: str, project: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """A batch sink of versions: each batch is one commit that upserts its papers and logs its arrivals, (project_id, source, batch, n, at) with source ``__all__`` for a project's total.

    Readers see a batch's papers and arrivals together or not at all. A batch that runs again after a restart is known by its number and changes nothing; a commit that another
    writer overtook is computed again from the newer version. A batch costs the projects that it names, not the table.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        rows = stored(merged(batch, closure_groups(batch)).drop("n_records").withColumn("project_id", project()))
        told = batch.withColumn("project_id", project()).groupBy("project_id", F.coalesce(F.get("sources", F.lit(0)), F.lit("unknown")).alias("source")).agg(F.count("*").alias("n"))
        told = told.unionByName(told.groupBy("project_id").agg(F.sum("n").alias("n")).withColumn("source", F.lit("__all__")))
        told = told.select("project_id", "source", F.lit(batch_id).cast("long").alias("batch"), "n", F.current_timestamp().alias("at"))
        while True:
            store.tidy()
            now = store.manifest()
            held = store.read("papers", now["version"]) if "papers" in now["schemas"] else rows.where(F.lit(False))
            old = held.join(rows.select("project_id").distinct(), "project_id", "left_semi")
            new = upserted(old.select("project_id", *PAPER.fieldNames()), rows)
            try:
                store.commit({"papers": new, "arrivals": told}, {"papers": rows}, base=now["version"], batch=(query, batch_id), operation=f"batch {query}")
                break
            except Conflict:
                continue
        batch.unpersist()

    return sink


def ingest(spark: SparkSession, name: str, landing: str, store: str, checkpoint: str, project: Callable[[], Column]) -> StreamingQuery:
    """Takes in all files landed so far, then stops; a later call goes on from the checkpoint. ``stop()`` cancels."""
    return prepared(landed(spark, name, landing)).writeStream.foreachBatch(into_store(store, project)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(papers: DataFrame, at: str, late: str = "1 hour") -> DataFrame:
    """A stream's first record of each DOI or title within the watermark."""
    key = F.coalesce(F.nullif(F.lower("doi"), F.lit("")), F.lower(F.trim("title")))
    return papers.withColumn("arrival_key", key).withWatermark(at, late).dropDuplicatesWithinWatermark(["arrival_key"])


def tumbling(events: DataFrame, at: str = "ts", width: str = "1 day", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(window_start, by, n, total) of events; works on streams and tables alike."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, at: str = "ts", gap: str = "30 minutes", by: str = "user_id", late: str = "1 hour") -> DataFrame:
    """(by, session_start, session_end, n): runs of events with gaps under ``gap``."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.session_window(at, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def progress(query: StreamingQuery) -> list[dict]:
    """What a query has done: batch, rows in, source."""
    return [{"batch": p.batchId, "rows": p.numInputRows, "sources": [s.description for s in p.sources]} for p in query.recentProgress]
