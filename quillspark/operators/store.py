"""State of projects as Parquet tables partitioned by project: inserts, upserts, deletes, snapshots of event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quillspark.session import stored


def replace_projects(df: DataFrame, path: str) -> None:
    """Writes the projects in ``df`` and no others: only their partitions are overwritten. A frame that reads ``path`` itself is stored first."""
    df = stored(df)
    df.repartition("project_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project_id").parquet(path)


def delete_projects(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the rows of the projects in ``gone`` (project_id)."""
    return {k: t.join(gone.select("project_id").distinct(), "project_id", "left_anti") for k, t in tables.items()}


def insert_unique(table: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of ``rows``: text keys are trimmed; a row whose key is blank, in ``table``, or earlier in ``rows`` (by ord) is rejected."""
    text = {f.name for f in rows.schema if f.dataType.simpleString() == "string"}
    rows = rows.withColumns({k: F.trim(k) for k in keys if k in text})
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull() | ((F.col(k) == "") if k in text else F.lit(False))
    held = table.select(*keys).distinct().withColumn("__there", F.lit(True))
    first = rows.groupBy(*keys).agg(F.min("ord").alias("__first"))
    marked = rows.join(held, keys, "left").join(first, keys, "left")
    ok = ~blank & F.col("__there").isNull() & (F.col("ord") == F.col("__first"))
    plain = lambda d: d.select(rows.columns)
    return plain(marked.where(ok)), plain(marked.where(~F.coalesce(ok, F.lit(False))))


def latest(log: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The last row of each key by ``at``: an upsert's state from its log."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("r")).select(*keys, "r.*")


def touched(items: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """``items`` with last_used_at and use_count: 1 for the insert and 1 for each row of ``uses`` (key, at)."""
    seen = uses.groupBy(key).agg(F.max("at").alias("__at"), F.count("*").alias("__n"))
    joined = items.join(seen, key, "left")
    return joined.withColumns({"last_used_at": F.coalesce("__at", "last_used_at"), "use_count": 1 + F.coalesce("__n", F.lit(0))}).drop("__at", "__n")


def with_notes(rows: DataFrame, notes: DataFrame) -> DataFrame:
    """Rows added again take back the note kept for (project_id, paper_identifier) unless they bring their own. notes: (project_id, paper_identifier, notes, at)."""
    kept = latest(notes, ["project_id", "paper_identifier"], "at").select("project_id", "paper_identifier", F.col("notes").alias("__kept"))
    return rows.join(kept, ["project_id", "paper_identifier"], "left").withColumn("notes", F.coalesce(F.nullif(F.col("notes"), F.lit("")), "__kept")).drop("__kept")


def valid_projects(rows: DataFrame) -> DataFrame:
    """Projects with trimmed names; blank ones go."""
    return rows.withColumn("name", F.trim("name")).where("name is not null and name <> ''")


def contains(table: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` with present: whether its key is in ``table``."""
    held = table.select(*keys).distinct().withColumn("present", F.lit(True))
    return wanted.join(held, keys, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def remaining(rows: DataFrame, done: DataFrame, key: str, label: str) -> DataFrame:
    """Rows that still lack a label: a stopped job goes on where it was, in any order."""
    return rows.join(done.where(F.coalesce(F.trim(label), F.lit("")) != "").select(key), key, "left_anti")


def without_node(nodes: DataFrame, links: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Placed nodes and links (src, dst) without the nodes in ``gone`` (node) and the links at them."""
    for end in ("src", "dst"):
        links = links.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return nodes.join(gone.select("node"), "node", "left_anti"), links.select("src", "dst")


def after_first(rows: DataFrame, shown: DataFrame, key: str) -> DataFrame:
    """What a continued search still has to bring: rows whose key was not shown."""
    return rows.join(shown.select(key), key, "left_anti")


def fresh(cache: DataFrame, at: str, now, seconds: int = 300) -> DataFrame:
    """Cached rows fetched within the last ``seconds``."""
    return cache.where(F.col(at) > now - F.make_dt_interval(secs=F.lit(seconds)))


def answered(requests: DataFrame, answers: DataFrame, key: str, at: str, seconds: int = 300, slice_seconds: int = 86400) -> DataFrame:
    """``requests`` (key, at, ...) with value, answered_at and state, by the last good answer for the key at or before each: ``fresh`` within ``seconds``, later ``stale``, ``none`` without one.

    answers: (key, at, value, ok); those that are not ok, or hold no value, leave the one before in place. Of good answers at one instant the largest value counts. Null keys and times find none.
    Time is cut into slices: a window runs over the rows of a key within a slice, behind the last answer of the slices before, which comes from one row a key and slice. A hot key is thus spread over its slices.
    """
    piece = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (slice_seconds * 1_000_000))
    good = answers.where(F.col("ok") & F.col("value").isNotNull() & F.col(key).isNotNull() & F.col(at).isNotNull())
    good = good.select(F.col(key).alias("__key"), F.col(at).alias("__at"), piece.alias("__slice"), F.struct(F.col(at).alias("at"), "value").alias("__good"))
    asked = requests.select(F.col(key).alias("__key"), F.col(at).alias("__at"), piece.alias("__slice"), F.struct("*").alias("__row"))
    by_slice = good.groupBy("__key", "__slice").agg(F.max("__good").alias("__good"))
    slices = by_slice.unionByName(asked.select("__key", "__slice").distinct(), allowMissingColumns=True).groupBy("__key", "__slice").agg(F.max("__good").alias("__good"))
    before = F.last("__good", ignorenulls=True).over(W.partitionBy("__key").orderBy("__slice").rowsBetween(W.unboundedPreceding, -1))
    carried = slices.select("__key", "__slice", before.alias("__good")).where("__good is not null")
    rows = carried.unionByName(good, allowMissingColumns=True).unionByName(asked, allowMissingColumns=True)
    # Carried answers have no time and come first; at one instant answers come before requests, the largest last.
    order = W.partitionBy("__key", "__slice").orderBy(F.col("__at").asc_nulls_first(), F.col("__row").isNotNull(), F.col("__good").asc_nulls_first())
    found = rows.withColumn("__last", F.last("__good", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).where("__row is not null")
    age = F.unix_micros(F.col("__at").cast("timestamp")) - F.unix_micros(F.col("__last.at").cast("timestamp"))
    known = F.col("__key").isNotNull() & F.col("__at").isNotNull() & F.col("__last").isNotNull()
    state = F.when(~known, "none").when(age < seconds * 1_000_000, "fresh").otherwise("stale")
    return found.select("__row.*", F.when(known, F.col("__last.value")).alias("value"), F.when(known, F.col("__last.at")).alias("answered_at"), state.alias("state"))
