"""Tables that change by versions: files are never rewritten, a manifest names those of a version, and one rename makes a version the current one.

A commit adds rows, or replaces all rows of some owners (projects, files), in any number of tables at once. What it costs is what it changes:
a replaced owner's old rows stay in their files and are left out when read, until ``compact`` writes the live rows anew and ``expire`` deletes what no kept
version names. Readers hold the files of the version they opened. A commit that fails before its rename leaves only files that nothing names.
The rename must be atomic and refuse an existing name, as on HDFS; object stores without such a rename need a table format with its own commits.
Null owners are an owner of their own; a commit without rows, and a table that no commit has written, are empty.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType
from py4j.protocol import Py4JJavaError

from quillspark.session import qualified

JOB = "project_id long, query_text string, keywords string, databases_used string, n_results long, failed_sources string, completed_at timestamp"


class Conflict(RuntimeError):
    """Another commit came between the version that a change was computed from and its own."""


class Versions:
    """Versioned tables under ``folder``, changed by ``owner``. After about ``most_commits`` commits since the last compaction ``tidy``, which every commit without ``base`` calls, compacts: this bounds the manifest and the order of commits, which readers broadcast."""

    def __init__(self, spark: SparkSession, folder: str, owner: str = "project_id", most_commits: int = 500):
        self.spark, self.owner, self.most_commits = spark, owner, most_commits
        self.folder = qualified(spark, folder).rstrip("/")

    # --- manifests ---------------------------------------------------------------------------------------------------------------------------------------------------------

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Versions that can be read, oldest first."""
        fs, at = self._fs(), self._path("manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The current version; 0 before the first commit."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "commits": [], "schemas": {}, "batches": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/manifests/v{version:010d}.json", wholetext=True).first()[0])

    def _switch(self, manifest: dict) -> bool:
        """Makes ``manifest`` the current version, unless its number is taken."""
        jvm = self.spark.sparkContext._jvm
        draft, name = self._path("manifests", f".{uuid.uuid4().hex}"), self._path("manifests", f"v{manifest['version']:010d}.json")
        out = self._fs().create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, name, options)
        except Py4JJavaError as e:
            self._fs().delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    # --- reading -----------------------------------------------------------------------------------------------------------------------------------------------------------

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The rows of ``table`` in a version, by default the current one."""
        return self._rows(self.manifest(version), table)

    def _rows(self, manifest: dict, table: str) -> DataFrame:
        if table not in manifest["schemas"]:
            raise ValueError(f"no commit has written {table}")
        schema = StructType.fromJson(manifest["schemas"][table])
        held = [c["id"] for c in manifest["commits"] if table in c["rows"]]
        gone = [c["id"] for c in manifest["commits"] if table in c["replaced"]]
        if not held:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(StructType(schema.fields).add("__commit", StringType())).parquet(*[f"{self.folder}/data/{c}/{table}" for c in held])
        if not gone:
            return rows.drop("__commit")
        order = F.broadcast(self.spark.createDataFrame([(c["id"], i) for i, c in enumerate(manifest["commits"])], "__commit string, __place int"))
        owners = self.spark.read.schema(StructType([schema[self.owner]]).add("__commit", StringType())).parquet(*[f"{self.folder}/data/{c}/{table}-replaced" for c in gone])
        since = owners.join(order, "__commit").groupBy(F.col(self.owner).alias("__owner")).agg(F.max("__place").alias("__since"))
        live = rows.join(order, "__commit").join(since, F.col(self.owner).eqNullSafe(F.col("__owner")), "left")
        return live.where(F.col("__place") >= F.coalesce("__since", F.lit(-1))).select(schema.fieldNames())

    def history(self) -> DataFrame:
        """(version, at, operation, table, n_rows): what each version that is kept has added."""
        rows = self.spark.read.schema("version long, at timestamp, operation string, added map<string,long>").json(f"{self.folder}/manifests/v*.json")
        return rows.select("version", "at", "operation", F.explode_outer("added").alias("table", "n_rows"))

    # --- writing -----------------------------------------------------------------------------------------------------------------------------------------------------------

    def _write(self, df: DataFrame, commit: str, name: str) -> int:
        seen = Observation()
        df.withColumn("__commit", F.lit(commit)).observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.folder}/data/{commit}/{name}")
        return seen.get["n"]

    def commit(self, rows: dict[str, DataFrame] | None = None, replaced: dict[str, DataFrame] | None = None, *, base: int | None = None, batch: tuple[str, int] | None = None, operation: str = "commit") -> int:
        """Adds ``rows`` by table, after all earlier rows of the owners in ``replaced`` (by table; frames that hold the owner) went; returns the version.

        base: the version that the change was computed from; if another commit came since, ``Conflict`` is raised and nothing changes. Without it the change holds
        whatever came before, and takes the next free number. batch: (query, number) of a streaming batch; a batch that was committed before changes nothing.
        """
        rows, replaced = rows or {}, replaced or {}
        now = self.manifest()
        if batch and now["batches"].get(batch[0], -1) >= batch[1]:
            return now["version"]
        if base is None:
            self.tidy()
        commit = uuid.uuid4().hex
        for t, owners in replaced.items():
            kind = rows[t].schema[self.owner].dataType if t in rows else StructType.fromJson(now["schemas"][t])[self.owner].dataType
            self._write(owners.select(F.col(self.owner).cast(kind).alias(self.owner)).distinct(), commit, f"{t}-replaced")
        added = {t: self._write(df, commit, t) for t, df in rows.items()}
        entry = {"id": commit, "rows": sorted(rows), "replaced": sorted(replaced)}
        while True:
            now = self.manifest()
            if batch and now["batches"].get(batch[0], -1) >= batch[1]:
                return now["version"]
            if base is not None and now["version"] != base:
                raise Conflict(f"version {now['version']} came after {base}")
            schemas = now["schemas"] | {t: _wider(now["schemas"].get(t), df.schema) for t, df in rows.items()}
            after = {"version": now["version"] + 1, "at": datetime.now(UTC).isoformat(), "operation": operation, "added": added, "commits": [*now["commits"], entry], "schemas": schemas,
                     "batches": now["batches"] | ({batch[0]: batch[1]} if batch else {})}
            if self._switch(after):
                return after["version"]

    def compact(self) -> int:
        """A version of one commit with the live rows of all tables. Gives way (``Conflict``) to a commit that comes meanwhile."""
        now = self.manifest()
        commit = uuid.uuid4().hex
        added = {t: self._write(self._rows(now, t), commit, t) for t in now["schemas"]}
        after = now | {"version": now["version"] + 1, "at": datetime.now(UTC).isoformat(), "operation": "compact", "added": added, "commits": [{"id": commit, "rows": sorted(added), "replaced": []}]}
        if not self._switch(after):
            raise Conflict(f"version {after['version']} was taken")
        return after["version"]

    def tidy(self) -> None:
        """Compacts when ``most_commits`` have come since the last time; with others at work it may be one of them that does."""
        if len(self.manifest()["commits"]) >= self.most_commits:
            try:
                self.compact()
            except Conflict:
                pass

    def expire(self, keep: int = 1, grace_seconds: int = 86400) -> list[str]:
        """Drops all but the last ``keep`` versions, then the files that no kept version names and that are older than ``grace_seconds``: longer than any commit takes. Returns the commits that went."""
        fs, numbers = self._fs(), self.versions()
        kept = numbers[-keep:] if keep else numbers[-1:]
        named = {c["id"] for v in kept for c in self.manifest(v)["commits"]}
        for v in set(numbers) - set(kept):
            fs.delete(self._path("manifests", f"v{v:010d}.json"), False)
        limit, gone = (datetime.now(UTC).timestamp() - grace_seconds) * 1000, []
        for s in fs.listStatus(self._path("data")) if fs.exists(self._path("data")) else []:
            if (name := s.getPath().getName()) not in named and s.getModificationTime() <= limit:
                fs.delete(s.getPath(), True)
                gone.append(name)
        return gone


def _wider(old: dict | None, new: StructType) -> dict:
    """The schema of both: columns may come, and are null in earlier rows; a column keeps its type."""
    fields = {f.name: f for f in StructType.fromJson(old).fields} if old else {}
    for f in new.fields:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise AnalysisException(f"{f.name} is {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, f)
    return StructType([type(f)(f.name, f.dataType, True) for f in fields.values()]).jsonValue()


# --- projects in such a store ----------------------------------------------------------------------------------------------------------------------------------------------


def job_rows(jobs: DataFrame) -> DataFrame:
    """Retrieval jobs as logged: jobs (project_id, keywords, databases, n_results, failed_sources, completed_at), lists as JSON text, the query text as the keywords in a row."""
    text = lambda c: F.to_json(F.coalesce(c, F.array().cast("array<string>")))
    rows = jobs.select(
        F.col("project_id").cast("long").alias("project_id"), F.coalesce(F.array_join("keywords", " "), F.lit("")).alias("query_text"), text("keywords").alias("keywords"), text("databases").alias("databases_used"),
        F.col("n_results").cast("long").alias("n_results"), text("failed_sources").alias("failed_sources"), F.col("completed_at").cast("timestamp").alias("completed_at"),
    )
    return rows


def load_projects(store: Versions, papers: DataFrame, jobs: DataFrame) -> int:
    """A search's papers in place of all that their projects held, jobs included, and the search's own job: one version. ``jobs`` names the projects, so that a search without results empties its project."""
    jobs = job_rows(jobs)
    return store.commit({"papers": papers, "jobs": jobs}, {"papers": jobs, "jobs": jobs}, operation="load")


def delete_projects(store: Versions, gone: DataFrame) -> int:
    """All tables without the projects in ``gone`` (project_id): one version."""
    return store.commit(replaced={t: gone for t in store.manifest()["schemas"]}, operation="delete")
