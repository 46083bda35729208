"""The citation index of a folder of CSV files, kept by the state of each file: only files that came or changed are parsed, and what a changed or removed file gave goes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillspark.operators.versions import Versions
from quillspark.session import stored
from quillspark.sources.files import citations, read_corpus

#: Files that an index of another format has parsed are parsed again.
FORMAT = 1
#: Characters of references, about 40 a citation, that one task sorts.
PIECE = 1 << 24


def file_states(spark, folder: str) -> DataFrame:
    """(file, path, size, changed) of the CSV files below ``folder``, listed without being read."""
    rows = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter="*.csv").load(folder)
    return rows.select(F.col("_metadata.file_path").alias("file"), "path", F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("changed"))


def update_index(store: Versions, folder: str) -> dict[str, list[str]]:
    """Brings the index in ``store`` (owner ``file``) up to the files in ``folder``, in one version; returns the files parsed and the files removed.

    A file counts as changed when its size, its time or the index's format differs from what the manifest's ``files`` table holds; a file that changes while it is
    parsed differs again next time. Without changes there is no new version. The lists that the driver holds are names of changed files, as every reader holds them. Names without glob signs are expected.
    """
    spark = store.spark
    seen = stored(file_states(spark, folder).withColumn("format", F.lit(FORMAT)))
    base = store.version()
    known = store.read("files", base) if base else seen.where(F.lit(False)).drop("path")
    old = known.select(F.col("file"), F.struct("size", "changed", "format").alias("was"))
    both = seen.select("file", "path", F.struct("size", "changed", "format").alias("now")).join(old, "file", "full_outer")
    moved = both.where(~F.col("now").eqNullSafe(F.col("was"))).select("file", "path", "now").collect()
    parsed, removed = [r for r in moved if r.now is not None], [r.file for r in moved if r.now is None]
    if moved:
        rows: dict[str, DataFrame] = {}
        if parsed:
            new = stored(read_corpus(spark, [r.path for r in parsed]).select(F.col("_metadata.file_path").alias("file"), "*"))
            cites = citations(new.withColumn("id", F.struct("file", "id"))).select("src.file", F.col("src.id").alias("src"), "dst", "pos")
            fresh = seen.drop("path").join(spark.createDataFrame([(r.file,) for r in parsed], "file string"), "file", "left_semi")
            # Ids and file names shrink so well that a task given by its bytes would sort millions of them.
            signs = new.agg(F.sum(F.char_length("references"))).first()[0] or 0
            rows = {"files": fresh, "cites": cites.repartition(signs // PIECE + 1, "src").sortWithinPartitions("src", "pos"), "meta": new.drop("references", "authors")}
        gone = spark.createDataFrame([(r.file,) for r in moved], "file string")
        store.commit(rows, {t: gone for t in ("files", "cites", "meta") if base or t in rows}, base=base, operation="index")
    return {"parsed": sorted(r.file for r in parsed), "removed": sorted(removed)}


def index_tables(store: Versions, version: int | None = None) -> dict[str, DataFrame]:
    """cites (src, dst, pos), meta, and titles (title_key, id): the first id of each title by file name and place in the file."""
    version = store.version() if version is None else version
    cites, meta = store.read("cites", version), store.read("meta", version)
    titles = meta.groupBy(F.lower(F.trim("title")).alias("title_key")).agg(F.min_by("id", F.struct("file", "ord")).alias("id")).where("title_key != ''")
    return {"cites": cites.drop("file"), "meta": meta.drop("file"), "titles": titles}
