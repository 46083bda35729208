"""Session defaults and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's defaults; ``conf`` wins over them."""
    builder = SparkSession.builder.appName("quillspark").config(map=DEFAULTS | conf)
    return (builder.master(master) if master else builder).getOrCreate()


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme of the default file system where it names none and that is not the local one: what Python tasks open is then what Spark writes to."""
    if "://" in folder or folder.startswith("file:"):
        return folder
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    default = jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(conf)
    return folder if default.getScheme() in (None, "file") else jvm.org.apache.hadoop.fs.Path(folder).makeQualified(default, jvm.org.apache.hadoop.fs.Path("/")).toString()


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where none is set and Spark is local."""
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(folder)
        return qualified(spark, folder).rstrip("/")
    if folder := spark.sparkContext.getCheckpointDir():
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(folder := tempfile.mkdtemp(prefix="spark-quill-"))
    return spark.sparkContext.getCheckpointDir() or folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: columns stay prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_written: list[str] = []


def written() -> int:
    """How many tables ``stored`` has written in this process: a mark for ``swept``."""
    return len(_written)


def settled(df: DataFrame, since: int) -> DataFrame:
    """``df`` stored, after which the other tables that ``stored`` has written after the mark ``since`` go."""
    out = stored(df)
    last = _written.pop()
    swept(df.sparkSession, since)
    _written.append(last)
    return out


def swept(spark: SparkSession, since: int, *paths: str) -> None:
    """Deletes ``paths`` and the tables that ``stored`` has written after the mark ``since``, for when everything that reads them is done."""
    gone = [*_written[since:], *paths]
    del _written[since:]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
