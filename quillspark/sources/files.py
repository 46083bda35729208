"""Files by suffix, the CSV corpus and its citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillspark.functions.text import filled, label, quoted_names, safe_int
from quillspark.schemas import CORPUS
from quillspark.sources.normalize import as_papers, author

UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def read_any(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """csv, json, jsonl or parquet, told by the suffix."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    reader = spark.read.schema(schema) if schema else spark.read
    if kind == "csv":
        return reader.options(header=True, multiLine=True, escape='"').csv(path)
    if kind in ("json", "jsonl", "ndjson"):
        return reader.json(path)
    if kind == "parquet":
        return reader.parquet(path)
    raise ValueError(f"no reader for {path}")


def write_any(df: DataFrame, path: str, mode: str = "error") -> None:
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    writer = df.write.mode(mode)
    {"csv": lambda: writer.option("header", True).option("escape", '"').csv(path), "jsonl": lambda: writer.json(path), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[kind]()


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The CSV corpus with its blanks as ''; numbers that cannot be read are null. ``ord`` follows the file."""
    text = "string"
    raw = ", ".join(f"`{f.name}` {text}" for f in CORPUS)
    rows = spark.read.schema(raw).options(header=True, multiLine=True, escape='"', nullValue="\0", emptyValue="").csv(path)
    rows = rows.withColumns({c: safe_int(c) for c in ("year", "n_citation")} | {c: F.coalesce(c, F.lit("")) for c in ("title", "abstract", "venue", "authors", "references")})
    return rows.withColumn("ord", F.monotonically_increasing_id())


def corpus_papers(rows: DataFrame) -> DataFrame:
    """Corpus rows as papers: names and references out of list literals, zero and blank as null, archetype None as null."""
    refs = F.regexp_extract_all(F.col("references"), F.lit(f"['\"]([^'\"]+)['\"]"), F.lit(1))
    return as_papers(
        rows, "corpus", semantic_scholar_id=F.col("id"), title=F.col("title"), abstract=filled("abstract"), venue=filled("venue"), year=F.nullif(F.col("year"), F.lit(0)),
        citation_count=F.nullif(F.col("n_citation"), F.lit(0)), authors=F.transform(quoted_names("authors"), lambda n: author(n)), references=refs,
        reference_count=F.nullif(F.size(refs), F.lit(0)), predicted_main_archetype=label("predicted_main_archetype"), predicted_second_tier_archetype=label("predicted_second_tier_archetype"),
    )


def citations(rows: DataFrame) -> DataFrame:
    """(src, dst, pos): one row a reference of ``rows`` (id, references), duplicates and absent ids included."""
    ids = F.regexp_extract_all(F.col("references"), F.lit(f"({UUID})"), F.lit(1))
    return rows.select(F.col("id").alias("src"), F.posexplode(ids).alias("pos", "dst")).select("src", "dst", F.col("pos").cast("long"))


def titles(rows: DataFrame) -> DataFrame:
    """(title_key, id): the first id by ``ord`` for each title in lower case."""
    return rows.groupBy(F.lower(F.trim("title")).alias("title_key")).agg(F.min_by("id", "ord").alias("id")).where("title_key != ''")


def write_index(rows: DataFrame, folder: str, version: int = 1) -> None:
    """The citation index as tables sorted by either end, under a version; ``read_index`` gives them back without another parse."""
    cites = citations(rows)
    for by in ("src", "dst"):
        cites.repartition(by).sortWithinPartitions(by, "pos").write.mode("overwrite").parquet(f"{folder}/v{version}/cites_by_{by}")
    rows.drop("references", "authors").write.mode("overwrite").parquet(f"{folder}/v{version}/meta")
    titles(rows).write.mode("overwrite").parquet(f"{folder}/v{version}/titles")


def read_index(spark: SparkSession, folder: str, version: int = 1) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/v{version}/{n}") for n in ("cites_by_src", "cites_by_dst", "meta", "titles")}
