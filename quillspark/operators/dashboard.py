"""Counts and recent activity of projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def per_project(projects: DataFrame, tables: dict[str, DataFrame], dated: dict[str, str]) -> DataFrame:
    """``projects`` (project_id, updated_at) with n_<table> for each table (0 if none) and last_activity.

    last_activity: the latest time over the ``dated`` tables (name to time column), updated_at only if there is none.
    Each table is aggregated before it meets the projects.
    """
    out = projects
    for name, t in tables.items():
        out = out.join(t.groupBy("project_id").agg(F.count("*").alias(f"n_{name}")), "project_id", "left").withColumn(f"n_{name}", F.coalesce(f"n_{name}", F.lit(0)))
    latest = None
    for name, at in dated.items():
        part = tables[name].groupBy("project_id").agg(F.max(at).alias("at"))
        latest = part if latest is None else latest.unionByName(part)
    latest = latest.groupBy("project_id").agg(F.max("at").alias("latest"))
    return out.join(latest, "project_id", "left").withColumn("last_activity", F.coalesce("latest", "updated_at")).drop("latest")


def totals(projects: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): rows of each table, those of unknown projects included, and of projects."""
    out = projects.agg(F.count("*").alias("n")).select(F.lit("projects").alias("name"), "n")
    for name, t in tables.items():
        out = out.union(t.agg(F.count("*").alias("n")).select(F.lit(name), "n"))
    return out


def in_last(df: DataFrame, at: str, now: Column, days: int = 7) -> DataFrame:
    """(n): rows of the last days before ``now``."""
    return df.where(F.col(at) >= now - F.make_dt_interval(F.lit(days))).agg(F.count("*").alias("n"))


def recent(projects: DataFrame, branches: dict[str, DataFrame], n: int = 15) -> DataFrame:
    """(kind, project_id, project_name, label, at): the latest rows over all branches (project_id, label, at).

    Each branch is cut to its latest ``n`` before the union (Spark does not push a top-k below one), then rows of unknown
    projects go, then the latest ``n`` stay.
    """
    out = None
    for kind, b in branches.items():
        part = b.select(F.lit(kind).alias("kind"), "project_id", "label", "at").orderBy(F.desc("at"), "project_id", "label").limit(n)
        out = part if out is None else out.unionByName(part)
    named = out.join(projects.select("project_id", F.col("name").alias("project_name")), "project_id")
    return named.select("kind", "project_id", "project_name", "label", "at").orderBy(F.desc("at"), "kind", "project_id", "label").limit(n)
