"""Citation-graph traversal over ``cites`` (src, dst, pos): src cites dst, in order of pos."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions.text import looks_like_identifier, matches_any
from quillspark.session import cut, stored

BOTH, PAST, FUTURE = "both", "past", "future"


def resolve_seeds(meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, id) for each row of ``wanted`` (query): the exact id, else the first paper of that title, else the most cited whose title holds the query (earliest on ties).

    ``meta``: id, title, n_citation, ord. Exact matches are hash joins. What neither settles meets the titles through their grams (``holding``).
    """
    q = wanted.select("query", F.lower(F.trim("query")).alias("low")).where("low <> ''").distinct()
    by_id = q.join(meta.select("id"), F.trim("query") == F.col("id")).select("query", "id")
    named = meta.groupBy(F.lower(F.trim("title")).alias("low")).agg(F.min_by("id", "ord").alias("id"))
    by_title = q.join(by_id, "query", "left_anti").join(named, "low").select("query", "id")
    rest = q.join(by_id.union(by_title), "query", "left_anti")
    part = holding(meta, rest)
    best = part.groupBy("query").agg(F.max_by("id", F.struct(F.coalesce("n_citation", F.lit(0)), -F.col("ord"))).alias("id"))
    return by_id.union(by_title).union(best)


def holding(meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """``meta`` beside each row of ``wanted`` (query, low) whose ``low`` its title in lower case holds.

    An index of grams of three letters (for shorter queries, of as many as they have): of a query's grams the one that fewest titles have
    names the titles that are compared. Only grams of queries are looked up; both joins are by equality.
    """
    size = F.least(F.lit(3), F.char_length("low"))
    grams = lambda text, n: F.array_distinct(F.expr(f"transform(sequence(1, char_length({text}) - {n} + 1), i -> substring({text}, i, {n}))"))
    asked = stored(wanted.withColumn("n", size).where("n > 0").select("query", "low", "n", F.explode(grams("low", "n")).alias("gram")))
    sizes = sorted(r.n for r in asked.select("n").distinct().collect())  # 1, 2 and 3 at most
    titles = meta.withColumn("held", F.lower("title"))
    told = [titles.where(F.char_length("held") >= n).select("*", F.explode(grams("held", n)).alias("gram")) for n in sizes]
    if not told:  # no query is left
        told = [titles.where("false").withColumn("gram", F.lit(""))]
    index = functools.reduce(DataFrame.unionByName, told).join(asked.select("gram").distinct(), "gram", "left_semi")
    index = stored(index)
    rarity = index.groupBy("gram").agg(F.count("*").alias("titles"))
    rarest = asked.join(rarity, "gram", "left").groupBy("query", "low").agg(F.min(F.struct(F.coalesce("titles", F.lit(0)).alias("titles"), "gram"))["gram"].alias("gram"))
    return rarest.join(index, "gram").where(F.contains("held", F.col("low"))).drop("gram", "held")


def seed_or_raw(meta: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, id): an identifier stays as it is; a title is resolved, or stays raw if nothing matches."""
    found = resolve_seeds(meta, wanted.where(~looks_like_identifier("query"))).withColumnRenamed("id", "found")
    return wanted.join(found, "query", "left").select("query", F.coalesce("found", F.trim("query")).alias("id"))


def adjacency(cites: DataFrame, meta: DataFrame, direction: str = BOTH, cap: int | None = None, keywords: list[str] | None = None, exclude_non_matching: bool = True,
              of: DataFrame | None = None) -> DataFrame:
    """(at, to, src, dst): neighbours of the nodes in ``of`` (at; every node without it) as they may be followed.

    The cap takes the first ``cap`` entries of a node's references and of its citers, duplicates and absent papers
    included; then neighbours must exist in ``meta`` and match a keyword. None of this depends on what has been
    visited. Nodes are cut to ``of`` before anything is ranked. Direction past: references; future: citers; anything else but both: none.
    """
    sides = []
    if direction in (BOTH, PAST):
        sides.append(cites.select(F.lit(0).alias("side"), F.col("src").alias("at"), F.col("dst").alias("to"), "pos", "src", "dst"))
    if direction in (BOTH, FUTURE):
        sides.append(cites.select(F.lit(1).alias("side"), F.col("dst").alias("at"), F.col("src").alias("to"), "pos", "src", "dst"))
    if not sides:
        return cites.select(F.col("src").alias("at"), F.col("dst").alias("to"), "src", "dst").where(F.lit(False))
    if of is not None:
        sides = [x.join(of.select("at"), "at", "left_semi") for x in sides]
    rows = sides[0] if len(sides) == 1 else sides[0].union(sides[1])
    if cap is not None:
        # pos orders a paper's own references; citers come in order of their id, then pos.
        place = W.partitionBy("side", "at").orderBy(F.when(F.col("side") == 0, F.col("pos")), "src", "pos")
        rows = rows.withColumn("place", F.row_number().over(place)).where(F.col("place") <= cap)
    known = meta
    if keywords and exclude_non_matching:
        known = meta.where(matches_any(keywords))
    return rows.join(known.select(F.col("id").alias("to")), "to", "left_semi").select("at", "to", "src", "dst").distinct()


def bfs(seeds: DataFrame, near: Callable[[DataFrame], DataFrame], hops: int) -> tuple[DataFrame, DataFrame]:
    """(id, hop) first reached within ``hops``, and the distinct edges (src, dst) leaving nodes of fewer hops.

    ``near`` gives the neighbours (at, to, src, dst) of a frontier (at). Each node is expanded once, and its
    edges are kept, so a hop reads what its frontier touches; ``hops`` is at most 10. Frontiers are checkpointed, so plans stay short.
    Stops at an empty frontier.
    """
    if not 1 <= hops <= 10:
        raise ValueError("hops: 1 to 10")
    visited = fresh = cut(seeds.select("id", F.lit(0).alias("hop")).distinct())
    edges = None
    for hop in range(1, hops + 1):
        met = cut(near(fresh.select(F.col("id").alias("at"))).select("to", "src", "dst").distinct())
        edges = met.select("src", "dst") if edges is None else edges.union(met.select("src", "dst"))
        fresh = cut(met.select(F.col("to").alias("id")).distinct().join(visited, "id", "left_anti").select("id", F.lit(hop).alias("hop")))
        if fresh.isEmpty():
            break
        visited = visited.union(fresh)
    return visited, edges.distinct()


def explore(cites: DataFrame, meta: DataFrame, seeds: DataFrame, hops: int = 2, direction: str = BOTH, cap: int | None = None, keywords: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, hop) and edges (src, dst) around ``seeds`` (id). Seeds unknown to ``meta`` are dropped; keywords never filter seeds."""
    if cap is not None and not 1 <= cap <= 100_000:
        raise ValueError("cap: 1 to 100000")
    known = seeds.select("id").join(meta.select("id"), "id", "left_semi")
    return bfs(known, lambda at: adjacency(cites, meta, direction, cap, keywords, of=at), hops)


def reference_counts(cites: DataFrame) -> DataFrame:
    """(id, reference_count): entries of a paper's list, absent papers included."""
    return cites.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("reference_count"))


def reference_graph(papers: DataFrame, ids: list[str], refs: str = "references", citers: str = "referenced_by") -> DataFrame:
    """(src, dst) by ord: references and citers of ``papers`` that name another of its papers by any of ``ids``, in any case; no loops, each pair once.

    An identifier that several papers carry stands for the last of them.
    """
    names = papers.select("ord", F.explode(F.array(*[F.lower(F.trim(c)) for c in ids])).alias("name")).where("name <> ''")
    named = names.groupBy("name").agg(F.max("ord").alias("other"))
    out = papers.select("ord", F.explode(F.transform(refs, lambda x: F.lower(F.trim(x)))).alias("name"), F.lit(True).alias("cites"))
    back = papers.select("ord", F.explode(F.transform(citers, lambda x: F.lower(F.trim(x)))).alias("name"), F.lit(False).alias("cites"))
    met = out.union(back).join(named, "name").where("ord <> other")
    ends = lambda a, b: F.when(F.col("cites"), F.col(a)).otherwise(F.col(b))
    return met.select(ends("ord", "other").alias("src"), ends("other", "ord").alias("dst")).distinct()


def induced(edges: DataFrame, kept: DataFrame, id_col: str = "id") -> DataFrame:
    """Edges with both ends in ``kept``."""
    for end in ("src", "dst"):
        edges = edges.join(kept.select(F.col(id_col).alias(end)), end, "left_semi")
    return edges.select("src", "dst")


def undirected(edges: DataFrame, pieces: int | None = None) -> DataFrame:
    """(a, b) with a < b, each pair once, no loops. pieces: how many tasks tell the pairs apart, where their bytes should not decide."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return (pairs.repartition(pieces, "a", "b") if pieces else pairs).distinct()


def reindexed(nodes: DataFrame, edges: DataFrame, id_col: str = "id", by: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with a gapless idx in order of ``by``, and edges (source, target) between indices; edges with an absent end go.

    Indices are offsets of range partitions plus places in them, so no task holds all nodes.
    """
    ranged = cut(nodes.repartitionByRange(by if by is not None else F.col(id_col)).withColumn("__p", F.spark_partition_id()))
    parts = ranged.groupBy("__p").agg(F.count("*").alias("n"))
    before = parts.select("__p", F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__from"))
    place = F.row_number().over(W.partitionBy("__p").orderBy(by if by is not None else F.col(id_col)))
    nodes = ranged.withColumn("__n", place).join(before, "__p").withColumn("idx", F.col("__from") + F.col("__n") - 1).drop("__p", "__n", "__from")
    at = lambda end, name: nodes.select(F.col(id_col).alias(end), F.col("idx").alias(name))
    return nodes, edges.join(at("src", "source"), "src").join(at("dst", "target"), "dst").select("source", "target")


def filtered_graph(nodes: DataFrame, edges: DataFrame, seed: Column, keywords: list[str], on: bool = True, prefiltered: bool = False) -> tuple[DataFrame, DataFrame]:
    """The graph (nodes: id, title, abstract; edges: src, dst) under the keyword toggle: on, the seed and matching nodes with the edges between them; off, all of it.

    Without keywords, or on a graph that was prefiltered, the toggle does nothing.
    """
    if not on or prefiltered or not keywords:
        return nodes, edges.select("src", "dst")
    kept = nodes.where((F.col("id") == seed) | matches_any(keywords))
    return kept, induced(edges, kept)


def clusters_shown(nodes: DataFrame, most: int = 3000) -> DataFrame:
    """(n, shown): whether a graph is small enough for the cluster view."""
    return nodes.agg(F.count("*").alias("n")).withColumn("shown", F.col("n") <= most)


@dataclass(frozen=True)
class GraphSettings:
    """How a neighbourhood is explored; ``most_per_hop`` None: all citations."""

    hops: int = 2
    most_per_hop: int | None = None
    resolution: float = 0.5


def _number(text: Column) -> Column:
    """The number that a form field holds; a blank one is 0, anything else null."""
    t = F.trim(text)
    return F.when(t == "", 0.0).when(t.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), t.try_cast("double"))


def sanitized_settings(hops: Column, most_per_hop: Column, resolution: Column, defaults: GraphSettings = GraphSettings()) -> Column:
    """Struct of settings out of form fields: hops rounded and 1 or more, most_per_hop rounded and positive or null, resolution positive; else the defaults."""
    nearest = lambda x: F.floor(_number(x) + 0.5).cast("int")
    return F.struct(
        F.when(nearest(hops) >= 1, nearest(hops)).otherwise(defaults.hops).alias("hops"), F.when(nearest(most_per_hop) > 0, nearest(most_per_hop)).alias("most_per_hop"),
        F.when(_number(resolution) > 0, _number(resolution)).otherwise(defaults.resolution).alias("resolution"),
    )


def settings_from_json(raw: Column, defaults: GraphSettings = GraphSettings()) -> Column:
    """Saved settings over their defaults; what cannot be parsed leaves the defaults."""
    given = F.from_json(raw, "hops int, most_per_hop int, resolution double")
    kinds = {"hops": "int", "most_per_hop": "int", "resolution": "double"}
    return F.struct(*[F.coalesce(given[k], F.lit(v).cast(kinds[k])).alias(k) for k, v in defaults.__dict__.items()])
