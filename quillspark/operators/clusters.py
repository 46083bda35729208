"""Cluster analytics over a dendrogram (level, node, community) and nodes (node, score, year, title, ord)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillspark.functions.scores import middle_years
from quillspark.session import stored


def representatives(levels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(level, community, rep, size): the best-scored node of each cluster, the smallest on ties."""
    rows = levels.join(nodes.select("node", "score"), "node")
    return rows.groupBy("level", "community").agg(F.max_by("node", F.struct(F.coalesce("score", F.lit(0.0)), -F.col("node"))).alias("rep"), F.count("*").alias("size"))


def rep_levels(levels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, rep_level): the coarsest level that a node represents, -1 for none."""
    reps = representatives(levels, nodes).groupBy(F.col("rep").alias("node")).agg(F.max("level").alias("rep_level"))
    return nodes.select("node").join(reps, "node", "left").select("node", F.coalesce("rep_level", F.lit(-1)).alias("rep_level"))


def sizes(levels: DataFrame) -> DataFrame:
    return levels.groupBy("level", "community").agg(F.count("*").alias("size"))


def legend(levels: DataFrame, level: int) -> DataFrame:
    """Clusters of a level, largest first."""
    return sizes(levels).where(F.col("level") == level).select("community", "size").orderBy(F.desc("size"), "community")


def members(levels: DataFrame, nodes: DataFrame, level: int) -> DataFrame:
    """(community, node, place, is_rep): members of each cluster by score, then title."""
    rows = levels.where(F.col("level") == level).join(nodes.select("node", "score", "title"), "node")
    by = W.partitionBy("community")
    return rows.select("community", "node", F.row_number().over(by.orderBy(F.desc("score"), "title", "node")).alias("place"),
                       (F.first("node").over(by.orderBy(F.desc("score"), "node")) == F.col("node")).alias("is_rep"))


def _ends(edges: DataFrame, at: DataFrame, *cols: str) -> DataFrame:
    """``edges`` (source, target) with the columns of ``at`` (node, ...) for both ends, suffixed 1 and 2."""
    for end, n in (("source", 1), ("target", 2)):
        edges = edges.join(at.select(F.col("node").alias(end), *[F.col(c).alias(f"{c}{n}") for c in cols]), end)
    return edges


def cluster_edges(edges: DataFrame, at: DataFrame) -> DataFrame:
    """(a, b, n): edges between clusters of ``at`` (node, community), undirected; those inside a cluster are left out."""
    rows = _ends(edges, at, "community").where("community1 <> community2")
    return rows.groupBy(F.least("community1", "community2").alias("a"), F.greatest("community1", "community2").alias("b")).agg(F.count("*").alias("n"))


def bridges(edges: DataFrame, top: DataFrame, sub: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, n, sub_a, sub_b, rep_a, rep_b): linked top clusters, anchored at the pair of sub-clusters with most edges (smallest on ties) and their representatives.

    top: (node, community, is_misc); sub: (node, community). The miscellaneous cluster never bridges.
    """
    at = top.where("not is_misc").select("node", "community").join(sub.select("node", F.col("community").alias("sub")), "node")
    rows = _ends(edges, at, "community", "sub").where("community1 <> community2")
    flip = F.col("community1") > F.col("community2")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    pairs = rows.groupBy(pick("community1", "community2").alias("a"), pick("community2", "community1").alias("b"), pick("sub1", "sub2").alias("sub_a"), pick("sub2", "sub1").alias("sub_b")).agg(F.count("*").alias("k"))
    best = pairs.groupBy("a", "b").agg(F.sum("k").alias("n"), F.max_by(F.struct("sub_a", "sub_b"), F.struct("k", -F.col("sub_a"), -F.col("sub_b"))).alias("p"))
    best = best.select("a", "b", "n", "p.sub_a", "p.sub_b")
    reps = representatives(sub.select(F.lit(0).alias("level"), "node", "community"), nodes)
    for side in "ab":
        best = best.join(reps.select(F.col("community").alias(f"sub_{side}"), F.col("rep").alias(f"rep_{side}")), f"sub_{side}")
    return best.select("a", "b", "n", "sub_a", "sub_b", "rep_a", "rep_b")


def top_level(levels: DataFrame) -> DataFrame:
    """(node, community, ...) at the coarsest level."""
    return levels.join(F.broadcast(levels.agg(F.max("level").alias("level"))), "level").drop("level")


def scope(levels: DataFrame, nodes: DataFrame, cluster: int | None = None) -> DataFrame:
    """``nodes`` of one cluster of the coarsest level; all of them without a cluster or levels."""
    if cluster is None or levels.isEmpty():
        return nodes
    return nodes.join(top_level(levels).where(F.col("community") == cluster).select("node"), "node", "left_semi")


def seeds(levels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(level, community, node, first): what a new view places, the representative of each cluster of the coarsest level; ``first``, its first node, gives the order."""
    top = F.broadcast(levels.agg(F.max("level").alias("level")))
    first = levels.join(top, "level").groupBy("level", "community").agg(F.min("node").alias("first"))
    return representatives(levels.join(top, "level"), nodes).join(first, ["level", "community"]).select("level", "community", F.col("rep").alias("node"), "first")


def misc_clusters(levels: DataFrame) -> DataFrame:
    """(level, community): at every level the cluster that holds level 0's cluster of unlinked nodes. levels: (level, node, community, is_misc)."""
    return levels.join(levels.where("level = 0 AND is_misc").select("node"), "node", "left_semi").select("level", "community").distinct()


def meta_graph(levels: DataFrame, nodes: DataFrame, edges: DataFrame, level: int | None) -> DataFrame:
    """(kind, a, b, n, label, x, y, radius): the graph as a level shows it.

    Rows of kind ``cluster`` are the clusters of ``level`` (a: its id, n: its nodes) at their middle, those of kind ``link`` the edges between two of them (a < b, n: how many).
    Without a level they are ``paper`` rows (a: node, the label its shortened title) and single edges as they run. nodes: (node, title, x, y); levels: (level, node, community, is_misc).
    """
    empty = {c: F.lit(None).cast("double") for c in ("x", "y", "radius")}
    if level is None:
        title = F.coalesce("title", F.lit(""))
        label = F.when(F.char_length(title) > 22, F.concat(F.left(title, F.lit(20)), F.lit("..."))).otherwise(title)
        shown = nodes.select(F.lit("paper").alias("kind"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), F.lit(1).cast("long").alias("n"), label.alias("label"), "x", "y", F.lit(12.0).alias("radius"))
        links = edges.select(F.lit("link").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), F.lit(1).cast("long").alias("n"), F.lit(None).cast("string").alias("label"))
        return shown.unionByName(links.withColumns(empty))
    at = levels.where(F.col("level") == level).select("node", "community")
    size = at.join(nodes.select("node"), "node").groupBy("community").agg(F.count("*").alias("n"))
    misc = misc_clusters(levels).where(F.col("level") == level).select("community", F.lit(True).alias("misc"))
    rows = centroids(at, nodes.select("node", "x", "y")).join(size, "community").join(misc, "community", "left")
    name = F.when(F.col("misc"), F.lit("Miscellaneous")).otherwise(F.concat(F.lit("Cluster "), F.col("community").cast("string")))
    shown = rows.select(F.lit("cluster").alias("kind"), F.col("community").alias("a"), F.lit(None).cast("long").alias("b"), "n", F.concat(name, F.lit(" · "), F.col("n").cast("string")).alias("label"), "x", "y", "radius")
    return shown.unionByName(cluster_edges(edges, at).select(F.lit("link").alias("kind"), "a", "b", "n", F.lit(None).cast("string").alias("label")).withColumns(empty))


def kpis(at: DataFrame, nodes: DataFrame, placed: DataFrame, tiers: DataFrame) -> DataFrame:
    """(community, papers, shown, gold, silver): totals of each cluster; shown: placed ones."""
    rows = at.join(placed.select("node", F.lit(True).alias("on")), "node", "left").join(tiers.select("node", "tier"), "node", "left")
    return rows.groupBy("community").agg(F.count("*").alias("papers"), F.count_if("on").alias("shown"), F.count_if(F.col("tier") == "gold").alias("gold"), F.count_if(F.col("tier") == "silver").alias("silver"))


def centroids(at: DataFrame, xy: DataFrame) -> DataFrame:
    """(community, x, y, radius): mean place; radius grows with the root of the size up to 46."""
    return at.join(xy, "node").groupBy("community").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.least(F.lit(46.0), 12 + 4 * F.sqrt(F.count("*"))).alias("radius"))


def year_queues(levels: DataFrame, nodes: DataFrame, lane_of: DataFrame, placed: DataFrame, year: int) -> DataFrame:
    """(lane, node, rep_level, place): the nodes of a year not yet placed, in each lane by level represented, score and node."""
    free = nodes.where(F.col("year") == year).join(placed.select("node"), "node", "left_anti")
    rows = free.join(rep_levels(levels, nodes), "node").join(lane_of.select("node", F.col("community").alias("lane")), "node")
    by = W.partitionBy("lane").orderBy(F.desc("rep_level"), F.desc("score"), "node")
    return rows.select("lane", "node", "rep_level", F.row_number().over(by).alias("place"))


def expandable_years(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    return nodes.where("year is not null").join(placed.select("node"), "node", "left_anti").select("year").distinct()


def expandable_gaps(gaps: DataFrame, years: DataFrame) -> DataFrame:
    """``gaps`` (left, right: years) with expandable: whether a middle year of the gap is in ``years`` (year)."""
    each = gaps.select("left", "right", F.explode(middle_years(F.col("left"), F.col("right"))).alias("year")).join(years.distinct().withColumn("is", F.lit(True)), "year", "left")
    return each.groupBy("left", "right").agg(F.coalesce(F.bool_or("is"), F.lit(False)).alias("expandable"))


def parent_links(placed: DataFrame, at: DataFrame) -> DataFrame:
    """(community, parent): the placed node of the coarsest level in each cluster, the first placed on ties. placed: (node, level, ord)."""
    return placed.join(at, "node").groupBy("community").agg(F.max_by("node", F.struct("level", -F.col("ord"))).alias("parent"))


def siblings(levels: DataFrame, nodes: DataFrame, placed: DataFrame, node: int) -> DataFrame:
    """(node, level): what to place next to ``node``: representatives of the sub-clusters beside it, at the coarsest level that has any not placed; at level 0 papers."""
    own = levels.where(F.col("node") == node).select("level", F.col("community").alias("inside"))
    below = levels.select(F.col("level").alias("below"), "node", F.col("community").alias("sub"))
    above = levels.select((F.col("level") - 1).alias("below"), "node", F.col("community").alias("inside"))
    mine = own.select((F.col("level") - 1).alias("below"), "inside")
    inner = above.join(mine, ["below", "inside"]).join(below, ["below", "node"])
    reps = representatives(levels, nodes).select(F.col("level").alias("below"), F.col("community").alias("sub"), F.col("rep"))
    level_reps = inner.select("below", "sub").distinct().join(reps, ["below", "sub"]).select((F.col("below") + 1).alias("level"), F.col("rep").alias("node"))
    leaves = levels.where("level = 0").join(own.where("level = 0").select("inside"), F.col("community") == F.col("inside")).select(F.lit(0).alias("level"), "node")
    free = level_reps.union(leaves).join(placed.select("node"), "node", "left_anti").where(F.col("node") != node).distinct()
    best = free.agg(F.max("level").alias("level"))
    return free.join(F.broadcast(best), "level").select("node", "level")


def split_by_time(found: DataFrame, year: Column) -> DataFrame:
    """``found`` with side: past if earlier than ``year``, else future (null years too)."""
    return found.withColumn("side", F.when(F.col("year") < year, "past").otherwise("future"))


def cells(nodes: DataFrame) -> DataFrame:
    """(node, x, y): nodes (node, lane, year, score) on a grid: dense year index, place in the (lane, year) cell around its middle. Yearless nodes go."""
    rows = nodes.where("year is not null")
    years = rows.select("year").distinct().withColumn("x", F.dense_rank().over(W.orderBy("year")) - 1)
    cell = W.partitionBy("lane", "year")
    rows = rows.join(years, "year")
    j, k = F.row_number().over(cell.orderBy(F.desc("score"), "node")) - 1, F.count("*").over(cell)
    return rows.select("node", "lane", "x", (j - (k - 1) / 2).alias("y"))


def lane_offsets(heights: DataFrame) -> DataFrame:
    """(lane, top): running sum of the heights of the lanes before. Lanes are few."""
    return heights.select("lane", F.coalesce(F.sum("height").over(W.orderBy("lane").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("top"))


def year_dividers(years: DataFrame) -> DataFrame:
    """(year, divider): halfway to the next year shown."""
    return years.select("year", ((F.col("x") + F.lead("x").over(W.orderBy("year"))) / 2).alias("divider"))


def year_position(axis: DataFrame, wanted: DataFrame) -> DataFrame:
    """(year, x): a year's place on the axis (year, x), between its neighbours in proportion; beyond the ends, that of the end. The axis has one row a year."""
    a = axis.select(F.col("year").alias("y0"), F.col("x").alias("x0"), F.lead("year").over(W.orderBy("year")).alias("y1"), F.lead("x").over(W.orderBy("year")).alias("x1"))
    ends = axis.agg(F.min("year").alias("first"), F.max("year").alias("last"), F.min_by("x", "year").alias("xf"), F.max_by("x", "year").alias("xl"))
    rows = wanted.select("year").join(F.broadcast(a), (F.col("year") >= F.col("y0")) & (F.col("year") < F.col("y1")), "left").join(F.broadcast(ends), F.lit(True))
    inner = F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("year") - F.col("y0")) / (F.col("y1") - F.col("y0"))
    return rows.select("year", F.coalesce(inner, F.when(F.col("year") < F.col("first"), F.col("xf")).otherwise(F.col("xl"))).cast("double").alias("x"))


def letters(n: Column) -> Column:
    """A to Z, then the number."""
    return F.when(n <= 26, F.char(64 + n)).otherwise(n.cast("string"))


def renumbered(at: DataFrame) -> DataFrame:
    """Communities numbered from 0 by their first node."""
    first = at.groupBy("community").agg(F.min("node").alias("first")).withColumn("number", F.row_number().over(W.orderBy("first")) - 1)
    return at.join(first, "community").select("node", F.col("number").alias("community"))


# --- summaries (fixed values: the wording of summaries and prompts) --------------------------------------------------------------------------------------------------------


def truncated_title(t: Column, n: int = 60) -> Column:
    t = F.trim(F.coalesce(t, F.lit("")))
    return F.when(F.char_length(t) <= n, t).otherwise(F.concat(F.rtrim(F.left(t, F.lit(n - 1))), F.lit("…")))


def finest_summaries(at: DataFrame, nodes: DataFrame, name: Column | None = None) -> DataFrame:
    """(community, title, summary) of level-0 clusters: how many papers, and the titles of the first three by ord."""
    rows = at.join(nodes.select("node", "title", "ord"), "node")
    place = F.row_number().over(W.partitionBy("community").orderBy(F.when(F.coalesce(F.trim("title"), F.lit("")) != "", F.col("ord")).asc_nulls_last()))
    top = rows.withColumn("place", place)
    held = F.when((F.col("place") <= 3) & (F.coalesce(F.trim("title"), F.lit("")) != ""), F.struct("place", "title"))
    found = top.groupBy("community").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(held)), lambda x: x["title"]).alias("titles"))
    s = F.when(F.col("n") == 1, "").otherwise("s")
    told = F.concat(F.lit("A group of "), F.col("n"), F.lit(" related paper"), s, F.lit(". Representative works: "), F.array_join("titles", "; "), F.lit("."))
    summary = F.when(F.size("titles") > 0, told).otherwise(F.concat(F.lit("A group of "), F.col("n"), F.lit(" related papers.")))
    title = F.coalesce(name if name is not None else F.lit(None).cast("string"), F.when(F.size("titles") > 0, truncated_title(F.get("titles", F.lit(0)))), F.lit("Cluster"))
    return found.select("community", title.alias("title"), summary.alias("summary"))


def higher_summaries(children: DataFrame) -> DataFrame:
    """(community, title, summary) from children (community, child, title): how many sub-clusters, and the titles of the first three."""
    rows = children.withColumn("place", F.row_number().over(W.partitionBy("community").orderBy("child")))
    titled = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("Untitled"))
    found = rows.groupBy("community").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.when(F.col("place") <= 3, F.struct("place", titled.alias("t"))))), lambda x: x["t"]).alias("titles"))
    s = F.when(F.col("n") == 1, "").otherwise("s")
    summary = F.concat(F.lit("A broader area grouping "), F.col("n"), F.lit(" sub-cluster"), s, F.lit(": "), F.array_join("titles", "; "), F.lit("."))
    return found.select("community", truncated_title(F.get("titles", F.lit(0))).alias("title"), summary.alias("summary"))


def hierarchy(levels: DataFrame, nodes: DataFrame) -> DataFrame:
    """(level, community, title, summary), bottom up: level 0 from papers, each level above from its distinct children."""
    top = levels.agg(F.max("level")).first()[0]
    if top is None:
        return finest_summaries(levels.select("node", "community"), nodes).select(F.lit(0).alias("level"), "community", "title", "summary")
    below = stored(finest_summaries(levels.where("level = 0").select("node", "community"), nodes).withColumn("level", F.lit(0)))
    out = below
    for level in range(1, top + 1):
        up = levels.where(F.col("level") == level).select("node", "community")
        down = levels.where(F.col("level") == level - 1).select("node", F.col("community").alias("child"))
        family = up.join(down, "node").select("community", "child").distinct()
        below = higher_summaries(family.join(below.select(F.col("community").alias("child"), "title"), "child")).withColumn("level", F.lit(level))
        below = stored(below)  # read by the union and by the level above
        out = out.unionByName(below)
    return out.select("level", "community", "title", "summary")


def finest_prompt(papers: Column, name: Column) -> Column:
    """Prompt text of a cluster from array<struct<title, abstract, archetypes>>."""
    line = lambda p, i: F.concat(
        (i + 1).cast("string"), F.lit(". Title: "), F.coalesce(p["title"], F.lit("")), F.lit("\n   Archetypes: "),
        F.coalesce(F.nullif(F.array_join(F.filter(p["archetypes"], lambda a: F.coalesce(a, F.lit("")) != ""), ", "), F.lit("")), F.lit("n/a")),
        F.lit("\n   Abstract: "), F.coalesce(F.nullif(F.trim(p["abstract"]), F.lit("")), F.lit("n/a")))
    head = F.concat(F.lit("Papers in this cluster ("), F.size(papers).cast("string"), F.lit("):"))
    return F.concat_ws("\n", F.concat(F.lit("Cluster label: "), F.nullif(name, F.lit(""))), head, F.array_join(F.transform(papers, line), "\n"))


def higher_prompt(children: Column, name: Column) -> Column:
    """Prompt text of a cluster from array<struct<title, summary>> of its sub-clusters."""
    line = lambda c, i: F.concat((i + 1).cast("string"), F.lit(". "), F.coalesce(F.nullif(c["title"], F.lit("")), F.lit("Untitled")), F.lit(" — "), c["summary"])
    head = F.concat(F.lit("Finer sub-cluster summaries ("), F.size(children).cast("string"), F.lit("):"))
    return F.concat_ws("\n", F.concat(F.lit("Cluster label: "), F.nullif(name, F.lit(""))), head, F.array_join(F.transform(children, line), "\n"))
