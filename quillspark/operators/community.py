"""Communities: hierarchical Louvain of each graph, modularity, dendrogram levels, lane order."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window as W, functions as F

from quillspark.session import settled, stored, written

LEVELS = "graph_id string, level int, node long, community long, is_misc boolean"


class Rows:
    """Links of nodes 0 to n - 1 as flat lists, a tenth of the memory of dicts: a node's are a dict while it is visited. ends: where each node's end."""

    def __init__(self, ends: list[int], others: list[int], weights: list[float]) -> None:
        self.ends, self.others, self.weights = ends, others, weights

    def __len__(self) -> int:
        return len(self.ends)

    def __iter__(self):
        start = 0
        for end in self.ends:
            yield dict(zip(self.others[start:end], self.weights[start:end]))
            start = end


class Moves:
    """One level of local moving: nodes 0 to n - 1 in order, neighbours in the order in which edges named them."""

    def __init__(self, links: list[dict[int, float]] | Rows, degree: list[float], label: list[int], total: float, resolution: float) -> None:
        self.links, self.degree, self.label = links, degree, label
        self.pull = resolution / total
        self.mass = [0.0] * len(links)
        for node, c in enumerate(label):
            self.mass[c] += degree[node]

    def best(self, node: int, near: dict[int, float]) -> int:
        """The community that gains most over staying; staying unless the gain is over 0."""
        label, mass, k = self.label, self.mass, self.degree[node]
        home, drawn = label[node], self.pull * k
        toward: dict[int, float] = {}
        for other, w in near.items():
            if other != node:
                c = label[other]
                toward[c] = toward.get(c, 0.0) + w
        most, to = 0.0, home
        stay = toward.pop(home, 0.0) - drawn * (mass[home] - k)
        for c, w in toward.items():
            gain = w - drawn * mass[c] - stay
            if gain > most:  # the first of equal gains
                most, to = gain, c
        return to

    def run(self, sweeps: int = 20) -> list[int]:
        """Labels numbered by first appearance, after sweeps without a move or ``sweeps`` of them."""
        links, label, mass, degree = self.links, self.label, self.mass, self.degree
        for _ in range(sweeps):
            moved = False
            for node, near in enumerate(links):
                if near and (to := self.best(node, near)) != label[node]:
                    mass[label[node]] -= degree[node]
                    mass[to] += degree[node]
                    label[node] = to
                    moved = True
            if not moved:
                break
        seen: dict[int, int] = {}
        return [seen.setdefault(c, len(seen)) for c in label]


def climbed(links: list[dict[int, float]] | Rows, degree: list[float], label: list[int], resolution: float, max_levels: int) -> list[list[int]]:
    """Maps of nodes to communities, level by level (level L maps the communities of level L - 1), until a level merges nothing."""
    levels, total = [], sum(degree)
    while len(levels) < max_levels:
        label = Moves(links, degree, label, total, resolution).run()
        n_new = max(label) + 1
        if levels and n_new == len(links):
            break
        levels.append(label)
        if n_new == len(links):
            break
        merged: list[dict[int, float]] = [{} for _ in range(n_new)]
        sums = [0.0] * n_new
        for node, near in enumerate(links):
            sums[label[node]] += degree[node]
            to = merged[label[node]]
            for other, w in near.items():
                d = label[other]
                to[d] = to.get(d, 0.0) + w
        links, degree, label = merged, sums, list(range(n_new))
    return levels


def dendrogram(n: int, edges: list[tuple[int, int, float]], resolution: float = 1.0, max_levels: int = 20) -> tuple[list[list[int]], int | None]:
    """Maps of nodes to communities, level by level (level L maps the communities of level L - 1), and the level-0 community of unlinked nodes."""
    links: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b:
            links[a][b] = links[a].get(b, 0.0) + w
            links[b][a] = links[b].get(a, 0.0) + w
    degree = [sum(x.values()) for x in links]
    if not n or not any(degree):
        return ([[0] * n], 0) if n else ([], None)
    alone = [i for i, x in enumerate(links) if not x]
    label = [alone[0] if not x else i for i, x in enumerate(links)]
    levels = climbed(links, degree, label, resolution, max_levels)
    return levels, levels[0][alone[0]] if levels and alone else None


def louvain(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, max_levels: int = 20) -> DataFrame:
    """(graph_id, level, node, community, is_misc): communities of every node at every level.

    nodes: (graph_id, idx), idx from 0 in each graph; edges: (graph_id, source, target, weight, ord). Parallel
    edges add up, loops go, unlinked nodes share one community. The sequential method visits nodes in order of idx
    and neighbours in order of edges, so each graph is one task of its own: graphs are as many as there are
    and each as large as one task's memory holds (interactive ones have 3000 nodes at most).
    """
    n = nodes.groupBy("graph_id").agg(F.count("*").alias("n"))

    def run(key, own_nodes, own_edges):
        import pandas as pd

        n = int(own_nodes["n"].iloc[0]) if len(own_nodes) else 0
        rows = own_edges.sort_values("ord")
        listed = list(zip(rows["source"].tolist(), rows["target"].tolist(), rows["weight"].tolist(), strict=True))
        levels, misc = dendrogram(n, listed, resolution, max_levels)
        at, odd, out = list(range(n)), [False] * n, []
        for level, to in enumerate(levels):
            at = [to[c] for c in at]
            if level == 0 and misc is not None:
                odd = [c == misc for c in at]
            out.append(pd.DataFrame({"graph_id": key[0], "level": level, "node": range(n), "community": at, "is_misc": odd}))
        return pd.concat(out) if out else pd.DataFrame({"graph_id": [], "level": [], "node": [], "community": [], "is_misc": []})

    edges = edges.select(*[F.col(c).alias(c) for c in ("graph_id", "source", "target", "weight", "ord")])
    return n.groupBy("graph_id").cogroup(edges.groupBy("graph_id")).applyInPandas(run, LEVELS)


#: Nodes of a level up to which its tables are broadcast in the rounds: what the driver is sent is then bounded by this number, whatever the graph.
FEW = 1 << 14


def aside(nodes: DataFrame, few: bool = False) -> DataFrame:
    """``nodes``, a row a key, to be joined in partitions unless they are ``few``: below Spark's threshold tables that grow with the graph would pass the driver as broadcasts, in every round again."""
    return nodes.hint("broadcast" if few else "shuffle_hash")


def weighed(links: DataFrame, nodes: DataFrame, resolution: float, few: bool = False) -> DataFrame:
    """(graph_id, q) of the labels in ``nodes`` (graph_id, node, k, inner, label, m2): textbook modularity. inner: weight inside a node, both ways."""
    named = lambda end, x: aside(nodes.select("graph_id", F.col("node").alias(end), F.col("label").alias(x)), few)
    sides = links.where("a < b").join(named("a", "x"), ["graph_id", "a"]).join(named("b", "y"), ["graph_id", "b"])
    within = sides.where("x = y").groupBy("graph_id").agg(F.sum(2 * F.col("w")).alias("w"))
    mass = nodes.groupBy("graph_id", "label").agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"), F.max("m2").alias("m2"))
    mass = mass.groupBy("graph_id").agg(F.sum(F.col("inner") / F.col("m2") - resolution * (F.col("k") / F.col("m2")) ** 2).alias("own"), F.max("m2").alias("m2"))
    return mass.join(within, "graph_id", "left").select("graph_id", (F.col("own") + F.coalesce("w", F.lit(0.0)) / F.col("m2")).alias("q"))


def moved_half(links: DataFrame, nodes: DataFrame, resolution: float, turn: int, few: bool = False) -> DataFrame:
    """``nodes`` (graph_id, node, k, inner, label, m2) after one step in which about half of them, told by a hash, take the label that gains most, if any gains; ties go to the smallest label."""
    mass = nodes.groupBy("graph_id", "label").agg(F.sum("k").alias("mass"))
    held = nodes.join(aside(mass, few), ["graph_id", "label"])
    moving = held.where(F.pmod(F.xxhash64(F.lit(turn // 2), "graph_id", "node"), F.lit(2)) == turn % 2)
    near = held.select("graph_id", F.col("node").alias("b"), F.col("label").alias("to"), "mass")
    toward = links.where(F.pmod(F.xxhash64(F.lit(turn // 2), "graph_id", "a"), F.lit(2)) == turn % 2).join(aside(near, few), ["graph_id", "b"])
    toward = toward.select("graph_id", F.col("a").alias("node"), "to", "mass", "w").unionByName(moving.select("graph_id", "node", F.col("label").alias("to"), "mass", F.lit(0.0).alias("w")))
    # Dealt by node once: sums by label, the node's own row and its best choice are then in one place.
    toward = toward.repartition("graph_id", "node")
    choices = toward.groupBy("graph_id", "node", "to").agg(F.sum("w").alias("w"), F.max("mass").alias("mass"))
    rated = choices.join(aside(moving.drop("mass", "inner"), few), ["graph_id", "node"])
    stays = F.col("to") == F.col("label")
    gain = F.col("w") - resolution * F.col("k") * (F.col("mass") - F.when(stays, F.col("k")).otherwise(0.0)) / F.col("m2")
    # The own label wins unless another is better beyond rounding.
    best = rated.groupBy("graph_id", "node").agg(F.max_by("to", F.struct(F.round(gain, 9), stays, -F.col("to"))).alias("to"))
    return nodes.join(aside(best, few), ["graph_id", "node"], "left").withColumn("label", F.coalesce("to", "label")).drop("to")


#: Nodes and links (both ways) of a graph up to which one task finishes it. What is larger is coarsened in rounds until it fits.
FITS = 3 << 20


def finished(level: DataFrame, links: DataFrame, resolution: float, max_levels: int, first: bool, tasks: int) -> DataFrame:
    """(graph_id, node, tail): each node's communities from here up, by the sequential method, a graph a task; named by their smallest nodes. Without merges none, but for one level if this is the ``first``."""
    kind = level.schema["graph_id"].dataType.simpleString()

    def run(key, own, pairs):
        import numpy as np
        import pyarrow as pa

        order = np.argsort(own["node"].to_numpy())
        node, n = own["node"].to_numpy()[order], len(order)
        a, b = (np.searchsorted(node, pairs[x].to_numpy()) for x in ("a", "b"))
        order_b = np.lexsort((b, a))
        ends, b, w = np.cumsum(np.bincount(a, minlength=n)), b[order_b], pairs["w"].to_numpy()[order_b]
        # Equal numbers are one object.
        ids, told = list(range(n)), {}
        near = Rows(ends.tolist(), [ids[x] for x in memoryview(b)], [told.setdefault(x, x) for x in memoryview(w)])
        del a, b, w, order_b
        # What lies inside a node counts in its degree alone.
        maps = climbed(near, own["k"].to_numpy()[order].tolist(), list(ids), resolution, max_levels)
        if not first and maps and max(maps[0]) + 1 == n:
            maps = []
        at, tails = np.arange(n), []
        for to in maps:
            at = np.array(to)[at]
            tails.append(node[np.unique(at, return_index=True)[1][at]])
        tail = np.column_stack(tails).ravel() if tails else np.array([], dtype="int64")
        tail = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(tails), pa.int32()), pa.array(tail, pa.int64()))
        return pa.table({"graph_id": pa.repeat(key[0], n), "node": node, "tail": tail})

    own = level.select("graph_id", "node", "k").repartition(tasks, "graph_id")
    pairs = links.select("graph_id", "a", "b", "w").repartition(tasks, "graph_id")
    return own.groupBy("graph_id").cogroup(pairs.groupBy("graph_id")).applyInArrow(run, f"graph_id {kind}, node long, tail array<long>")


def moved(level: DataFrame, links: DataFrame, resolution: float, sweeps: int) -> DataFrame:
    """(graph_id, node, k, inner, m2, to): a level's nodes and their communities after local moving in rounds, named by their smallest nodes."""
    few, mark = level.count() <= FEW, written()
    # Links stay where their far ends' labels come to in every step.
    tasks = max(links.sparkSession.sparkContext.defaultParallelism, links.count() >> 19)
    links = links.repartition(tasks, "graph_id", "b").persist()
    # At first no link is inside a community.
    alone = level.groupBy("graph_id").agg(F.sum(F.col("inner") / F.col("m2") - resolution * (F.col("k") / F.col("m2")) ** 2).alias("q"))
    best = stored(level.withColumn("label", F.col("node")).join(F.broadcast(alone), "graph_id").withColumn("idle", F.lit(0)))
    for turn in range(sweeps):
        step = best.where("idle < 2").select("graph_id", "node", "k", "inner", "label", "m2")
        for half in (0, 1):
            step = stored(moved_half(links, step, resolution, 2 * turn + half, few))
        rise = weighed(links, step, resolution, few).withColumnRenamed("q", "now")
        tried = step.select("graph_id", "node", F.col("label").alias("new")).join(F.broadcast(rise), "graph_id")
        gains = F.coalesce(F.col("now") > F.col("q") + 1e-6, F.lit(False))
        best = stored(best.join(aside(tried, few), ["graph_id", "node"], "left").select(
            "graph_id", "node", "k", "inner", "m2", F.when(gains, F.col("new")).otherwise(F.col("label")).alias("label"), F.when(gains, F.col("now")).otherwise(F.col("q")).alias("q"), F.when(gains, 0).otherwise(F.col("idle") + 1).alias("idle")))
        if best.where("idle < 2").isEmpty():
            break
    names = best.groupBy("graph_id", "label").agg(F.min("node").alias("to"))
    out = settled(best.join(aside(names, few), ["graph_id", "label"]).select("graph_id", "node", "k", "inner", "m2", "to"), mark)
    links.unpersist()
    return out


def louvain_paths(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, max_levels: int = 20, sweeps: int = 8, fits: int = FITS) -> DataFrame:
    """(graph_id, node, path, is_misc): each node's communities from the first level to its graph's last one, for graphs of any size.

    A graph of up to ``fits`` nodes and links is finished by the sequential method in one task; larger ones, which no task holds, go through rounds until they fit.
    Local moving by joins: in every step about half of the nodes, another half each time, move at once to the neighbouring community that gains most by the sums
    of the step before; nodes that move together can then not swap places with those that stay. A graph keeps the labels of its best sweep (a step of either half) by modularity, and rests when two sweeps, with different halves,
    gain nothing. Then communities become nodes, links between them add up, and the level above begins, until none gains or ``max_levels`` are done. Modularity so never falls from
    level to level, and each level's communities are unions of those below. A community is named by its smallest node; unlinked nodes share one, named by the smallest of them.
    The order of edges plays no part: results differ from those of ``louvain``, which takes neighbours in that order.
    """
    mark = written()
    pairs = edges.where("source <> target").select("graph_id", F.col("source").cast("long").alias("a"), F.col("target").cast("long").alias("b"), F.col("weight").cast("double").alias("w"))
    links = stored(pairs.unionByName(pairs.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("graph_id", "a", "b").agg(F.sum("w").alias("w")))
    every = nodes.select("graph_id", F.col("idx").cast("long").alias("node"))
    degree = links.groupBy("graph_id", F.col("a").alias("node")).agg(F.sum("w").alias("k"))
    held = stored(every.join(aside(degree), ["graph_id", "node"], "left").withColumn("is_misc", F.col("k").isNull()))
    alone = held.where("is_misc").groupBy("graph_id").agg(F.min("node").alias("misc"))
    m2 = held.groupBy("graph_id").agg(F.sum("k").alias("m2")).where("m2 > 0")
    # Each node's communities so far and the last of them, the level's nodes, and what single tasks have found above.
    path = F.array().cast("array<long>")
    below, tails = held.join(F.broadcast(alone), "graph_id", "left").select("graph_id", "node", F.when(F.col("is_misc"), F.coalesce("misc", "node")).otherwise(F.col("node")).alias("at"), "is_misc", path.alias("path")), []
    level = stored(held.where("NOT is_misc").join(F.broadcast(m2), "graph_id").select("graph_id", "node", "k", F.lit(0.0).alias("inner"), "m2"))
    depth = 0
    while depth < max_levels:
        sizes = stored(level.select("graph_id").unionByName(links.select("graph_id")).groupBy("graph_id").agg(F.count("*").alias("n")).withColumn("fits", F.col("n") <= fits))
        many = {r.fits: r for r in sizes.groupBy("fits").agg(F.count("*").alias("graphs"), F.sum("n").alias("n")).collect()}
        of = lambda df, fit: df.join(F.broadcast(sizes.where(F.col("fits") == fit).select("graph_id")), "graph_id")
        if small := many.get(True):
            tasks = max(min(8 * small.graphs, 256), small.n >> 20)
            tails.append(stored(finished(of(level, True), of(links, True), resolution, max_levels - depth, depth == 0, tasks)))
        if False not in many:
            break
        renamed = moved(of(level, False), of(links, False), resolution, sweeps)
        merging = renamed.where("node <> to").select("graph_id").distinct()
        # A graph that merges nothing is done, with a level of single nodes if it has none yet.
        going = stored(renamed.join(F.broadcast(merging), "graph_id"))
        to = (going if depth else renamed).select("graph_id", F.col("node").alias("at"), "to")
        below = stored(below.join(aside(to), ["graph_id", "at"], "left").select("graph_id", "node", F.coalesce("to", "at").alias("at"), "is_misc", F.when(F.col("to").isNull(), F.col("path")).otherwise(F.concat("path", F.array("to"))).alias("path")))
        depth += 1
        named = lambda end, x: aside(going.select("graph_id", F.col("node").alias(end), F.col("to").alias(x)))
        ends = links.join(named("a", "x"), ["graph_id", "a"]).join(named("b", "y"), ["graph_id", "b"])
        ends = stored(ends.groupBy("graph_id", F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("w").alias("w")))
        inner = ends.where("a = b").select("graph_id", F.col("a").alias("node"), F.col("w").alias("more"))
        level = going.groupBy("graph_id", F.col("to").alias("node")).agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"), F.max("m2").alias("m2"))
        level = stored(level.join(aside(inner), ["graph_id", "node"], "left").select("graph_id", "node", "k", "m2", (F.col("inner") + F.coalesce("more", F.lit(0.0))).alias("inner")))
        links = ends.where("a <> b")
    if tails:
        above = functools.reduce(DataFrame.unionByName, tails).withColumnRenamed("node", "at")
        below = below.join(aside(above), ["graph_id", "at"], "left").withColumn("path", F.concat("path", F.coalesce("tail", path))).drop("tail")
    below = stored(below.withColumn("path", F.when(F.size("path") == 0, F.array("at")).otherwise(F.col("path"))))
    # Unlinked nodes have no part in the levels: theirs is the same one at each of their graph's.
    deepest = below.groupBy("graph_id").agg(F.max(F.size("path")).alias("depth"))
    whole = F.concat("path", F.array_repeat(F.element_at("path", -1), F.coalesce("depth", F.size("path")) - F.size("path")))
    return settled(below.join(F.broadcast(deepest), "graph_id", "left").select("graph_id", "node", whole.alias("path"), "is_misc"), mark)


def louvain_parallel(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, max_levels: int = 20, sweeps: int = 8, fits: int = FITS) -> DataFrame:
    """(graph_id, level, node, community, is_misc) of ``louvain_paths``, as ``louvain`` has them."""
    paths = louvain_paths(nodes, edges, resolution, max_levels, sweeps, fits)
    return paths.select("graph_id", "node", "is_misc", F.posexplode("path").alias("level", "community")).select("graph_id", "level", "node", "community", "is_misc")


def nested_paths(paths: DataFrame) -> DataFrame:
    """``nested`` of (graph_id, node, path)."""
    steps = F.posexplode(F.arrays_zip(F.expr("slice(path, 1, size(path) - 1)").alias("community"), F.expr("slice(path, 2, size(path) - 1)").alias("above")))
    split = paths.select("graph_id", steps.alias("level", "step")).groupBy("graph_id", "level", "step.community").agg((F.min("step.above") == F.max("step.above")).alias("whole"))
    broken = split.groupBy("graph_id").agg(F.bool_and("whole").alias("whole"))
    return paths.select("graph_id").distinct().join(broken, "graph_id", "left").select("graph_id", F.coalesce("whole", F.lit(True)).alias("nested"))


def modularities(paths: DataFrame, edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(graph_id, level, modularity), textbook, of every level of (graph_id, node, path): edges meet their ends' paths once for all levels."""
    depth = paths.agg(F.max(F.size("path"))).first()[0] or 0
    held = paths.join(aside(degrees(edges)), ["graph_id", "node"])
    total = held.groupBy("graph_id").agg(F.sum("degree").alias("m2"))
    mass = held.select("graph_id", "degree", F.posexplode("path").alias("level", "community")).groupBy("graph_id", "level", "community").agg(F.sum("degree").alias("d"))
    null = mass.join(F.broadcast(total), "graph_id").groupBy("graph_id", "level").agg(F.sum((F.col("d") / F.col("m2")) ** 2).alias("null_q"), F.max("m2").alias("m2"))
    side = lambda end, x: aside(paths.select("graph_id", F.col("node").alias(end), F.col("path").alias(x)))
    sides = edges.where("source <> target").select("graph_id", "source", "target", "weight").join(side("source", "x"), ["graph_id", "source"]).join(side("target", "y"), ["graph_id", "target"])
    same = [F.sum(F.when(F.get("x", F.lit(i)) == F.get("y", F.lit(i)), F.col("weight"))).alias(f"w{i}") for i in range(depth)]
    within = sides.groupBy("graph_id").agg(F.lit(0).alias("none"), *same).select("graph_id", F.posexplode(F.array(*[f"w{i}" for i in range(depth)]).cast("array<double>")).alias("level", "w"))
    return null.join(within, ["graph_id", "level"], "left").select("graph_id", "level", (2 * F.coalesce("w", F.lit(0.0)) / F.col("m2") - resolution * F.col("null_q")).alias("modularity"))


def nested(levels: DataFrame) -> DataFrame:
    """(graph_id, nested): whether nodes that share a community share the one above too, at every level."""
    above = levels.select("graph_id", "node", (F.col("level") - 1).alias("level"), F.col("community").alias("above"))
    split = levels.join(aside(above), ["graph_id", "node", "level"]).groupBy("graph_id", "level", "community").agg(F.countDistinct("above").alias("parts"))
    broken = split.groupBy("graph_id").agg(F.max("parts").alias("parts"))
    return levels.select("graph_id").distinct().join(broken, "graph_id", "left").select("graph_id", (F.coalesce("parts", F.lit(1)) == 1).alias("nested"))


def at_level(levels: DataFrame, level: int) -> DataFrame:
    """(graph_id, node, community) at a level, or at the last one of a graph that has fewer."""
    last = levels.withColumn("top", F.max("level").over(W.partitionBy("graph_id", "node")))
    return last.where(F.col("level") == F.least(F.col("top"), F.lit(level))).select("graph_id", "node", "community", "is_misc")


def degrees(edges: DataFrame) -> DataFrame:
    """(graph_id, node, degree): summed weights, loops left out."""
    ends = edges.where("source <> target").select("graph_id", F.explode(F.array("source", "target")).alias("node"), "weight")
    return ends.groupBy("graph_id", "node").agg(F.sum("weight").alias("degree"))


def modularity(edges: DataFrame, assigned: DataFrame, resolution: float = 1.0, textbook: bool = False) -> DataFrame:
    """(graph_id, modularity) of an assignment (graph_id, node, community).

    The null model is summed over adjacent pairs of a community only, which is what the reference values are;
    ``textbook`` sums it over all pairs: per community (degree / 2m)^2.
    """
    k = degrees(edges)
    total = k.groupBy("graph_id").agg(F.sum("degree").alias("m2"))
    # Ends of two communities count for nothing: such edges go before parallel ones add up.
    held = assigned.join(aside(k), ["graph_id", "node"])
    side = lambda end, x: held.select("graph_id", F.col("node").alias(end), F.col("community").alias(f"c{x}"), F.col("degree").alias(f"k{x}"))
    inside = edges.where("source <> target").select("graph_id", "source", "target", "weight").join(aside(side("source", "a")), ["graph_id", "source"]).join(aside(side("target", "b")), ["graph_id", "target"]).where("ca = cb")
    inside = inside.groupBy("graph_id", F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    inside = inside.agg(F.sum("weight").alias("w"), F.max(F.col("ka") * F.col("kb")).alias("kk")).join(total, "graph_id")
    if not textbook:
        term = 2 * (F.col("w") - resolution * F.col("kk") / F.col("m2")) / F.col("m2")
        q = inside.groupBy("graph_id").agg(F.sum(term).alias("q"))
        return total.join(q, "graph_id", "left").select("graph_id", F.coalesce("q", F.lit(0.0)).alias("modularity"))
    within = inside.groupBy("graph_id").agg(F.sum(2 * F.col("w") / F.col("m2")).alias("within"))
    mass = held.groupBy("graph_id", "community").agg(F.sum("degree").alias("d"))
    null = mass.join(total, "graph_id").groupBy("graph_id").agg(F.sum((F.col("d") / F.col("m2")) ** 2).alias("null_q"))
    return null.join(within, "graph_id", "left").select("graph_id", (F.coalesce("within", F.lit(0.0)) - resolution * F.col("null_q")).alias("modularity"))


def lanes(sizes: DataFrame, weights: DataFrame, sweeps: int = 12) -> DataFrame:
    """(graph_id, community, lane): clusters in an order that keeps linked ones near each other.

    sizes: (graph_id, community, size, is_misc); weights: (graph_id, a, b, n). Each connected part is ordered around
    its hub, then by weighted means of neighbours' places; parts are ordered around the heaviest; unlinked clusters
    follow by size, the miscellaneous one last. Clusters of one graph are few, so a graph is one task.
    """

    def around(items: list) -> list:
        """The first in the middle, the others in turn below and above."""
        return items[1::2][::-1] + items[0::2]

    def run(key, own, pairs):
        import pandas as pd

        size = dict(zip(own["community"].tolist(), own["size"].tolist(), strict=True))
        misc = set(own["community"][own["is_misc"]].tolist())
        near: dict[int, dict[int, float]] = {c: {} for c in size}
        for a, b, w in zip(pairs["a"], pairs["b"], pairs["n"], strict=True):
            if w > 0 and a in near and b in near:
                near[a][b] = near[a].get(b, 0) + w
                near[b][a] = near[b].get(a, 0) + w
        weight = {c: sum(x.values()) for c, x in near.items()}
        left, parts = sorted(c for c in size if weight[c]), []
        while left:
            part, todo = set(), [left[0]]
            while todo:
                if (c := todo.pop()) not in part:
                    part.add(c)
                    todo.extend(near[c])
            parts.append(sorted(part))
            left = [c for c in left if c not in part]
        order = []
        for part in around(sorted(parts, key=lambda p: (-sum(weight[c] for c in p), -len(p), p))):
            row = around(sorted(part, key=lambda c: (-weight[c], -size[c], c)))
            for _ in range(sweeps if len(row) > 1 else 0):
                at = {c: i for i, c in enumerate(row)}
                mean = {c: sum(w * at[d] for d, w in near[c].items()) / weight[c] for c in row}
                row = sorted(row, key=lambda c: (mean[c], at[c]))
            order += row
        order += sorted((c for c in size if not weight[c]), key=lambda c: (c in misc, -size[c], c))
        return pd.DataFrame({"graph_id": key[0], "community": order, "lane": range(len(order))})

    weights = weights.select(*[F.col(c).alias(c) for c in ("graph_id", "a", "b", "n")])
    return sizes.groupBy("graph_id").cogroup(weights.groupBy("graph_id")).applyInPandas(run, "graph_id string, community long, lane int")
