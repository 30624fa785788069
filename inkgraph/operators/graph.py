"""Degrees, ranks, components, paths and communities of the link graph."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.operators.resolve import find_by_title, links_of
from inkgraph.plans.components import connected_components
from inkgraph.plans.prefix import numbered
from inkgraph.plans.tables import Scratch

DAMPING, ITERATIONS = 0.85, 10


def degrees(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, out_degree, in_degree, degree); unresolved and repeated links count as out-links."""
    into = edges.where("dst is not null").groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("in_degree"))
    got = notes.select("path", F.size("links").cast("long").alias("out_degree")).join(into, "path", "left")
    got = got.withColumn("in_degree", F.coalesce("in_degree", F.lit(0).cast("long")))
    return got.withColumn("degree", F.col("out_degree") + F.col("in_degree"))


def graph_stats(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_notes, n_links, n_resolved, n_unresolved_targets."""
    counts = edges.agg(
        F.count("*").alias("n_links"),
        F.count("dst").alias("n_resolved"),
        F.count_distinct(F.when(F.col("dst").isNull(), F.col("target"))).alias("n_unresolved_targets"),
    )
    return notes.agg(F.count("*").alias("n_notes")).crossJoin(counts)


def ui_degree(notes: DataFrame) -> DataFrame:
    """(id, degree, size): ends of links whose text is a note's title; size is for drawing."""
    links = links_of(notes)
    ends = links.select(F.col("src_title").alias("id")).unionAll(links.select(F.col("target").alias("id")))
    counted = ends.groupBy("id").agg(F.count("*").alias("degree"))
    got = notes.select(F.col("title").alias("id")).distinct().join(counted, "id", "left")
    got = got.withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return got.withColumn("size", F.col("degree") + 1)


def pagerank(notes: DataFrame, edges: DataFrame, iterations: int = ITERATIONS) -> DataFrame:
    """(path, rank): synchronous updates from 1/N; unresolved links let mass out, none is put back.

    The graph is written once, with each edge's share of its source; equal edges are one row with
    their number, so hubs and repeats cost one row per neighbour. Lineage is cut every few steps.
    """
    scratch = Scratch(notes.sparkSession, "pagerank")
    nodes = scratch.keep(notes.select("path", F.size("links").alias("out")), "nodes")
    n = nodes.count()
    if n == 0:
        return nodes.select("path", F.lit(0.0).alias("rank"))
    into = edges.where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("k"))
    shares = scratch.keep(into.join(nodes, F.col("src") == F.col("path")).select("src", "dst", (F.col("k") / F.col("out")).alias("share")), "shares")
    # Only notes with out-links give rank on.
    rank = nodes.select("path", F.lit(1.0 / n).alias("rank"))
    at = None
    for step in range(iterations):
        given = shares.join(rank, F.col("src") == F.col("path")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = nodes.select("path").join(given, F.col("path") == F.col("dst"), "left").select(
            "path", (F.lit((1 - DAMPING) / n) + DAMPING * F.coalesce("got", F.lit(0.0))).alias("rank")
        )
        if step % 5 == 4:
            rank, now = scratch.keep_at(rank, "rank")
            if at:
                scratch.drop(at)
            at = now
    return rank


def components(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, component): weakly connected, labelled by the smallest path."""
    scratch = Scratch(notes.sparkSession, "components")
    linked = connected_components(edges.where("dst is not null"), scratch, "src", "dst")
    return notes.select("path").join(linked, F.col("path") == F.col("id"), "left").select("path", F.coalesce("component", "path").alias("component"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def orphans(labels: DataFrame) -> DataFrame:
    """(path): notes alone in their component; a link to itself doesn't make company."""
    return labels.join(component_sizes(labels).where("size = 1"), "component").select("path")


def islands(labels: DataFrame, threshold: int = 3) -> DataFrame:
    """(component, path): components of two to ``threshold`` notes."""
    return labels.join(component_sizes(labels).where(F.col("size").between(2, threshold)), "component").select("component", "path")


def gc_summary(labels: DataFrame, threshold: int = 3) -> DataFrame:
    sizes = component_sizes(labels)
    count = lambda c: F.count(F.when(c, 1))
    return sizes.agg(count(F.col("size") == 1).alias("n_orphans"), count(F.col("size").between(2, threshold)).alias("n_islands"))


def bfs(edges: DataFrame, start: DataFrame, goal: str | None = None) -> DataFrame:
    """(path, distance, parent) of notes reachable from ``start`` (path) along links.

    The parent is the smallest predecessor of the level before. With ``goal`` (a path), levels end
    when it is reached. Each level is one join of the frontier with the graph.
    """
    scratch = Scratch(edges.sparkSession, "bfs")
    graph = scratch.keep(edges.where("dst is not null").select("src", "dst").distinct(), "graph")
    level = scratch.keep(start.select("path", F.lit(0).cast("long").alias("distance"), F.lit(None).cast("string").alias("parent")), "level")
    seen = level
    distance = 0
    while not level.isEmpty() and (goal is None or level.where(F.col("path") == goal).isEmpty()):
        distance += 1
        step = graph.join(level.select(F.col("path").alias("src")), "src").groupBy(F.col("dst").alias("path")).agg(F.min("src").alias("parent"))
        step = step.join(seen.select("path"), "path", "left_anti").select("path", F.lit(distance).cast("long").alias("distance"), "parent")
        level = scratch.keep(step, "level")
        seen = seen.unionAll(level)
    return seen


def shortest_path(notes: DataFrame, edges: DataFrame, start: str, end: str) -> DataFrame:
    """(step, title) along the shortest directed path between two notes named by title; else no row."""
    spark = notes.sparkSession
    a, b = (find_by_title(notes, x).select("path").head() for x in (start, end))
    none = spark.createDataFrame([], "step long, title string")
    if a is None or b is None:
        return none
    reached = bfs(edges, spark.createDataFrame([(a["path"],)], "path string"), b["path"])
    # One row of the tree a step: as many look-ups as the path is long.
    path, at = [], b["path"]
    while at is not None:
        row = reached.where(F.col("path") == at).select("parent").head()
        if row is None:
            return none
        path.append(at)
        at = row["parent"]
    steps = spark.createDataFrame(list(enumerate(reversed(path))), "step long, path string")
    return steps.join(notes.select("path", "title"), "path").select("step", "title")


def communities(notes: DataFrame, edges: DataFrame, passes: int = 10) -> DataFrame:
    """(path, community): one level of local moving by modularity gain, notes in the order of paths.

    A note only ever joins a neighbour's community, so components don't touch each other and are
    worked on one by one; the number of all links, which the gain needs, is passed in. Sequential
    moves within a component are inherent to the method: a component is one task.
    """
    total = notes.agg(F.sum(F.size("links"))).head()[0] or 0
    labels = components(notes, edges)
    if total == 0:
        got = labels.select("path", F.col("path").alias("_c"))
    else:
        out = notes.select("path", F.size("links").alias("out"))
        ends = edges.where("dst is not null").groupBy("src").agg(F.collect_list("dst").alias("to"))
        rows = labels.join(out, "path").join(ends, F.col("path") == F.col("src"), "left").select("component", "path", "out", "to")

        def move(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("path", ignore_index=True)
            number = {p: i for i, p in enumerate(part["path"])}
            near: list[dict[int, int]] = [{} for _ in number]
            degree = part["out"].astype(int).tolist()
            for i, to in enumerate(part["to"]):
                for p in to if to is not None else ():
                    j = number[p]
                    degree[j] += 1
                    for x, y in ((i, j), (j, i)):
                        near[x][y] = near[x].get(y, 0) + 1
            own, weight = list(range(len(number))), list(map(float, degree))
            for _ in range(passes):
                moved = False
                for i in range(len(own)):
                    links: dict[int, int] = {}
                    for j, k in near[i].items():
                        links[own[j]] = links.get(own[j], 0) + k
                    best, most = own[i], 0.0
                    for c in sorted(links):
                        if c != own[i]:
                            gain = links[c] / total - weight[c] * degree[i] / (2.0 * total * total)
                            if gain > most:
                                best, most = c, gain
                    if best != own[i]:
                        weight[own[i]] -= degree[i]
                        weight[best] += degree[i]
                        own[i], moved = best, True
                if not moved:
                    break
            first: dict[int, str] = {}
            for i, c in enumerate(own):
                first.setdefault(c, part["path"][i])
            return pd.DataFrame({"path": part["path"], "_c": [first[c] for c in own]})

        got = rows.groupBy("component").applyInPandas(move, "path string, _c string")
    # Numbered in the order of their smallest paths.
    scratch = Scratch(notes.sparkSession, "communities")
    got = scratch.keep(got, "moved")
    names = numbered(got.select("_c").distinct(), "_c", "community", scratch)
    return got.join(names, "_c").select("path", "community")
