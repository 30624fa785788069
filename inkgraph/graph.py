"""One object for a collection of notes: links are resolved once, every operator is a method."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from inkgraph.functions import parse
from inkgraph.operators import graph, render, resolve, similarity
from inkgraph.plans.prefix import numbered
from inkgraph.plans.tables import Scratch
from inkgraph.sources import notes as source


class KnowledgeGraph:
    """``raw`` has a row (path, content) for each note; paths are distinct. ``notes`` may be given parsed."""

    def __init__(self, raw: DataFrame | None, notes: DataFrame | None = None):
        #: A plan, not a table: a query on a few columns reads and parses no others.
        self.notes = parse.notes(raw) if notes is None else notes
        self._scratch = Scratch(self.notes.sparkSession, "graph")

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> KnowledgeGraph:
        files, _ = source.split_oversize(source.read_files(spark, root))
        return cls(files.select("path", "content"))

    @classmethod
    def rescanned(cls, spark: SparkSession, root: str, cache: str) -> KnowledgeGraph:
        """The notes of a folder by its JSON cache: only files whose time has changed are read. The
        cache is written again if anything has changed."""
        return cls(None, source.refreshed(spark, root, cache, parse.notes))

    @cached_property
    def nodes(self) -> DataFrame:
        """What the graph operators read of the notes, without their texts: parsed once and written."""
        return self._scratch.keep(self.notes.drop("content", "hash", "mtime"), "nodes")

    @cached_property
    def edges(self) -> DataFrame:
        return self._scratch.keep(resolve.edges_of(self.nodes), "edges")

    def drop(self) -> None:
        """Remove the tables written for this graph; frames made from them can't be read any more."""
        self._scratch.drop(self._scratch.base)

    @cached_property
    def components(self) -> DataFrame:
        return self._scratch.keep(graph.components(self.nodes, self.edges), "components")

    @cached_property
    def groups(self) -> DataFrame:
        """(component, group): components numbered from 1 in the order of their smallest paths."""
        names = numbered(self.components.select("component").distinct(), "component", "n", self._scratch)
        return names.selectExpr("component", "n + 1 AS `group`")

    @cached_property
    def communities(self) -> DataFrame:
        return self._scratch.keep(graph.communities(self.nodes, self.edges), "communities")

    def pagerank(self, iterations: int = graph.ITERATIONS) -> DataFrame:
        return graph.pagerank(self.nodes, self.edges, iterations)

    def shortest_path(self, start: str, end: str) -> DataFrame:
        return graph.shortest_path(self.nodes, self.edges, start, end)

    def orphans(self) -> DataFrame:
        return graph.orphans(self.components)

    def islands(self, threshold: int = 3) -> DataFrame:
        return graph.islands(self.components, threshold)

    def similar(self, title: str, k: int = 5) -> DataFrame:
        return similarity.similar_notes(self.notes, title, k)

    def suggest(self, threshold: float = 0.1, k: int = 10) -> DataFrame:
        return similarity.suggest_links(self.notes, threshold, k)

    def context(self, path: str) -> str:
        row = render.contexts(self.nodes.where(self.nodes["path"] == path), self.edges).head()
        if row is None:
            raise LookupError(f"no note at {path!r}")
        return row["context"]

    def contexts(self) -> DataFrame:
        return render.contexts(self.nodes, self.edges)

    def bundle(self, tag: str | None = None, status: str | None = None) -> DataFrame:
        return render.bundle(self.nodes, self.edges, self.pagerank(), tag, status)

    def csv_map(self) -> DataFrame:
        return render.csv_map(self.nodes, self.edges)

    def json_nodes(self) -> DataFrame:
        return render.json_nodes(self.nodes, self.components, self.pagerank(), self.groups)

    def json_links(self) -> DataFrame:
        return render.json_links(self.nodes)

    def map_of_content(self) -> DataFrame:
        return render.map_of_content(self.nodes, self.communities)
