"""Command line: init, scan, export, path, clusters, gc, similar, suggest, visualize, moc, watch."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgraph.graph import KnowledgeGraph
from inkgraph.operators import render
from inkgraph.session import session
from inkgraph.sources.notes import CACHE, MARKER, init_workspace, workspace_root


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="inkgraph", description=__doc__)
    p.add_argument("command", choices=["init", "scan", "export", "path", "clusters", "gc", "similar", "suggest", "visualize", "moc", "watch"])
    p.add_argument("args", nargs="*")
    p.add_argument("--tag")
    p.add_argument("--status")
    p.add_argument("--threshold", type=float)
    p.add_argument("--date", default="", help="date in the head of an export")
    p.add_argument("--out", help="folder for exports; by default the workspace's parent, so that a scan doesn't read them")
    return p


def _write(at: Path, head: str, rows: DataFrame, column: str, between: str = "", tail: str = "") -> None:
    """One file, row by row in the order of paths; the driver holds one partition at a time."""
    with at.open("w", encoding="utf-8") as out:
        out.write(head)
        for i, r in enumerate(rows.toLocalIterator()):
            out.write((between if i else "") + r[column])
        out.write(tail)
    print(f"written to {at}")


def main(argv: list[str] | None = None) -> int:
    o = _parser().parse_args(argv)
    if o.command == "init":
        print(init_workspace(o.args[0] if o.args else "."))
        return 0
    root = workspace_root(".")
    if root is None:
        print("not in a workspace; run init first", file=sys.stderr)
        return 1
    out = Path(o.out) if o.out else root.parent
    spark = session()
    if o.command == "watch":
        from inkgraph.streaming.watch import event_lines, watch

        lines = event_lines(watch(spark, str(Path(o.args[0]).resolve() if o.args else root)))
        lines.writeStream.format("console").option("truncate", "false").trigger(processingTime="1 second").start().awaitTermination()
        return 0
    if len(o.args) < {"path": 2, "similar": 1}.get(o.command, 0):
        print("path needs two titles, similar one", file=sys.stderr)
        return 2
    g = KnowledgeGraph.rescanned(spark, str(root), str(root / MARKER / CACHE))
    if o.command == "scan":
        found = render.filtered(g.nodes, o.tag, o.status)
        if o.tag is not None or o.status is not None:
            for r in render.contexts(found, g.edges).orderBy("path").toLocalIterator():
                print(r["context"])
        print(f"{found.count()} notes")
    elif o.command == "export":
        _write(out / "llm_knowledge.md", render.bundle_header(o.date, o.tag, o.status), g.bundle(o.tag, o.status).orderBy("path"), "section")
    elif o.command == "path":
        steps = [r["title"] for r in g.shortest_path(*o.args[:2]).orderBy("step").toLocalIterator()]
        print(" -> ".join(steps) or "no path")
    elif o.command == "clusters":
        lines = render.csv_lines(g.csv_map()).orderBy("path").withColumn("line", F.concat("line", F.lit("\n")))
        _write(out / "map.csv", ",".join(render.MAP_COLUMNS) + "\n", lines, "line")
    elif o.command == "gc":
        most = int(o.threshold) if o.threshold is not None else 3
        for r in g.orphans().orderBy("path").toLocalIterator():
            print("orphan", r["path"])
        for r in g.islands(most).orderBy("component", "path").toLocalIterator():
            print("island", r["component"], r["path"])
    elif o.command == "similar":
        for r in g.similar(o.args[0]).collect():  # at most five rows
            print(f"- {r['title']} ({r['score']:.4f})")
    elif o.command == "suggest":
        for r in g.suggest(o.threshold if o.threshold is not None else 0.1).collect():  # at most ten rows
            print(f"- [[{r['source']}]] <-> [[{r['target']}]] ({r['score']:.4f})")
    elif o.command == "moc":
        _write(out / "MOC.md", render.MOC_HEADER, g.map_of_content().orderBy("community"), "section")
    elif o.command == "visualize":
        both = render.graph_json(g.json_nodes(), g.json_links())
        _write(out / "graph.json", '{"nodes":[', both.where("kind = 'node'"), "json", ",", '],"links":[')
        with (out / "graph.json").open("a", encoding="utf-8") as f:
            for i, r in enumerate(both.where("kind = 'link'").toLocalIterator()):
                f.write(("," if i else "") + r["json"])
            f.write("]}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
