"""A streaming source over a folder of notes whose offset is the snapshot of file times.

A batch is the difference of two snapshots, so a replay of the same offsets gives the same events.
The listing is made by the driver, as any file source does; contents are read by the tasks.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from inkgraph.functions.parse import notes

SCHEMA = "event string, path string, mtime bigint, content string"


def snapshot(root: str) -> dict[str, int]:
    """Relative path to modification time (ns) of all ``*.md`` files; top-level dot names are skipped."""
    out: dict[str, int] = {}
    for folder, _, names in os.walk(root):
        for name in names:
            path = os.path.relpath(os.path.join(folder, name), root)
            if name.endswith(".md") and not path.startswith("."):
                try:
                    out[path] = os.stat(os.path.join(root, path)).st_mtime_ns
                except FileNotFoundError:
                    continue  # gone between the listing and the look at it
    return out


def changes(known: dict[str, int], current: dict[str, int]) -> list[tuple[str, str]]:
    """(event, path): deleted, created, and updated where the time is later; an older time is ignored."""
    gone = [("deleted", p) for p in sorted(known.keys() - current.keys())]
    new = [("updated" if p in known else "created", p) for p in sorted(current) if p not in known or current[p] > known[p]]
    return gone + new


class _Change(InputPartition):
    def __init__(self, event: str, path: str, mtime: int | None):
        self.event, self.path, self.mtime = event, path, mtime


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, replay: bool):
        self.root, self.replay = root, replay

    def initialOffset(self) -> dict:
        return {"files": json.dumps({} if self.replay else snapshot(self.root), sort_keys=True)}

    def latestOffset(self) -> dict:
        return {"files": json.dumps(snapshot(self.root), sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[_Change]:
        current = json.loads(end["files"])
        return [_Change(e, p, current.get(p)) for e, p in changes(json.loads(start["files"]), current)]

    def read(self, partition: _Change) -> Iterator[tuple]:
        text = None
        if partition.event != "deleted":
            try:
                with open(os.path.join(self.root, partition.path), encoding="utf-8", errors="replace") as f:
                    text = f.read()
            except FileNotFoundError:
                text = None  # deleted since; the next batch says so
        yield partition.event, partition.path, partition.mtime, text


class NotesChanges(DataSource):
    """Format ``inkgraph_notes``; options ``path`` and ``replay`` (existing files count as created)."""

    @classmethod
    def name(cls) -> str:
        return "inkgraph_notes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"], self.options.get("replay", "false").lower() == "true")


def watch(spark: SparkSession, root: str, replay: bool = False) -> DataFrame:
    """A streaming frame (event, path, node): the node of created and updated notes, else null."""
    spark.dataSource.register(NotesChanges)
    rows = spark.readStream.format("inkgraph_notes").option("path", root).option("replay", str(replay).lower()).load()
    return events(rows)


def events(rows: DataFrame) -> DataFrame:
    """(event, path, node) of rows (event, path, content)."""
    # Paths repeat over batches, so a note is parsed beside its event rather than joined to it.
    parsed = notes(rows.select(F.to_json(F.struct("event", "path")).alias("path"), "content"))
    at = F.from_json("path", "event string, path string")
    title = F.regexp_extract(at["path"], r"[^/]+$", 0)
    h = F.md5(at["path"])
    id_ = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    node = F.struct(title.alias("title"), id_.alias("id"), "tags", "links")
    return parsed.select(at["event"].alias("event"), at["path"].alias("path"), F.when(at["event"] != "deleted", node).alias("node"))


def event_lines(stream: DataFrame) -> DataFrame:
    """(value): events as JSON lines, the node left out where there is none."""
    return stream.select(F.to_json(F.struct("event", "path", "node")).alias("value"))
