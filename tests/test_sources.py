"""Files, manifests, the JSON cache, the change feed, the command line."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from inkgraph import cli
from inkgraph.functions import parse
from inkgraph.sources import notes as source
from inkgraph.streaming.watch import changes, event_lines, snapshot, watch


def write(root, files):
    for p, t in files.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)


def test_scan(spark, tmp_path):
    root = tmp_path / "a+b c"
    write(root, {"x.md": "one", "d/y z.md": "two\nlines", ".hid/n.md": "no", "t.txt": "no", "empty.md": "", "big.md": "x" * (source.MAX_BYTES + 1)})
    files, rejected = source.split_oversize(source.read_files(spark, str(root)))
    assert {(r["path"], r["content"]) for r in files.collect()} == {("x.md", "one"), ("d/y z.md", "two\nlines"), ("empty.md", "")}
    assert [r["path"] for r in rejected.collect()] == ["big.md"]


def test_names_that_file_sources_hide(spark, tmp_path):
    """Only dot names at the top are no notes; a folder's name may repeat below it."""
    root = tmp_path / "kb"
    write(root, {"_u.md": "under", "_d/x.md": "in", "d/.h/y.md": "dot below", ".top.md": "no", ".t/z.md": "no", f"old{root}/x.md": "twice", "x.md": "one", "_e.md": "", "a[1]{b}*.md": "odd"})
    want = {"_u.md": "under", "_d/x.md": "in", "d/.h/y.md": "dot below", f"old{root}/x.md": "twice", "x.md": "one", "_e.md": "", "a[1]{b}*.md": "odd"}
    got = source.read_files(spark, str(root))
    assert {r["path"]: r["content"] for r in got.collect()} == want and got.count() == len(want)
    assert {r["path"]: r["length"] for r in source.list_files(spark, f"file://{root}").collect()} == {p: len(t) for p, t in want.items()}
    assert set(snapshot(str(root))) == set(want)
    assert {r["path"]: r["content"] for r in source._files(spark, str(root), ["_u.md", "a[1]{b}*.md", "_e.md"]).collect()} == {p: want[p] for p in ("_u.md", "a[1]{b}*.md", "_e.md")}


def test_unchanged_files_are_not_opened(spark, tmp_path):
    """A file whose time is as before isn't read: another content under the old time goes unseen."""
    root, cache = tmp_path / "ws", f"file://{tmp_path}/cache.json"
    write(root, {"a.md": "#a", "b.md": "#b", "_c.md": "#c"})
    tags = lambda: {r["path"]: tuple(r["tags"]) for r in source.refreshed(spark, str(root), cache, parse.notes).collect()}
    assert tags() == {"a.md": ("a",), "b.md": ("b",), "_c.md": ("c",)}
    written = (tmp_path / "cache.json").stat().st_mtime_ns
    times = {n: (root / n).stat() for n in ("a.md", "_c.md")}
    write(root, {"a.md": "#z", "_c.md": "#z"})
    for n, t in times.items():
        os.utime(root / n, ns=(t.st_atime_ns, t.st_mtime_ns))
    opened = []
    real = source._files
    with pytest.MonkeyPatch.context() as m:
        m.setattr(source, "_files", lambda spark, root, only=None: opened.append(only) or real(spark, root, only))
        assert tags() == {"a.md": ("a",), "b.md": ("b",), "_c.md": ("c",)}
        assert [x for x in opened if x is not None] == [] and (tmp_path / "cache.json").stat().st_mtime_ns == written
        os.utime(root / "a.md")  # another time: read, and parsed as the hash differs
        os.utime(root / "b.md")  # touched only
        assert tags() == {"a.md": ("z",), "b.md": ("b",), "_c.md": ("c",)} and sorted(opened[-1]) == ["a.md", "b.md"]
        (root / "b.md").unlink()
        assert set(tags()) == {"a.md", "_c.md"}
        assert source.load_cache(spark, cache).count() == 2


def test_rescan_reuses(spark, tmp_path):
    write(tmp_path, {"a.md": "#a", "b.md": "#b", "c.md": "#c"})
    none = source.manifest(spark.createDataFrame([], "path string, mtime timestamp"), parse.notes(spark.createDataFrame([], "path string, content string")))
    first = source.rescan(spark, str(tmp_path), none, parse.notes)
    kept = spark.createDataFrame(first.collect(), first.schema)
    time.sleep(0.05)
    write(tmp_path, {"b.md": "#b2"})
    (tmp_path / "c.md").unlink()
    assert {(r["path"], tuple(r["tags"])) for r in source.rescan(spark, str(tmp_path), kept, parse.notes).collect()} == {("a.md", ("a",)), ("b.md", ("b2",))}


def test_hash_known_answer(spark):
    assert spark.range(1).select(F.sha2(F.lit("hello world"), 256)).head()[0] == "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"


def test_cache_file(spark, tmp_path):
    rows = spark.createDataFrame([('q"uo\\te\n.md', 'tab\t "x" [[a]] [[k::b]] #t'), ("p.md", "---\nk: v\n---")], "path string, content string")
    kept = parse.notes(rows).withColumn("mtime", F.timestamp_micros(F.lit(1_700_000_000_123_456)))
    at = tmp_path / "cache.json"
    source.save_cache(kept, str(at))
    plain = json.loads(at.read_text())
    assert plain["version"] == 1 and plain["files"]["p.md"]["mtime"] == 1_700_000_000_123_456_000
    assert plain["files"]['q"uo\\te\n.md']["node"]["links"] == [{"target": "a", "nature": None}, {"target": "b", "nature": "k"}]
    back = source.load_cache(spark, str(at))
    cols = ["path", "title", "id", "content", "hash", "tags", "links", "metadata", "mtime"]
    assert sorted(map(str, back.select(cols).collect())) == sorted(map(str, kept.select(cols).collect()))
    assert source.load_cache(spark, str(tmp_path / "none.json")).count() == 0
    at.write_text("not json")
    with pytest.raises(Exception):
        source.load_cache(spark, str(at)).collect()


def test_snapshot_diff(spark):
    listing = lambda rows: spark.createDataFrame(rows, "path string, mtime long")
    got = source.snapshot_diff(listing([("a", 1), ("b", 1), ("c", 2), ("d", 1)]), listing([("b", 2), ("c", 1), ("d", 1), ("e", 1)]))
    assert {tuple(r) for r in got.collect()} == {("deleted", "a"), ("updated", "b"), ("created", "e")}
    assert changes({"a": 1, "b": 1, "c": 2, "d": 1}, {"b": 2, "c": 1, "d": 1, "e": 1}) == [("deleted", "a"), ("updated", "b"), ("created", "e")]


def test_watch(spark, tmp_path):
    write(tmp_path, {"old.md": "before"})
    query = event_lines(watch(spark, str(tmp_path))).writeStream.format("memory").queryName("feed").trigger(processingTime="200 milliseconds").start()

    def lines(n):
        for _ in range(150):
            got = [json.loads(r["value"]) for r in spark.table("feed").collect()]
            if len(got) >= n:
                return got
            time.sleep(0.2)
        raise AssertionError(got)

    try:
        while not query.lastProgress:
            time.sleep(0.1)
        write(tmp_path, {"new.md": "#tag [[old]]"})
        assert [(e["event"], e["path"]) for e in lines(1)] == [("created", "new.md")]
        time.sleep(0.05)
        write(tmp_path, {"old.md": "after"})
        lines(2)
        (tmp_path / "new.md").unlink()
        got = lines(3)
    finally:
        query.stop()
    assert [(e["event"], e["path"]) for e in got] == [("created", "new.md"), ("updated", "old.md"), ("deleted", "new.md")]
    assert got[0]["node"]["tags"] == ["tag"] and got[0]["node"]["title"] == "new.md" and "node" not in got[2]
    assert set(snapshot(str(tmp_path))) == {"old.md"}


def test_workspace_and_commands(spark, tmp_path, monkeypatch, capsys):
    ws = tmp_path / "ws"
    assert cli.main(["init", str(ws)]) == 0 and cli.main(["init", str(ws)]) == 0
    assert source.workspace_root(str(ws / ".li")) == ws.resolve()
    write(ws, {"a.md": "---\nstatus: on\n---\nsome shared words [[b]] #t", "b.md": "some shared words", "c.md": "alone"})
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.chdir(ws)
    for command in (["scan"], ["scan", "--tag", "t"], ["export", "--status", "on"], ["path", "a", "b"], ["clusters"], ["gc"], ["similar", "a"], ["suggest"], ["visualize"], ["moc"]):
        assert cli.main(command) == 0
    assert cli.main(["path", "a"]) == cli.main(["similar"]) == 2
    out = capsys.readouterr().out
    assert "3 notes" in out and "1 notes" in out and "### Node: a.md" in out and json.loads((ws / ".li/cache.json").read_text())["version"] == 1 and "a.md -> b.md" in out and "orphan c.md" in out
    assert (tmp_path / "llm_knowledge.md").read_text().startswith("# LLM Knowledge Bundle\n") and "**PageRank:** 0.0500" in (tmp_path / "llm_knowledge.md").read_text()
    assert (tmp_path / "map.csv").read_text().startswith("id,path,tags,") and len((tmp_path / "map.csv").read_text().splitlines()) == 4
    moc = (tmp_path / "MOC.md").read_text()
    assert moc.startswith("# Map of Content (MOC)\n") and moc.count("## Community ") == 2 and "- [[c.md]] (c.md)\n" in moc
    graph = json.loads((tmp_path / "graph.json").read_text())
    assert len(graph["nodes"]) == 3 and graph["links"] == [{"source": "a.md", "target": "b", "type": "link"}]
    monkeypatch.chdir(tmp_path)
    assert cli.main(["scan"]) == 1
