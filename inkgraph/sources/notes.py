"""Note files, the manifest of parsed notes, incremental rescans, the JSON cache."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.functions.parse import LINK_TYPE
from inkgraph.plans.tables import Scratch

#: Larger files are rejected rather than parsed.
MAX_BYTES = 1 << 20
MARKER, CACHE = ".li", "cache.json"


def init_workspace(folder: str) -> Path:
    """Make a workspace of a folder; again is no error."""
    at = Path(folder)
    (at / MARKER).mkdir(parents=True, exist_ok=True)
    return at.resolve()


def workspace_root(start: str) -> Path | None:
    """The nearest folder from ``start`` upwards that is a workspace."""
    here = Path(start).resolve()
    return next((p for p in (here, *here.parents) if (p / MARKER).is_dir()), None)


#: How the file system's listing prints a file (a fixed format).
_STATUS = re.compile(r"\{path=(.*?); isDirectory=(true|false)(?:; length=(\d+).*?)?; modification_time=(\d+);", re.DOTALL)
#: Most changed files that are read by name; if more have changed the folder is read.
BY_NAME = 10_000


def _file_system(spark: SparkSession, at: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, root: str) -> str:
    """The folder as the file source names it."""
    path, fs = _file_system(spark, root.rstrip("/") or "/")
    return fs.makeQualified(path).toString()


def _unlisted(spark: SparkSession, base: str) -> list[tuple[str, int, int]]:
    """(path relative to ``base``, time in ms, length) of the ``*.md`` files that Spark's file sources pass
    over: those of no bytes, and those under a name that begins with ``_`` or ``.``.

    One call a folder; what lies under a dot name at the top is no part of the notes.
    """
    found, folders = [], [base]
    while folders:
        path, fs = _file_system(spark, folders.pop())
        text = spark.sparkContext._jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.listStatus(path))
        for at, folder, length, ms in _STATUS.findall(text):
            name = at[len(base) :].lstrip("/")
            if name.startswith("."):
                continue
            if folder == "true":
                folders.append(at)
            elif name.endswith(".md") and (length == "0" or re.search(r"(?:^|/)[._]", name)):
                found.append((name, int(ms), int(length)))
    return found


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, length) of all ``*.md`` files under ``root``, none of them opened."""
    return _files(spark, root).drop("content")


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, length, content) of all ``*.md`` files under ``root``, paths relative to it.

    Names that begin with a dot are left out at the top of the folder only. A filter on ``length`` is
    pushed into the source, so files it rejects are not read. The few files that the file source does
    not see are listed by folder and, unless empty, copied to the shared folder under names it sees.
    """
    return _files(spark, root)


def _files(spark: SparkSession, root: str, only: list[str] | None = None) -> DataFrame:
    base = qualified(spark, root)
    unlisted = _unlisted(spark, base)
    reader = spark.read.format("binaryFile")
    if only is None:
        raw = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(base)
    else:
        rest = set(only) - {name for name, _, _ in unlisted}
        unlisted = [x for x in unlisted if x[0] in set(only)]
        none = spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
        raw = reader.load([re.sub(r"([\\*?{}\[\]])", r"\\\1", f"{base}/{name}") for name in sorted(rest)]) if rest else none
    text = F.col("content").cast("string").alias("content")
    files = raw.select(F.substring("path", len(base.rstrip("/")) + 2, 1 << 30).alias("path"), F.col("modificationTime").alias("mtime"), "length", text)
    files = files.where(~F.col("path").startswith("."))
    if unlisted:
        rows = spark.createDataFrame(unlisted, "path string, ms long, length long").select("path", F.timestamp_millis("ms").alias("mtime"), "length")
        files = files.unionByName(rows.where("length = 0").withColumn("content", F.lit("")))
        if any(length for _, _, length in unlisted):
            files = files.unionByName(_copied(spark, base, [x for x in unlisted if x[2]], rows))
    return files


def _copied(spark: SparkSession, base: str, hidden: list[tuple[str, int, int]], rows: DataFrame) -> DataFrame:
    at, jvm = Scratch(spark, "files").path("hidden"), spark.sparkContext._jvm
    names = []
    for i, (name, _, _) in enumerate(hidden):
        (src, a), (dst, b) = _file_system(spark, f"{base}/{name}"), _file_system(spark, f"{at}/{i}.md")
        jvm.org.apache.hadoop.fs.FileUtil.copy(a, src, b, dst, False, spark.sparkContext._jsc.hadoopConfiguration())
        names.append((f"{i}.md", name))
    raw = spark.read.format("binaryFile").load(at).select(F.substring_index("path", "/", -1).alias("_n"), F.col("content").cast("string").alias("content"))
    named = spark.createDataFrame(names, "_n string, path string")
    return rows.join(raw.join(named, "_n").drop("_n"), "path").select("path", "mtime", "length", "content")


def split_oversize(files: DataFrame, most: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """(files to parse, rejected files without content)."""
    return files.where(F.col("length") <= most), files.where(F.col("length") > most).drop("content")


def manifest(files: DataFrame, notes: DataFrame) -> DataFrame:
    """What is kept between scans: the notes with their files' times."""
    return notes.join(files.select("path", "mtime"), "path")


def incremental_plan(listing: DataFrame, known: DataFrame) -> DataFrame:
    """(path, action) for files (path, mtime, hash) against a manifest with the same columns.

    ``reuse`` for an equal time, ``reuse_touch`` for an equal hash, ``parse`` for anything else, and
    ``removed`` for what is listed no more.
    """
    old = known.select("path", F.col("mtime").alias("_m"), F.col("hash").alias("_h"))
    action = (
        F.when(F.col("_there").isNull(), "removed")
        .when(F.col("_m") == F.col("mtime"), "reuse")
        .when(F.col("_h") == F.col("hash"), "reuse_touch")
        .otherwise("parse")
    )
    both = listing.select("path", "mtime", "hash", F.lit(True).alias("_there")).join(old, "path", "full_outer")
    return both.select("path", action.alias("action"))


def rescan(spark: SparkSession, root: str, known: DataFrame, parse) -> DataFrame:
    """The new manifest of a folder: unchanged notes from ``known``, others parsed by ``parse``.

    Files are listed and compared by their times; only new ones and those whose time differs are
    opened, and of these only those whose hash differs too are parsed.
    """
    return _rescan(spark, root, known, parse)[0]


def _rescan(spark: SparkSession, root: str, known: DataFrame, parse) -> tuple[DataFrame, bool]:
    """The manifest, and whether anything differs from ``known``."""
    listing = list_files(spark, root).where(F.col("length") <= MAX_BYTES).select("path", "mtime")
    old = known.select("path", F.col("mtime").alias("_m"))
    same = listing.join(old, "path").where("mtime = _m").select("path")
    look = listing.join(same, "path", "left_anti").select("path")
    names = [r["path"] for r in look.limit(BY_NAME + 1).collect()]
    kept = known.join(same, "path", "left_semi")
    if not names:
        return kept, not known.join(same, "path", "left_anti").isEmpty()
    opened = _files(spark, root, names) if len(names) <= BY_NAME else read_files(spark, root).join(look, "path", "left_semi")
    opened = opened.withColumn("hash", F.sha2("content", 256))
    before = known.drop("mtime").withColumnRenamed("hash", "_h")
    touched = opened.select("path", "mtime", "hash").join(before, "path").where("hash = _h").drop("_h")
    fresh = opened.join(touched.select("path"), "path", "left_anti")
    return kept.unionByName(touched).unionByName(manifest(fresh, parse(fresh))), True


def refreshed(spark: SparkSession, root: str, cache: str, parse) -> DataFrame:
    """The manifest of a folder by its JSON cache, which is written again if the folder has changed."""
    now, changed = _rescan(spark, root, load_cache(spark, cache), parse)
    if changed:
        now = Scratch(spark, "scan").keep(now, "manifest")
        save_cache(now, cache)
    return now


ENTRY = f"struct<mtime:bigint,hash:string,node:struct<title:string,id:string,content:string,tags:array<string>,links:{LINK_TYPE},metadata:map<string,string>>>"


def cache_entries(kept: DataFrame) -> DataFrame:
    """(path, entry): a manifest's rows as the JSON objects of the cache file; times in nanoseconds."""
    node = F.struct("title", "id", "content", "tags", "links", "metadata")
    entry = F.struct((F.unix_micros("mtime") * 1000).alias("mtime"), "hash", node.alias("node"))
    return kept.select("path", F.to_json(entry, {"ignoreNullFields": "false"}).alias("entry"))


def cache_lines(entries: DataFrame) -> DataFrame:
    """(path, value): an entry with its path as a JSON string before it."""
    quoted = F.regexp_extract(F.to_json(F.struct("path")), r'(?s)\A\{"path":(.*)\}\z', 1)
    return entries.select("path", F.concat(quoted, F.lit(": "), F.col("entry")).alias("value"))


def save_cache(kept: DataFrame, at: str) -> None:
    """Write a manifest as the JSON cache: ``{"version": 1, "files": {path: entry, ...}}``.

    This is the exchange format of one small workspace, a single file by definition; between scans
    at scale the Parquet manifest is used.
    """
    rows = cache_lines(cache_entries(kept)).orderBy("path").select("value").toLocalIterator()
    path, fs = _file_system(kept.sparkSession, at)
    out = fs.create(path, True)
    try:
        out.write(b'{"version": 1, "files": {')
        for i, r in enumerate(rows):
            out.write((("," if i else "") + r["value"]).encode())
        out.write(b"}}")
    finally:
        out.close()


def load_cache(spark: SparkSession, at: str) -> DataFrame:
    """A JSON cache as a manifest; a missing file is an empty one, text that is no JSON an error."""
    path, fs = _file_system(spark, at)
    if not fs.exists(path):
        return entries_to_manifest(spark.createDataFrame([], "path string, entry string"))
    text = spark.read.text(at, wholetext=True)
    whole = text.select(F.from_json("value", f"struct<files:map<string,{ENTRY}>>", {"mode": "FAILFAST"}).alias("w"))
    return _manifest(whole.select(F.explode("w.files").alias("path", "e")))


def entries_to_manifest(entries: DataFrame) -> DataFrame:
    return _manifest(entries.select("path", F.from_json("entry", ENTRY).alias("e")))


def _manifest(parsed: DataFrame) -> DataFrame:
    return parsed.select(
        "path", F.col("e.node.title").alias("title"), F.col("e.node.id").alias("id"), F.col("e.node.content").alias("content"), F.col("e.hash").alias("hash"),
        F.col("e.node.tags").alias("tags"), F.col("e.node.links").alias("links"), F.col("e.node.metadata").alias("metadata"),
        F.timestamp_micros(F.floor(F.col("e.mtime") / 1000).cast("long")).alias("mtime"),
    )


def snapshot_diff(known: DataFrame, current: DataFrame) -> DataFrame:
    """(event, path) between two listings (path, mtime): created, updated (a later time), deleted."""
    a = known.select("path", F.col("mtime").alias("_old"), F.lit(1).alias("_k"))
    b = current.select("path", F.col("mtime").alias("_new"), F.lit(1).alias("_c"))
    event = F.when(F.col("_c").isNull(), "deleted").when(F.col("_k").isNull(), "created").when(F.col("_new") > F.col("_old"), "updated")
    return a.join(b, "path", "full_outer").select(event.alias("event"), "path").where("event is not null")
