"""Notes from text, as pure column expressions.

A note's title is its file name. Metadata come from a leading block between two ``---``; the rest
is the body. Links ``[[target]]`` or ``[[nature::target]]`` and tags ``#tag`` are found by one regular
expression that reads the body from left to right, so a link inside a tag and a tag inside a link
are seen as the scanner meets them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A metadata block: the text starts with ``---`` and holds another one anywhere after it.
FRONTMATTER = r"(?s)\A---(.*?)---"
#: A link up to the first ``]]``, or ``#`` and what follows up to white space, a point or a comma.
TOKEN = r"(?s)\[\[.*?\]\]|#(?![# ])[^\s.,]+"
LINK_TYPE = "array<struct<target:string,nature:string>>"


def title(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]+$", 0)


def without_extension(title_: Column) -> Column:
    return F.regexp_replace(title_, r"\.md$", "")


def note_id(path: Column) -> Column:
    """A stable id in the layout of a UUID, from the path."""
    h = F.md5(path)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat_ws("-", *cut)


def has_frontmatter(content: Column) -> Column:
    return content.rlike(FRONTMATTER)


def frontmatter(content: Column) -> Column:
    return F.regexp_extract(content, FRONTMATTER, 1)


def body(content: Column) -> Column:
    return F.regexp_replace(content, FRONTMATTER, "")


def metadata_entries(block: Column) -> Column:
    """Array of (key, value): the parts before and after a line's first colon, up to a second one."""
    lines = F.filter(F.split(block, r"[\r\n]+"), lambda x: x != "")
    entry = lambda x: F.struct(
        F.trim(F.split(x, ":")[0]).alias("key"), F.trim(F.coalesce(F.get(F.split(x, ":"), F.lit(1)), F.lit(""))).alias("value")
    )
    return F.filter(F.transform(lines, entry), lambda e: e["key"] != "")


def metadata(block: Column) -> Column:
    """A map; of a repeated key the last entry counts."""
    every = F.transform(F.array(metadata_entries(block)), lambda kv: F.filter(kv, lambda e, i: ~F.exists(F.slice(kv, i + 2, F.size(kv)), lambda x: x["key"] == e["key"])))[0]
    return F.map_from_entries(every)


def tokens(body_: Column) -> Column:
    return F.regexp_extract_all(body_, F.lit(TOKEN), F.lit(0))


def links(found: Column) -> Column:
    """Links in order, repeats kept; the first ``::`` parts nature and target."""
    inner = lambda t: F.substring(t, F.lit(3), F.char_length(t) - 4)
    at = lambda t: F.instr(inner(t), "::")
    link = lambda t: F.struct(
        F.trim(F.when(at(t) > 0, F.substring(inner(t), at(t) + 2, F.char_length(t))).otherwise(inner(t))).alias("target"),
        F.when(at(t) > 0, F.trim(F.substring(inner(t), F.lit(1), at(t) - 1))).alias("nature"),
    )
    return F.transform(F.filter(found, lambda t: t.startswith("[[")), link)


def tags(found: Column) -> Column:
    return F.transform(F.filter(found, lambda t: t.startswith("#")), lambda t: F.substring(t, F.lit(2), F.char_length(t)))


def notes(raw: DataFrame) -> DataFrame:
    """Notes (path, title, id, content, hash, tags, links, metadata) of rows (path, content).

    A null content is an empty note; rows without a path are no notes; other columns are dropped.
    """
    raw = raw.where("path is not null").select("path", F.coalesce("content", F.lit("")).alias("content"))
    found = raw.select(
        "path",
        "content",
        frontmatter(F.col("content")).alias("_block"),
        tokens(body(F.col("content"))).alias("_tokens"),
    )
    return found.select(
        "path",
        title(F.col("path")).alias("title"),
        note_id(F.col("path")).alias("id"),
        "content",
        F.sha2("content", 256).alias("hash"),
        tags(F.col("_tokens")).alias("tags"),
        links(F.col("_tokens")).alias("links"),
        metadata(F.col("_block")).alias("metadata"),
    )
