"""Links to notes, once for all operators.

A target names the note whose title it is, else the one whose title without ``.md`` it is, else the
first whose title holds it; among equals the smallest path. The first two are one equi-join. The
last concerns only distinct targets that missed: each probes the titles by its rarest substring of
three characters, so the work follows the matches and not targets times titles; a target that short
itself has the smallest path of its substring, an aggregate that no title is joined for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.functions.parse import without_extension

GRAM = 3


def links_of(notes: DataFrame) -> DataFrame:
    """(src, src_title, pos, target, nature): every link of every note, repeats kept."""
    return notes.select(F.col("path").alias("src"), F.col("title").alias("src_title"), F.posexplode("links").alias("pos", "l")).select(
        "src", "src_title", "pos", F.col("l.target").alias("target"), F.col("l.nature").alias("nature")
    )


def _grams(text: Column, size: int) -> Column:
    n = F.char_length(text) - (size - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, notes: DataFrame) -> DataFrame:
    """(target, path): for each distinct target the smallest path of a title that holds it.

    The empty target is held by every title.
    """
    needles = needles.select("target").where("target is not null").distinct()
    titles = notes.select("path", "title")
    size = F.char_length("target")
    probes = needles.where(size > GRAM).select("target", F.explode(_grams(F.col("target"), GRAM)).alias("gram"))
    short = needles.where((size > 0) & (size <= GRAM))
    wanted = probes.select("gram").unionAll(short.select(F.col("target").alias("gram"))).distinct()
    every = F.concat(*[_grams(F.col("title"), k) for k in range(1, GRAM + 1)])
    held = titles.select("path", "title", F.explode(every).alias("gram")).join(wanted, "gram", "left_semi")
    rarity = held.groupBy("gram").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    # A gram that no title holds makes a match impossible; else the rarest gram alone is probed.
    ranked = probes.join(rarity, "gram", "left").groupBy("target").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram")
    )
    met = ranked.where("least > 0").join(held, "gram").where(F.col("title").contains(F.col("target")))
    some = met.groupBy("target").agg(F.min("path").alias("path"))
    empty = needles.where(size == 0).crossJoin(titles.agg(F.min("path").alias("path"))).where("path is not null")
    brief = short.join(rarity, F.col("target") == F.col("gram")).select("target", F.col("first").alias("path"))
    return some.unionAll(brief).unionAll(empty.select("target", "path"))


def resolve(needles: DataFrame, notes: DataFrame) -> DataFrame:
    """(target, dst, match) for each distinct target that names a note; match is exact, noext or substring."""
    needles = needles.select("target").where("target is not null").distinct()
    names = notes.select("title", "path").select(
        "path", F.explode(F.array(F.struct(F.col("title").alias("name"), F.lit(0).alias("rank")), F.struct(without_extension(F.col("title")).alias("name"), F.lit(1).alias("rank")))).alias("n")
    )
    # Titles without the extension are their own second name; the exact rank wins.
    known = names.groupBy(F.col("n.name").alias("target")).agg(F.min(F.struct("n.rank", "path")).alias("m"))
    direct = needles.join(known, "target", "left")
    named = direct.where("m is not null").select("target", F.col("m.path").alias("dst"), F.when(F.col("m.rank") == 0, "exact").otherwise("noext").alias("match"))
    missed = direct.where("m is null").select("target")
    return named.unionAll(containing(missed, notes).select("target", F.col("path").alias("dst"), F.lit("substring").alias("match")))


def edges_of(notes: DataFrame) -> DataFrame:
    """All links with ``dst`` and ``match``, both null where the target names no note."""
    links = links_of(notes)
    return links.join(resolve(links, notes), "target", "left").select("src", "src_title", "pos", "target", "nature", "dst", "match")


def find_by_title(notes: DataFrame, needle: str) -> DataFrame:
    """The note that a title or part of one names: one row, or none."""
    best = F.when(F.col("title") == needle, 0).when(without_extension(F.col("title")) == needle, 1).otherwise(2)
    return notes.where(F.col("title").contains(needle)).orderBy(best, "path").limit(1)


def unresolved(edges: DataFrame) -> DataFrame:
    """(target, n): targets that name no note, and how many links have them."""
    return edges.where("dst is null").groupBy("target").agg(F.count("*").alias("n"))


def backlinks(edges: DataFrame) -> DataFrame:
    """(path, src, src_title, pos): a row for each link that leads to a note."""
    return edges.where("dst is not null").select(F.col("dst").alias("path"), "src", "src_title", "pos")


def relationships(notes: DataFrame, id_: str) -> DataFrame:
    """(direction, other, nature) of links whose ends have just this text, as the viewer shows them."""
    ends = links_of(notes).select(F.col("src_title").alias("source"), "target", F.coalesce("nature", F.lit("link")).alias("nature"))
    out = ends.where(F.col("source") == id_).select(F.lit("out").alias("direction"), F.col("target").alias("other"), "nature")
    into = ends.where(F.col("target") == id_).select(F.lit("in").alias("direction"), F.col("source").alias("other"), "nature")
    return out.unionAll(into)
