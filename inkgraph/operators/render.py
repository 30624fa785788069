"""What is shown or exported: contexts, bundles, CSV maps, graph JSON, maps of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.functions.text import csv_field, csv_list
from inkgraph.operators.resolve import links_of, resolve


def filtered(notes: DataFrame, tag: str | None = None, status: str | None = None) -> DataFrame:
    """Notes with a tag and a metadata status; a note without status has the empty one."""
    if tag is not None:
        notes = notes.where(F.array_contains("tags", tag))
    if status is not None:
        notes = notes.where(F.coalesce(F.try_element_at("metadata", F.lit("status")), F.lit("")) == status)
    return notes


def search(notes: DataFrame, text: str, k: int = 10) -> DataFrame:
    """(path, title, id) of the first k notes whose title or id holds the text, in any case."""
    found = F.lower("title").contains(text.lower()) | F.lower("id").contains(text.lower())
    return notes.where(found).orderBy("path").limit(k).select("path", "title", "id")


def _block(present: Column, text: Column) -> Column:
    return F.when(present, text).otherwise(F.lit(""))


# Texts of the rendered documents (fixed values).
NODE, PATH, META, TAGS = "### Node: ", "**Path:** ", "**Metadata:**\n", "**Tags:** "
CONNECTIONS, BACKLINKS = "\n### Connections\n", "\n### Backlinks (Linked by)\n"
MOC_HEADER = "# Map of Content (MOC)\nDetected via Louvain community detection\n\n"


def contexts(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, context): each note with its metadata, tags, links and backlinks as Markdown."""
    out = edges.select(
        F.col("src").alias("path"),
        "pos",
        F.concat(
            F.lit("- OUT"),
            F.when(F.col("nature").isNotNull(), F.concat(F.lit(" ("), F.col("nature"), F.lit(")"))).otherwise(F.lit("")),
            F.lit(": [["),
            F.col("target"),
            F.lit("]] ("),
            F.when(F.col("dst").isNotNull(), F.concat(F.lit("Found: "), F.col("dst"))).otherwise(F.lit("Unresolved")),
            F.lit(")\n"),
        ).alias("line"),
    )
    listed = lambda rows, order: rows.groupBy("path").agg(F.sort_array(F.collect_list(F.struct(*order, "line"))).alias("x")).select(
        "path", F.array_join(F.transform("x", lambda s: s["line"]), "").alias("lines")
    )
    outs = listed(out, ["pos"]).withColumnRenamed("lines", "outs")
    back = edges.where("dst is not null").select(F.col("dst").alias("path"), "src", "pos", F.concat(F.lit("- IN: "), F.col("src_title"), F.lit("\n")).alias("line"))
    backs = listed(back, ["src", "pos"]).withColumnRenamed("lines", "backs")
    entries = F.sort_array(F.map_entries("metadata"))
    meta = F.array_join(F.transform(entries, lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"], F.lit("\n"))), "")
    marks = F.array_join(F.transform("tags", lambda t: F.concat(F.lit("#"), t)), ", ")
    text = F.concat(
        F.concat(F.lit(NODE), F.col("title"), F.lit("\n" + PATH), F.col("path"), F.lit("\n")),
        _block(F.size("metadata") > 0, F.concat(F.lit(META), meta)),
        _block(F.size("tags") > 0, F.concat(F.lit(TAGS), marks, F.lit("\n"))),
        F.concat(F.lit(CONNECTIONS), F.coalesce("outs", F.lit(""))),
        _block(F.col("backs").isNotNull(), F.concat(F.lit(BACKLINKS), F.coalesce("backs", F.lit("")))),
    )
    return notes.join(outs, "path", "left").join(backs, "path", "left").select("path", text.alias("context"))


def bundle(notes: DataFrame, edges: DataFrame, ranks: DataFrame, tag: str | None = None, status: str | None = None) -> DataFrame:
    """(path, section): a section for each note that passes the filters, in the order of paths when written."""
    shown = contexts(filtered(notes, tag, status), edges)
    section = F.concat(F.lit("**PageRank:** "), F.format_string("%.4f", "rank"), F.lit("\n---\n"), F.col("context"), F.lit("\n"))
    return shown.join(ranks, "path").select("path", section.alias("section"))


def bundle_header(date: str, tag: str | None = None, status: str | None = None) -> str:
    lines = ["# LLM Knowledge Bundle", f"Generated on: {date}"]
    lines += [f"Filter Tag: {tag}"] * (tag is not None) + [f"Filter Status: {status}"] * (status is not None)
    return "\n".join(lines) + "\n\n"


MAP_COLUMNS = ["id", "path", "tags", "summary", "problem", "solution", "action", "causeIds", "effectIds", "nextPartOfIds", "previousPartOfIds"]


def _named_ids(notes: DataFrame, key: str) -> DataFrame:
    """(path, many, ids): the notes named by a metadata field, a title or a list of titles."""
    raw = notes.select("path", F.try_element_at("metadata", F.lit(key)).alias("raw")).where("raw is not null and raw != ''")
    many = F.col("raw").contains(",")
    part = F.transform(F.filter(F.split("raw", ","), lambda x: x != ""), lambda x: F.btrim(x, F.lit(' "')))
    names = raw.select("path", many.alias("many"), F.posexplode(F.when(many, part).otherwise(F.array("raw"))).alias("pos", "target"))
    ids = notes.select(F.col("path").alias("dst"), "id")
    found = names.join(resolve(names, notes).select("target", "dst"), "target", "left").join(ids, "dst", "left")
    listed = F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "id"))))
    return found.groupBy("path", "many").agg(F.transform(listed, lambda s: s["id"]).alias("ids"))


def csv_map(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """The eleven columns of the map, a row for each note, as they stand in its CSV but for quoting."""
    ids = notes.select("path", "id")
    both = edges.where("dst is not null").join(ids.select(F.col("path").alias("src"), F.col("id").alias("src_id")), "src")
    both = both.join(ids.select(F.col("path").alias("dst"), F.col("id").alias("dst_id")), "dst")
    take = lambda s: F.transform(s, lambda x: x["i"])
    causes = both.groupBy(F.col("dst").alias("path")).agg(F.sort_array(F.collect_list(F.struct("src", "pos", F.col("src_id").alias("i")))).alias("c"), F.count("*").alias("nc"))
    effects = both.groupBy(F.col("src").alias("path")).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("dst_id").alias("i")))).alias("e"))
    got = notes.join(causes, "path", "left").join(effects, "path", "left")
    none = F.array().cast("array<string>")
    # With several links the list is quoted, also if fewer of them lead to a note.
    listed = lambda a, n: F.when(n >= 2, csv_list(a, always=True)).otherwise(csv_list(a))
    cause = F.coalesce(take(F.col("c")), none)
    effect = F.coalesce(take(F.col("e")), none)
    plain = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit("")).alias(k)
    got = got.select(
        "id",
        "path",
        csv_list(F.col("tags")).alias("tags"),
        *[plain(k) for k in ("summary", "problem", "solution", "action")],
        listed(cause, F.size(cause)).alias("causeIds"),
        listed(effect, F.size("links")).alias("effectIds"),
    )
    for key, name in (("nextPartOf", "nextPartOfIds"), ("previousPartOf", "previousPartOfIds")):
        named = _named_ids(notes, key)
        named = named.select("path", F.when(F.col("many"), csv_list(F.col("ids"), always=True)).otherwise(csv_list(F.col("ids"))).alias(name))
        got = got.join(named, "path", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return got.select(*MAP_COLUMNS)


def csv_lines(mapped: DataFrame) -> DataFrame:
    """(path, line): rows of the map as CSV; lists are already quoted."""
    quoted = {"path", "summary", "problem", "solution", "action"}
    return mapped.select("path", F.concat_ws(",", *[csv_field(F.col(c)) if c in quoted else F.col(c) for c in MAP_COLUMNS]).alias("line"))


def json_nodes(notes: DataFrame, labels: DataFrame, ranks: DataFrame, groups: DataFrame) -> DataFrame:
    """(id, title, group, rank) of the viewer's graph; ``groups`` numbers the components."""
    named = labels.join(groups, "component").select("path", "group")
    return notes.select("path", "title").join(named, "path").join(ranks, "path").select(
        F.col("title").alias("id"), "title", "group", F.round("rank", 6).alias("rank")
    )


#: Colours that a viewer of the graph tells groups apart by.
COLORS = 10


def node_colors(nodes: DataFrame) -> DataFrame:
    """(id, color): the place in the palette of each node's group."""
    return nodes.select("id", (F.col("group") % COLORS).alias("color"))


def json_links(notes: DataFrame) -> DataFrame:
    """(source, target, type): targets as written, resolved or not."""
    return links_of(notes).select(F.col("src_title").alias("source"), "target", F.coalesce("nature", F.lit("link")).alias("type"))


def graph_json(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, json): one JSON object a row, for a sink that puts them together."""
    return nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("json")).unionAll(
        links.select(F.lit("link").alias("kind"), F.to_json(F.struct("*")).alias("json"))
    )


def map_of_content(notes: DataFrame, communities: DataFrame) -> DataFrame:
    """(community, size, section): a heading and a line for each note, in the order of paths."""
    rows = communities.join(notes.select("path", "title"), "path")
    line = F.concat(F.lit("- [["), F.col("title"), F.lit("]] ("), F.col("path"), F.lit(")\n"))
    got = rows.groupBy("community").agg(F.sort_array(F.collect_list(F.struct("path", line.alias("line")))).alias("x"), F.count("*").alias("size"))
    lines = F.array_join(F.transform("x", lambda s: s["line"]), "")
    head = F.concat(F.lit("## Community "), (F.col("community") + 1).cast("string"), F.lit(" ("), F.col("size").cast("string"), F.lit(" nodes)\n"))
    return got.select("community", "size", F.concat(head, lines, F.lit("\n")).alias("section"))
