"""The registered queries on notes and graphs, each with its SQL where SQL can express it.

Most run on KB, the graph derived from the tables; ``_mini`` ones on the small corpus of odd cases;
``docs_`` ones on the texts of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph import oracles as O  # noqa: N812
from inkgraph.corpus import DOCS, KB, MINI, MINI_NOTES, corpus, duckdb
from inkgraph.functions import parse
from inkgraph.functions.text import csv_field
from inkgraph.graph import KnowledgeGraph
from inkgraph.operators import graph, render, resolve, similarity
from inkgraph.plans.tables import Scratch
from inkgraph.sources import notes as source

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
CORPORA = {"": KB, "_mini": MINI}
START, GOAL = {"": "Customer#000000001", "_mini": "pruning"}, {"": "MIDDLE EAST", "_mini": "basil.md"}
NEEDLE = {"": "NATION", "_mini": "eta"}
NOTE = {"": "nation/NATION_1.md", "_mini": "edge/beta.md"}
TITLE = {"": "ASIA", "_mini": "beds.md"}
TAG, STATUS = {"": "debt", "_mini": "x"}, {"": "active", "_mini": "draft"}
SIMILAR = {"": "ASIA", "_mini": "basil.md"}


def _both(make: Callable[[KnowledgeGraph, str], DataFrame], name: str, sql: Callable[[str, str], str] | None, on: tuple[str, ...] = ("", "_mini")) -> None:
    for suffix in on:

        def run(spark: SparkSession, sf_dir: str, suffix: str = suffix) -> DataFrame:
            return make(KnowledgeGraph(corpus(spark, sf_dir, CORPORA[suffix])), suffix)

        QUERIES[name + suffix] = run
        if sql is not None:
            SQL[name + suffix] = sql(duckdb(CORPORA[suffix]), suffix)


def _add(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def _simple(name: str, make: Callable[[KnowledgeGraph], DataFrame], select: str, extra: str = "", on: tuple[str, ...] = ("", "_mini")) -> None:
    _both(lambda g, _: make(g), name, lambda c, _: O.chain(c) + extra + select, on)


# Parsing.
_simple("note_titles", lambda g: g.notes.select("path", "title", "id"), "SELECT path, title, id FROM n")
_simple("content_hash", lambda g: g.notes.select("path", "hash"), "SELECT path, sha256(content) AS hash FROM n")
_simple(
    "frontmatter",
    lambda g: g.notes.select("path", parse.has_frontmatter(F.col("content")).alias("has_block"), parse.body(F.col("content")).alias("body")),
    r"SELECT path, regexp_matches(content, '(?s)\A---.*?---') AS has_block, body FROM n",
)
_simple("metadata_kv", lambda g: g.notes.select("path", F.explode("metadata").alias("key", "value")), "SELECT path, key, value FROM meta")
_simple("wikilinks", lambda g: resolve.links_of(g.notes).select("src", "pos", "target"), "SELECT src, pos, target FROM link")
_simple("typed_links", lambda g: resolve.links_of(g.notes).where("nature is not null").select("src", "pos", "target", "nature"), "SELECT src, pos, target, nature FROM link WHERE nature IS NOT NULL")
_simple("link_natures", lambda g: resolve.links_of(g.notes).groupBy("nature").agg(F.count("*").alias("n")), "SELECT nature, count(*) AS n FROM link GROUP BY nature")
_simple("tags", lambda g: g.notes.select("path", F.posexplode("tags").alias("pos", "tag")), "SELECT path, pos::INT AS pos, tag FROM tag")
_simple("tag_counts", lambda g: g.notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")), "SELECT tag, count(*) AS n FROM tag GROUP BY tag")

# Filters and look-ups.
_HAS_TAG = "EXISTS (SELECT 1 FROM tag t WHERE t.path = n.path AND t.tag = '{tag}')"
_HAS_STATUS = "coalesce((SELECT value FROM meta m WHERE m.path = n.path AND key = 'status'), '') = '{status}'"


def _filter(name: str, by_tag: bool, by_status: bool) -> None:
    where = " AND ".join([_HAS_TAG] * by_tag + [_HAS_STATUS] * by_status)
    _both(
        lambda g, s: render.filtered(g.notes, TAG[s] if by_tag else None, STATUS[s] if by_status else None).select("path", "title"),
        name,
        lambda c, s: O.chain(c) + "SELECT path, title FROM n WHERE " + where.format(tag=TAG[s], status=STATUS[s]),
    )


_filter("filter_tag", True, False)
_filter("filter_status", False, True)
_filter("filter_tag_status", True, True)
_both(lambda g, s: render.filtered(g.notes, None, "").select("path"), "filter_no_status", lambda c, s: O.chain(c) + "SELECT path FROM n WHERE " + _HAS_STATUS.format(status=""))
_simple("scan_count", lambda g: g.notes.agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM n")
_both(
    lambda g, s: resolve.find_by_title(g.notes, NEEDLE[s]).select("path", "title"),
    "find_by_title",
    lambda c, s: O.chain(c, f"SELECT '{NEEDLE[s]}' AS target") + f"SELECT path, title FROM n JOIN res ON dst = path WHERE target = '{NEEDLE[s]}'",
)
_both(
    lambda g, s: render.search(g.notes, NEEDLE[s]),
    "search_nodes",
    lambda c, s: O.chain(c) + f"SELECT path, title, id FROM n WHERE contains(lower(title), lower('{NEEDLE[s]}')) OR contains(lower(id), lower('{NEEDLE[s]}')) ORDER BY path LIMIT 10",
)

# Links.
_simple("resolve_links", lambda g: g.edges.select("src", "pos", "target", "nature", "dst", "match"), "SELECT src, pos, target, nature, dst, match FROM edge")
_simple("unresolved_links", lambda g: resolve.unresolved(g.edges), "SELECT target, count(*) AS n FROM edge WHERE dst IS NULL GROUP BY target")
_simple("backlinks", lambda g: resolve.backlinks(g.edges), "SELECT dst AS path, src, src_title, pos FROM edge WHERE dst IS NOT NULL")
_simple("backlink_counts", lambda g: resolve.backlinks(g.edges).groupBy("path").agg(F.count("*").alias("n")), "SELECT dst AS path, count(*) AS n FROM edge WHERE dst IS NOT NULL GROUP BY dst")
_simple("degrees", lambda g: graph.degrees(g.nodes, g.edges), "SELECT path, out_degree, in_degree, out_degree + in_degree AS degree FROM deg")
_simple(
    "graph_stats",
    lambda g: graph.graph_stats(g.nodes, g.edges),
    "SELECT (SELECT count(*) FROM n) AS n_notes, count(*) AS n_links, count(dst) AS n_resolved, count(DISTINCT CASE WHEN dst IS NULL THEN target END) AS n_unresolved_targets FROM edge",
)
_simple(
    "ui_degree",
    lambda g: graph.ui_degree(g.notes),
    "SELECT title AS id, coalesce(c, 0)::BIGINT AS degree, coalesce(c, 0)::BIGINT + 1 AS size FROM (SELECT DISTINCT title FROM n) LEFT JOIN (SELECT x, count(*) AS c FROM (SELECT src_title AS x FROM link UNION ALL SELECT target FROM link) GROUP BY x) ON x = title",
)
_both(
    lambda g, s: resolve.relationships(g.notes, TITLE[s]),
    "relationships",
    lambda c, s: O.chain(c)
    + f"SELECT 'out' AS direction, target AS other, coalesce(nature, 'link') AS nature FROM link WHERE src_title = '{TITLE[s]}' UNION ALL SELECT 'in', src_title, coalesce(nature, 'link') FROM link WHERE target = '{TITLE[s]}'",
)

# Graph algorithms.
_simple("pagerank", lambda g: g.pagerank().select("path", F.round("rank", 6).alias("rank")), "SELECT path, round(r, 6) AS rank FROM p10", O.pagerank())
_simple("components", lambda g: g.components, "SELECT path, component FROM comp", O.components())
_simple("component_sizes", lambda g: graph.component_sizes(g.components), "SELECT component, size FROM size_", O.components())
_simple("gc_orphans", lambda g: g.orphans(), "SELECT path FROM comp JOIN size_ USING (component) WHERE size = 1", O.components())
_simple("gc_islands", lambda g: g.islands(3), "SELECT component, path FROM comp JOIN size_ USING (component) WHERE size BETWEEN 2 AND 3", O.components())
_simple("gc_summary", lambda g: graph.gc_summary(g.components, 3), "SELECT count(*) FILTER (size = 1) AS n_orphans, count(*) FILTER (size BETWEEN 2 AND 3) AS n_islands FROM size_", O.components())


def _bfs(g: KnowledgeGraph, suffix: str) -> DataFrame:
    return graph.bfs(g.edges, resolve.find_by_title(g.nodes, START[suffix]).select("path"))


_both(_bfs, "bfs_distances", lambda c, s: O.chain(c, f"SELECT '{START[s]}' AS target") + O.bfs(START[s]) + "SELECT path, distance, parent FROM dist")
_both(
    lambda g, s: g.shortest_path(START[s], GOAL[s]),
    "shortest_path",
    lambda c, s: O.chain(c, f"SELECT '{START[s]}' AS target UNION ALL SELECT '{GOAL[s]}'")
    + O.bfs(START[s])
    + f""", back(path, step) AS (SELECT path, distance FROM dist JOIN res ON dst = path WHERE target = '{GOAL[s]}' UNION ALL SELECT d.parent, b.step - 1 FROM back b JOIN dist d ON d.path = b.path WHERE d.parent IS NOT NULL)
SELECT step::BIGINT AS step, title FROM back JOIN n USING (path)""",
)
_both(lambda g, s: g.communities, "communities", None)
_both(lambda g, s: g.map_of_content(), "moc", None)

# Similarity.
_W = "SELECT path, word FROM (SELECT path, unnest(words) AS word FROM w)"
_simple("word_sets", lambda g: similarity.word_sets(g.notes).select("path", F.explode("words").alias("word")), _W, O.words())


def _similar_sql(c: str, s: str) -> str:
    return (
        O.chain(c, f"SELECT '{SIMILAR[s]}' AS target")
        + O.words()
        + f""", one AS (SELECT w.words, dst FROM res JOIN w ON w.path = dst WHERE target = '{SIMILAR[s]}'),
sc AS (SELECT w.path, title, len(list_intersect(w.words, one.words)) AS c, len(w.words) AS a, len(one.words) AS b FROM w JOIN n USING (path), one WHERE w.path <> one.dst)
SELECT path, title, round((c::FLOAT / (a + b - c)::FLOAT)::FLOAT::DOUBLE, 6) AS score FROM sc WHERE c > 0 ORDER BY 3 DESC, path LIMIT 5"""
    )


_both(lambda g, s: g.similar(SIMILAR[s]), "similar_notes", _similar_sql)
_both(
    lambda g, s: g.suggest(0.1),
    "suggest_links",
    lambda c, s: O.chain(c)
    + O.words()
    + """, pr AS (SELECT a.path AS source, b.path AS target, len(list_intersect(a.words, b.words)) AS c, len(a.words) AS na, len(b.words) AS nb FROM w a JOIN w b ON a.path < b.path),
sc AS (SELECT source, target, CASE WHEN na > 0 AND nb > 0 THEN (c::FLOAT / (na + nb - c)::FLOAT)::FLOAT ELSE 0::FLOAT END AS f FROM pr)
SELECT source, sc.target AS target, round(f::DOUBLE, 6) AS score FROM sc JOIN n a ON a.path = source JOIN n b ON b.path = sc.target WHERE f >= 0.1::FLOAT
  AND NOT EXISTS (SELECT 1 FROM link l WHERE l.src = sc.source AND contains(b.title, l.target)) AND NOT EXISTS (SELECT 1 FROM link l WHERE l.src = sc.target AND contains(a.title, l.target))
ORDER BY 3 DESC, 1, 2 LIMIT 10""",
)
_DOCS = "WITH raw AS (" + duckdb(DOCS) + "), n AS (SELECT path, coalesce(content, '') AS content FROM raw)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir, DOCS)


@_add("docs_similarity_pairs", _DOCS + O.words() + O.pairs(0.5) + " SELECT source, target, round(score::DOUBLE, 6) AS score FROM pair")
def docs_similarity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of different word sets of documents with a Jaccard similarity of 0.5 or more."""
    return similarity.class_pairs(_docs(spark, sf_dir), 0.5).select("source", "target", F.round(F.col("score").cast("double"), 6).alias("score"))


@_add("docs_set_classes", _DOCS + O.words() + " SELECT w.path, CASE WHEN len(words) = 0 THEN w.path ELSE min(w.path) OVER (PARTITION BY list_sort(words)) END AS rep, len(words)::BIGINT AS n_words FROM w")
def docs_set_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the first one that has the same word set."""
    return similarity.set_classes(_docs(spark, sf_dir))


@_add("docs_word_counts", _DOCS + O.words() + " SELECT word, count(*) AS n FROM (SELECT unnest(words) AS word FROM w) GROUP BY word")
def docs_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.word_sets(_docs(spark, sf_dir)).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@_add(
    "jaccard_pairs",
    O.chain(duckdb(MINI))
    + O.words()
    + """ SELECT a.path AS source, b.path AS target, CASE WHEN len(a.words) > 0 AND len(b.words) > 0 THEN round((len(list_intersect(a.words, b.words))::FLOAT
  / (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))::FLOAT)::FLOAT::DOUBLE, 6) ELSE 0 END AS score FROM w a JOIN w b ON a.path < b.path""",
)
def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The similarity of every pair of a handful of notes, also of those with nothing in common."""
    w = similarity.word_sets(KnowledgeGraph(corpus(spark, sf_dir, MINI)).notes)
    a, b = w.alias("a"), w.alias("b")
    met = a.join(b, F.col("a.path") < F.col("b.path"))
    return met.select(F.col("a.path").alias("source"), F.col("b.path").alias("target"), F.round(similarity._score(F.col("a.words"), F.col("b.words")).cast("double"), 6).alias("score"))


# Renderers.
_CSV_CASES = "(VALUES (1, 'plain'), (2, 'a,b'), (3, 'say \"x\"'), (4, 'two' || chr(10) || 'lines'), (5, 'cr' || chr(13)), (6, '')) AS t(k, v)"


@_add("csv_escape", f"SELECT k, CASE WHEN regexp_matches(v, '[,\"\\n]') THEN '\"' || replace(v, '\"', '\"\"') || '\"' ELSE v END AS field FROM {_CSV_CASES}")
def csv_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {_CSV_CASES}").select("k", csv_field(F.col("v")).alias("field"))


_CONTEXT = """, outs AS (
  SELECT src AS path, string_agg('- OUT' || coalesce(' (' || nature || ')', '') || ': [[' || target || ']] (' || coalesce('Found: ' || dst, 'Unresolved') || ')' || chr(10), '' ORDER BY pos) AS s FROM edge GROUP BY src
), backs AS (SELECT dst AS path, string_agg('- IN: ' || src_title || chr(10), '' ORDER BY src, pos) AS s FROM edge WHERE dst IS NOT NULL GROUP BY dst),
metas AS (SELECT path, string_agg('- ' || key || ': ' || value || chr(10), '' ORDER BY key) AS s FROM meta GROUP BY path),
tagl AS (SELECT path, string_agg('#' || tag, ', ' ORDER BY pos) AS s FROM tag GROUP BY path),
ctx AS (SELECT n.path, '### Node: ' || title || chr(10) || '**Path:** ' || n.path || chr(10) || coalesce('**Metadata:**' || chr(10) || metas.s, '')
  || coalesce('**Tags:** ' || tagl.s || chr(10), '') || chr(10) || '### Connections' || chr(10) || coalesce(outs.s, '')
  || coalesce(chr(10) || '### Backlinks (Linked by)' || chr(10) || backs.s, '') AS context
  FROM n LEFT JOIN outs USING (path) LEFT JOIN backs USING (path) LEFT JOIN metas USING (path) LEFT JOIN tagl USING (path))
"""
_simple("node_contexts", lambda g: g.contexts(), "SELECT path, context FROM ctx", _CONTEXT)
_both(
    lambda g, s: render.contexts(g.nodes.where(F.col("path") == NOTE[s]), g.edges),
    "node_context",
    lambda c, s: O.chain(c) + _CONTEXT + f"SELECT path, context FROM ctx WHERE path = '{NOTE[s]}'",
)
_BUNDLE = "SELECT n.path, '**PageRank:** ' || printf('%.4f', round(r, 4)) || chr(10) || '---' || chr(10) || context || chr(10) AS section FROM n JOIN ctx USING (path) JOIN p10 USING (path)"
_both(lambda g, s: g.bundle(), "export_all", lambda c, s: O.chain(c) + O.pagerank() + _CONTEXT + _BUNDLE)
_both(
    lambda g, s: g.bundle(TAG[s]),
    "scan_filtered",
    lambda c, s: O.chain(c) + O.pagerank() + _CONTEXT + _BUNDLE + " WHERE " + _HAS_TAG.format(tag=TAG[s]),
)
_both(
    lambda g, s: g.bundle(None, STATUS[s]),
    "knowledge_bundle",
    lambda c, s: O.chain(c) + O.pagerank() + _CONTEXT + _BUNDLE + " WHERE " + _HAS_STATUS.format(status=STATUS[s]),
)
_PART = """, {k}n AS (SELECT path, value AS raw, contains(value, ',') AS many FROM meta WHERE key = '{k}' AND value <> ''),
{k}p AS (SELECT path, many, unnest(generate_series(1, len(x))) AS pos, trim(unnest(x), ' "') AS target FROM (SELECT path, many, CASE WHEN many THEN list_filter(split(raw, ','), lambda y: y <> '') ELSE [raw] END AS x FROM {k}n)),
{k}i AS (SELECT p.path, any_value(p.many) AS many, coalesce(string_agg(n.id, ',' ORDER BY p.pos), '') AS ids FROM {k}p p LEFT JOIN res r ON r.target = p.target LEFT JOIN n ON n.path = r.dst GROUP BY p.path),
{k}q AS (SELECT path, CASE WHEN many THEN '"' || ids || '"' ELSE ids END AS v FROM {k}i)"""
_MAP = (
    ", mv AS (SELECT path, max(value) FILTER (key = 'summary') AS summary, max(value) FILTER (key = 'problem') AS problem, max(value) FILTER (key = 'solution') AS solution, max(value) FILTER (key = 'action') AS action FROM meta GROUP BY path)"
    ", tg AS (SELECT path, CASE WHEN count(*) > 1 THEN '\"' || string_agg(tag, ',' ORDER BY pos) || '\"' ELSE min(tag) END AS v FROM tag GROUP BY path)"
    ", ca AS (SELECT dst AS path, CASE WHEN count(*) > 1 THEN '\"' || string_agg(n.id, ',' ORDER BY src, pos) || '\"' ELSE min(n.id) END AS v FROM edge JOIN n ON n.path = src WHERE dst IS NOT NULL GROUP BY dst)"
    ", ef AS (SELECT src AS path, CASE WHEN count(*) > 1 THEN '\"' || coalesce(string_agg(n.id, ',' ORDER BY pos), '') || '\"' ELSE min(n.id) END AS v FROM edge LEFT JOIN n ON n.path = dst GROUP BY src)"
    + _PART.format(k="nextPartOf")
    + _PART.format(k="previousPartOf")
    + """, mp AS (SELECT n.id, n.path, coalesce(tg.v, '') AS tags, coalesce(summary, '') AS summary, coalesce(problem, '') AS problem, coalesce(solution, '') AS solution, coalesce(action, '') AS action,
  coalesce(ca.v, '') AS "causeIds", coalesce(ef.v, '') AS "effectIds", coalesce(nq.v, '') AS "nextPartOfIds", coalesce(pq.v, '') AS "previousPartOfIds"
  FROM n LEFT JOIN mv USING (path) LEFT JOIN tg USING (path) LEFT JOIN ca USING (path) LEFT JOIN ef USING (path) LEFT JOIN nextPartOfq nq USING (path) LEFT JOIN previousPartOfq pq USING (path))
"""
)
_NAMED = """SELECT trim(unnest(list_filter(CASE WHEN contains(value, ',') THEN split(value, ',') ELSE [value] END, lambda y: y <> '')), ' "') AS target FROM meta WHERE key IN ('nextPartOf', 'previousPartOf') AND value <> ''"""
_quote = lambda c: f"CASE WHEN regexp_matches({c}, '[,\"\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
_both(lambda g, s: g.csv_map(), "map_csv", lambda c, s: O.chain(c, _NAMED) + _MAP + "SELECT * FROM mp")
_both(
    lambda g, s: render.csv_lines(g.csv_map()),
    "map_csv_lines",
    lambda c, s: O.chain(c, _NAMED)
    + _MAP
    + "SELECT path, concat_ws(',', id, " + ", ".join([_quote("path"), "tags", *[_quote(x) for x in ("summary", "problem", "solution", "action")]]) + ', "causeIds", "effectIds", "nextPartOfIds", "previousPartOfIds") AS line FROM mp',
)
_simple(
    "graph_json_nodes",
    lambda g: g.json_nodes(),
    'SELECT title AS id, title, dense_rank() OVER (ORDER BY component) AS "group", round(r, 6) AS rank FROM n JOIN comp USING (path) JOIN p10 USING (path)',
    O.components() + O.pagerank(),
)
_simple(
    "node_colors",
    lambda g: render.node_colors(g.json_nodes()),
    "SELECT title AS id, (dense_rank() OVER (ORDER BY component) % 10)::BIGINT AS color FROM n JOIN comp USING (path)",
    O.components(),
)
_simple("graph_json_links", lambda g: g.json_links(), "SELECT src_title AS source, target, coalesce(nature, 'link') AS type FROM link")


# Files, manifests, snapshots.
@_add("scan_notes", O.chain(duckdb(MINI)) + "SELECT path, strlen(content) AS length, sha256(content) AS hash FROM n")
def scan_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of note files (the small corpus, written for the purpose) scanned as files."""
    at = Scratch(spark, "files").path("notes")
    jvm = spark.sparkContext._jvm
    for path, text in MINI_NOTES.items():
        target = jvm.org.apache.hadoop.fs.Path(f"{at}/{path}")
        out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
        out.write(bytearray(text.encode()))
        out.close()
    files, _ = source.split_oversize(source.read_files(spark, at))
    return files.select("path", F.col("length").cast("long").alias("length"), F.sha2("content", 256).alias("hash"))


# A folder before the customers came and after the regions went.
_OLD = "SELECT path, length(path) AS mtime, md5(content) AS hash FROM n WHERE path NOT LIKE 'customer/%'"
_NEW = "SELECT path, length(path) + CASE WHEN length(content) % 3 = 0 THEN 1 ELSE 0 END AS mtime, CASE WHEN length(content) % 2 = 0 THEN 'new' ELSE md5(content) END AS hash FROM n WHERE path NOT LIKE 'region/%'"


def _listings(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n = KnowledgeGraph(corpus(spark, sf_dir, KB)).notes
    return (spark.sql(sql.replace("FROM n", "FROM {n}"), n=n) for sql in (_OLD, _NEW))


@_add(
    "incremental_plan",
    O.chain(duckdb(KB))
    + f", o AS ({_OLD}), c AS ({_NEW}) SELECT path, CASE WHEN c.mtime IS NULL THEN 'removed' WHEN c.mtime = o.mtime THEN 'reuse' WHEN c.hash = o.hash THEN 'reuse_touch' ELSE 'parse' END AS action FROM o FULL JOIN c USING (path)",
)
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, listing = _listings(spark, sf_dir)
    return source.incremental_plan(listing, known)


@_add(
    "snapshot_diff",
    """WITH o AS (SELECT user_id AS path, max(ts) AS mtime FROM events WHERE event_id <= (SELECT avg(event_id) FROM events) GROUP BY user_id), c AS (SELECT user_id AS path, max(ts) AS mtime FROM events GROUP BY user_id)
SELECT event, path::VARCHAR AS path FROM (SELECT path, CASE WHEN c.mtime IS NULL THEN 'deleted' WHEN o.mtime IS NULL THEN 'created' WHEN c.mtime > o.mtime THEN 'updated' END AS event FROM o FULL JOIN c USING (path)) WHERE event IS NOT NULL""",
)
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last events half-way through the feed and at its end, as two listings of files."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    half = ev.agg(F.avg("event_id").alias("half"))
    last = lambda rows: rows.groupBy(F.col("user_id").cast("string").alias("path")).agg(F.max("ts").alias("mtime"))
    return source.snapshot_diff(last(ev.join(F.broadcast(half), F.col("event_id") <= F.col("half")).drop("half")), last(ev))


@_add(
    "cache_roundtrip",
    O.chain(duckdb(MINI))
    + "SELECT n.path, title, id, sha256(content) AS hash, content, coalesce((SELECT string_agg(tag, '|' ORDER BY pos) FROM tag t WHERE t.path = n.path), '') AS tags, (SELECT count(*) FROM link l WHERE l.src = n.path) AS n_links, (SELECT count(*) FROM meta m WHERE m.path = n.path) AS n_meta FROM n",
)
def cache_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small corpus as a manifest, to JSON entries and back."""
    n = KnowledgeGraph(corpus(spark, sf_dir, MINI)).notes.withColumn("mtime", F.timestamp_seconds(F.lit(1_700_000_000)))
    back = source.entries_to_manifest(source.cache_entries(n))
    return back.select("path", "title", "id", "hash", "content", F.array_join("tags", "|").alias("tags"), F.size("links").cast("long").alias("n_links"), F.size("metadata").cast("long").alias("n_meta"))


@_add(
    "watch_events",
    O.chain(duckdb(KB))
    + f""", o AS ({_OLD}), c AS ({_NEW}), ev AS (SELECT path, CASE WHEN c.mtime IS NULL THEN 'deleted' WHEN o.mtime IS NULL THEN 'created' WHEN c.mtime > o.mtime THEN 'updated' END AS event FROM o FULL JOIN c USING (path)),
tl AS (SELECT path, string_agg('"' || tag || '"', ',' ORDER BY pos) AS s FROM tag GROUP BY path),
ll AS (SELECT src AS path, string_agg('{{"target":"' || target || '"' || coalesce(',"nature":"' || nature || '"', '') || '}}', ',' ORDER BY pos) AS s FROM link GROUP BY src)
SELECT '{{"event":"' || event || '","path":"' || path || '"' || CASE WHEN event = 'deleted' THEN '' ELSE ',"node":{{"title":"' || title || '","id":"' || id || '","tags":[' || coalesce(tl.s, '') || '],"links":[' || coalesce(ll.s, '') || ']}}' END || '}}' AS value
FROM ev JOIN n USING (path) LEFT JOIN tl USING (path) LEFT JOIN ll USING (path) WHERE event IS NOT NULL""",
)
def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The change feed's events for two snapshots of KB, as the stream renders them."""
    from inkgraph.streaming.watch import event_lines, events

    known, listing = _listings(spark, sf_dir)
    diff = source.snapshot_diff(known, listing)
    raw = corpus(spark, sf_dir, KB)
    return event_lines(events(diff.join(raw, "path", "left").select("event", "path", "content")))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty notes of highest rank, with their degrees."""
    g = KnowledgeGraph(corpus(spark, sf_dir, KB))
    top = g.pagerank().select("path", F.round("rank", 6).alias("rank")).orderBy(F.desc("rank"), "path").limit(20)
    return top.join(graph.degrees(g.nodes, g.edges), "path").join(g.nodes.select("path", "title"), "path").select("title", "rank", "in_degree", "out_degree").orderBy(F.desc("rank"), "title")
