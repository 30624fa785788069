"""The note and graph queries as DuckDB statements, independent of the Spark operators.

``chain`` is the shared head: from rows (path, content) to parsed notes, links and resolved edges.
"""

from __future__ import annotations

CHAIN = r"""
WITH RECURSIVE raw AS ({corpus}),
n AS (
  SELECT path, regexp_extract(path, '[^/]+$') AS title, coalesce(content, '') AS content,
    regexp_extract(coalesce(content, ''), '(?s)\A---(.*?)---', 1) AS block,
    regexp_replace(coalesce(content, ''), '(?s)\A---.*?---', '') AS body,
    substr(md5(path), 1, 8) || '-' || substr(md5(path), 9, 4) || '-' || substr(md5(path), 13, 4) || '-' || substr(md5(path), 17, 4) || '-' || substr(md5(path), 21, 12) AS id
  FROM raw
),
tok AS (SELECT path, title, regexp_extract_all(body, '(?s)\[\[.*?\]\]|#[^\s\x0B.,#][^\s\x0B.,]*') AS t FROM n),
tag AS (
  SELECT path, title, unnest(generate_series(0, len(x) - 1)) AS pos, substr(unnest(x), 2) AS tag
  FROM (SELECT path, title, list_filter(t, lambda y: y[1] = '#') AS x FROM tok)
),
inner_ AS (
  SELECT path AS src, title AS src_title, unnest(generate_series(0, len(x) - 1)) AS pos, unnest(list_transform(x, lambda y: substr(y, 3, length(y) - 4))) AS i
  FROM (SELECT path, title, list_filter(t, lambda y: y[1] = '[') AS x FROM tok)
),
link AS (
  SELECT src, src_title, pos::INT AS pos, CASE WHEN contains(i, '::') THEN trim(substr(i, instr(i, '::') + 2), ' ') ELSE trim(i, ' ') END AS target,
    CASE WHEN contains(i, '::') THEN trim(substr(i, 1, instr(i, '::') - 1), ' ') END AS nature FROM inner_
),
line AS (
  SELECT path, unnest(generate_series(0, len(x) - 1)) AS pos, unnest(x) AS l
  FROM (SELECT path, list_filter(regexp_split_to_array(block, '[\r\n]+'), lambda y: y <> '') AS x FROM n)
),
kv AS (SELECT path, pos, trim(split(l, ':')[1], ' ') AS key, trim(coalesce(split(l, ':')[2], ''), ' ') AS value FROM line),
meta AS (SELECT path, key, arg_max(value, pos) AS value FROM kv WHERE key <> '' GROUP BY path, key),
need AS (SELECT DISTINCT target FROM link UNION SELECT target FROM more_needles),
ranked AS (
  SELECT need.target, n.path AS dst, CASE WHEN n.title = need.target THEN 'exact' WHEN regexp_replace(n.title, '\.md$', '') = need.target THEN 'noext' ELSE 'substring' END AS match,
    row_number() OVER (PARTITION BY need.target ORDER BY CASE WHEN n.title = need.target THEN 0 WHEN regexp_replace(n.title, '\.md$', '') = need.target THEN 1 ELSE 2 END, n.path) AS k
  FROM need JOIN n ON contains(n.title, need.target)
),
res AS (SELECT target, dst, match FROM ranked WHERE k = 1),
edge AS (SELECT link.*, res.dst, res.match FROM link LEFT JOIN res USING (target)),
deg AS (
  SELECT n.path, (SELECT count(*) FROM link WHERE src = n.path) AS out_degree, (SELECT count(*) FROM edge WHERE dst = n.path) AS in_degree FROM n
),
more_needles AS ({needles})
"""


def chain(corpus: str, needles: str = "SELECT NULL::VARCHAR AS target WHERE false") -> str:
    head = CHAIN.replace("{corpus}", corpus)
    # The extra needles come first, so that the resolver sees them.
    body, _, _ = head.rpartition(",\nmore_needles AS")
    return body.replace("need AS (", f"more_needles AS ({needles}),\nneed AS (", 1)


def pagerank(steps: int = 10) -> str:
    """More of the chain: p0 to p{steps}."""
    out = [
        "sz AS MATERIALIZED (SELECT count(*) AS n FROM n)",
        "sh AS MATERIALIZED (SELECT e.src, e.dst, count(*)::DOUBLE / any_value(d.out_degree) AS share FROM edge e JOIN deg d ON d.path = e.src WHERE e.dst IS NOT NULL GROUP BY e.src, e.dst)",
        "p0 AS MATERIALIZED (SELECT path, 1.0::DOUBLE / (SELECT n FROM sz) AS r FROM n)",
    ]
    for i in range(steps):
        out.append(
            f"p{i + 1} AS MATERIALIZED (SELECT n.path, 0.15::DOUBLE / (SELECT n FROM sz) + 0.85::DOUBLE * coalesce(g.s, 0) AS r FROM n "
            f"LEFT JOIN (SELECT dst, sum(p.r * sh.share) AS s FROM sh JOIN p{i} p ON p.path = sh.src GROUP BY dst) g ON g.dst = n.path)"
        )
    return ",\n" + ",\n".join(out)


def components(rounds: int = 14) -> str:
    """More of the chain: comp(path, component), by rounds of smallest labels (enough for these graphs)."""
    out = [
        "both_ AS MATERIALIZED (SELECT src AS a, dst AS b FROM edge WHERE dst IS NOT NULL UNION SELECT dst, src FROM edge WHERE dst IS NOT NULL)",
        "l0 AS MATERIALIZED (SELECT path, path AS c FROM n)",
    ]
    for i in range(rounds):
        out.append(f"l{i + 1} AS MATERIALIZED (SELECT l.path, least(l.c, coalesce(m.c, l.c)) AS c FROM l{i} l LEFT JOIN (SELECT a, min(x.c) AS c FROM both_ JOIN l{i} x ON x.path = b GROUP BY a) m ON m.a = l.path)")
    out.append(f"comp AS MATERIALIZED (SELECT path, c AS component FROM l{rounds})")
    out.append("size_ AS (SELECT component, count(*) AS size FROM comp GROUP BY component)")
    return ",\n" + ",\n".join(out)


def bfs(start: str, depth: int = 14) -> str:
    """More of the chain: dist(path, distance, parent) from the note that ``start`` names."""
    return f""",
hop AS (SELECT DISTINCT src, dst FROM edge WHERE dst IS NOT NULL),
walk(path, d) AS (SELECT dst, 0 FROM res WHERE target = '{start}' UNION SELECT h.dst, w.d + 1 FROM walk w JOIN hop h ON h.src = w.path WHERE w.d < {depth}),
near AS (SELECT path, min(d)::BIGINT AS distance FROM walk GROUP BY path),
dist AS (SELECT b.path, b.distance, (SELECT min(h.src) FROM hop h JOIN near a ON a.path = h.src WHERE h.dst = b.path AND a.distance = b.distance - 1) AS parent FROM near b)"""


def words(source: str = "n") -> str:
    """More of the chain: w(path, words), the distinct words of each content."""
    return rf""",
w AS MATERIALIZED (
  SELECT path, list_distinct(list_filter(regexp_split_to_array(translate(content, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \n\r\t.,!?;:()\[\]{{}}"''#*\-_/\\@<>]+'), lambda x: strlen(x) > 3)) AS words FROM {source}
)"""


def pairs(threshold: float) -> str:
    """More of the chain: pair(source, target, score) between the first paths of equal word sets."""
    return f""",
cls AS MATERIALIZED (SELECT min(path) AS path, list_sort(words) AS words FROM w WHERE len(words) > 0 GROUP BY list_sort(words)),
e AS (SELECT path, len(words) AS n, unnest(words) AS word FROM cls),
cnt AS (SELECT a.path AS source, b.path AS target, a.n AS na, b.n AS nb, count(*) AS c FROM e a JOIN e b ON a.word = b.word AND a.path < b.path GROUP BY 1, 2, 3, 4),
pair AS (SELECT source, target, (c::FLOAT / (na + nb - c)::FLOAT)::FLOAT AS score FROM cnt WHERE (c::FLOAT / (na + nb - c)::FLOAT)::FLOAT >= {threshold}::FLOAT)"""
