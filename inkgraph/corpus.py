"""Corpora of notes derived from the driver's tables, as SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "supplier", "customer", "documents")

#: A graph of regions, nations, suppliers and customers; ``{name}`` stands for a table.
KB = """
SELECT 'region/' || r_name || '.md' AS path, '---' || chr(10) || 'status: active' || chr(10) || 'summary: Region ' || r_name || chr(10) || '---' || chr(10) || '# ' || r_name || ' #region' AS content FROM {region}
UNION ALL SELECT 'nation/' || n_name || '.md', '---' || chr(10) || 'status: active' || chr(10) || '---' || chr(10) || '[[part_of::' || r_name || ']] #nation' FROM {nation} JOIN {region} ON n_regionkey = r_regionkey
UNION ALL SELECT 'supplier/' || s_name || '.md', CASE WHEN s_acctbal >= 0 THEN '---' || chr(10) || 'status: active' || chr(10) || '---' || chr(10) || '[[based_in::' || n_name || ']] #supplier' ELSE 'Supplier ' || s_name || ' #supplier #debt' END FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey
UNION ALL SELECT 'customer/' || c_name || '.md', CASE WHEN c_acctbal >= 0 THEN '[[based_in::' || n_name || ']] [[Segment ' || c_mktsegment || ']] #customer' ELSE 'Orphan customer #debt' END FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
"""

DOCS = "SELECT 'doc/' || CAST(doc_id AS STRING) || '.md' AS path, text AS content FROM {documents}"

#: Small cases: repeated, typed, empty and ambiguous links, cycles, islands, quoting, odd metadata.
MINI_NOTES = {
    "garden/basil.md": "Basil grows quickly in warm soil and warm light.\n",
    "garden/compost.md": "Good compost keeps soil warm, and basil likes warm soil.\n",
    "garden/thyme.md": "Thyme wants dry ground #herb [[basil.md]] [[beds.md]]\n",
    "garden/beds.md": "---\nstatus: open\nseason: spring\nsown: 2025-03-20\n---\n# Which beds\n[[thyme.md]]",
    "garden/pruning.md": "---\nstatus: active\n---\n# Pruning\n[[waits_for::beds.md]]\n[[gives_to::compost.md]]\n#late-summer\n",
    "ring/Oak.md": "leads on to [[Elm]]",
    "ring/Elm.md": "leads on to [[Ash]]",
    "ring/Ash.md": "and back, [[Oak]]",
    "lone/left.md": "my other half: [[right]]",
    "lone/right.md": "and mine: [[left]]",
    "lone/salt.md": "goes with [[pepper]]",
    "lone/pepper.md": "never without [[salt]]",
    "lone/hermit.md": "nobody comes here",
    "_aside/hush.md": "kept out of sight #hidden [[hermit]]",
    "_aside/_still.md": "quieter yet",
    "edge/alpha.md": "---\nstatus: draft\nsummary: First, of \"two\"\nnextPartOf: beta.md\nproblem: none\n---\n[[beta]] [[beta]] [[alpha]] [[missing one]] #x #y",
    "edge/beta.md": "---\npreviousPartOf: alpha.md, gamma , nowhere\nurl: https://example.com\nurl: last: wins\n---\n[[rel::alpha.md]] [[eta.m]] [[]] ##tag #a#b #t[[q]] text.",
    "edge/gamma, comma.md": "Path with a comma [[supports::beta]] #solo [[a::b::c]] [[::Oak]]",
    "edge/blank.md": "",
    "edge/crlf.md": "---\r\nstatus: draft\r\nk:\r\n: no key\r\n---\r\nbody #one,#two. ## headé #café",
    "edge/early.md": "---a: b---c [[Draft [second]]] [[never closed",
    "edge/open.md": "---\nkey: value\nno closing line #open",
    "other/beta.md": "slow stews need patience onions and bones",
    "other/delta.md": "slow stews need patience onions and barley dumplings",
    "other/epsilon.md": "slow stews need patience onions and dumplings [[delta.md]]",
}


def _literal(text: str) -> str:
    """A string in SQL, control characters by their numbers."""
    parts, plain = [], ""
    for c in text:
        if c < " ":
            parts += [f"'{plain}'", f"chr({ord(c)})"]
            plain = ""
        else:
            plain += c.replace("'", "''")
    return " || ".join([*parts, f"'{plain}'"])


MINI = "SELECT * FROM (VALUES " + ", ".join(f"({_literal(p)}, {_literal(t)})" for p, t in MINI_NOTES.items()) + ") AS t(path, content)"


def corpus(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.format(**{t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}))


def duckdb(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})
