"""Mixing sources to target weights.

Each row gets a hash-random key; within a source, rows are ordered by it and a distributed prefix
sum of sizes (blocks of the key's range, about sqrt(n) of them) tells which rows lie before the
cut. A source whose target exceeds its size is repeated in whole epochs first, and only the rest of
the target is cut; the document at the cut is taken for exactly the words that are left.

Only doc_id, source and size take part in the sort. For the mix itself, the sums are reduced to the
place of each source's cut, in the order of the key, and how much of the row there is taken: a row
knows by its own key on which side of the cut it lies, so texts are not shuffled at all.

Defined cases: a null or empty text has size 0 and is never taken; a null source is a source of its
own, last in order; rows with equal doc_id are told apart by their texts' hash and then are
interchangeable (if the cut falls among them, they are numbered as they come); a text of any length is
taken whole or cut after a word; an empty table gives an empty result; other columns ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.plans.prefix import numbered_in_parts, prefix_sums
from inkgraph.plans.tables import Scratch

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = 17
SPACES = " \t\n\x0b\f\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) plus target: shares of the whole by weight, none above ``most`` times
    its size. What a capped source cannot take is reshared by weight among the others until none
    is above, which has a closed form: sources fill up in the order of cap / weight.

    One row per source: ranks come from a sort by source, so the table is tiny next to the corpus.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_code_point) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (place + 1).cast("int"))
    cap = F.col("source_size") * most
    ranked = sources.withColumn("w", weight.cast("long")).withColumn("cap", cap)
    fill = Window.orderBy(F.col("cap") / F.col("w"), "source")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = ranked.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest))
    # The first source, in this order, that the level does not fill settles the level of all after it.
    open_ = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    ranked = ranked.withColumn("settled", F.first(open_, ignorenulls=True).over(fill.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.coalesce(F.least(F.col("settled") * F.col("w"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def _key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _text_hash() -> Column:
    return F.md5(F.coalesce(F.col("text"), F.lit("")))


def mix_sizes(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, last_words, taken for every row.

    The mix takes ``epochs`` whole copies and, if ``last_words`` is above 0, one copy cut after that
    many words.
    """
    return _mixed(docs, weights, most, seed, Scratch(docs.sparkSession, "mix")).drop("_th", "_key", "_before", "_cut")


def _mixed(docs: DataFrame, weights: tuple[int, ...], most: int, seed: int, scratch: Scratch) -> DataFrame:
    sized = docs.select("doc_id", "source", words(F.col("text")).alias("size"), _text_hash().alias("_th"), _key(seed).alias("_key"))
    sized = scratch.keep(sized, "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    targets = source_targets(sources.select("source", "source_size"), weights, most)
    blocks = sources.select(F.col("source").alias("_s"), F.ceil(F.sqrt("_rows")).cast("long").alias("_blocks"))
    per_source = blocks.join(targets, F.col("_s").eqNullSafe(F.col("source"))).select("_s", "_blocks", "source_size", "target")
    joined = sized.join(per_source, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # The key's range in _blocks equal parts, in the order of the key.
    high = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    joined = joined.withColumn("_block", F.floor(high * F.col("_blocks") / F.lit(1 << 32)))
    placed = prefix_sums(joined, ["source"], "_block", [F.col("_key"), F.col("_th")], "size", "_before")
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    cut = budget - F.col("epochs") * F.col("source_size")
    placed = placed.withColumn("epochs", epochs).withColumn("_cut", cut)
    placed = placed.withColumn("last_words", F.greatest(F.lit(0), F.least(F.col("size"), F.col("_cut") - F.col("_before"))).cast("long"))
    # At the cap nothing is left after the whole epochs, so no document is taken more than ``most`` times.
    return placed.withColumn("taken", F.col("epochs") * F.col("size") + F.col("last_words")).drop("_blocks", "_block")


def _cuts(placed: DataFrame) -> DataFrame:
    """One row a source: its epochs, the key and text hash of the last row that the cut takes something
    of, and how many words the rows equal to it give together (no key: there is nothing to cut)."""
    at = F.when((F.col("size") > 0) & (F.col("_before") < F.col("_cut")), F.struct("_key", "_th", -F.col("_before")))
    cuts = placed.groupBy(F.col("source").alias("_source")).agg(F.max("epochs").alias("_epochs"), F.max("_cut").alias("_words"), F.max(at).alias("_at"))
    return cuts.select("_source", "_epochs", F.col("_at._key").alias("_last"), F.col("_at._th").alias("_lh"), (F.col("_words") + F.col("_at.col3")).alias("_words"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of ``docs``: whole copies, and the cut one up to a word's end."""
    scratch = Scratch(docs.sparkSession, "mix")
    cuts = scratch.keep(_cuts(_mixed(docs, weights, most, seed, scratch)), "cuts")
    # The row rides along whole, so that no name of its columns can clash.
    rows = docs.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.struct("*").alias("_row"), "source", _key(seed).alias("_k"), "text")
    rows = rows.join(cuts, F.col("source").eqNullSafe(F.col("_source")))
    # Texts are hashed only where the keys are equal.
    side = F.when(F.col("_last").isNull() | (F.col("_k") > F.col("_last")), 1).when(F.col("_k") < F.col("_last"), -1)
    side = side.when(_text_hash() < F.col("_lh"), -1).when(_text_hash() > F.col("_lh"), 1).otherwise(0)
    rows = rows.withColumn("_side", side)

    whole = rows.where("_side != 0").withColumn("_copies", F.col("_epochs") + (F.col("_side") < 0).cast("long")).where("_copies > 0")
    copies = lambda n: F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("_copy")
    whole = whole.select("_row", copies(F.col("_copies"))).select("_row")

    # The rows at the cut: one in each source, or those equal to it, numbered without being brought together.
    place = F.monotonically_increasing_id()
    edge = scratch.keep(rows.where("_side = 0").select("_row", "source", "_epochs", "_words", words(F.col("text")).alias("_size"), place.alias("_m")), "edge")
    nth = numbered_in_parts(edge, "source", "_m", "_nth")
    took = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_words") - F.col("_nth") * F.col("_size"))).cast("long")
    edge = nth.withColumn("_took", took).where("_epochs > 0 or _took > 0")
    edge = edge.select("_row", "_epochs", "_took", "_size", copies(F.col("_epochs") + (F.col("_took") > 0).cast("long")))
    cut = (F.col("_copy") > F.col("_epochs")) & (F.col("_took") < F.col("_size"))
    # The first words with the white space between them; split's limit leaves the rest in one piece.
    tail = F.element_at(F.split(F.ltrim(F.col("_row.text"), F.lit(SPACES)), SPACE_CLASS + "+", (F.col("_took") + 1).cast("int")), -1)
    head = F.rtrim(F.expr("substring(_row.text, 1, char_length(_row.text) - char_length(_tail))"), F.lit(SPACES))
    edge = edge.withColumn("_tail", F.when(cut, tail)).withColumn("_text", F.when(cut, head).otherwise(F.col("_row.text")))
    row = F.col("_row").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("_text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(edge.select(row.alias("_row"))).select("_row.*")


RESULT = ("doc_id", "size", "source_size", "target", "taken")
_ROWS = "ROWS BETWEEN UNBOUNDED PRECEDING AND"
SQL = rf"""
WITH s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS k, md5(coalesce(text, '')) AS th FROM documents
), ranked AS (
  SELECT source, source_size, 3 * source_size AS cap,
    [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS w
  FROM (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source)
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS FIRST {_ROWS} 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS FIRST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), settled AS (
  SELECT *, first_value(CASE WHEN level * w <= cap THEN level END IGNORE NULLS) OVER (ORDER BY cap / w, source NULLS FIRST {_ROWS} CURRENT ROW) AS lvl FROM levels
), targets AS (
  SELECT source, source_size, coalesce(least(lvl * w, cap::DOUBLE), cap::DOUBLE) AS target FROM settled
), placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY k, th {_ROWS} 1 PRECEDING), 0)::BIGINT AS before
  FROM s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM placed
)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::BIGINT AS taken FROM cut
"""
