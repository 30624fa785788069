"""Near-duplicate classes by b-bit MinHash, confirmed on full shingle sets.

1. One pass over the texts makes, for each document, its shingle-set size, a fingerprint of the
   set, the low ``bits`` bits of ``perms`` minima packed into 64-bit words, and one key for each
   band of ``rows`` minima.
2. Documents with equal sets are one class; only one of each class goes on.
3. Classes that share a band key are candidates. A bucket is never expanded into all pairs. First
   each member meets one leader, the member with the most bucket mates, which lies near the middle
   of a group of edited copies. Candidates whose bit count puts the collision-corrected similarity
   far under the threshold are left out; the others are confirmed on the full sets.
4. In the buckets that still hold more than one component, every member outside the bucket's
   largest component is a query: it is tried on full sets, in blocks, against that component and
   against the other outsiders. So every candidate pair is either inside a component or has been
   tried: the components are exactly those of all confirmed candidates.

Texts are shuffled only where a candidate needs them: a bitmap of the ids (``plans.sieve``) is looked up
where the texts lie.

Defined cases: null and empty texts (or texts without words) have an empty set and are linked with
nothing; the rows of one doc_id are one document, in one component whatever their texts, and each keeps
a row; rows with a null doc_id link nothing unless they share a class with an id; texts of any length are
taken whole, their sets compared as sorted arrays; an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgraph.llm.textbuf import Texts, U, mix, shingle_sets
from inkgraph.llm.worker import let_go
from inkgraph.plans import sieve
from inkgraph.plans.components import connected_components
from inkgraph.plans.tables import Scratch

PERMS, ROWS, BITS = 128, 4, 4
SKETCH = "doc_id long, n_shingles long, fp binary, sig array<long>, bands array<long>"
#: Members and queries of one block of the full-set comparison.
BLOCK_MEMBERS, BLOCK_QUERIES = 128, 512
#: Members of a bucket whose signatures one task compares with each other.
BLOCK_SIGNATURES = 2048
#: Standard deviations of the estimate that a candidate may lie under the threshold.
SLACK = 5.0


def _factors(perms: int, seed: int) -> np.ndarray:
    return mix(np.arange(1, perms + 1, dtype=np.uint64) + U(seed)) | U(1)


def minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum of each permutation (an odd multiplier mod 2^64 over mixed hashes)."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 512):
        np.minimum(low, (shingles[a : a + 512, None] * factors[None, :]).min(axis=0), out=low)
    return low


def pack(low: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of the (mixed) minima, 64 / bits to a word."""
    per = 64 // bits
    lanes = (mix(low) & U((1 << bits) - 1)).reshape(-1, per)
    return np.bitwise_or.reduce(lanes << (np.arange(per, dtype=np.uint64) * U(bits)), axis=1)


def estimate(same: int | float, perms: int, bits: int) -> float:
    """Similarity from the number of equal b-bit minima, corrected for chance collisions."""
    by_chance = 2.0**-bits
    return (same / perms - by_chance) / (1 - by_chance)


def least_same(threshold: float, perms: int, bits: int, slack: float = SLACK) -> int:
    """Equal lanes that a pair at the threshold has, less ``slack`` standard deviations."""
    p = threshold + (1 - threshold) * 2.0**-bits
    return max(0, int(np.floor(perms * p - slack * np.sqrt(perms * p * (1 - p)))))


def sketches(docs: DataFrame, width: int, perms: int = PERMS, rows: int = ROWS, bits: int = BITS, carry: tuple[str, ...] = (), seed: int = 7) -> DataFrame:
    """Step 1, for the columns doc_id and text; the ``carry`` columns ride along."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        let_go()
        factors = _factors(perms, seed)
        for batch in batches:
            texts = Texts(batch.column(1))
            sizes, fps, sigs, bands = [], [], [], []
            for s in shingle_sets(texts, width):
                sizes.append(len(s))
                if not len(s):
                    fps.append(None)
                    sigs.append(None)
                    bands.append(None)
                    continue
                low = minima(s, factors)
                key = low.reshape(-1, rows)[:, 0].copy()
                for k in range(1, rows):
                    key = mix(key) + low.reshape(-1, rows)[:, k]
                fps.append(xxhash.xxh3_128_digest(s.tobytes()))
                sigs.append(pack(low, bits).view(np.int64))
                bands.append(mix(key + np.arange(len(key), dtype=np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary()), pa.array(sigs, pa.list_(pa.int64())), pa.array(bands, pa.list_(pa.int64())), *batch.columns[2:]],
                names=["doc_id", "n_shingles", "fp", "sig", "bands", *carry],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", *carry).mapInArrow(make, SKETCH + "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry))


def _same_lanes(a: str, b: str, perms: int, bits: int) -> Column:
    """Number of equal lanes of two packed signatures, in built-in bit operations."""
    one = sum(1 << k for k in range(0, 64, bits))
    one = one - (1 << 64) if one >= 1 << 63 else one
    differ = None
    for k in range(perms * bits // 64):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        folded = x
        for s in range(1, bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, s))
        n = F.bit_count(folded.bitwiseAND(F.lit(one)))
        differ = n if differ is None else differ + n
    return F.lit(perms) - differ


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(shingle_sets(Texts(batch.column(2)), width), shingle_sets(Texts(batch.column(3)), width), strict=True)):
                if len(x) and len(y):
                    both = np.sort(np.concatenate([x, y]))
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    keep[i] = 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("_ta"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("_tb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "_ta", "_tb").mapInArrow(check, "a long, b long")


def _confirmed_in_blocks(queries: DataFrame, members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between the queries and the members of each group.

    Both are rows (to, doc_id, comp) of a group ``to``; comp is the component so far. Queries and
    members of a group are both dealt into blocks and each pair of blocks is one task's work, so a
    large group is spread and no pair becomes a row. Of the links found in a pair of blocks, those
    that join components not yet joined there are given: all connections, at most one link for each.
    """
    sizes = queries.groupBy("to").agg(F.count("*").alias("_q")).join(members.groupBy("to").agg(F.count("*").alias("_m")), "to")
    sizes = sizes.select("to", F.ceil(F.col("_m") / BLOCK_MEMBERS).alias("_mb"), F.ceil(F.col("_q") / BLOCK_QUERIES).alias("_qb"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    # New names on one side: both come from the same tables.
    left = members.join(sizes, "to").join(texts, "doc_id").select("to", "doc_id", "comp", "text", dealt("_mb").alias("m"), every("_qb").alias("q"))
    right = queries.join(sizes, "to").join(texts, "doc_id").select(
        (F.col("to") + 0).alias("to"), F.col("doc_id").alias("asked"), F.col("comp").alias("own"), F.col("text").alias("words"), every("_mb").alias("m"), dealt("_qb").alias("q")
    )

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        let_go()
        found = []
        if len(left) and len(right):
            sets = list(shingle_sets(Texts(left["text"]), width))
            sizes_, flat = np.array([len(x) for x in sets]), np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes_)
            ids, comps = left["doc_id"].to_pylist(), left["comp"].to_pylist()
            root: dict[int, int] = {}

            def find(c: int) -> int:
                while (up := root.get(c, c)) != c:
                    root[c] = root.get(up, up)
                    c = up
                return c

            for o, comp, own in zip(right["asked"].to_pylist(), right["own"].to_pylist(), shingle_sets(Texts(right["words"]), width), strict=True):
                if not len(own):
                    continue
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                common = np.bincount(owner[own[at] == flat], minlength=len(sets))
                for g in np.flatnonzero((100 * common >= percent * (len(own) + sizes_ - common)) & (sizes_ > 0)).tolist():
                    x, y = find(comps[g]), find(comp)
                    if x != y:
                        root[x] = y
                        found.append((max(o, ids[g]), min(o, ids[g])))
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    keys = ["to", "m", "q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "a long, b long")


def _in_blocks(rows: DataFrame, blocks: str, own: str, met: str) -> DataFrame:
    """``rows``, dealt into their bucket's blocks by ``own``, once for each block that ``met`` may name."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    return rows.withColumn(own, F.pmod(F.xxhash64("doc_id"), F.col(blocks))).withColumn(met, every)


def near_duplicate_classes(
    docs: DataFrame, width: int = 5, percent: int = 80, perms: int = PERMS, rows: int = ROWS, bits: int = BITS, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and ``carry`` for every row of ``docs`` (doc_id, text).

    ``width`` is the words of a shingle and ``percent`` the least similarity of a link. A pair at
    a similarity of 0.8 shares no band with a chance of (1 - 0.8^4)^32, below 1e-7.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    gone: list[str] = []

    def keep(df: DataFrame, label: str) -> DataFrame:
        table, at = scratch.keep_at(df, label)
        gone.append(at)
        return table

    enough = least_same(percent / 100, perms, bits)
    near = _same_lanes("sig", "sig2", perms, bits) >= enough
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry)

    def texts_of(ids: DataFrame) -> DataFrame:
        """The texts of these documents, and a few more."""
        return keep(sieve.split(docs.select("doc_id", "text").where("doc_id is not null"), ["doc_id"], ids)[0].distinct(), "texts")

    # Signature and bands are functions of the set, so those of any row of a class serve.
    sketch = keep(sketches(docs, width, perms, rows, bits, carry), "sketch")
    classes = sketch.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bands").alias("bands"))
    classes = keep(classes, "classes")
    got = keep(sketch.join(classes.select("fp", "rep"), "fp", "left").select("doc_id", "n_shingles", "rep", *carry), "rows")
    # The classes of a document that has several belong together, and an empty text of it with them.
    several = got.where("doc_id is not null").groupBy("doc_id").agg(F.min("rep").alias("least"), F.max("rep").alias("most"), F.count("*").alias("n"), F.count("rep").alias("full"))
    several = keep(several.where("least != most or (full > 0 and full < n)").select("doc_id", "least"), "several")
    same = got.join(several, "doc_id").where("rep != least").select(F.col("rep").alias("a"), F.col("least").alias("b")).distinct()

    one = classes.where("rep is not null").select(F.col("rep").alias("doc_id"), "sig", "bands")
    keyed = one.select("doc_id", F.explode("bands").alias("key"))
    mates = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = keep(keyed.join(mates.hint("merge"), "key"), "members")
    sigs = keep(one.select("doc_id", "sig").join(members, "doc_id", "left_semi"), "sigs")
    sig2 = sigs.select(F.col("doc_id").alias("doc2"), F.col("sig").alias("sig2"))

    # Each member with its bucket's leader.
    weight = members.groupBy("doc_id").agg(F.sum("n").alias("w"))
    lead = members.join(weight, "doc_id").groupBy("key").agg(F.max_by("doc_id", F.struct("w", -F.col("doc_id"))).alias("doc2"))
    met = members.join(lead, "key").where("doc_id != doc2").select("doc_id", "doc2").distinct()
    met = met.join(sigs, "doc_id").join(sig2, "doc2").where(near)
    pairs = keep(met.select(F.greatest("doc_id", "doc2").alias("a"), F.least("doc_id", "doc2").alias("b")).distinct(), "pairs")
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    links = keep(_confirmed(pairs, texts, width, percent).unionAll(same).distinct(), "links")
    labels = keep(connected_components(links, scratch), "labels")

    # The buckets that still hold several components.
    comp = F.coalesce("component", "doc_id").alias("comp")
    here = members.join(labels, F.col("doc_id") == F.col("id"), "left").select("key", "doc_id", comp)
    largest = here.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(
        F.max_by("comp", F.struct("c", -F.col("comp"))).alias("to"), F.count("*").alias("k"), F.ceil(F.sum("c") / BLOCK_SIGNATURES).alias("_nb")
    )
    open_ = keep(here.join(largest.where("k > 1").select("key", "to", "_nb"), "key").join(sigs, "doc_id"), "open")
    outside = _in_blocks(open_.where("comp != to"), "_nb", "_i", "_j")
    met = [F.col(c).alias(f"{c}2") for c in ("_i", "_j", "key", "comp", "sig")]
    inside, others = (_in_blocks(open_.where(side), "_nb", "_j", "_i").select(*met) for side in ("comp = to", "comp != to"))
    block = (F.col("key") == F.col("key2")) & (F.col("_i") == F.col("_i2")) & (F.col("_j") == F.col("_j2")) & near
    asked = keep(outside.join(inside, block, "left_semi").select("doc_id", "to", "comp").distinct(), "asked")
    among = outside.join(others, block & (F.col("comp") != F.col("comp2")), "left_semi")
    among = keep(among.select("to", "doc_id", "comp").distinct(), "among")
    # A component that is one document is asked as a pair.
    grown = labels.select(F.col("component").alias("to")).distinct()
    pairs = asked.join(grown, "to", "left_anti").select(F.greatest("doc_id", "to").alias("a"), F.least("doc_id", "to").alias("b")).distinct()
    pairs = keep(pairs.join(links, ["a", "b"], "left_anti"), "pairs")
    asked = asked.join(grown, "to", "left_semi")
    inner = labels.join(asked.select("to").distinct(), F.col("component") == F.col("to")).select("to", F.col("id").alias("doc_id"), F.col("component").alias("comp"))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).unionAll(asked.select("doc_id")).unionAll(among.select("doc_id"))
    texts = texts_of(ids.unionAll(inner.select("doc_id")))
    more = _confirmed(pairs, texts, width, percent).unionAll(_confirmed_in_blocks(asked, inner, texts, width, percent))
    more = keep(more.unionAll(_confirmed_in_blocks(among, among, texts, width, percent)), "links")
    if not more.isEmpty():
        # Components of components: the ends of the new links by their labels so far.
        la, lb = (labels.select(F.col("id").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
        joined = more.join(la, "a", "left").join(lb, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        above = keep(connected_components(joined, scratch), "above")
        named = labels.join(above.withColumnsRenamed({"id": "_i", "component": "_c"}), F.col("component") == F.col("_i"), "left")
        named = named.select("id", F.coalesce("_c", "component").alias("component"))
        labels = keep(named.unionAll(above.join(labels, "id", "left_anti").select("id", "component")), "labels")

    got = got.join(several, "doc_id", "left").withColumn("rep", F.coalesce("rep", "least")).join(labels, F.col("rep") == F.col("id"), "left")
    own = F.coalesce("component", "rep", "doc_id")
    result, _ = scratch.keep_at(got.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"), *carry), "result")
    scratch.drop(*gone)
    return result


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of near-duplicates, with the columns of ``docs``: the one of least
    doc_id. Of rows equal in doc_id and text one stays.

    Rows are known by two hashes of doc_id and text, null or not. Only rows that go, or that others
    repeat, and the few that share a bit of the bitmap with them, are shuffled.
    """
    k1, k2 = "_k1", "_k2"
    keys = [F.xxhash64(F.lit(k), "doc_id", "text").alias(name) for k, name in ((1, k1), (2, k2))]
    found = near_duplicate_classes(docs.select("doc_id", "text", *keys), width, percent, carry=(k1, k2))
    decided = found.groupBy(k1, k2).agg(F.bool_or("kept").alias("_stays"), F.count("*").alias("_n")).where("not _stays or _n > 1")
    decided = Scratch(docs.sparkSession, "neardup").keep(decided.select(k1, k2, "_stays"), "decided")
    # Rows ride along whole, so that no name of their columns can clash. Repeats meet before the shuffle.
    concerned, clear = sieve.split(docs.select(F.struct("*").alias("_row"), *keys), [k1, k2], decided)
    stay = concerned.dropDuplicates([k1, k2]).join(decided, [k1, k2], "left").where("coalesce(_stays, true)")
    return clear.unionByName(stay.drop("_stays")).select("_row.*")
