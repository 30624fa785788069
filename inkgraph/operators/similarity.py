"""Word-set similarity: classes of equal sets, an exact prefix-filtered join, top lists.

Notes with equal word sets are one class, so copies cost one row each and never a pair each. The
join is exact for thresholds above 0: words are ordered from the rarest on, two sets at the
threshold must share several of their first words, and their sizes must be within a factor t
(``set_join``). Sets of neighbouring sizes are broadcast, so many at once, and all that are large
enough are held against them where they lie; only pairs that may reach the threshold become rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.functions.text import jaccard, word_set
from inkgraph.operators import set_join
from inkgraph.operators.resolve import find_by_title
from inkgraph.plans import sieve
from inkgraph.plans.tables import Scratch

#: Most sets and words that are broadcast at once (a larger set alone).
PASS_SETS, PASS_WORDS = 1 << 15, 6_000_000
#: Less than single-precision rounding can bring a score up to the threshold.
EPS = 1e-6
#: Below any score of two sets with a word in common.
LEAST_SCORE = 1e-12


def word_sets(notes: DataFrame) -> DataFrame:
    """(path, title, words): ``notes`` may be any rows of path and content."""
    extra = ["title"] if "title" in notes.columns else []
    return notes.select("path", *extra, word_set(F.col("content")).alias("words"))


def set_classes(notes: DataFrame) -> DataFrame:
    """(path, rep, n_words): the smallest path with the same word set stands for a class.

    Notes without words are classes of their own.
    """
    keyed = _keyed(notes).drop("words")
    least = keyed.where("n_words > 0").groupBy("fp").agg(F.min("path").alias("rep"))
    return keyed.join(least, "fp", "left").select("path", F.coalesce("rep", "path").alias("rep"), "n_words")


def _keyed(notes: DataFrame) -> DataFrame:
    sets = word_sets(notes).withColumn("words", F.sort_array("words"))
    return sets.select("path", F.sha2(F.array_join("words", " "), 256).alias("fp"), F.size("words").cast("long").alias("n_words"), "words")


def class_pairs(notes: DataFrame, threshold: float) -> DataFrame:
    """(source, target, score) of all pairs of classes with a score of at least ``threshold`` > 0;
    source and target are the classes' representatives, source < target."""
    if threshold <= 0:
        raise ValueError("a threshold of 0 or less admits all pairs")
    spark = notes.sparkSession
    scratch = Scratch(spark, "similarity")
    t = max(threshold - EPS, EPS)
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    every = _keyed(notes).where("n_words > 0 and path is not null")
    every, every_at = scratch.keep_at(every.select("path", F.unhex("fp").alias("fp"), F.col("n_words").alias("n"), hashed.alias("words")), "hashed")
    sets = scratch.keep(_from_the_rarest(_representatives(every, scratch)).sortWithinPartitions("n"), "sets")
    scratch.drop(every_at)
    sizes = sorted((r["n"], r["count"]) for r in sets.groupBy("n").count().collect())
    met = spark.createDataFrame([], PAIR)
    for low, high, part, parts in _passes(sizes):
        block = sets.where(F.col("n").between(low, high))
        if parts > 1:
            block = block.where(F.pmod(F.xxhash64("fp"), F.lit(parts)) == part)
        probes = sets.where((F.col("n") >= low) & (F.col("n") * t - EPS <= high))
        met = met.unionAll(_met(block, probes, t, scratch))
    scored = met.select("source", "target", jaccard(F.col("common"), F.col("na"), F.col("nb")).alias("score"))
    return scored.where(F.col("score") >= F.lit(threshold).cast("float"))


PAIR = "source string, target string, common long, na long, nb long"


def _representatives(every: DataFrame, scratch: Scratch) -> DataFrame:
    """The first row by path of each fingerprint; only the others' rows are moved with their words."""
    named = every.select("fp", "path")
    several = named.groupBy("fp").agg(F.min("path").alias("rep"), F.count("*").alias("c")).where("c > 1")
    several = scratch.keep(several.select("fp", "rep"), "several")
    shared = sieve.split(named, ["fp"], several)[0].groupBy("fp", "path").agg(F.count("*").alias("c")).join(several, "fp")
    moved = scratch.keep(shared.where("path != rep or c > 1").select("fp", "path", F.expr("path = rep").alias("stays")), "moved")
    concerned, clear = sieve.split(every, ["fp", "path"], moved)
    concerned = concerned.join(moved, ["fp", "path"], "left").where("coalesce(stays, true)").dropDuplicates(["fp"])
    return clear.unionByName(concerned.drop("stays"))


def _from_the_rarest(sets: DataFrame) -> DataFrame:
    """The sets' words as bytes, in the order of how often words of their bucket are found."""
    bucket = F.col("w").bitwiseAND(F.lit((1 << set_join.RARITY_BITS) - 1)).cast("int")
    counts = sets.select(F.explode("words").alias("w")).groupBy(bucket.alias("b")).count().toArrow()
    level = set_join.levels(counts["b"].to_numpy(), counts["count"].to_numpy())

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column(3), batch.column(2)
            found = set_join.ordered(words.flatten().to_numpy(), n.to_numpy(), level)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n, pa.array(found, pa.binary())], names=["path", "fp", "n", "words"])

    return sets.select("path", "fp", "n", "words").mapInArrow(order, "path string, fp binary, n long, words binary")


def _passes(sizes: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """(low, high, part, parts): sizes that are broadcast together, or a size whose sets are dealt into parts."""
    low = high = sets = words = 0
    for n, count in sizes:
        if sets and (sets + count > PASS_SETS or words + n * count > PASS_WORDS):
            yield low, high, 0, 1
            sets = words = 0
        if count > PASS_SETS or (n * count > PASS_WORDS and count > 1):
            parts = min(count, max(-(-count // PASS_SETS), -(-n * count // PASS_WORDS)))
            yield from ((n, n, part, parts) for part in range(parts))
            continue
        low, high, sets, words = n if not sets else low, n, sets + count, words + n * count
    if sets:
        yield low, high, 0, 1


def _met(block: DataFrame, probes: DataFrame, t: float, scratch: Scratch) -> DataFrame:
    """Pairs of one of the block's sets with one of ``probes`` of no less than its size, as PAIR, each pair once."""
    rows = block.toArrow().sort_by("n")
    sizes, sets = rows["n"].to_numpy(), rows["words"].to_pylist()
    names = rows["path"].to_pylist(), rows["fp"].to_pylist()
    del rows
    sent = block.sparkSession.sparkContext.broadcast((list(set_join.blocks(sizes, sets, t)), names))
    del sets

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, (paths, fps) = sent.value
        for batch in batches:
            own, prints, n, words = batch.column(0), batch.column(1), batch.column(2).to_numpy(), batch.column(3).to_pylist()
            for first, some in held:
                for i, j in some.candidates(n, words):
                    # Of two sets of one size each meets the other.
                    once = [some.sizes[y] < n[x] or fps[first + y] < prints[x].as_py() for x, y in zip(i.tolist(), j.tolist(), strict=True)]
                    i, j = i[once], j[once]
                    if not len(i):
                        continue
                    common = some.common(words, i, j)
                    a, b = own.take(pa.array(i)).to_pylist(), [paths[first + y] for y in j.tolist()]
                    ends = [(x, y) if x < y else (y, x) for x, y in zip(a, b, strict=True)]
                    columns = [[x for x, _ in ends], [y for _, y in ends], common, n[i], some.sizes[j]]
                    met = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["source", "target", "common", "na", "nb"])
                    yield met.filter(pa.array([x != y for x, y in ends]))

    got = scratch.keep(probes.select("path", "fp", "n", "words").mapInArrow(meet, PAIR), "met")
    sent.destroy()
    return got


def _score(a: Column, b: Column) -> Column:
    return jaccard(F.size(F.array_intersect(a, b)), F.size(a), F.size(b))


def similar_notes(notes: DataFrame, needle: str, k: int = 5) -> DataFrame:
    """(path, title, score): the k notes most like the one that ``needle`` names, best first.

    The one note is a broadcast row; all others are scored in one narrow pass.
    """
    one = find_by_title(notes, needle).select(F.col("path").alias("_p"), word_set(F.col("content")).alias("_own"))
    if one.isEmpty():
        raise LookupError(f"no note is named {needle!r}")
    met = word_sets(notes).join(F.broadcast(one), F.col("path") != F.col("_p"))
    scored = met.select("path", "title", _rounded(_score(F.col("words"), F.col("_own"))).alias("score"))
    return scored.where("score > 0").orderBy(F.desc("score"), "path").limit(k)


def _rounded(score: Column) -> Column:
    return F.round(score.cast("double"), 6)


def _linked() -> Column:
    """Whether either note has a link whose target is part of the other's title."""
    holds = lambda links, title: F.exists(F.col(links), lambda x: F.col(title).contains(x["target"]))
    return holds("la", "tb") | holds("lb", "ta")


def _class_sources(of: DataFrame, classes: DataFrame, after: int, upto: int) -> DataFrame:
    """(source, target, score, path, other, nth): of each pair of classes, its notes ``after`` < nth <= ``upto``
    by path, with the class their partners are in."""
    ends = [of.select("source", "target", "score", F.col("source").alias("rep"), F.col("target").alias("other"))]
    ends.append(of.where("source <> target").select("source", "target", "score", F.col("target").alias("rep"), F.col("source").alias("other")))
    every = ends[0].unionAll(ends[1]).join(classes.select("rep", "path"), "rep")
    nth = F.row_number().over(Window.partitionBy("source", "target").orderBy("path"))
    return every.withColumn("nth", nth).where(F.col("nth") <= upto).where(F.col("nth") > after).select("source", "target", "score", "path", "other", "nth")


def _partners(sources: DataFrame, classes: DataFrame) -> DataFrame:
    """(source, target, score): each of the notes with all later ones of its partners' class."""
    b = classes.select(F.col("rep").alias("other"), F.col("path").alias("pb"))
    met = sources.select("path", "other", "score").join(b, "other").where(F.col("path") < F.col("pb"))
    return met.select(F.col("path").alias("source"), F.col("pb").alias("target"), "score")


def _filled(notes: DataFrame, some: DataFrame, k: int) -> DataFrame:
    """``some`` pairs and, up to k, the first unlinked ones without a word in common, one source after the other."""
    rows = notes.select("path", F.col("title").alias("tb"), F.col("links").alias("lb"), word_set(F.col("content")).alias("wb"))
    n, after = some.count(), None
    while n < k:
        source = (rows if after is None else rows.where(F.col("path") > after)).orderBy("path").limit(1)
        at = source.select("path").head()
        if at is None:
            break
        after = at["path"]
        one = source.select(F.col("path").alias("source"), F.col("tb").alias("ta"), F.col("lb").alias("la"), F.col("wb").alias("wa"))
        met = rows.join(F.broadcast(one), F.col("path") > F.col("source")).where(~_linked() & (_score(F.col("wa"), F.col("wb")) == 0))
        more = met.select("source", F.col("path").alias("target"), F.lit(0.0).alias("score")).orderBy("target").limit(k - n)
        some = some.unionByName(Scratch(notes.sparkSession, "suggest").keep(more, "more"))
        n = some.count()
    return some


def suggest_links(notes: DataFrame, threshold: float = 0.1, k: int = 10) -> DataFrame:
    """(source, target, score): the k most similar pairs of notes that are not linked yet.

    Pairs of classes are scored first. They are expanded to notes by falling score, in steps of
    distinct scores, only until k unlinked pairs are found; within a step by the first note of a pair,
    one note of each pair of classes, then two, four and so on, only while a later one could still
    come before the k-th pair found. So copies cost one row each unless their pairs are linked.

    A threshold of 0 or less admits pairs with nothing in common too: they come last, by path.
    """
    if threshold <= 0:
        some = suggest_links(notes, LEAST_SCORE, k)
        some = Scratch(notes.sparkSession, "suggest").keep(some, "some")
        return _filled(notes, some, k).orderBy(F.desc("score"), "source", "target").limit(k)
    scratch = Scratch(notes.sparkSession, "suggest")
    pairs = scratch.keep(class_pairs(notes, threshold).select("source", "target", _rounded(F.col("score")).alias("score")), "pairs")
    classes = scratch.keep(set_classes(notes).where("n_words > 0"), "classes")
    ends = notes.select("path", F.col("title").alias("t"), F.col("links").alias("l"))
    best = (F.desc("score"), F.col("source"), F.col("target"))

    def unlinked(met: DataFrame) -> DataFrame:
        ea = ends.select(F.col("path").alias("source"), F.col("t").alias("ta"), F.col("l").alias("la"))
        eb = ends.select(F.col("path").alias("target"), F.col("t").alias("tb"), F.col("l").alias("lb"))
        return met.join(ea, "source").join(eb, "target").where(~_linked()).select("source", "target", "score")

    def expanded(of: DataFrame) -> DataFrame:
        """The first k unlinked pairs of these pairs of classes."""
        top, after, upto = None, 0, 1
        while True:
            sources = scratch.keep(_class_sources(of, classes, after, upto), "sources")
            found = unlinked(_partners(sources, classes))
            top = scratch.keep((found if top is None else top.unionAll(found)).orderBy(*best).limit(k), "top")
            kth = top.agg(F.count("*").alias("n"), F.max_by(F.struct("score", "source"), F.struct(-F.col("score"), "source", "target")).alias("last")).head()
            of = sources.where(F.col("nth") == upto)
            if kth["n"] == k:
                last = kth["last"]
                of = of.where((F.col("score") > last["score"]) | ((F.col("score") == last["score"]) & (F.col("path") < last["source"])))
            of = scratch.keep(of.select("source", "target", "score"), "of")
            if of.isEmpty():
                return top
            after, upto = upto, 2 * upto

    # Classes of several notes pair up within themselves at a score of 1.
    twins = classes.groupBy("rep").agg(F.count("*").alias("n")).where("n > 1")
    within = twins.select(F.col("rep").alias("source"), F.col("rep").alias("target"), F.lit(1.0).alias("score")) if threshold <= 1 else None
    every = pairs if within is None else pairs.unionAll(within)
    every = scratch.keep(every, "every")
    got, n, below = None, 0, None
    while n < k:
        rest = every if below is None else every.where(F.col("score") < below)
        # The score of the k-th pair from here on bounds what has to be looked at next.
        bound = rest.orderBy(F.desc("score")).limit(k).agg(F.min("score")).head()[0]
        if bound is None:
            break
        step = expanded(rest.where(F.col("score") >= bound))
        got = step if got is None else got.unionAll(step)
        n, below = n + step.count(), bound
    if got is None:
        return every.limit(0)
    return got.orderBy(*best).limit(k)
