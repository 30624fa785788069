"""Telling rows apart that a set of keys may concern, before any of them is shuffled.

The keys' hashes mark bits of a bitmap that is broadcast as a table of 64-bit words, at most ``BITS`` / 64
rows however many keys there are. Rows whose bit is not marked surely are not concerned and stay where
they are; only the others need to meet the keys themselves. With n keys about n / ``BITS`` of the rows
are let through needlessly; far beyond ``BITS`` keys all are, and the join is the plain one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgraph.plans.tables import free_name

BITS = 1 << 26


def split(rows: DataFrame, key: list[str], others: DataFrame, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(concerned, clear): the rows of ``rows`` whose ``key`` columns may be among those of ``others``, and
    the rows for which they surely aren't. Both have the columns of ``rows``; null keys are values too."""
    bit = F.xxhash64(*key).bitwiseAND(F.lit(bits - 1))
    at, marks = free_name(rows, "_word"), free_name(rows, "_marks")
    one: Column = F.expr("1L")
    mark = F.call_function("shiftleft", one, bit.bitwiseAND(F.lit(63)).cast("int"))
    words = others.select(F.shiftright(bit, 6).alias(at), mark.alias("m")).groupBy(at).agg(F.bit_or("m").alias(marks))
    probed = rows.withColumn(at, F.shiftright(bit, 6)).join(F.broadcast(words), at, "left")
    hit = F.coalesce(F.call_function("shiftrightunsigned", F.col(marks), bit.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return probed.where(hit).drop(at, marks), probed.where(~hit).drop(at, marks)
