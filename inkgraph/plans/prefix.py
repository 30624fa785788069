"""Distributed prefix sums within groups, in two levels.

The rows of a group are cut into order-preserving blocks; block totals (map-side combined) are
summed first, then rows within their block. With about sqrt(n) blocks of sqrt(n) rows, no task
holds more than a small part of a group, however hot the group is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgraph.plans.tables import Scratch


def prefix_sums(
    rows: DataFrame, group: list[str], block: str, order: list[Column], value: str, out: str, index: str | None = None
) -> DataFrame:
    """``rows`` plus ``out`` (sum of ``value`` over earlier rows of the group, the row itself not
    counted) and, if asked, ``index`` (number of earlier rows).

    ``block`` must not decrease along ``order`` within a group. Null group keys and blocks are
    values like any other.
    """
    keys = [*group, block]
    totals = rows.groupBy(*keys).agg(F.sum(value).alias("_t"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_base"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"),
    )
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    got = rows.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    if index:
        got = got.withColumn("_at", F.count(F.lit(1)).over(inside))
    got = got.join(offsets, on).withColumn(out, F.col("_base") + F.col("_in"))
    if index:
        got = got.withColumn(index, F.col("_first") + F.col("_at"))
    return got.drop("_base", "_first", "_in", "_at", *[f"_k{i}" for i in range(len(keys))])


def numbered_in_parts(rows: DataFrame, group: str, mark: str, out: str) -> DataFrame:
    """``rows`` plus ``out``: 0, 1, ... within each group, in the order of ``mark``, which holds numbers
    that ``monotonically_increasing_id`` gave and that were written with the rows.

    Rows stay where they are, but for those of a group in one part, counted there first.
    """
    part = F.shiftright(mark, 33)
    earlier = Window.partitionBy("_g").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(F.col(group).alias("_g"), part.alias("_q")).agg(F.count("*").alias("_n"))
    counts = counts.select("_g", "_q", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, part).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)
    got = rows.withColumn("_at", F.count(F.lit(1)).over(inside))
    got = got.join(counts, F.col(group).eqNullSafe(F.col("_g")) & (part == F.col("_q")))
    return got.withColumn(out, (F.col("_base") + F.col("_at")).cast("long")).drop("_g", "_q", "_base", "_at")


def numbered(rows: DataFrame, order: str, out: str, scratch: Scratch) -> DataFrame:
    """``rows`` plus ``out``: 0, 1, ... in the order of a column, without bringing rows together.

    Rows are sorted by range and written with their place in their partition; only one row a
    partition is summed up.
    """
    at = F.monotonically_increasing_id()
    placed = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", at)
    placed = scratch.keep(placed, "numbered")
    part, place = F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    earlier = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(part).agg(F.count("*").alias("_n"))
    counts = counts.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    joined = placed.withColumn("_p", part).join(counts, F.col("_p") == F.col("_q"))
    return joined.withColumn(out, (F.col("_base") + place).cast("long")).drop("_m", "_p", "_q", "_base")
