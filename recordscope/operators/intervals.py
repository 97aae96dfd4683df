"""Conflicts between byte intervals, and merges of ranges.

Two intervals conflict if one starts strictly inside of the other. Equal
starts with different sizes do not: they are union candidates. Lengths are
positive; rows with others are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import unused


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return ((start < other_start) & (other_start < end)) | ((other_start < start) & (start < other_end))


def conflicted(intervals: DataFrame, keys: Sequence[str] = ("base",), start: str = "offset", size: str = "size") -> DataFrame:
    """Keys with at least one conflict among their own intervals.

    No pairs are made: in order of start, a conflict exists if some interval
    starts below the largest end of those that start before it.
    """
    rows = intervals.where(F.col(size) > 0)
    ends = rows.groupBy(*keys, start).agg(F.max(F.col(start) + F.col(size)).alias("_end"))
    before = Window.partitionBy(*keys).orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    return ends.withColumn("_reach", F.max("_end").over(before)).where(F.col("_reach") > F.col(start)).select(*keys).distinct()


def cross_conflicted(intervals: DataFrame, group: str, node: str, start: str = "offset", size: str = "size") -> DataFrame:
    """Groups with a conflict between intervals of two different nodes.

    For each start, the two furthest ends of different nodes among smaller
    starts suffice. A first window keeps the furthest end and its node. What a row
    leaves behind for the second place is its own end, or, where it takes the
    first place from another node, that node's end; a second window keeps the
    largest of these. No rows are paired.
    """
    top, behind, end = unused(intervals.columns, "_top", "_behind", "_end")
    own = F.struct(F.col(end).alias("e"), F.col(node).alias("n"))
    rows = intervals.where(F.col(size) > 0).groupBy(group, node, start).agg(F.max(F.col(start) + F.col(size)).alias(end))
    earlier = Window.partitionBy(group).orderBy(start, end, node).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(top, F.max(own).over(earlier))
    leads = F.col(top).isNull() | (own > F.col(top))
    rows = rows.withColumn(behind, F.when(~leads, F.when(F.col(f"{top}.n") != F.col(node), F.col(end))).when(F.col(f"{top}.n") != F.col(node), F.col(f"{top}.e")))
    smaller = Window.partitionBy(group).orderBy(start).rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(top, F.max(own).over(smaller)).withColumn(behind, F.max(behind).over(smaller))
    other = F.when(F.col(f"{top}.n") != F.col(node), F.col(f"{top}.e")).otherwise(F.col(behind))
    return rows.where(other > F.col(start)).select(group).distinct()


def nest_conflicts(nester: DataFrame, nestee: DataFrame, links: DataFrame) -> DataFrame:
    """Links (outer, inner, delta) where inner's fields, moved by delta, conflict with outer's. Fields: base, offset, size."""
    a = nester.where("size > 0").select(F.col("base").alias("outer"), F.col("offset").alias("ao"), (F.col("offset") + F.col("size")).alias("ae"))
    b = nestee.where("size > 0").select(F.col("base").alias("inner"), F.col("offset").alias("bo"), F.col("size").alias("bs"))
    pairs = links.join(a, "outer").join(b, "inner").withColumn("bo", F.col("bo") + F.col("delta")).withColumn("be", F.col("bo") + F.col("bs"))
    return pairs.where(overlaps(F.col("ao"), F.col("ae"), F.col("bo"), F.col("be"))).select("outer", "inner", "delta").distinct()


def merge_ranges(ranges: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping ranges as one; ranges that only touch stay apart."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.when(F.col(start) < F.max(end).over(before), 0).otherwise(1)
    islands = ranges.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_island")


def in_ranges(points: DataFrame, ranges: DataFrame, keys: Sequence[str], point: str, start: str = "start", end: str = "end") -> DataFrame:
    """Points with start <= point < end for some range of their key; ranges are disjoint, so the last one that starts before decides."""
    both = points.withColumns({"_at": F.col(point), "_end": F.lit(None).cast("long"), "_p": F.lit(1)}).unionByName(ranges.select(*keys, F.col(start).alias("_at"), F.col(end).cast("long").alias("_end"), F.lit(0).alias("_p")), allowMissingColumns=True)
    last = Window.partitionBy(*keys).orderBy("_at", "_p").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_reach", F.last("_end", ignorenulls=True).over(last)).where((F.col("_p") == 1) & (F.col("_reach") > F.col("_at"))).drop("_at", "_end", "_p", "_reach")


def member_conflicts(fields: DataFrame, keys: Sequence[str] = ("base",), offset: str = "offset", size: str = "size", pointer_size: int = 8) -> DataFrame:
    """Fields whose next neighbour is nearer than their size (drop the field) or than a pointer (drop its reference)."""
    gap = F.lead(offset).over(Window.partitionBy(*keys).orderBy(offset)) - F.col(offset)
    return fields.withColumn("gap", gap).where(F.col("gap") < F.greatest(F.col(size), F.lit(pointer_size))).select(*keys, offset, size, "gap", (F.col("gap") < F.col(size)).alias("drop_field"), (F.col("gap") < pointer_size).alias("drop_reference"))


def next_start(intervals: DataFrame, keys: Sequence[str] = ("base",), start: str = "offset", size: str = "size") -> DataFrame:
    """Adds next_start: the first start at or after the interval's end."""
    ends = intervals.select(*keys, start, size, (F.col(start) + F.col(size)).alias("_at"), F.lit(0).alias("_kind"))
    starts = intervals.select(*keys, F.lit(None).cast("long").alias(start), F.lit(None).cast("int").alias(size), F.col(start).cast("long").alias("_at"), F.lit(1).alias("_kind")).distinct()
    ahead = Window.partitionBy(*keys).orderBy("_at", "_kind").rowsBetween(0, Window.unboundedFollowing)
    return ends.unionByName(starts).withColumn("next_start", F.first(F.when(F.col("_kind") == 1, F.col("_at")), ignorenulls=True).over(ahead)).where("_kind = 0").drop("_at", "_kind")
