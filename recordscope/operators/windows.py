"""Repeats of field patterns in a layout, found with window functions.

A window is a run of ``capacity`` consecutive fields. Windows that start
``capacity`` fields apart form a chain; a repeat is a stretch of a chain whose
windows look alike and follow each other at the window's aligned size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def aligned_window_size(elements: Column) -> Column:
    """Size of a record with these elements (struct with size and align): each padded to its alignment, the end to the largest."""
    def up(value: Column, align: Column) -> Column:
        return F.ceil(value / align).cast("long") * align

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(1).cast("long").alias("most"))
    return F.aggregate(elements, zero, lambda t, e: F.struct((up(t["at"], e["align"].cast("long")) + e["size"]).alias("at"), F.greatest(t["most"], e["align"].cast("long")).alias("most")), lambda t: up(t["at"], t["most"]))


def contiguous(elements: Column) -> Column:
    """Whether each element (offset, size, align) starts where the one before ends, after padding."""
    start = F.element_at(elements, 1)["offset"].cast("long")
    zero = F.struct(start.alias("end"), F.lit(True).alias("ok"))

    def step(t: Column, e: Column) -> Column:
        align = e["align"].cast("long")
        padded = start + F.ceil((t["end"] - start) / align).cast("long") * align
        return F.struct((e["offset"].cast("long") + e["size"]).alias("end"), (t["ok"] & (padded == e["offset"])).alias("ok"))

    return F.aggregate(elements, zero, step, lambda t: t["ok"])


def field_windows(fields: DataFrame, capacity: int, base: str = "base", blocked: str | None = None, pointer_size: int = 8) -> DataFrame:
    """(base, idx, offset, elements, shape, span): every usable window. fields: base, offset, size, kind (a pointee or the size's name).

    Left out: windows over a blocked field, a lone pointer-sized field, alike
    fields for capacities above 1, and fields that don't follow each other.
    """
    order = Window.partitionBy(base).orderBy("offset")
    align = F.least(F.greatest(F.col("size"), F.lit(1)), F.lit(pointer_size))
    entry = F.struct("offset", "size", align.alias("align"), "kind", F.coalesce(F.col(blocked), F.lit(False)).alias("blocked") if blocked else F.lit(False).alias("blocked"))
    numbered = fields.withColumn("idx", F.row_number().over(order) - 1).withColumn("elements", F.collect_list(entry).over(order.rowsBetween(0, capacity - 1)))
    full = numbered.where(F.size("elements") == capacity).where(~F.exists("elements", lambda e: e["blocked"]))
    if capacity == 1:
        full = full.where(F.col("size") != pointer_size)
    else:
        full = full.where(F.size(F.array_distinct(F.transform("elements", lambda e: e["kind"]))) > 1).where(contiguous(F.col("elements")))
    shape = F.transform("elements", lambda e: F.struct((e["offset"] - F.col("offset")).alias("at"), e["size"].alias("size"), e["kind"].alias("kind")))
    return full.select(base, "idx", "offset", "elements", shape.alias("shape"), aligned_window_size(F.col("elements")).alias("span"))


def repeats(windows: DataFrame, capacity: int, threshold: int, base: str = "base") -> DataFrame:
    """(base, start, end, repeats, capacity, shape): the longest repeats of at least ``threshold`` windows."""
    chain = Window.partitionBy(base, "lane").orderBy("idx")
    lanes = windows.withColumn("lane", F.col("idx") % capacity)
    before = {c: F.lag(c).over(chain) for c in ("idx", "offset", "shape", "span")}
    goes_on = (F.col("idx") - before["idx"] == capacity) & (F.col("shape") == before["shape"]) & (F.col("offset") - before["offset"] == before["span"])
    lanes = lanes.withColumn("_break", F.when(goes_on, 0).otherwise(1)).withColumn("_island", F.sum("_break").over(chain))
    runs = lanes.groupBy(base, "lane", "_island").agg(F.min("offset").alias("start"), F.count("*").alias("repeats"), F.min_by("span", "idx").alias("span"), F.min_by("shape", "idx").alias("shape"))
    return runs.where(F.col("repeats") >= threshold).select(base, "start", (F.col("start") + F.col("repeats") * F.col("span")).alias("end"), "repeats", F.lit(capacity).alias("capacity"), "shape")


def primitive_repeats(fields: DataFrame, base: str = "base", threshold: int = 4, pointer_size: int = 8) -> DataFrame:
    """Runs of single fields of one type: arrays of a primitive. They start at aligned offsets."""
    found = repeats(field_windows(fields, 1, base, pointer_size=pointer_size), 1, 1, base)
    # A run that starts unaligned counts from its first aligned field on.
    size = F.element_at("shape", 1)["size"]
    skip = F.pmod(-F.col("start"), F.lit(pointer_size)) / size
    whole = found.where(F.pmod(-F.col("start"), F.lit(pointer_size)) % size == 0).withColumn("_skip", skip.cast("long"))
    return whole.select(base, (F.col("start") + F.col("_skip") * size).alias("start"), "end", (F.col("repeats") - F.col("_skip")).alias("repeats"), "capacity", "shape").where(F.col("repeats") >= threshold)


def complex_repeats(fields: DataFrame, base: str = "base", threshold: int = 3, most: int | None = None, pointer_size: int = 8) -> DataFrame:
    """Repeats of windows of 2 or more unlike fields (at most ``most``, if given), without those inside of a repeat of the same shape.

    A window has at most a base's fields over the threshold, or over 2 if that
    is more; the largest base sets the number of capacities.
    """
    if most is None:
        largest = fields.groupBy(base).count().agg(F.max("count")).first()[0] or 0
        most = largest // max(2, threshold)
    out = None
    for capacity in range(2, max(2, most) + 1):
        found = repeats(field_windows(fields, capacity, base, pointer_size=pointer_size), capacity, threshold, base)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy(base, "shape").orderBy("start", F.desc("end"), "capacity").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("_reach", F.max("end").over(order)).where(F.col("_reach").isNull() | (F.col("end") > F.col("_reach"))).drop("_reach")
