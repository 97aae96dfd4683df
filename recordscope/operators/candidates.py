"""Candidate layouts of constraints: unions, size variants, repeats, and the plain one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import field_name, hash31, hex_text, unique_names
from .windows import complex_repeats, primitive_repeats


def size_variants(profile: DataFrame, sizes: DataFrame, refs: DataFrame) -> DataFrame:
    """(c, start, end, kind, size): for each field of several sizes that is no reference, a union and one variant for each size.

    profile: (c, offset, min_size, max_size); sizes: (c, offset, size) distinct.
    """
    mixed = profile.where("min_size <> max_size").join(refs.select("c", "offset"), ["c", "offset"], "left_anti").select("c", "offset", (F.col("offset") + F.col("max_size")).alias("end"))
    union = mixed.select("c", F.col("offset").alias("start"), "end", F.lit("union").alias("kind"), F.lit(None).cast("int").alias("size"))
    each = mixed.join(sizes, ["c", "offset"]).select("c", F.col("offset").alias("start"), "end", F.lit("struct").alias("kind"), F.col("size").cast("int").alias("size"))
    return union.unionByName(each)


def repeat_candidates(fields: DataFrame, pointer_size: int = 8) -> DataFrame:
    """(c, start, end, kind, capacity, repeats): the plain layout and the one with an array, for each repeat. fields: (c, offset, size, kind)."""
    base = fields.withColumnRenamed("c", "base")
    found = complex_repeats(base, pointer_size=pointer_size).withColumn("kind", F.lit("nested_array"))
    found = found.unionByName(primitive_repeats(base, pointer_size=pointer_size).withColumn("kind", F.lit("array")))
    both = found.withColumn("kind", F.explode(F.array(F.lit("struct"), F.col("kind"))))
    return both.select(F.col("base").alias("c"), "start", "end", "kind", "capacity", "repeats")


def anonymous_records(fields: DataFrame, pointer_size: int = 8) -> DataFrame:
    """(c, start, end, name, shape, repeats): the anonymous record that each complex repeat is an array of; equal shapes share a name. fields: (c, offset, size, kind)."""
    found = complex_repeats(fields.withColumnRenamed("c", "base"), pointer_size=pointer_size)
    part = lambda x: F.concat_ws(":", x["at"], x["size"], x["kind"])
    # Members are told apart by their places, so the set of them is the shape.
    return found.select(F.col("base").alias("c"), "start", "end", unique_names("Anon", F.transform("shape", part)).alias("name"), "shape", "repeats")


def dedup_candidates(candidates: DataFrame) -> DataFrame:
    """The first by name of candidates with one layout hash in one range. candidates: (c, start, end, name, layout_hash)."""
    order = Window.partitionBy("c", "start", "end", "layout_hash").orderBy("name")
    return candidates.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def generate(constraints: DataFrame, fields: DataFrame, profile: DataFrame, sizes: DataFrame, refs: DataFrame, marks: DataFrame) -> DataFrame:
    """(c, scope, start, end, name, kind, layout_hash): all candidates; a constraint without any gets its plain layout as final.

    Primitive arrays have global candidates, the element type and the plain layout.
    """
    plain = fields.groupBy("c").agg(F.array_sort(F.collect_list(F.struct(F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size")))).alias("layout"))
    none = F.lit(None).cast("long")
    whole = constraints.join(marks.where("mark = 'primitive_array'").select("c", "final_type"), "c")
    whole = whole.select("c", F.lit("global").alias("scope"), none.alias("start"), none.alias("end"), F.explode(F.array(F.struct(F.col("final_type").alias("name"), F.lit("primitive").alias("kind")), F.struct(F.lit("plain").alias("name"), F.lit("struct").alias("kind")))).alias("x"))
    whole = whole.select("c", "scope", "start", "end", "x.name", "x.kind", none.alias("own"))
    others = constraints.join(marks.select("c"), "c", "left_anti")
    at = (F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    variants = size_variants(profile, sizes, refs).select("c", F.lit("range").alias("scope"), *at, F.concat_ws("_", "kind", hex_text(F.col("start")), F.coalesce(F.col("size").cast("string"), F.lit("all"))).alias("name"), "kind", F.col("size").cast("long").alias("own"))
    runs = repeat_candidates(fields).select("c", F.lit("range").alias("scope"), *at, F.concat_ws("_", "kind", hex_text(F.col("start")), F.col("capacity").cast("string")).alias("name"), "kind", none.alias("own"))
    ranged = others.select("c").join(variants.unionByName(runs), "c")
    made = whole.unionByName(ranged)
    final = others.select("c").join(made.select("c").distinct(), "c", "left_anti").select("c", F.lit("final").alias("scope"), none.alias("start"), none.alias("end"), F.lit("plain").alias("name"), F.lit("struct").alias("kind"), none.alias("own"))
    out = made.unionByName(final).join(plain, "c", "left")
    # A variant's layout is the plain one with its own size at the start of its range.
    held = F.transform("layout", lambda f: F.struct(f["offset"].alias("offset"), F.when(F.col("own").isNotNull() & (f["offset"] == F.col("start")), F.col("own")).otherwise(f["size"]).alias("size")))
    key = hash31(F.flatten(F.transform(held, lambda f: F.array(f["offset"], f["size"]))))
    return dedup_candidates(out.withColumn("layout_hash", F.when(F.col("kind") == "struct", F.coalesce(key, F.lit(0))).otherwise(F.xxhash64("name"))).drop("layout", "own"))


def components_by_mode(fields: DataFrame, refs: DataFrame, arrays: DataFrame) -> DataFrame:
    """(c, offset, size, type, name, kind): members of the plain layout: pointers where there is a reference, arrays over their ranges, most accessed types elsewhere.

    arrays: (c, start, end, element_size); fields inside of an array are left out.
    """
    inside = fields.join(arrays, "c").where("offset >= start AND offset < `end`").select("c", "offset").distinct()
    free = fields.join(inside, ["c", "offset"], "left_anti").join(refs.select("c", "offset", F.coalesce("ptr_level", F.lit(1)).alias("ptr_level")), ["c", "offset"], "left")
    kind = F.when(F.col("ptr_level").isNotNull(), "pointer").otherwise("primitive")
    single = free.select("c", "offset", "size", F.when(F.col("ptr_level").isNotNull(), F.concat(F.lit("void"), F.repeat(F.lit("*"), F.col("ptr_level")))).otherwise(F.col("dt")).alias("type"), kind.alias("kind"))
    runs = arrays.select("c", F.col("start").alias("offset"), (F.col("end") - F.col("start")).cast("int").alias("size"), F.concat(F.lit("array of "), F.col("element_size").cast("string")).alias("type"), F.lit("array").alias("kind"))
    return single.unionByName(runs).withColumn("name", field_name(F.col("offset"), F.col("kind")))


def overflowing(members: DataFrame, sizes: DataFrame) -> DataFrame:
    """Members that end beyond their record's size, which is an error of the caller."""
    return members.join(sizes, "c").where(F.col("offset") + members["size"] > F.col("total"))


def retype_variables(accesses: DataFrame, ranges: DataFrame) -> DataFrame:
    """(c, start, end, base): variables that are bases of accesses inside of a candidate's range. accesses: (c, base, offset)."""
    return accesses.join(ranges, "c").where((F.col("start").isNull()) | ((F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end")))).select("c", "start", "end", "base").distinct()


def most_members(layouts: DataFrame, group: str) -> DataFrame:
    """Of each group's layouts (name, members) the one with most members, then the smaller name."""
    order = Window.partitionBy(group).orderBy(F.desc("members"), "name")
    return layouts.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")
