"""Access points, field types, partial layouts and their merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hash31


def dedup_accesses(accesses: DataFrame, keys: Sequence[str] = ("base", "offset", "op")) -> DataFrame:
    """One access per key; of several types the first in order stays."""
    rest = [c for c in accesses.columns if c not in keys]
    return accesses.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_")).select(*keys, "_.*")


def type_counts(accesses: DataFrame, keys: Sequence[str] = ("base", "offset")) -> DataFrame:
    """How often each field is accessed with each type."""
    return accesses.groupBy(*keys, "dt", "size").agg(F.count("*").alias("n"))


def most_accessed(accesses: DataFrame, keys: Sequence[str] = ("base", "offset")) -> DataFrame:
    """Each field's most common type: higher count, then larger size, then smaller name."""
    order = Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("size"), F.asc("dt"))
    return type_counts(accesses, keys).withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def size_profile(accesses: DataFrame, keys: Sequence[str] = ("base", "offset")) -> DataFrame:
    """Smallest and largest size, number of types and whether all sizes are equal, per field."""
    return accesses.groupBy(*keys).agg(F.min("size").alias("min_size"), F.max("size").alias("max_size"), F.count_distinct("dt").alias("types"), F.count("*").alias("accesses")).withColumn("same_size", F.col("min_size") == F.col("max_size"))


def constraint_sizes(profile: DataFrame, sources: DataFrame | None = None, base: str = "base") -> DataFrame:
    """The least size that holds all fields, or the largest known size if that is more."""
    own = profile.groupBy(base).agg(F.max(F.col("offset") + F.col("max_size")).alias("size"))
    if sources is None:
        return own
    known = sources.groupBy(base).agg(F.max("size").alias("known"))
    return own.join(known, base, "full").select(base, F.greatest("size", "known").alias("size"))


def single_field(profile: DataFrame, base: str = "base") -> DataFrame:
    """Bases with one field only, at offset 0: pointers to a primitive."""
    return profile.groupBy(base).agg(F.count("*").alias("fields"), F.min("offset").alias("first")).where("fields = 1 AND first = 0").select(base)


def small_equal_members(profile: DataFrame, base: str = "base", pointer_size: int = 8) -> DataFrame:
    """Bases with several fields, one at 0, all of one size below a pointer's: arrays of a primitive."""
    return profile.groupBy(base).agg(F.count("*").alias("fields"), F.min("offset").alias("first"), F.min("min_size").alias("low"), F.max("max_size").alias("high")).where((F.col("fields") > 1) & (F.col("first") == 0) & (F.col("low") == F.col("high")) & (F.col("high") < pointer_size)).select(base, F.col("high").alias("element_size"))


def merge_layouts(accesses: DataFrame, members: DataFrame, node: str = "base", component: str = "component") -> DataFrame:
    """The union of all members' accesses per component and offset (commutative, associative, idempotent)."""
    joined = accesses.join(members, node)
    return joined.groupBy(component, "offset").agg(F.count_distinct(F.struct(node, "op")).alias("accesses"), F.array_sort(F.collect_set("size")).alias("sizes"), F.array_sort(F.collect_set("dt")).alias("types"))


def merge_skeletons(members: DataFrame, attributes: DataFrame, sizes: DataFrame, elements: DataFrame, inferred: DataFrame, node: str = "base", component: str = "component") -> DataFrame:
    """(component, attributes, sizes, element_sizes, inferred, is_composite): what its nodes' skeletons hold apart from fields, as sorted sets (commutative, associative, idempotent).

    members: (node, component, is_composite); attributes: (node, attr); sizes,
    elements: (node, size); inferred: (node, dt).
    """
    nodes = members.select(node, component, "is_composite")
    out = nodes.groupBy(component).agg(F.bool_or("is_composite").alias("is_composite"))
    for rows, column, name in ((attributes, "attr", "attributes"), (sizes, "size", "sizes"), (elements, "size", "element_sizes"), (inferred, "dt", "inferred")):
        held = nodes.join(rows.select(node, F.col(column).alias("_v")), node).groupBy(component).agg(F.array_sort(F.collect_set("_v")).alias(name))
        kind = dict(rows.dtypes)[column]
        out = out.join(held, component, "left").withColumn(name, F.coalesce(name, F.array().cast(f"array<{kind}>")))
    return out


def layouts(fields: DataFrame, base: str = "base", extra: Column | None = None) -> DataFrame:
    """Each base's fields as one array by offset; a base has few fields, as offsets are bounded."""
    entry = F.struct("offset", "size", "dt") if extra is None else F.struct("offset", "size", "dt", extra)
    return fields.groupBy(base).agg(F.array_sort(F.collect_list(entry)).alias("layout"))


def layout_hash(layout: DataFrame) -> DataFrame:
    """Adds layout_hash over offsets and sizes."""
    flat = F.flatten(F.transform("layout", lambda f: F.array(f["offset"].cast("long"), f["size"].cast("long"))))
    return layout.withColumn("layout_hash", hash31(flat))


def dedup_layouts(layout: DataFrame, base: str = "base") -> DataFrame:
    """One base, the first in order, for each distinct layout, with the number of bases that share it."""
    key = F.array_join(F.transform("layout", lambda f: F.concat_ws(":", f["offset"], f["size"])), ",")
    return layout.select(base, key.alias("layout_key")).groupBy("layout_key").agg(F.min(base).alias(base), F.count("*").alias("bases"))
