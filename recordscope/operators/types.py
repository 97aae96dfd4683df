"""The data-type dimension: navigation, descriptions, library and user types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release, union_all

COMPOSITE = ("struct", "union")


def load_catalogue(types: DataFrame) -> DataFrame:
    """One row per type name; of several the one with the largest length, then the last category."""
    rest = [c for c in types.columns if c != "dt"]
    return types.groupBy("dt").agg(F.max_by(F.struct(*rest), F.struct(F.coalesce("length", F.lit(-1)), F.coalesce("category", F.lit("")))).alias("_")).select("dt", "_.*")


def walk(types: DataFrame) -> DataFrame:
    """(dt, bare, root, ptr_level) of each type: itself without typedefs, the innermost type through typedefs and pointers, and the pointers on the way.

    One walk gives all three. A cycle ends where it closes.
    """
    links = types.select(F.col("dt").alias("root"), F.coalesce("typedef_of", "pointee").alias("to"), F.col("typedef_of").isNull().alias("down")).where("to IS NOT NULL")
    at = types.select("dt", F.lit(None).cast("string").alias("bare"), F.col("dt").alias("root"), F.lit(0).alias("ptr_level"), F.array("dt").alias("seen"), F.lit(True).alias("go"))
    links, at = materialize(links, "links"), materialize(at, "walked")
    done = []
    while not at.isEmpty():
        moved = at.join(links, "root", "left")
        go = F.col("to").isNotNull() & ~F.array_contains("seen", F.coalesce("to", F.lit("")))
        bare = F.coalesce("bare", F.when(F.coalesce("down", F.lit(True)), F.col("root")))
        step = materialize(moved.select(
            "dt", F.when(go, bare).otherwise(F.coalesce(bare, "root")).alias("bare"), F.when(go, F.col("to")).otherwise(F.col("root")).alias("root"),
            (F.col("ptr_level") + (go & F.col("down")).cast("int")).alias("ptr_level"), F.when(go, F.concat("seen", F.array("to"))).otherwise(F.col("seen")).alias("seen"), go.alias("go"),
        ), "walked")
        done.append(step.where("NOT go").select("dt", "bare", "root", "ptr_level"))
        at = step.where("go")
    release(links)
    return union_all(done) if done else at.select("dt", "bare", "root", "ptr_level")


def describe_variable(types: DataFrame) -> DataFrame:
    """(dt, desc, ptr_level): PointerToStruct / Union / Primitive through all pointers, StackStruct / Union, or Primitive."""
    kind = types.select(F.col("dt").alias("k"), "kind")
    out = walk(types).join(kind.select(F.col("k").alias("bare"), F.col("kind").alias("own")), "bare", "left").join(kind.select(F.col("k").alias("root"), F.col("kind").alias("inner")), "root", "left")
    word = lambda c: F.when(c == "struct", "Struct").when(c == "union", "Union").otherwise("Primitive")
    desc = F.when(F.col("own") == "pointer", F.concat(F.lit("PointerTo"), word(F.col("inner")))).when(F.col("own").isin(*COMPOSITE), F.concat(F.lit("Stack"), word(F.col("own")))).otherwise("Primitive")
    return out.select("dt", desc.alias("desc"), F.coalesce("ptr_level", F.lit(0)).alias("ptr_level"))


def pointer_to(name: Column, level: Column) -> Column:
    """The name of a pointer of this level to a type."""
    return F.concat(name, F.when(level > 0, F.concat(F.lit(" "), F.repeat(F.lit("*"), level))).otherwise(F.lit("")))


def array_of(name: Column, length: Column) -> Column:
    """The name of an array of a type."""
    return F.concat(name, F.lit("["), length.cast("string"), F.lit("]"))


def describe_member(kind: Column, element_kind: Column, pointee_kind: Column) -> Column:
    """A member's description by its own kind, an array's elements or a pointer's first pointee (typedefs resolved)."""
    word = lambda c: F.when(c == "struct", "Struct").when(c == "union", "Union").otherwise("Primitive")
    return F.when(kind.isin(*COMPOSITE), F.concat(F.lit("Nested"), word(kind))).when(kind == "array", F.concat(F.lit("ArrayOf"), word(element_kind))).when(kind == "pointer", F.concat(F.lit("PointerTo"), word(pointee_kind))).otherwise("Primitive")


def library_types(types: DataFrame, own_category: str = "/DWARF") -> DataFrame:
    """Composite types outside of the program's own category."""
    return types.where(~F.col("category").startswith(own_category) & F.col("kind").isin(*COMPOSITE)).select("dt").distinct()


def user_types(types: DataFrame, own_category: str = "/DWARF") -> DataFrame:
    """Composite types of the program's own category that no library type shares its name with."""
    own = types.where(F.col("category").startswith(own_category) & F.col("kind").isin(*COMPOSITE)).select("dt").distinct()
    return own.join(library_types(types, own_category), "dt", "left_anti")


def used_library_types(used: DataFrame, user: DataFrame) -> DataFrame:
    """Composite types that variables use and that are not the user's."""
    return used.where(F.col("kind").isin(*COMPOSITE)).select("dt").distinct().join(user.select("dt"), "dt", "left_anti")
