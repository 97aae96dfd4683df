"""Symbols and variable nodes: which count, and how they are found again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import location_key


def integer_parameters(params: DataFrame, register: str = "reg") -> DataFrame:
    """Parameters that are not passed in vector registers."""
    return params.where(~F.coalesce(F.col(register).contains("XMM"), F.lit(False)))


def split_parameters(symbols: DataFrame, varnodes: DataFrame) -> DataFrame:
    """(func, sym): parameters that aren't isolated and whose instances are in several merge groups."""
    groups = varnodes.where("sym IS NOT NULL").groupBy("func", "sym").agg(F.count_distinct("merge_group").alias("groups")).where("groups > 1")
    return symbols.where("role = 'param' AND NOT is_isolated").join(groups, ["func", "sym"], "left_semi").select("func", "sym")


def used_symbols(symbols: DataFrame, varnodes: DataFrame) -> DataFrame:
    """Symbols with at least one instance."""
    return symbols.join(varnodes.select("func", "sym").distinct(), ["func", "sym"], "left_semi")


def traced_ops(ops: DataFrame, facts: DataFrame) -> DataFrame:
    """Operations with an input that holds a fact."""
    return ops.withColumn("vn", F.explode("input_vns")).join(facts.select("func", "vn").distinct(), ["func", "vn"], "left_semi").select("func", "op").distinct()


def type_through_casts(varnodes: DataFrame, ops: DataFrame, ranks: DataFrame, forward: bool = True) -> DataFrame:
    """(func, vn, dt): a value's type, or that beyond its only CAST if it is more specific.

    ranks: (dt, rank), the host's order of types; higher is more specific. Forward follows a lone use, backward the definition.
    """
    casts = ops.where("opcode = 'CAST'").select("func", F.element_at("input_vns", 1).alias("i"), F.col("output_vn").alias("o"))
    uses = ops.select("func", F.explode("input_vns").alias("i")).groupBy("func", "i").agg(F.count("*").alias("uses"))
    here, there = ("i", "o") if forward else ("o", "i")
    step = casts.join(uses.where("uses = 1"), ["func", "i"], "left_semi") if forward else casts
    step = step.select("func", F.col(here).alias("vn"), F.col(there).alias("other"))
    own = varnodes.select("func", "vn", "dt").join(ranks, "dt", "left")
    beyond = own.select("func", F.col("vn").alias("other"), F.col("dt").alias("dt2"), F.col("rank").alias("rank2"))
    both = own.join(step, ["func", "vn"], "left").join(beyond, ["func", "other"], "left")
    chosen = F.when(F.coalesce("rank2", F.lit(-1)) > F.coalesce("rank", F.lit(-1)), F.col("dt2")).otherwise(F.col("dt"))
    return both.groupBy("func", "vn").agg(F.max_by(chosen, F.coalesce("rank2", F.lit(-1))).alias("dt"))


def located(symbols: DataFrame) -> DataFrame:
    """Adds loc, the key by which a symbol is found again after another decompilation."""
    kind: Column = F.when(F.col("storage_kind") == "stack", "stack").when(F.col("role") == "param", "param").otherwise("register")
    return symbols.withColumn("loc", location_key(F.col("func"), kind, F.col("name"), F.col("stack_offset"), F.col("pc_addr")))


def match_symbols(old: DataFrame, new: DataFrame) -> DataFrame:
    """(loc, old_sym, new_sym) of symbols at the same place before and after."""
    return located(old).select("loc", F.col("sym").alias("old_sym")).join(located(new).select("loc", F.col("sym").alias("new_sym")), "loc")


def in_category(types: DataFrame, root: str) -> DataFrame:
    """Types of a category and of those below it."""
    path = F.col("category")
    return types.where((path == root) | path.startswith(root.rstrip("/") + "/"))


def complex_types(types: DataFrame) -> DataFrame:
    """Structures, unions, and pointers to them; typedefs resolved by the caller. types: (dt, kind, pointee_kind)."""
    composite = F.col("kind").isin("struct", "union")
    return types.where(composite | ((F.col("kind") == "pointer") & F.col("pointee_kind").isin("struct", "union")))
