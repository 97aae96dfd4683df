"""From the fact tables to what the interpreter and the size passes read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.types import COMPOSITE

NODE = "struct<vn:string,size:int,sym:string,dt:string,value:long,space:string>"


def symbol_expr(func: Column, sym: Column, role: Column, address: Column) -> Column:
    """A symbol's expression, the same in all functions for a global one and for no other."""
    return F.when(role == "global", F.concat(F.lit("global:0x"), F.lower(F.hex(address)))).otherwise(F.concat(func, F.lit(":"), sym))


def named_symbols(symbols: DataFrame) -> DataFrame:
    """Adds expr."""
    return symbols.withColumn("expr", symbol_expr(F.col("func"), F.col("sym"), F.col("role"), F.col("global_addr")))


def build_ops(pcode_ops: DataFrame, varnodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(func, ord, op, opcode, out, ins): operations in block order with their variable nodes, as the interpreter reads them."""
    names = named_symbols(symbols).select("func", "sym", "expr")
    node = F.struct("vn", F.col("size").cast("int").alias("size"), F.col("expr").alias("sym"), "dt", F.col("value").cast("long").alias("value"), "space").cast(NODE)
    nodes = varnodes.join(names, ["func", "sym"], "left").select("func", "vn", node.alias("node"))
    rows = pcode_ops.select("func", (F.shiftleft(F.col("block").cast("long"), 32) + F.col("seq")).alias("ord"), "op", "opcode", "output_vn", "input_vns")
    ins = rows.select("func", "op", F.posexplode("input_vns").alias("pos", "vn")).join(nodes, ["func", "vn"]).groupBy("func", "op").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("ins"))
    out = nodes.select("func", F.col("vn").alias("output_vn"), F.col("node").alias("out"))
    whole = rows.join(ins, ["func", "op"], "left").join(out, ["func", "output_vn"], "left")
    return whole.select("func", "ord", "op", "opcode", "out", F.coalesce("ins", F.array().cast(f"array<{NODE}>")).alias("ins"))


def seeds(symbols: DataFrame, data_types: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sizes, inferred) that the symbols' own types tell: sizes (expr, size), inferred (expr, dt, kind, length, element).

    A composite variable tells of its address; a pointer to a composite of what it
    points to, so that type is recorded, not the pointer.
    """
    own = data_types.select("dt", "kind", "length", "pointee", "element")
    beyond = data_types.select(F.col("dt").alias("pointee"), F.col("kind").alias("kind2"), F.col("length").alias("length2"), F.col("element").alias("element2"))
    rows = named_symbols(symbols).select("expr", "dt").join(own, "dt").join(beyond, "pointee", "left")
    direct, through = F.col("kind").isin(*COMPOSITE, "array"), (F.col("kind") == "pointer") & F.col("kind2").isin(*COMPOSITE, "array")
    known = rows.where(direct | through).select(
        F.when(direct, F.concat(F.lit("&"), "expr")).otherwise(F.col("expr")).alias("expr"), F.when(direct, F.col("dt")).otherwise(F.col("pointee")).alias("dt"), F.when(direct, F.col("kind")).otherwise(F.col("kind2")).alias("kind"),
        F.when(direct, F.col("length")).otherwise(F.col("length2")).alias("length"), F.when(direct, F.col("element")).otherwise(F.col("element2")).alias("element"),
    )
    sizes = known.where(F.col("kind").isin(*COMPOSITE) & (F.col("length") > 0)).select("expr", F.col("length").cast("long").alias("size")).distinct()
    return sizes, known.distinct()
