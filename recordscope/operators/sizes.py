"""Size sources: resolution, and propagation over the type-flow graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize, release, replace
from .graph import flow_edges, path_exists, reach, without_edges


def resolve_sizes(sources: DataFrame) -> DataFrame:
    """(expr, size, is_union): the size of each expression, or union if several are left.

    sources: (expr, size, source_type CALLSITE or EXPRESSION, on_stack). For
    stack variables, call-site sizes count if there are any. Elsewhere, of one
    size of each type the larger counts.
    """
    site, own = F.col("source_type") == "CALLSITE", F.col("source_type") == "EXPRESSION"
    per = sources.groupBy("expr").agg(
        F.bool_or("on_stack").alias("stack"), F.count_distinct(F.when(site, F.col("size"))).alias("n_site"), F.count_distinct(F.when(own, F.col("size"))).alias("n_own"),
        F.max(F.when(site, F.col("size"))).alias("site"), F.max(F.when(own, F.col("size"))).alias("own"), F.count_distinct("size").alias("n"), F.max("size").alias("only"),
    )
    size = F.when(F.col("n") == 1, F.col("only")).when(F.col("stack") & (F.col("n_site") == 1), F.col("site")).when(~F.col("stack") & (F.col("n_site") == 1) & (F.col("n_own") == 1), F.greatest("site", "own"))
    return per.select("expr", size.alias("size"), size.isNull().alias("is_union"))


def propagate_sizes(edges: DataFrame, sources: DataFrame, passes: tuple[bool, ...] = (True, False)) -> DataFrame:
    """(node, size, conflict): sizes spread along the edges, forward, then backward.

    In a round, each frontier node offers its size to its neighbours at once.
    A node without a size takes the one that is offered; offers that differ,
    or that differ from its own, make it a conflict node, which keeps the
    smallest and offers nothing. sources: (node, size).
    """
    known = materialize(sources.groupBy("node").agg(F.min("size").alias("size"), (F.count_distinct("size") > 1).alias("conflict")), "sizes")
    table = known
    flow = flow_edges(edges) if "edge_type" in edges.columns else edges
    for forward in passes:
        a, b = ("src", "dst") if forward else ("dst", "src")
        step = materialize(flow.select(F.col(a).alias("node"), F.col(b).alias("to")).where("node <> to").distinct(), "steps")
        front = known.where(~F.col("conflict")).select("node", "size")
        while True:
            offers = front.join(step, "node").groupBy(F.col("to").alias("node")).agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
            after = known.join(offers, "node", "full").select(
                "node", F.coalesce("size", "lo").alias("size"), F.coalesce("conflict", F.lit(False)).alias("was"), F.col("size").isNull().alias("new"),
                (F.coalesce("conflict", F.lit(False)) | F.coalesce((F.col("lo") != F.col("hi")) | (F.coalesce("size", "lo") != F.col("lo")), F.lit(False))).alias("conflict"),
            )
            after = replace(table, after, "sizes")
            table, known = after, after.select("node", "size", "conflict")
            front = after.where("new AND NOT conflict").select("node", "size")
            if front.isEmpty():
                break
        release(step)
    return known


def wrapper_sizes(edges: DataFrame, allocations: DataFrame, constants: DataFrame, depth: int = 10) -> DataFrame:
    """(receiver, cs, size): sizes of allocation wrappers' results.

    allocations: (cs, size_expr, result), calls of an allocator with a size
    that is not constant; constants: (expr, cs, value, receiver), call sites
    that pass a constant. Constants that reach the size within ``depth`` edges
    are candidates; those whose receiver the allocator's result flows to stay.
    """
    flow = materialize(flow_edges(edges), "flow")
    back = reach(flow, allocations.select(F.col("size_expr").alias("node")), forward=False, depth=depth)
    candidates = allocations.join(back.select(F.col("seed").alias("size_expr"), F.col("node").alias("expr")), "size_expr").join(constants.withColumnRenamed("cs", "at"), "expr")
    candidates = materialize(candidates.select("result", "receiver", F.col("at").alias("cs"), F.col("value").alias("size")).distinct(), "candidates")
    ok = path_exists(flow, candidates.select(F.col("result").alias("src"), F.col("receiver").alias("dst")).distinct()).where("has_path").select(F.col("src").alias("result"), F.col("dst").alias("receiver"))
    return candidates.join(ok, ["result", "receiver"], "left_semi").select("receiver", "cs", "size").distinct()


def cut_wrappers(edges: DataFrame, returns: DataFrame) -> DataFrame:
    """edges without those from a wrapper's returned expression to a receiver that the allocation reaches. returns: (src, dst)."""
    return without_edges(edges, path_exists(flow_edges(edges), returns.select("src", "dst").distinct()).where("has_path"))
