"""Functions, calls and what they pass: predicates, stitching, external models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

# Names of functions that hold no program logic of their own.
TRIVIAL = ("_init", "_start", "_fini", "__do_global_dtors_aux", "frame_dummy", "deregister_tm_clones", "register_tm_clones", "ck_assert_failed")
#: Facts that are kept per variable.
MOST_FACTS = 10


def normal(external: Column, thunk: Column) -> Column:
    return ~external & ~thunk


def meaningful(functions: DataFrame) -> DataFrame:
    """Functions that are neither external, thunks nor trivial."""
    return functions.where(normal(F.col("is_external"), F.col("is_thunk")) & ~F.col("name").isin(*TRIVIAL))


def direct_calls(call_insts: DataFrame, functions: DataFrame) -> DataFrame:
    """(caller, callee): resolved CALL instructions; indirect and unresolved ones are left out."""
    targets = functions.select(F.col("func").alias("callee"), F.col("entry").alias("flow"))
    return call_insts.where((F.col("mnemonic") == "CALL") & F.col("flow").isNotNull()).join(targets, "flow").select("caller", "callee").distinct()


def call_roots(functions: DataFrame, call_insts: DataFrame) -> DataFrame:
    """Meaningful functions that are a main function or that no function calls directly."""
    calls = direct_calls(call_insts, functions)
    kept = meaningful(functions)
    starters = functions.where("name = '_start'").select(F.col("func").alias("caller"))
    started = calls.join(starters, "caller", "left_semi").select(F.col("callee").alias("func"))
    mains = kept.where("name = 'main'").select("func").unionByName(kept.join(started, "func", "left_semi").select("func"))
    uncalled = kept.join(calls.select(F.col("callee").alias("func")).distinct(), "func", "left_anti").select("func")
    return mains.unionByName(uncalled).distinct()


def call_graph(functions: DataFrame, call_insts: DataFrame, roots: DataFrame) -> DataFrame:
    """(caller, callee) edges reached from the roots; only meaningful callees are expanded."""
    edges = materialize(direct_calls(call_insts, functions), "calls")
    inner = meaningful(functions).select(F.col("func").alias("callee"))
    front = materialize(roots.select(F.col("func").alias("caller")).distinct(), "front")
    seen = [front]
    while not front.isEmpty():
        found = edges.join(front, "caller", "left_semi").join(inner, "callee", "left_semi").select(F.col("callee").alias("caller")).distinct()
        for s in seen:
            found = found.join(s, "caller", "left_anti")
        front = materialize(found, "front")
        seen.append(front)
    reached = seen[0]
    for s in seen[1:]:
        reached = reached.unionByName(s)
    return edges.join(reached, "caller", "left_semi").select("caller", "callee")


def vararg_functions(call_sites: DataFrame, params: DataFrame) -> DataFrame:
    """(callee, fixed): callees that are called with different numbers of arguments, and the least of them.

    call_sites: (callee, n_args); params: (callee, n_params).
    """
    counts = call_sites.select("callee", F.col("n_args").alias("n")).unionByName(params.select("callee", F.col("n_params").alias("n")))
    return counts.groupBy("callee").agg(F.count_distinct("n").alias("kinds"), F.min("n").alias("fixed")).where("kinds > 1").select("callee", "fixed")


def merged_variables(varnodes: DataFrame) -> DataFrame:
    """(func, sym): variables whose instances are in more than one merge group."""
    return varnodes.where("sym IS NOT NULL").groupBy("func", "sym").agg(F.count_distinct("merge_group").alias("groups")).where("groups > 1").select("func", "sym")


def stitch_arguments(call_sites: DataFrame, functions: DataFrame, params: DataFrame, facts: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """CALL edges (src, dst): each fact of an argument to the parameter in its place.

    call_sites: (cs, caller, callee_entry, args); params: (func, idx, expr);
    facts: (func, vn, expr). Calls of a function by itself are left out, and
    arguments beyond the fixed number of a callee in fixed (callee, fixed), as vararg_functions gives it.
    """
    if fixed is not None:
        limits = fixed.select(F.col("callee").alias("func"), "fixed")
        params = params.join(limits, "func", "left").where("fixed IS NULL OR idx < fixed").drop("fixed")
    sites = call_sites.join(functions.select(F.col("func").alias("callee"), F.col("entry").alias("callee_entry")), "callee_entry").where("caller <> callee")
    args = sites.select("cs", "caller", "callee", F.posexplode("args").alias("idx", "vn"))
    held = args.join(facts.select(F.col("func").alias("caller"), "vn", F.col("expr").alias("src")), ["caller", "vn"])
    return held.join(params.select(F.col("func").alias("callee"), "idx", F.col("expr").alias("dst")), ["callee", "idx"]).where("src <> dst").select("src", "dst", F.lit("CALL").alias("edge_type")).distinct()


def stitch_returns(call_sites: DataFrame, functions: DataFrame, returns: DataFrame, facts: DataFrame) -> DataFrame:
    """RETURN edges (src, dst): each returned fact of the callee to each fact of the receiver. returns: (func, expr)."""
    sites = call_sites.where("receiver IS NOT NULL").join(functions.select(F.col("func").alias("callee"), F.col("entry").alias("callee_entry")), "callee_entry").where("caller <> callee")
    held = sites.join(returns.select(F.col("func").alias("callee"), F.col("expr").alias("src")), "callee")
    return held.join(facts.select(F.col("func").alias("caller"), F.col("vn").alias("receiver"), F.col("expr").alias("dst")), ["caller", "receiver"]).where("src <> dst").select("src", "dst", F.lit("RETURN").alias("edge_type")).distinct()


#: External functions that tell a size: the arguments to multiply, and whose size it is (None: the receiver).
EXTERNAL = {"malloc": ((0,), (None,)), "calloc": ((0, 1), (None,)), "memset": ((2,), (0,)), "memcpy": ((2,), (0, 1)), "mempcpy": ((2,), (0, 1))}


def external_sizes(calls: DataFrame, models: dict[str, tuple[tuple[int, ...], tuple[int | None, ...]]] = EXTERNAL) -> DataFrame:
    """(cs, holder, size): sizes by known external functions with constant arguments.

    calls: (cs, name, arg_values array<bigint>, arg_exprs array<string>, receiver). More models can be passed.
    """
    out = None
    for name, (factors, holders) in models.items():
        size = F.lit(1).cast("long")
        for k in factors:
            size = size * F.get("arg_values", F.lit(k))
        for h in holders:
            holder = F.col("receiver") if h is None else F.get("arg_exprs", F.lit(h))
            rows = calls.where(F.col("name") == name).select("cs", holder.alias("holder"), size.alias("size")).where("holder IS NOT NULL AND size > 0")
            out = rows if out is None else out.unionByName(rows)
    return out


def calloc_sizes(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cs, size): call sites with both a count and an element size, multiplied."""
    return counts.select("cs", F.col("value").alias("count")).join(sizes.select("cs", F.col("value").alias("each")), "cs").select("cs", (F.col("count") * F.col("each")).alias("size"))


def bounded_facts(facts: DataFrame, most: int = MOST_FACTS) -> DataFrame:
    """At most ``most`` facts per variable, the first in order of their key."""
    order = Window.partitionBy("func", "vn").orderBy("expr")
    return facts.distinct().withColumn("ord", F.row_number().over(order) - 1).where(F.col("ord") < most)
