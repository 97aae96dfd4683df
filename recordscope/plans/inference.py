"""One inference run: from fact tables to constraints, candidates and documents.

The steps are those of the operators, each on the whole program at once:
interpret the functions below the roots, stitch their graphs at calls and
returns, resolve and spread sizes, cut conflicts, build constraints, find
aliases, references and nests, generate candidates, write documents.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..functions import field_name, unique_names
from ..operators import calls, candidates, constraints, fields, graph, layout, sizes, symbols, types
from ..storage import materialize
from . import facts as build
from .interpreter import field_accesses, interpret

ACCESS = "base string, offset long, field_expr string, op string, access_type string, dt string, size int, scale long"


class Inference(NamedTuple):
    """edges (src, dst, edge_type); sizes (node, size, conflict); members (expr, c); accesses, fields by constraint; marks, refs, nests, candidates; documents (kind, c, doc)."""

    edges: DataFrame
    sizes: DataFrame
    members: DataFrame
    accesses: DataFrame
    fields: DataFrame
    marks: DataFrame
    refs: DataFrame
    nests: DataFrame
    candidates: DataFrame
    documents: DataFrame


def scope(facts: Mapping[str, DataFrame]) -> DataFrame:
    """(func): meaningful functions that the roots of the call graph lead to, and the roots."""
    roots = calls.call_roots(facts["functions"], facts["call_insts"])
    reached = calls.call_graph(facts["functions"], facts["call_insts"], roots)
    every = roots.select("func").unionByName(reached.select(F.col("callee").alias("func"))).distinct()
    return every.join(calls.meaningful(facts["functions"]).select("func"), "func", "left_semi")


def flow_graph(facts: Mapping[str, DataFrame], inside: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, learnt, exprs): the interpreted functions, stitched at calls and returns."""
    named = build.named_symbols(facts["symbols"])
    merged = calls.merged_variables(facts["varnodes"]).join(named.select("func", "sym", "expr"), ["func", "sym"]).select("func", F.col("expr").alias("sym"))
    ops = build.build_ops(facts["pcode_ops"], facts["varnodes"], facts["symbols"]).join(inside, "func", "left_semi")
    learnt, exprs = interpret(ops, merged)
    learnt = materialize(learnt, "learnt")
    sites = facts["call_sites"].join(inside.select(F.col("func").alias("caller")), "caller", "left_semi")
    params = named.where("role = 'param'").select("func", F.col("param_idx").alias("idx"), "expr")
    counts = params.groupBy(F.col("func").alias("callee")).agg(F.count("*").alias("n_params"))
    entries = facts["functions"].select(F.col("func").alias("callee"), F.col("entry").alias("callee_entry"))
    fixed = calls.vararg_functions(sites.join(entries, "callee_entry").select("callee", F.size("args").cast("long").alias("n_args")), counts)
    # An argument's facts are kept by operation and place.
    placed = sites.select("cs", "caller", "callee_entry", F.transform("args", lambda x, i: F.concat_ws(":", F.col("op"), i.cast("string"))).alias("args"), F.when(F.col("receiver").isNotNull(), F.concat("op", F.lit(":r"))).alias("receiver"))
    args = learnt.where("what = 'arg'").select("func", F.concat_ws(":", "op", F.col("n").cast("string")).alias("vn"), F.col("a").alias("expr"))
    received = learnt.where("what = 'receiver'").select("func", F.concat("op", F.lit(":r")).alias("vn"), F.col("a").alias("expr"))
    returns = learnt.where("what = 'return'").select("func", F.col("a").alias("expr")).distinct()
    made = learnt.where("what = 'edge'").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("kind").alias("edge_type"), F.lit(0).alias("ord"))
    passed = calls.stitch_arguments(placed, facts["functions"], params, args, fixed).withColumn("ord", F.lit(1))
    given = calls.stitch_returns(placed, facts["functions"], returns, received).withColumn("ord", F.lit(2))
    return materialize(graph.dedup_edges(made.unionByName(passed).unionByName(given)), "edges"), learnt, exprs


def size_sources(facts: Mapping[str, DataFrame], learnt: DataFrame) -> DataFrame:
    """(expr, size, source_type, on_stack): what allocations, block copies and the symbols' own types tell."""
    names = facts["functions"].where("is_external").select(F.col("entry").alias("callee_entry"), "name")
    sites = facts["call_sites"].join(names, "callee_entry").select(F.col("caller").alias("func"), "op", "cs", "name")
    held = learnt.where("what IN ('arg', 'const_arg', 'receiver')").join(sites, ["func", "op"])
    n = F.col("n").cast("int")
    constant = F.when(F.col("what") == "const_arg", F.struct(n.alias("k"), F.when(F.col("a").startswith("-"), F.lit(-1).cast("long")).otherwise(F.conv(F.regexp_replace("a", "^-?0x", ""), 16, 10).cast("long")).alias("v")))
    expr = F.when(F.col("what") == "arg", F.struct(n.alias("k"), F.col("a").alias("v")))
    per = held.groupBy("cs", "name").agg(F.collect_set(constant).alias("consts"), F.collect_set(expr).alias("exprs"), F.collect_set(F.when(F.col("what") == "receiver", F.col("a"))).alias("receivers"))
    pick = lambda column: F.array(*[F.try_element_at(F.array_sort(F.transform(F.filter(F.col(column), lambda x, k=k: x["k"] == k), lambda x: x["v"])), F.lit(1)) for k in range(3)])
    rows = per.select("cs", "name", pick("consts").alias("arg_values"), pick("exprs").alias("arg_exprs"), F.explode_outer("receivers").alias("receiver"))
    sites_sizes = calls.external_sizes(rows).select(F.col("holder").alias("expr"), "size", F.lit("CALLSITE").alias("source_type"))
    own, _ = build.seeds(facts["symbols"], facts["data_types"])
    both = sites_sizes.unionByName(own.select("expr", "size", F.lit("EXPRESSION").alias("source_type")))
    return both.distinct().withColumn("on_stack", F.col("expr").startswith("&"))


def infer(facts: Mapping[str, DataFrame], pointer_size: int = 8) -> Inference:
    """Runs all steps on fact tables with the schemas of ``sources.FACTS``, by name."""
    inside = materialize(scope(facts), "scope")
    edges, learnt, exprs = flow_graph(facts, inside)

    # Sizes: nodes with several are unions, nodes where they clash are conflicts; neither passes anything on.
    resolved = materialize(sizes.resolve_sizes(size_sources(facts, learnt)), "resolved")
    edges = materialize(graph.without_nodes(edges, resolved.where("is_union").select(F.col("expr").alias("node"))), "edges")
    spread = sizes.propagate_sizes(edges, resolved.where("NOT is_union").select(F.col("expr").alias("node"), "size"))
    edges = materialize(graph.without_nodes(edges, spread.where("conflict").select("node")), "edges")

    # Layouts: what flows together without a conflict is one constraint.
    found = materialize(field_accesses(learnt, exprs), "accesses")
    flow = graph.flow_edges(edges).select("src", "dst")
    _, labels = layout.remove_conflicts(flow, found.select("base", "offset", "size"))
    linked = labels.unionByName(found.select(F.col("base").alias("node"), F.col("base").alias("label")).join(labels.select("node"), "node", "left_anti").distinct())
    members = materialize(linked.select(F.col("node").alias("expr"), F.col("label").alias("c")).distinct(), "members")
    rows = materialize(constraints.build(found, labels), "built")
    loose = constraints.references(found, members, members, pointer_size)
    aliases = constraints.merge_aliases(rows.select("c", "offset", "size").unionByName(members.select("c", F.lit(0).cast("long").alias("offset"), F.lit(0).alias("size")).distinct()), loose.select("c", "offset", "target"))
    rename = aliases.select("c", F.col("label").alias("name"))
    members = materialize(members.join(rename, "c").select("expr", F.col("name").alias("c")), "members")
    rows = materialize(rows.join(rename, "c").drop("c").withColumnRenamed("name", "c"), "accesses")

    profile = materialize(fields.size_profile(rows, ("c", "offset")), "profile")
    modes = materialize(fields.most_accessed(rows, ("c", "offset")), "modes")
    _, told = build.seeds(facts["symbols"], facts["data_types"])
    inferred = materialize(told.join(members, "expr").select("c", "dt", "kind", "length", "element").distinct(), "inferred")
    marks = materialize(constraints.mark_primitive(profile, modes, inferred, pointer_size), "marks")
    refs = constraints.final_references(constraints.references(found, members, members, pointer_size))
    chains = constraints.pointer_chains(refs, profile, pointer_size)
    mids = materialize(profile.join(refs.where("offset = 0").select("c").distinct(), "c", "left_semi").groupBy("c").agg(F.count("*").alias("n"), F.min("offset").alias("o"), F.max("max_size").alias("s"), F.min("min_size").alias("z")).where(f"n = 1 AND o = 0 AND s = {pointer_size} AND z = {pointer_size}").select("c"), "mids")
    marks = materialize(marks.join(mids, "c", "left_anti"), "marks")
    refs = materialize(chains.join(marks.select(F.col("c").alias("target")), "target", "left_anti").select("c", "offset", "target", "ptr_level"), "refs")

    arguments = learnt.where("what = 'arg'").select(F.col("a").alias("expr"))
    nests = materialize(constraints.nesting(constraints.nesting_candidates(arguments, exprs, members), modes, marks, pointer_size), "nests")
    whole = materialize(constraints.populate(modes, nests), "fields")
    kept = materialize(constraints.drop_redundant(rows.select("c").distinct(), whole, marks.where("mark <> 'primitive_array'"), mids), "constraints")

    nested = nests.select(F.col("outer").alias("c"), F.col("delta").alias("offset"))
    free = profile.join(nested, ["c", "offset"], "left_anti")
    kinds = whole.join(refs.select("c", "offset", "ptr_level"), ["c", "offset"], "left").select("c", "offset", "size", F.when(F.col("ptr_level").isNotNull(), types.pointer_to(F.lit("void"), F.col("ptr_level"))).otherwise(F.col("dt")).alias("kind"))
    kinds = materialize(kinds, "kinds")
    made = candidates.generate(kept, kinds, free, rows.select("c", "offset", F.col("size").cast("long").alias("size")).distinct(), refs, marks)
    made = materialize(made, "candidates")
    return Inference(edges, spread, members, rows, whole, marks, refs, nests, made, documents(kept, whole, refs, nests, made, kinds, rows, inferred))


def documents(kept: DataFrame, whole: DataFrame, refs: DataFrame, nests: DataFrame, made: DataFrame, kinds: DataFrame, rows: DataFrame, inferred: DataFrame) -> DataFrame:
    """(kind, c, doc): one document of each constraint, by what there is to say of it."""
    nest = nests.select(F.col("outer").alias("c"), F.col("delta").alias("offset"), F.col("inner").alias("target"))
    told = inferred.join(kept, "c", "left_semi").where("kind <> 'array'")
    untold = kept.join(told.select("c").distinct(), "c", "left_anti")
    chosen = materialize(made.join(untold, "c", "left_semi").withColumn("key", F.concat_ws("|", "c", "scope", F.coalesce(F.col("start").cast("string"), F.lit("")), F.coalesce(F.col("end").cast("string"), F.lit("")), "name")), "chosen")
    plain = whole.join(refs.select("c", "offset", F.col("target"), "ptr_level"), ["c", "offset"], "left")
    pointer = F.col("ptr_level").isNotNull()
    member = plain.select(
        "c", "offset", "size", F.when(pointer, types.pointer_to(F.lit("void"), F.col("ptr_level"))).otherwise(F.col("dt")).alias("type"),
        F.when(pointer, F.concat_ws("_", field_name(F.col("offset"), F.lit("pointer")), "target")).otherwise(field_name(F.col("offset"), F.lit("primitive"))).alias("name"), F.when(pointer, "pointer").otherwise("primitive").alias("kind"),
    )
    anon = candidates.anonymous_records(kinds).select("c", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("name").alias("anon"), "shape", "repeats").dropDuplicates(["c", "start", "end"])
    struct = chosen.where("kind <> 'primitive'").select("key", "c", "start", "end", "name", F.col("kind").alias("what"))
    held = struct.join(member.withColumnsRenamed({"name": "field", "kind": "field_kind"}), "c")
    inside = (F.col("what") != "struct") & (F.col("offset") >= F.col("start")) & (F.col("offset") < F.col("end"))
    outside = held.where(F.col("start").isNull() | ~inside).select("key", "offset", "size", "type", F.col("field").alias("name"), F.col("field_kind").alias("kind"))
    # A variant's own size stands at the start of its range.
    own = F.when(F.col("name").rlike("^struct_.*_[0-9]+$") & (F.col("start") == F.col("offset")), F.regexp_extract("name", "_([0-9]+)$", 1).cast("int"))
    sized = held.where(F.col("start").isNull() | ~inside).where(own.isNotNull() & (F.col("field_kind") != "pointer")).select("key", "offset", own.alias("own")).distinct()
    outside = outside.join(sized, ["key", "offset"], "left").withColumn("size", F.coalesce("own", "size")).drop("own")
    length = (F.col("end") - F.col("start")).cast("int").alias("size")
    spans = struct.where("what <> 'struct'").join(anon, ["c", "start", "end"], "left")
    union_name = unique_names("Union", F.array("c", F.col("start").cast("string")))
    label = F.when(F.col("what") == "union", union_name).when(F.col("what") == "nested_array", types.array_of(F.col("anon"), F.col("repeats"))).otherwise(F.concat(F.lit("array of "), length.cast("string")))
    runs = spans.select("key", F.col("start").alias("offset"), length, label.alias("type"), field_name(F.col("start"), F.when(F.col("what") == "union", "primitive").otherwise("array")).alias("name"), F.when(F.col("what") == "union", "union").otherwise("array").alias("kind"))
    members = outside.unionByName(runs)
    records = sources.anonymous_documents(anon.select(F.col("anon").alias("name"), "shape"))
    anonymous = spans.where("what = 'nested_array'").select("key", F.col("anon").alias("name")).join(records, "name")
    ranges = struct.where("what = 'union'").select("key", "c", F.col("start").alias("offset"), union_name.alias("name"))
    unions = sources.union_layout(ranges.join(rows.select("c", "offset", F.col("dt").alias("type"), "size", F.lit("primitive").alias("kind")).distinct(), ["c", "offset"]), "key")
    anonymous = anonymous.unionByName(unions.join(ranges.select("key", "name"), "key").select("key", "name", "doc"))
    by_key = lambda table: struct.select("key", "c").join(table, "c").drop("c")
    full = sources.full_documents(members, by_key(refs.select("c", "offset", "target", "ptr_level")), by_key(nest), anonymous, by_key(inferred.select("c", "dt", "kind")), "key")
    primitive = chosen.where("kind = 'primitive'").select("key", F.to_json(F.struct(F.lit("Primitive").alias("desc"), F.col("name").alias("type"))).alias("doc"))
    stem = F.when(F.col("kind") == "primitive", F.col("name")).otherwise(unique_names("Struct", F.array("key")))
    docs = materialize(chosen.select("key", "c", "scope", "start", "end", stem.alias("name")).join(full.unionByName(primitive), "key"), "docs")
    out = sources.final_documents(docs.where("scope = 'final'")).unionByName(sources.global_documents(docs.where("scope = 'global'"))).unionByName(sources.range_documents(docs.where("scope = 'range'")))
    return out.unionByName(sources.inferred_documents(told))


def variable_index(facts: Mapping[str, DataFrame], members: DataFrame) -> DataFrame:
    """(func, doc): each function's parameters and locals with their constraints, by location."""
    named = symbols.located(build.named_symbols(facts["symbols"])).where("role <> 'global'")
    reached = members.select("expr", "c").unionByName(members.where(F.col("expr").startswith("&")).select(F.expr("substring(expr, 2)").alias("expr"), "c"))
    stack = F.when(F.col("storage_kind") == "stack", "stack").otherwise("pointer")
    rows = named.join(reached, "expr", "left").join(facts["functions"].select("func", F.col("name").alias("func_name")), "func")
    return sources.variable_index(rows.select("func", "func_name", "role", "loc", "name", stack.alias("desc"), "c"))
