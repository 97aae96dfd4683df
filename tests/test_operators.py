"""Operators on small hand-made tables, with results worked out by hand or by brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from recordscope import functions as S
from recordscope.operators import calls, candidates, constraints, fields, graph, intervals, layout, sizes, tournament, types, windows


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.select(*names).collect())


def table(spark, schema, *data):
    return spark.createDataFrame(list(data), schema)


def test_most_accessed_prefers_count_then_size_then_name(spark):
    a = table(spark, "base int, offset int, op int, dt string, size int", (1, 0, 1, "b", 4), (1, 0, 2, "a", 4), (1, 0, 3, "c", 2), (1, 8, 1, "x", 2), (1, 8, 2, "y", 1), (1, 8, 3, "y", 1))
    assert rows(fields.most_accessed(a), "offset", "dt", "n") == [(0, "a", 1), (8, "y", 2)]


def test_signed_constants_extend_the_sign_bit(spark):
    df = table(spark, "v long, n int", (0x80, 1), (0x80000010, 4), (0x7F, 1), (-1, 8)).select(S.signed_constant(F.col("v"), F.col("n")).alias("s"))
    assert [r.s for r in df.collect()] == [-128, -0x7FFFFFF0, 127, -1]


def test_hex_text_goes_both_ways(spark):
    df = table(spark, "v long", (47,), (-88,), (0,)).select("v", S.hex_text(F.col("v")).alias("h")).withColumn("back", S.from_hex_text(F.col("h")))
    assert [(r.h, r.back) for r in df.collect()] == [("0x2f", 47), ("-0x58", -88), ("0x0", 0)]


def clash(a, b):
    return a[0] < b[0] < a[0] + a[1] or b[0] < a[0] < b[0] + b[1]


def test_conflicts_equal_brute_force(spark):
    rng = random.Random(3)
    data = sorted({(g, n, rng.randrange(12), rng.choice([1, 2, 4, 8])) for g in range(40) for n in range(3) for _ in range(2)})
    df = spark.createDataFrame(data, "g int, n int, offset int, size int")
    inside = {g for g in range(40) if any(clash(x[2:], y[2:]) for x, y in itertools.combinations([d for d in data if d[0] == g], 2))}
    across = {g for g in range(40) if any(x[1] != y[1] and clash(x[2:], y[2:]) for x, y in itertools.combinations([d for d in data if d[0] == g], 2))}
    assert {r.g for r in intervals.conflicted(df, ["g"]).collect()} == inside
    assert {r.g for r in intervals.cross_conflicted(df, "g", "n").collect()} == across


def test_equal_starts_are_no_conflict(spark):
    df = table(spark, "base int, offset int, size int", (1, 0, 8), (1, 0, 4), (2, 0, 8), (2, 4, 4))
    assert rows(intervals.conflicted(df), "base") == [(2,)]


def test_touching_ranges_stay_apart(spark):
    df = table(spark, "k int, start int, end int", (1, 0, 4), (1, 4, 8), (1, 5, 6), (1, 8, 9))
    assert rows(intervals.merge_ranges(df, ["k"]), "start", "end") == [(0, 4), (4, 8), (8, 9)]


def test_components_partition_a_random_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    df = graph.min_labels(spark.createDataFrame(edges, "src int, dst int"), nodes=spark.range(300).select(F.col("id").cast("int").alias("node")))
    assert rows(df, "node", "label") == [(k, find(k)) for k in range(300)]


def test_long_chain_has_one_component(spark):
    df = graph.min_labels(spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")))
    assert df.where("label <> 0").isEmpty() and df.count() == 201


def test_paths_and_reach(spark):
    e = table(spark, "src string, dst string, edge_type string", ("a", "b", "CALL"), ("b", "c", "CALL"), ("a", "c", "CALL"), ("c", "b", "ALIAS"))
    flow = graph.flow_edges(e)
    assert rows(graph.simple_paths(flow), "path") == [(["a", "b", "c"],), (["a", "c"],)]
    assert rows(graph.reach(flow, table(spark, "node string", ("a",)), depth=1), "node", "depth") == [("a", 0), ("b", 1), ("c", 1)]
    tree = graph.shortest_paths(flow, table(spark, "node string", ("c",)))
    assert rows(graph.backtrack(tree, table(spark, "seed string, node string", ("c", "a"))), "path") == [(["c", "a"],)]
    assert rows(graph.strong_components(e), "node", "label") == [("a", "a"), ("b", "b"), ("c", "b")]


def test_long_paths_raise(spark):
    with pytest.raises(ValueError):
        graph.simple_paths(spark.range(5).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), max_length=3)


def test_repeats(spark):
    f = [(1, 2 * k, 2, "u2") for k in range(8)] + [(2, 0, 4, "u4"), (2, 4, 2, "u2"), (2, 8, 4, "u4"), (2, 12, 2, "u2"), (2, 16, 4, "u4"), (2, 20, 2, "u2")]
    df = spark.createDataFrame(f, "base int, offset int, size int, kind string")
    assert rows(windows.primitive_repeats(df), "base", "start", "end", "repeats") == [(1, 0, 16, 8)]
    assert rows(windows.complex_repeats(df), "base", "start", "end", "repeats", "capacity") == [(2, 0, 24, 3, 2)]


def test_repeats_of_wide_records_and_nested_ones(spark):
    wide = [(1, 40 * k + 4 * j, 4, f"k{j}") for k in range(3) for j in range(10)]
    # Three records of (a b a b a b c d): the pairs inside of the longest repeat stay.
    nested = [(2, 32 * k + 4 * j, 4, c) for k in range(3) for j, c in enumerate("abababcd")]
    df = spark.createDataFrame(wide + nested, "base int, offset int, size int, kind string")
    found = rows(windows.complex_repeats(df), "base", "start", "end", "repeats", "capacity")
    assert (1, 0, 120, 3, 10) in found and (2, 0, 96, 3, 8) in found
    assert {(2, 32 * k, 32 * k + 24, 3, 2) for k in range(3)} <= set(found)


def test_sizes_spread_backward_too(spark):
    e = table(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("y", "c"))
    assert rows(sizes.propagate_sizes(e, table(spark, "node string, size long", ("b", 8))), "node", "size", "conflict") == [("a", 8, False), ("b", 8, False), ("c", 8, False), ("y", 8, False)]


def test_sizes_spread_and_conflict(spark):
    e = table(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("x", "c"), ("c", "d"))
    known = table(spark, "node string, size long", ("a", 8), ("x", 16))
    assert rows(sizes.propagate_sizes(e, known, passes=(True,)), "node", "size", "conflict") == [("a", 8, False), ("b", 8, False), ("c", 16, True), ("d", 16, False), ("x", 16, False)]


def test_size_resolution_rules(spark):
    s = table(spark, "expr string, size long, source_type string, on_stack boolean", ("s", 8, "CALLSITE", True), ("s", 16, "EXPRESSION", True), ("h", 8, "CALLSITE", False), ("h", 16, "EXPRESSION", False), ("u", 8, "CALLSITE", False), ("u", 16, "CALLSITE", False))
    assert rows(sizes.resolve_sizes(s).fillna({"size": -1}), "expr", "size", "is_union") == [("h", 16, False), ("s", 8, False), ("u", -1, True)]


def test_wrapper_sizes(spark):
    e = table(spark, "src string, dst string, edge_type string", ("k", "n", "CALL"), ("r", "v", "RETURN"))
    found = sizes.wrapper_sizes(e, table(spark, "cs string, size_expr string, result string", ("m", "n", "r")), table(spark, "expr string, cs string, value long, receiver string", ("k", "c1", 24, "v"), ("k", "c2", 32, "w")))
    assert rows(found, "receiver", "cs", "size") == [("v", "c1", 24)]


def test_call_roots_and_graph(spark):
    f = table(spark, "func string, entry long, name string, is_external boolean, is_thunk boolean", ("m", 1, "main", False, False), ("a", 2, "a", False, False), ("b", 3, "b", False, False), ("x", 4, "x", True, False), ("s", 5, "_start", False, False))
    c = table(spark, "caller string, inst long, mnemonic string, flow long", ("m", 10, "CALL", 2), ("a", 11, "CALL", 4), ("b", 12, "CALL", None), ("s", 13, "CALL", 1))
    roots = calls.call_roots(f, c)
    assert rows(roots, "func") == [("b",), ("m",)]
    assert rows(calls.call_graph(f, c, roots), "caller", "callee") == [("a", "x"), ("m", "a")]


def test_pointer_levels(spark):
    t = table(spark, "dt string, kind string, pointee string, typedef_of string", ("S", "struct", None, None), ("S*", "pointer", "S", None), ("T", "typedef", None, "S*"), ("T*", "pointer", "T", None), ("int", "primitive", None, None))
    assert rows(types.describe_variable(t), "dt", "desc", "ptr_level") == [("S", "StackStruct", 0), ("S*", "PointerToStruct", 1), ("T", "PointerToStruct", 1), ("T*", "PointerToStruct", 2), ("int", "Primitive", 0)]


def test_conflicting_chain_is_cut_once(spark):
    e = table(spark, "src string, dst string", ("a", "b"), ("b", "c"))
    f = table(spark, "base string, offset int, size int", ("a", 0, 8), ("b", 8, 8), ("c", 4, 8))
    edges, labels = layout.remove_conflicts(e, f)
    assert rows(edges, "src", "dst") == [("a", "b")]
    assert rows(labels, "node", "label") == [("a", "a"), ("b", "a"), ("c", "c")]


def test_chains_are_walked_whole_and_too_many_paths_raise():
    chain = [f"n{k:04}" for k in range(500)]
    assert layout.paths_of({a: {b} for a, b in zip(chain, chain[1:])}, chain) == [chain]
    assert layout.paths_of({"a": {"b", "c"}, "b": {"d"}, "c": {"d", "a"}}, list("abcd")) == [["a", "b", "d"], ["a", "c", "d"]]
    ladder: dict = {}
    for k in range(12):  # 4096 paths
        ladder |= {f"{k:02}": {f"{k:02}a", f"{k:02}b"}, f"{k:02}a": {f"{k + 1:02}"}, f"{k:02}b": {f"{k + 1:02}"}}
    with pytest.raises(ValueError):
        layout.paths_of(ladder, sorted(ladder))


def test_settled_parts_equal_brute_force():
    rng = random.Random(11)
    for _ in range(300):
        n = rng.randrange(2, 9)
        edges = {}
        for _ in range(rng.randrange(1, 12)):
            edges.setdefault(f"n{rng.randrange(n)}", set()).add(f"n{rng.randrange(n)}")
        own = {f"n{k}": frozenset((rng.randrange(0, 24, 4), rng.choice([4, 8, 16])) for _ in range(2)) for k in range(n)}
        pairs = [(a, b) for a, b in itertools.combinations(own, 2) if any(clash(x, y) for x in own[a] for y in own[b])]
        assert layout.crossing(own, own) == bool(pairs)
        evil, labels = layout.settle({a: set(b) for a, b in edges.items()}, own)
        assert set(labels) == set(own) and all(labels[a] != labels[b] for a, b in pairs)
        kept = {(a, b) for a, outs in edges.items() for b in outs} - evil
        assert all(labels[a] == labels[b] for a, b in kept) and all(labels[v] <= k for k, v in labels.items())


def test_no_component_keeps_a_conflict_between_nodes(spark):
    rng = random.Random(5)
    e = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)]
    f = [(f"n{k}", o, rng.choice([4, 8])) for k in range(30) for o in [rng.choice([0, 4, 8])]]
    _, labels = layout.remove_conflicts(spark.createDataFrame(e, "src string, dst string"), spark.createDataFrame(f, "base string, offset int, size int"))
    held = spark.createDataFrame(f, "base string, offset int, size int").join(labels.withColumnRenamed("node", "base"), "base")
    assert intervals.cross_conflicted(held, "label", "base").isEmpty()


def test_nesting_and_populate(spark):
    f = table(spark, "c string, offset int, size int, dt string", ("o", 0, 8, "q"), ("i", 0, 8, "q"), ("j", 0, 8, "q"))
    n = constraints.nesting(table(spark, "outer string, inner string, delta int, variables int", ("o", "i", 8, 2), ("o", "j", 8, 1), ("o", "j", 4, 9), ("i", "j", 8, 1)), f, table(spark, "c string", ("none",)))
    assert rows(n, "outer", "inner", "delta") == [("i", "j", 8), ("o", "i", 8)]
    assert rows(constraints.populate(f, n).where("c = 'o'"), "offset") == [(0,), (8,), (16,)]


def test_pointer_cycle_ends(spark):
    p = table(spark, "c string, offset int, min_size int, max_size int", ("a", 0, 8, 8), ("b", 0, 8, 8))
    r = table(spark, "c string, offset int, target string", ("a", 0, "b"), ("b", 0, "a"))
    assert rows(constraints.pointer_chains(r, p), "c", "ptr_level") == [("a", 2), ("b", 2)]


def test_aliases_merge_unless_they_conflict(spark):
    a = table(spark, "c string, offset int, size int", ("p", 0, 8), ("x", 0, 8), ("y", 0, 8), ("z", 4, 8))
    r = table(spark, "c string, offset int, target string", ("p", 0, "x"), ("p", 0, "y"), ("p", 0, "z"))
    assert rows(constraints.merge_aliases(a, r), "c", "label") == [("p", "p"), ("x", "x"), ("y", "x"), ("z", "z")]


def test_tournament_of_n_eliminates_n_minus_1(spark):
    players = [(g, p, float(hash((g, p)) % 97)) for g in range(6) for p in range(g + 1)]
    champions, games = tournament.run_tournaments(spark.createDataFrame(players, "grp int, player int, score double"))
    assert len({r.grp for r in champions.collect()}) == champions.count() == 6
    best = {g: max((s, -p) for g2, p, s in players if g2 == g) for g in range(6)}
    assert all(best[r.grp][1] == -r.player for r in champions.collect())
    assert rows(games.where("bracket <> 'w'").groupBy("grp").count(), "grp", "count") == [(g, g) for g in range(1, 6)]


def test_votes(spark):
    v = table(spark, "match int, vote int", (1, 0), (1, 0), (1, 1), (2, 0), (2, 1), (3, None))
    assert rows(tournament.votes_to_winner(v), "match", "first_wins") == [(1, True), (2, False), (3, True)]


def test_candidate_dedup(spark):
    c = table(spark, "c int, start int, end int, name string, layout_hash long", (1, 0, 8, "b", 5), (1, 0, 8, "a", 5), (1, 0, 8, "c", 6))
    assert rows(candidates.dedup_candidates(c), "name") == [("a",), ("c",)]


def test_bitmap_never_misses_a_member(spark):
    from recordscope.operators.skew import hot_keys, maybe_member, salted_lookup

    keys = spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    marked = maybe_member(spark.range(5000).select(F.col("id").alias("k"), F.lit("x").alias("v")), "k", keys, "hit")
    assert marked.where("k % 7 = 0 AND NOT hit").isEmpty() and marked.where("k % 7 <> 0 AND hit").count() < 10
    many = spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), "id")
    counted = many.groupBy("k").agg(F.count("*").alias("n"))
    hot = hot_keys(counted, "k", "n", 4000)
    assert rows(hot, "k") == [(1,)]
    assert salted_lookup(many, counted, "k", hot, F.col("id")).where("n = 3000").count() == 3000


def test_symbols(spark):
    from recordscope.operators import symbols

    v = table(spark, "func string, vn string, sym string, dt string, merge_group int", ("f", "a", "x", "int", 1), ("f", "b", "x", "int", 2), ("f", "c", "y", "S*", 1))
    s = table(spark, "func string, sym string, name string, role string, storage_kind string, stack_offset long, pc_addr long, is_isolated boolean", ("f", "x", "x", "param", "register", None, 4, False), ("f", "y", "y", "local", "stack", -16, 4, False), ("f", "z", "z", "local", "register", None, 64, False))
    assert rows(symbols.split_parameters(s, v), "sym") == [("x",)] and rows(symbols.used_symbols(s, v), "sym") == [("x",), ("y",)]
    assert rows(symbols.located(s), "loc") == [("f:RegUniq[0x40]",), ("f:stack[-0x10]",), ("f:x",)]
    o = table(spark, "func string, op string, opcode string, output_vn string, input_vns array<string>", ("f", "o", "CAST", "c", ["a"]))
    r = table(spark, "dt string, rank int", ("int", 1), ("S*", 5))
    assert rows(symbols.type_through_casts(v, o, r), "vn", "dt") == [("a", "S*"), ("b", "int"), ("c", "S*")]
    assert rows(symbols.match_symbols(s, s), "old_sym", "new_sym") == [("x", "x"), ("y", "y"), ("z", "z")]


def test_neighbourhood_and_degrees(spark):
    e = table(spark, "src string, dst string", ("a", "b"), ("b", "c"), ("c", "d"))
    assert rows(graph.neighbourhood(e, table(spark, "node string", ("b",)), 1), "src", "dst") == [("a", "b"), ("b", "c")]
    assert rows(graph.least_degree(e, table(spark, "node string", ("b",), ("a",))), "node") == [("a",)]
    c = table(spark, "a string, b string", ("s", "t"), ("s", "u"), ("t", "u"))
    assert rows(graph.most_conflicts(c, table(spark, "a string, b string", ("t", "u"))), "node", "n") == [("s", 2), ("t", 1), ("u", 1)]


def test_empty_tables_give_empty_results(spark):
    e, f = table(spark, "src string, dst string"), table(spark, "c string, offset int, size int, dt string")
    assert graph.simple_paths(e).count() == graph.min_labels(e).count() == graph.strong_components(e).count() == graph.backward_edges(e, graph.simple_paths(e)).count() == 0
    champions, games = tournament.run_tournaments(table(spark, "grp int, player int, score double"))
    assert champions.count() == games.count() == 0 and "level" in games.columns
    assert constraints.populate(f, table(spark, "outer string, inner string, delta int")).count() == 0
    assert types.describe_variable(table(spark, "dt string, kind string, pointee string, typedef_of string")).count() == 0


def test_nests_in_a_cycle_raise(spark):
    f = table(spark, "c string, offset int, size int, dt string", ("a", 0, 8, "q"), ("b", 0, 8, "q"))
    with pytest.raises(ValueError):
        constraints.populate(f, table(spark, "outer string, inner string, delta int", ("a", "b", 8), ("b", "a", 8)))


def test_levels_go_up_with_each_round_of_a_bracket(spark):
    _, games = tournament.run_tournaments(spark.createDataFrame([(1, p, float(p)) for p in range(5)], "grp int, player int, score double"))
    for bracket in ("w", "l"):
        levels = [r.level for r in tournament.bracket_order(games).where(f"bracket = '{bracket}'").select("round", "level").distinct().orderBy("round").collect()]
        assert levels == sorted(set(levels)) and levels[0] == 0 or bracket == "l" and levels == sorted(set(levels))


def test_types_of_levels(spark):
    df = table(spark, "n string, k int", ("S", 0), ("S", 2)).select(types.pointer_to(F.col("n"), F.col("k")).alias("p"), types.array_of(F.col("n"), F.col("k")).alias("a"))
    assert [(r.p, r.a) for r in df.collect()] == [("S", "S[0]"), ("S **", "S[2]")]


def test_a_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    from recordscope import storage

    conf = SimpleNamespace(get=lambda *a: None)
    session = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(_conf=conf, master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        storage.shared_root(session)


def test_helper_columns_do_not_clash(spark):
    from recordscope.operators.skew import maybe_member, salted_lookup

    rows_ = spark.range(20).select(F.col("id").alias("k"), F.lit("a").alias("_salt"), F.lit("b").alias("_AT"), F.lit("c").alias("_page"), F.lit("d").alias("_hot"), F.lit("e").alias("_map"))
    keys = spark.range(0, 20, 2).select(F.col("id").alias("k"))
    marked = maybe_member(rows_, "k", keys, "hit")
    assert marked.where("hit AND _at = 'b' AND _map = 'e'").count() == 10
    assert salted_lookup(rows_, keys.withColumn("v", F.lit(1)), "k", keys.limit(1), F.col("k")).where("_salt = 'a' AND _hot = 'd'").count() == 10
