"""Graph operators on edge tables: degrees, reachability, components, paths.

Loops run on the driver, one DataFrame round at a time; every round's result
is a table in shared storage, so plans stay short and lost executors cost one
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, release, replace, replace_counting, union_all


def dedup_edges(edges: DataFrame, src: str = "src", dst: str = "dst", first_by: str = "ord", kind: str = "edge_type") -> DataFrame:
    """One edge per (src, dst): the one that comes first keeps its type."""
    return edges.groupBy(src, dst).agg(F.min_by(kind, F.struct(first_by, kind)).alias(kind))


def both_ways(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(u, v) in both directions, without self-loops."""
    there = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u <> v")
    return there.unionByName(there.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def min_labels(edges: DataFrame, src: str = "src", dst: str = "dst", nodes: DataFrame | None = None, node: str = "node") -> DataFrame:
    """(node, label): the smallest node of each weakly connected component.

    Each round, a node takes the smallest of its own label, its neighbours'
    labels, and the label that its label has: labels halve their distance to the
    smallest. nodes adds isolated ones. Rounds go on until nothing changes; a
    round is one written table, which counts its changes as it is written.
    """
    near = materialize(both_ways(edges, src, dst), "edges")
    known = near.select(F.col("u").alias("node")).distinct()
    if nodes is not None:
        known = known.unionByName(nodes.select(F.col(node).alias("node"))).where("node IS NOT NULL").distinct()
    labels, changed = materialize(known.select("node", F.col("node").alias("label")), "labels"), 1
    while changed:
        around = near.join(labels.select(F.col("node").alias("u"), "label"), "u").groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        hop = labels.where("node <> label").select(F.col("node").alias("label"), F.col("label").alias("hop"))
        lower = labels.join(around, "node", "left").join(hop, "label", "left").select("node", F.least("label", "near", "hop").alias("label"), F.col("label").alias("was"))
        labels, changed = replace_counting(labels, lower, "labels", F.col("label") < F.col("was"))
    release(near)
    return labels.select("node", "label")


#: Rounds of a search that are kept as tables of their own.
MERGE = 8

#: Edges that carry data; ALIAS edges do not.
FLOW = ("CALL", "RETURN", "DATAFLOW")


def flow_edges(edges: DataFrame, kind: str = "edge_type") -> DataFrame:
    return edges.where(F.col(kind).isin(*FLOW))


def without_edges(edges: DataFrame, evil: DataFrame) -> DataFrame:
    """edges without those of evil (src, dst)."""
    return edges.join(evil.select("src", "dst").distinct(), ["src", "dst"], "left_anti")


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges without those at a node of nodes (node)."""
    gone = nodes.select("node").distinct()
    return edges.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select(*edges.columns)


def degrees(edges: DataFrame) -> DataFrame:
    """(node, n_in, n_out)."""
    ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))


def sources_and_sinks(edges: DataFrame) -> DataFrame:
    """(node, role): source without in-edges, sink without out-edges."""
    return degrees(edges).where("n_in = 0 OR n_out = 0").select("node", F.when(F.col("n_in") == 0, "source").otherwise("sink").alias("role"))


def reach(edges: DataFrame, seeds: DataFrame, forward: bool = True, depth: int | None = None) -> DataFrame:
    """(seed, node, depth): all nodes reached from each seed (itself at 0) and the least number of steps.

    One frontier join a round against the visited set, which is one table that
    takes in the rounds since whenever they number MERGE, so a round reads
    a bounded number of tables however deep the graph is.
    """
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = materialize(edges.select(F.col(a).alias("node"), F.col(b).alias("to")).distinct(), "steps")
    front = materialize(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("depth")).distinct(), "front")
    visited, k = [front], 0
    while depth is None or k < depth:
        k += 1
        found = front.join(step, "node").select("seed", F.col("to").alias("node")).distinct()
        seen = union_all(v.select("seed", "node") for v in visited)
        front = materialize(found.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(k)), "front")
        if front.isEmpty():
            release(front)
            break
        visited.append(front)
        if len(visited) > MERGE:
            whole = materialize(union_all(visited), "visited")
            release(*visited[:-1])
            visited = [whole]
    release(step)
    return union_all(visited)


def path_exists(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Adds has_path to pairs (src, dst): a directed path, or src = dst."""
    hit = reach(edges, pairs.select(F.col("src").alias("node")).distinct()).select(F.col("seed").alias("src"), F.col("node").alias("dst"), F.lit(True).alias("_hit"))
    return pairs.join(hit, ["src", "dst"], "left").select(*pairs.columns, F.coalesce("_hit", F.lit(False)).alias("has_path"))


def shortest_paths(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(seed, node, depth, parent): undirected breadth-first trees; of several parents the smallest."""
    near = materialize(both_ways(edges, "src", "dst"), "near")
    found = materialize(reach(near.select(F.col("u").alias("src"), F.col("v").alias("dst")), seeds), "reached")
    before = found.select("seed", F.col("node").alias("u"), (F.col("depth") + 1).alias("depth"))
    parents = before.join(near, "u").select("seed", F.col("v").alias("node"), "depth", "u")
    return found.join(parents, ["seed", "node", "depth"], "left").groupBy("seed", "node", "depth").agg(F.min("u").alias("parent"))


def backtrack(tree: DataFrame, ends: DataFrame) -> DataFrame:
    """(seed, node, path): the nodes from the seed to each end (seed, node)."""
    tree = materialize(tree, "tree")
    at = materialize(ends.join(tree, ["seed", "node"]).select("seed", F.col("node").alias("end"), F.col("parent").alias("at"), F.array("node").alias("path")), "trail")
    while not at.where("at IS NOT NULL").isEmpty():
        up = tree.select("seed", F.col("node").alias("at"), F.col("parent").alias("up"))
        moved = at.join(up, ["seed", "at"], "left")
        at = materialize(moved.select("seed", "end", F.col("up").alias("at"), F.when(F.col("at").isNull(), F.col("path")).otherwise(F.concat(F.array("at"), F.col("path"))).alias("path")), "trail")
    return at.select("seed", F.col("end").alias("node"), "path")


def simple_paths(edges: DataFrame, max_length: int = 16) -> DataFrame:
    """(path): simple paths from sources to sinks of at most max_length nodes; longer ones raise an error rather than being dropped."""
    ends = materialize(sources_and_sinks(edges), "ends")
    return paths_between(edges, ends.where("role = 'source'").select("node"), ends.where("role = 'sink'").select("node"), max_length)


def path_edges(paths: DataFrame) -> DataFrame:
    """Distinct (src, dst) on any path."""
    steps = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda k: F.struct(F.element_at("path", k).alias("src"), F.element_at("path", k + 1).alias("dst")))
    return paths.where(F.size("path") > 1).select(F.explode(steps).alias("e")).select("e.*").distinct()


def backward_edges(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges on no path."""
    return edges.select("src", "dst").distinct().join(path_edges(paths), ["src", "dst"], "left_anti")


def uncovered_nodes(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes on no path."""
    return degrees(edges).select("node").join(paths.select(F.explode("path").alias("node")).distinct(), "node", "left_anti")


def common_prefix(paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, prefix): the longest start that all paths of a key share, by positions; no path is compared with another."""
    total = paths.groupBy(*keys).agg(F.count("*").alias("_paths"))
    cells = paths.select(*keys, F.posexplode("path").alias("pos", "at")).groupBy(*keys, "pos").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n")).join(total, keys)
    broken = F.max(F.when((F.col("lo") == F.col("hi")) & (F.col("n") == F.col("_paths")), 0).otherwise(1)).over(Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    kept = cells.withColumn("_broken", broken).where("_broken = 0").groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lo"))), lambda x: x["lo"]).alias("prefix"))
    return total.select(*keys).join(kept, keys, "left")


def shared_reach(reached: DataFrame) -> DataFrame:
    """(a, b, shared): pairs of sources that reach a common node. reached: (seed, node).

    A node's sources are paired within the node; callers bound the sources per
    component, as the pairs are their result.
    """
    left, right = reached.select("node", F.col("seed").alias("a")), reached.select("node", F.col("seed").alias("b"))
    return left.join(right, "node").where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


def exclusive_reach(reached: DataFrame) -> DataFrame:
    """(seed, node) for nodes that one source only reaches."""
    return reached.groupBy("node").agg(F.min("seed").alias("seed"), F.count_distinct("seed").alias("n")).where("n = 1").select("seed", "node")


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node that reaches and is reached.

    Each round, every node left takes the smallest node that reaches it; those
    that also reach that one, within the nodes of equal colour, are its
    component and leave. No set of reached nodes is kept per node.
    """
    left = materialize(edges.select("src", "dst").distinct(), "left")
    done, rest = [], materialize(degrees(left).select("node"), "rest")
    while not rest.isEmpty():
        colour = materialize(spread_least(left, rest.select("node", F.col("node").alias("value")), "src", "dst"), "colours")
        a = colour.select(F.col("node").alias("src"), F.col("value").alias("c1"))
        b = colour.select(F.col("node").alias("dst"), F.col("value").alias("c2"))
        inside = left.join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst")
        roots = colour.select(F.col("node"), F.when(F.col("node") == F.col("value"), F.col("node")).alias("value"))
        back = spread_least(inside, roots.where("value IS NOT NULL"), "dst", "src")
        found = materialize(back.select("node", F.col("value").alias("label")), "strong")
        done.append(found)
        out = found.select("node")
        rest = replace(rest, rest.join(out, "node", "left_anti"), "rest")
        left = replace(left, without_nodes(left, out), "left")
        release(colour)
    release(left)
    return union_all(done) if done else edges.select(F.col("src").alias("node"), F.col("src").alias("label")).where("false")


def spread_least(edges: DataFrame, values: DataFrame, a: str, b: str) -> DataFrame:
    """(node, value): the smallest value (node, value) of any node from which edges lead there, itself too."""
    known = materialize(values.select("node", "value", F.lit(True).alias("new")), "spread")
    while True:
        offers = known.where("new").join(edges.select(F.col(a).alias("node"), F.col(b).alias("to")), "node").groupBy(F.col("to").alias("node")).agg(F.min("value").alias("offer"))
        lower = known.join(offers, "node", "full").select("node", F.least("value", "offer").alias("value"), (F.coalesce(F.col("offer") < F.col("value"), F.col("value").isNull())).alias("new"))
        known = replace(known, lower.withColumn("new", F.coalesce("new", F.lit(False))), "spread")
        if known.where("new").isEmpty():
            return known.select("node", "value")


def processable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(label, nodes) of the components that can be worked on: more than one node, and none of them without an edge. nodes: (node, label)."""
    joined = nodes.join(degrees(edges), "node", "left")
    return joined.groupBy("label").agg(F.count("*").alias("nodes"), F.count("n_in").alias("linked")).where("nodes > 1 AND nodes = linked").select("label", "nodes")


def cover(edges: DataFrame, paths: DataFrame, max_length: int = 16) -> DataFrame:
    """(path): paths, and such through the nodes that none of them has.

    Each round, uncovered nodes without an uncovered one before them start,
    those without one behind them end; if there are none, the one with the
    smallest in- or out-degree of the smallest key does, per component. When a
    round covers nothing, each node that is left is a path by itself.
    """
    step = materialize(edges.select("src", "dst").distinct(), "steps")
    label = materialize(min_labels(step), "labels")
    found, left = [paths.select("path")], uncovered_nodes(step, paths)
    left = materialize(left, "uncovered")
    while not left.isEmpty():
        inner = step.join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi")
        ranked = left.join(label, "node").join(degrees(step), "node")
        ends = {}
        for side, column in (("dst", "n_in"), ("src", "n_out")):
            free = ranked.join(inner.where("src <> dst").select(F.col(side).alias("node")).distinct(), "node", "left_anti").select("node", "label")
            none = ranked.join(free.select("label").distinct(), "label", "left_anti").groupBy("label").agg(F.min(F.struct(column, "node")).alias("x")).select(F.col("x.node").alias("node"), "label")
            ends[side] = materialize(free.unionByName(none), "ends")
        new = materialize(paths_between(step, ends["dst"].select("node"), ends["src"].select("node"), max_length), "paths")
        found.append(new)
        after = left.join(new.select(F.explode("path").alias("node")).distinct(), "node", "left_anti")
        if new.isEmpty():
            found.append(left.select(F.array("node").alias("path")))
            break
        left = replace(left, after, "uncovered")
    return union_all(found).distinct()


def paths_between(edges: DataFrame, starts: DataFrame, ends: DataFrame, max_length: int = 16) -> DataFrame:
    """(path): simple paths from any node of starts to any of ends (node) of at most max_length nodes; longer ones raise an error."""
    step = edges.select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct()
    sinks = ends.select(F.col("node").alias("at"))
    front = starts.select(F.col("node").alias("at"), F.array("node").alias("path"))
    done = [front.select("path").where("false")]
    for _ in range(max_length):
        front = materialize(front, "paths")
        if front.isEmpty():
            break
        done.append(front.join(sinks, "at", "left_semi").select("path"))
        front = front.join(step, "at").where(~F.array_contains("path", F.col("to"))).select(F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
    else:
        if not front.isEmpty():
            raise ValueError(f"paths of more than {max_length} nodes; raise max_length or split the component")
    return union_all(done)


def assert_covered(edges: DataFrame, paths: DataFrame) -> None:
    """Raises if some node is on no path."""
    if not uncovered_nodes(edges, paths).isEmpty():
        raise ValueError("some nodes are on no path")


def heights(edges: DataFrame) -> DataFrame:
    """(node, height): callees before callers. A node's height is above those of all that it leads to, but for nodes of its own cycle, which share one."""
    label = materialize(strong_components(edges), "strong")
    a, b = (label.select(F.col("node").alias(x), F.col("label").alias(y)) for x, y in (("src", "a"), ("dst", "b")))
    between = materialize(edges.select("src", "dst").join(a, "src").join(b, "dst").where("a <> b").select("a", "b").distinct(), "between")
    height = materialize(label.select(F.col("label").alias("a"), F.lit(0).alias("height")).distinct(), "heights")
    while True:
        above = between.join(height.withColumnRenamed("a", "b"), "b").groupBy("a").agg((F.max("height") + 1).alias("least"))
        new = height.join(above, "a", "left").select("a", F.greatest("height", F.coalesce("least", F.lit(0))).alias("height"), (F.coalesce("least", F.lit(0)) > F.col("height")).alias("up"))
        new = replace(height, new, "heights")
        height = new
        if new.where("up").isEmpty():
            break
    return label.join(height.select(F.col("a").alias("label"), "height"), "label").select("node", "height")


def post_order(edges: DataFrame) -> DataFrame:
    """(node, ord): an order in which what a node leads to comes before it, ties by key; total within a height."""
    order = Window.partitionBy("height").orderBy("node")
    ranked = heights(edges).withColumn("at", F.row_number().over(order))
    return ranked.select("node", "height", F.col("at").alias("ord"))


def least_degree(edges: DataFrame, nodes: DataFrame, column: str = "n_in") -> DataFrame:
    """The node of ``nodes`` with the smallest in- (n_in) or out-degree (n_out); ties by key. One row."""
    return degrees(edges).join(nodes.select("node"), "node", "left_semi").orderBy(column, "node").limit(1)


def most_conflicts(pairs: DataFrame, shared: DataFrame) -> DataFrame:
    """(node, n): how many others a node conflicts with without sharing anything, most first. pairs, shared: (a, b) with a < b."""
    apart = pairs.select("a", "b").join(shared.select("a", "b"), ["a", "b"], "left_anti")
    return apart.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node")


def neighbourhood(edges: DataFrame, node: DataFrame, depth: int) -> DataFrame:
    """Edges whose ends are both within ``depth`` steps of the node, in either direction."""
    near = materialize(reach(edges, node, True, depth).select("node").unionByName(reach(edges, node, False, depth).select("node")).distinct(), "near")
    return edges.join(near.withColumnRenamed("node", "src"), "src", "left_semi").join(near.withColumnRenamed("node", "dst"), "dst", "left_semi")
