"""Conflict-free layouts over the type-flow graph, one group per component.

Components whose union of fields has no conflict are clean: nothing can go
wrong on any path, so they skip the sequential work. The others are walked in
one group each, in the order of their keys: fields are merged along paths,
across the paths of a source, and breadth-first from the sources; edges at
which a merge would conflict are evil and are removed. What is left of the
component is split, and parts that still hold a conflict between two of their
nodes are walked again in the same task, so the graph is labelled only once.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .graph import min_labels, without_edges
from .intervals import cross_conflicted

Fields = frozenset[tuple[int, int]]

#: Paths of a component, of any length; beyond, it is an error.
PATHS = 2_000


def clash(a: Iterable[tuple[int, int]], b: Iterable[tuple[int, int]]) -> bool:
    """Whether an interval (offset, size) of one starts strictly inside one of the other."""
    return any(s < o < s + n or o < s < o + m for s, n in a for o, m in b)


def walk_path(path: list, fields: dict) -> tuple[list[list], list[tuple]]:
    """Cuts a path where its fields conflict: the parts that merge, and the edges between them."""
    parts, evil, held, start = [], [], set(), 0
    for k, node in enumerate(path):
        own = fields.get(node, frozenset())
        if k > start and clash(held, own):
            parts.append(path[start:k])
            evil.append((path[k - 1], node))
            held, start = set(), k
        held |= own
    return [*parts, path[start:]], evil


def paths_of(edges: dict, nodes: list) -> list[list]:
    """Simple paths from sources to sinks, then single steps for what they leave out; in order of keys. Raises if there are more than PATHS."""
    before: dict = {}
    for a, outs in edges.items():
        for b in outs:
            before.setdefault(b, set()).add(a)
    found: list[list] = []
    starts = [n for n in nodes if n not in before and edges.get(n)] or nodes[:1]
    for start in starts:
        path, on, ahead = [], set(), [iter([start])]
        while ahead:
            node = next(ahead[-1], None)
            if node is None:
                ahead.pop()
                if path:
                    on.remove(path.pop())
                continue
            path.append(node)
            on.add(node)
            outs = [b for b in sorted(edges.get(node, ())) if b not in on]
            if not outs:
                if len(found) == PATHS:
                    raise ValueError(f"more than {PATHS} paths in the component of {nodes[0]}")
                found.append(list(path))
            ahead.append(iter(outs))
    covered = {n for p in found for n in p}
    return found + [[n] for n in nodes if n not in covered]


def evil_edges(edges: dict, fields: dict) -> set[tuple]:
    """Edges to remove so that what flows together has no conflict."""
    nodes = sorted({*edges, *(b for outs in edges.values() for b in outs)})
    evil: set[tuple] = set()
    paths = []
    for path in paths_of(edges, nodes):
        parts, cut = walk_path(path, fields)
        evil.update(cut)
        paths += parts
    # The paths of one source: they part where their merged fields conflict, after what they share.
    by_source: dict = {}
    for p in paths:
        by_source.setdefault(p[0], []).append(p)
    for group in by_source.values():
        merged: list[tuple[list, set]] = []
        for p in sorted(group):
            own = set().union(*(fields.get(n, frozenset()) for n in p))
            for other, held in merged:
                if clash(held, own):
                    k = 0
                    while k < min(len(p), len(other)) and p[k] == other[k]:
                        k += 1
                    evil.update((q[k - 1], q[k]) for q in (p, other) if 0 < k < len(q))
            merged.append((p, own))
    # Breadth-first from the sources: what conflicts with what reached it is cut off.
    left = {a: {b for b in outs if (a, b) not in evil} for a, outs in edges.items()}
    inward = {b for outs in left.values() for b in outs}
    holds: dict = {}
    for source in (n for n in nodes if n not in inward):
        front, seen, held = [source], {source}, set(fields.get(source, frozenset()))
        while front:
            following = []
            for a in front:
                for b in sorted(left.get(a, ())):
                    if b in seen:
                        continue
                    own = fields.get(b, frozenset())
                    if clash(held, own):
                        evil.add((a, b))
                        continue
                    seen.add(b)
                    held |= own
                    following.append(b)
            front = following
        holds[source] = (seen, held)
    # Sources that conflict with each other: those with most conflicts are cut from what they alone don't reach. Sources that share what they reach are left to the edges that were cut on the way.
    names = sorted(holds)
    clashes = {s: {t for t in names if t != s and not holds[s][0] & holds[t][0] and clash(holds[s][1], holds[t][1])} for s in names}
    while any(clashes.values()):
        worst = min(names, key=lambda s: (-len(clashes[s]), s))
        others = set().union(*(holds[t][0] for t in names if t != worst))
        alone = holds[worst][0] - others
        evil.update((a, b) for a, outs in left.items() for b in outs if (a in alone) != (b in alone))
        for t in clashes.pop(worst):
            clashes[t].discard(worst)
        clashes[worst] = set()
    return evil or cut_against_direction(edges, nodes, fields)


def cut_against_direction(edges: dict, nodes: list, fields: dict) -> set[tuple]:
    """For conflicts that no directed walk meets (cycles, sources that meet below): nodes join over edges of any direction, and those that conflict are cut off."""
    near: dict = {n: set() for n in nodes}
    for a, outs in edges.items():
        for b in outs:
            near[a].add(b)
            near[b].add(a)
    evil: set[tuple] = set()
    seen: set = set()
    for start in nodes:
        if start in seen:
            continue
        seen.add(start)
        joined, front, held = {start}, [start], set(fields.get(start, frozenset()))
        while front:
            node = front.pop(0)
            for other in sorted(near[node] - seen):
                own = fields.get(other, frozenset())
                if not clash(held, own):
                    seen.add(other)
                    joined.add(other)
                    held |= own
                    front.append(other)
        evil.update((a, b) for a, outs in edges.items() for b in outs if (a in joined) != (b in joined))
    return evil


def crossing(nodes: Iterable, fields: dict) -> bool:
    """Whether intervals of two different nodes conflict: in order of start, the two furthest ends of different nodes decide."""
    spans = sorted((o, o + n, k) for k in nodes for o, n in fields.get(k, ()))
    first, second = (-1, None), (-1, None)
    waiting: list[tuple[int, int, object]] = []
    for start, end, node in spans:
        if waiting and waiting[0][0] < start:
            for _, e, k in waiting:
                if k == first[1]:
                    first = max(first, (e, k), key=lambda x: x[0])
                elif e > first[0]:
                    first, second = (e, k), first
                elif e > second[0]:
                    second = (e, k)
            waiting = []
        if (second if first[1] == node else first)[0] > start:
            return True
        waiting.append((start, end, node))
    return False


def weak_parts(nodes: Iterable, edges: dict) -> list[list]:
    """The nodes of each weakly connected part, in order."""
    near: dict = {n: [] for n in nodes}
    for a, outs in edges.items():
        for b in outs:
            near[a].append(b)
            near[b].append(a)
    seen, parts = set(), []
    for start in sorted(near):
        if start in seen:
            continue
        part, todo = [], [start]
        seen.add(start)
        while todo:
            n = todo.pop()
            part.append(n)
            new = [m for m in near[n] if m not in seen]
            seen.update(new)
            todo += set(new)
        parts.append(sorted(part))
    return parts


def settle(edges: dict, fields: dict) -> tuple[set[tuple], dict]:
    """(evil edges, label of each node): cut and split until no part holds a conflict between its nodes."""
    nodes = {*edges, *(b for outs in edges.values() for b in outs), *fields}
    evil: set[tuple] = set()
    labels: dict = {}
    todo = weak_parts(nodes, edges)
    while todo:
        part = todo.pop()
        if not crossing(part, fields):
            labels.update(dict.fromkeys(part, part[0]))
            continue
        inside = {a: edges[a] for a in part if edges.get(a)}
        cut = evil_edges(inside, fields) & {(a, b) for a, outs in inside.items() for b in outs}
        if not cut:
            raise ValueError(f"the conflict in the component of {part[0]} can't be cut")
        evil |= cut
        for a, b in cut:
            edges[a] = edges[a] - {b}
        todo += weak_parts(part, {a: edges[a] for a in part if edges.get(a)})
    return evil, labels


def _group(table: pa.Table) -> pa.Table:
    edges: dict = {}
    fields: dict = {}
    for r in table.to_pylist():
        if r["dst"] is not None:
            edges.setdefault(r["src"], set()).add(r["dst"])
        else:
            fields[r["src"]] = frozenset((x["offset"], x["size"]) for x in r["fields"])
    evil, labels = settle(edges, fields)
    rows = [("evil", a, b) for a, b in sorted(evil)] + [("label", a, b) for a, b in sorted(labels.items())]
    return pa.table({name: pa.array([r[k] for r in rows], pa.string()) for k, name in enumerate(("what", "a", "b"))})


def remove_conflicts(edges: DataFrame, fields: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, labels): edges without evil ones, and (node, label) components of what is left.

    edges: (src, dst) strings; fields: (base, offset, size). Raises if a conflict can't be cut.
    """
    edges = materialize(edges.select("src", "dst").distinct(), "tfg")
    labels = materialize(min_labels(edges, nodes=fields.select(F.col("base").alias("node")).distinct()), "components")
    held = fields.join(labels.select(F.col("node").alias("base"), F.col("label").alias("component")), "base")
    dirty = materialize(cross_conflicted(held, "component", "base"), "dirty")
    inside = edges.join(labels.select(F.col("node").alias("src"), F.col("label").alias("component")), "src").join(dirty, "component", "left_semi")
    own = held.join(dirty, "component", "left_semi").groupBy("component", "base").agg(F.collect_set(F.struct(F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size"))).alias("fields"))
    kind = "array<struct<offset:bigint,size:bigint>>"
    rows = inside.select("component", "src", "dst", F.lit(None).cast(kind).alias("fields")).unionByName(own.select("component", F.col("base").alias("src"), F.lit(None).cast("string").alias("dst"), F.col("fields").cast(kind)))
    settled = materialize(rows.groupBy("component").applyInArrow(_group, "what string, a string, b string"), "settled")
    evil = settled.where("what = 'evil'").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    clean = labels.join(dirty.withColumnRenamed("component", "label"), "label", "left_anti").select("node", "label")
    return materialize(without_edges(edges, evil), "tfg"), materialize(clean.unionByName(settled.where("what = 'label'").select(F.col("a").alias("node"), F.col("b").alias("label"))), "components")
