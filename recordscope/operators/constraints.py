"""Final constraints of components: marking, references, aliases, nesting, filters.

Tables: fields (c, offset, size, dt, n) with one row per field of constraint c
by its most accessed type; profile (c, offset, min_size, max_size, same_size);
refs (c, offset, target); inferred (c, dt, kind, length, element).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .graph import min_labels
from .intervals import cross_conflicted, nest_conflicts


def build(accesses: DataFrame, labels: DataFrame) -> DataFrame:
    """Accesses with their constraint c: the component's label, or the base itself outside of the graph."""
    return accesses.join(labels.select(F.col("node").alias("base"), "label"), "base", "left").withColumn("c", F.coalesce("label", "base")).drop("label")


def mark_primitive(profile: DataFrame, modes: DataFrame, inferred: DataFrame, pointer_size: int = 8) -> DataFrame:
    """(c, mark, final_type): constraints that stand for primitives; the first rule that holds decides."""
    own = profile.groupBy("c").agg(F.count("*").alias("fields"), F.min("offset").alias("first"), F.min("min_size").alias("low"), F.max("max_size").alias("high"))
    first = modes.where("offset = 0").select("c", F.col("dt").alias("mode"))
    known = inferred.groupBy("c").agg(F.count("*").alias("kinds"), F.bool_and(F.col("kind") == "array").alias("arrays"), F.count_distinct(F.when(F.col("length") > 0, F.col("length"))).alias("lengths"), F.min("element").alias("element"))
    rows = own.join(first, "c", "left").join(known, "c", "full").withColumn("kinds", F.coalesce("kinds", F.lit(0)))
    lone = (F.col("fields") == 1) & (F.col("first") == 0) & (F.col("kinds") == 0)
    arrays = (F.col("kinds") > 0) & F.col("arrays")
    small = (F.col("fields") > 1) & (F.col("first") == 0) & (F.col("low") == F.col("high")) & (F.col("high") < pointer_size)
    mark = F.when(lone | arrays | (F.col("lengths") > 1), "pointer_to_primitive").when(small, "primitive_array")
    final = F.when(lone, F.col("mode")).when(arrays, F.col("element")).when(F.col("lengths") > 1, F.lit(None).cast("string")).when(small, F.col("mode"))
    return rows.select("c", mark.alias("mark"), final.alias("final_type")).where("mark IS NOT NULL")


def references(fields: DataFrame, exprs: DataFrame, constraint_of: DataFrame, pointer_size: int = 8) -> DataFrame:
    """(c, offset, target, variables): a loaded field of c that is itself a base points to that base's constraint.

    fields: (base, offset, field_expr); constraint_of: (expr, c). variables: how many expressions support it.
    """
    at = fields.where(F.col("offset") % pointer_size == 0).join(constraint_of.select(F.col("expr").alias("base"), "c"), "base")
    to = at.join(constraint_of.select(F.col("expr").alias("field_expr"), F.col("c").alias("target")), "field_expr")
    return to.groupBy("c", "offset", "target").agg(F.count_distinct("field_expr").alias("variables"))


def final_references(refs: DataFrame) -> DataFrame:
    """One target per (c, offset): most variables, then the smaller key."""
    order = Window.partitionBy("c", "offset").orderBy(F.desc("variables"), "target")
    return refs.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def pointer_chains(refs: DataFrame, profile: DataFrame, pointer_size: int = 8) -> DataFrame:
    """(c, offset, target, ptr_level): references followed through constraints that are lone pointers. Cycles end where they close."""
    sole = profile.groupBy("c").agg(F.count("*").alias("fields"), F.min("offset").alias("first"), F.min("min_size").alias("low"), F.max("max_size").alias("high")).where(f"fields = 1 AND first = 0 AND low = {pointer_size} AND high = {pointer_size}")
    hop = materialize(refs.where("offset = 0").join(sole.select("c"), "c", "left_semi").select(F.col("c").alias("target"), F.col("target").alias("to")), "hops")
    at = materialize(refs.select("c", "offset", "target", F.lit(1).alias("ptr_level"), F.array("target").alias("seen")), "chains")
    while True:
        moved = at.join(hop, "target", "left").withColumn("go", F.col("to").isNotNull() & ~F.array_contains("seen", F.coalesce("to", F.lit(""))))
        new = moved.select("c", "offset", F.when(F.col("go"), F.col("to")).otherwise(F.col("target")).alias("target"), (F.col("ptr_level") + F.col("go").cast("int")).alias("ptr_level"), F.when(F.col("go"), F.concat("seen", F.array("to"))).otherwise(F.col("seen")).alias("seen"), "go")
        new = materialize(new, "chains")
        at = new.drop("go")
        if new.where("go").isEmpty():
            return at.drop("seen")


def merge_aliases(accesses: DataFrame, refs: DataFrame, rounds: int = 16) -> DataFrame:
    """(c, label): constraints that are the same because equal offsets of one cluster lead to both.

    All targets of one (cluster, offset) are candidates for one cluster; those
    whose fields conflict stay apart. accesses: (c, offset, size).
    """
    known = materialize(accesses.select(F.col("c").alias("node")).distinct(), "nodes")
    labels = materialize(known.select("node", F.col("node").alias("label")), "labels")
    for _ in range(rounds):
        at = refs.join(labels.select(F.col("node").alias("c"), F.col("label").alias("from")), "c").join(labels.select(F.col("node").alias("target"), F.col("label").alias("to")), "target")
        anchors = at.groupBy("from", "offset").agg(F.min("to").alias("anchor"))
        pairs = at.join(anchors, ["from", "offset"]).where("to <> anchor").select(F.col("anchor").alias("src"), F.col("to").alias("dst")).distinct()
        pairs = materialize(pairs, "alias_pairs")
        if pairs.isEmpty():
            return labels.withColumnRenamed("node", "c")
        held = accesses.join(labels.select(F.col("node").alias("c"), "label"), "c").select("label", "offset", "size").distinct()
        sides = pairs.select(F.concat_ws("|", "src", "dst").alias("pair"), F.explode(F.array("src", "dst")).alias("label"))
        bad = cross_conflicted(sides.join(held, "label"), "pair", "label")
        good = materialize(pairs.withColumn("pair", F.concat_ws("|", "src", "dst")).join(bad, "pair", "left_anti").select("src", "dst"), "merged")
        if good.isEmpty():
            return labels.withColumnRenamed("node", "c")
        up = min_labels(good)
        labels = materialize(labels.join(up.select(F.col("node").alias("label"), F.col("label").alias("up")), "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")
    raise ValueError(f"aliases still change after {rounds} rounds")


def nesting(candidates: DataFrame, fields: DataFrame, marks: DataFrame, pointer_size: int = 8) -> DataFrame:
    """(outer, inner, delta): which constraint is nested in which and where; one inner per place.

    candidates: (outer, inner, delta, variables) from arguments ``base + delta``. Unaligned places, primitives, a constraint within itself and
    conflicts are left out; of several, most variables win, then the smaller key.
    """
    plain = candidates.where((F.col("delta") != 0) & (F.col("delta") % pointer_size == 0) & (F.col("outer") != F.col("inner")))
    for side in ("outer", "inner"):
        plain = plain.join(marks.select(F.col("c").alias(side)), side, "left_anti")
    plain = plain.join(fields.select(F.col("c").alias("inner")).distinct(), "inner", "left_semi")
    plain = materialize(plain.select("outer", "inner", F.col("delta").cast("long").alias("delta"), "variables"), "nests")
    own = fields.select(F.col("c").alias("base"), F.col("offset").cast("long").alias("offset"), F.col("size").cast("long").alias("size"))
    good = plain.join(nest_conflicts(own, own, plain.select("outer", "inner", "delta").distinct()), ["outer", "inner", "delta"], "left_anti")
    order = Window.partitionBy("outer", "delta").orderBy(F.desc("variables"), "inner")
    return good.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").drop("_rn")


def populate(fields: DataFrame, nests: DataFrame) -> DataFrame:
    """Fields with those of nested constraints copied to their places, innermost first, to any depth; a cycle of nests raises an error."""
    own = fields.select("c", "offset", "size", "dt")
    out, layer, most, depth = own, own, nests.select("outer").distinct().count(), 0
    while True:
        moved = nests.select("outer", F.col("inner").alias("c"), "delta").join(layer, "c").select(F.col("outer").alias("c"), (F.col("offset") + F.col("delta")).alias("offset"), "size", "dt")
        layer = materialize(moved.join(out, ["c", "offset"], "left_anti").distinct(), "nested")
        if layer.isEmpty():
            break
        depth += 1
        if depth > most:
            raise ValueError("constraints are nested in a cycle")
        out = out.unionByName(layer)
    return out.groupBy("c", "offset").agg(F.max_by(F.struct("size", "dt"), F.struct("size", "dt")).alias("_")).select("c", "offset", "_.size", "_.dt")


def nesting_candidates(arguments: DataFrame, exprs: DataFrame, constraint_of: DataFrame) -> DataFrame:
    """(outer, inner, delta, variables): arguments ``base + delta`` whose base and whose own expression both have a constraint.

    arguments: (expr); exprs: (expr, base, off, idx); constraint_of: (expr, c).
    """
    moved = arguments.select("expr").distinct().join(exprs.where("kind = 'sum' AND base IS NOT NULL AND idx IS NULL AND off <> 0").select("expr", "base", F.col("off").alias("delta")).distinct(), "expr")
    outer = moved.join(constraint_of.select(F.col("expr").alias("base"), F.col("c").alias("outer")), "base")
    both = outer.join(constraint_of.select("expr", F.col("c").alias("inner")), "expr")
    return both.groupBy("outer", "inner", "delta").agg(F.count_distinct("expr").alias("variables"))


def field_expressions(fields: DataFrame, wanted: DataFrame) -> DataFrame:
    """(base, offset, field_expr): the expressions of the fields that wanted (base, offset) asks for."""
    return wanted.select("base", "offset").distinct().join(fields.select("base", "offset", "field_expr").distinct(), ["base", "offset"])


def merge_constraints(pairs: DataFrame, accesses: DataFrame, refs: DataFrame, nests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accesses, refs, nests) of the merged constraints, named by the pair's first; pairs with a conflict are left out.

    pairs: (first, second). accesses: (c, offset, size, dt, op); of refs (c, offset,
    target, ptr_level) and nests (outer, inner, delta), the second's count where both have one at a place.
    """
    sides = pairs.select(F.concat_ws("|", "first", "second").alias("pair"), "first", F.explode(F.array(F.struct(F.col("first").alias("c"), F.lit(0).alias("rank")), F.struct(F.col("second").alias("c"), F.lit(1).alias("rank")))).alias("x")).select("pair", "first", "x.c", "x.rank")
    held = sides.join(accesses, "c")
    good = materialize(sides.join(cross_conflicted(held, "pair", "c"), "pair", "left_anti"), "pairs")
    last = lambda rows, keys, values: rows.groupBy("first", *keys).agg(F.max_by(F.struct(*values), "rank").alias("_"))
    merged = good.join(accesses, "c").select(F.col("first").alias("c"), "offset", "size", "dt", "op").distinct()
    ref = last(good.join(refs, "c"), ["offset"], ["target", "ptr_level"]).select(F.col("first").alias("c"), "offset", "_.target", "_.ptr_level")
    nest = last(good.join(nests.withColumnRenamed("outer", "c"), "c"), ["delta"], ["inner"]).select(F.col("first").alias("outer"), "_.inner", "delta")
    return merged, ref, nest


def empty_constraints(constraints: DataFrame, fields: DataFrame, inferred: DataFrame, attributes: DataFrame) -> DataFrame:
    """(c) without fields, inferred types and attributes; sizes don't count."""
    kept = constraints.select("c").distinct()
    for rows in (fields, inferred, attributes):
        kept = kept.join(rows.select("c").distinct(), "c", "left_anti")
    return kept


def drop_redundant(constraints: DataFrame, fields: DataFrame, marks: DataFrame, mids: DataFrame) -> DataFrame:
    """Constraints with fields that are neither primitives nor pointers in the middle of a chain."""
    return constraints.join(fields.select("c").distinct(), "c", "left_semi").join(marks.select("c"), "c", "left_anti").join(mids.select("c").distinct(), "c", "left_anti")
