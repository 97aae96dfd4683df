"""Queries of the symbol, call, constraint, type and graph operators that work on facts, each with its SQL.

The tables stand in for facts: parts for symbols and types, orders and lines
for expressions, call sites and accesses, the geography for a call graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as S
from ..operators import calls, candidates, constraints, fields, graph, sizes, symbols, tournament, types
from ..storage import materialize
from .views import GEOGRAPHY_SQL, MODE_SQL, TURNS_SQL, accesses, accesses_sql, geography, table, turns

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def key(prefix: str, column: str | Column) -> Column:
    return F.concat(F.lit(prefix), (F.col(column) if isinstance(column, str) else column).cast("string"))


# Symbols, variable nodes and types.

SYMBOLS_SQL = "sy AS (SELECT 'f' || p_partkey % 50 AS func, 's' || p_partkey AS sym, 'n' || p_partkey AS name, CASE p_partkey % 3 WHEN 0 THEN 'param' ELSE 'local' END AS role, CASE WHEN p_size % 2 = 0 THEN 'stack' ELSE 'register' END AS storage_kind, p_size % 5 = 0 AS isolated, CASE WHEN p_size % 4 = 1 THEN 'XMM' || p_size ELSE 'RDI' END AS reg FROM part), vn AS (SELECT 'f' || l_partkey % 50 AS func, 's' || l_partkey AS sym, l_linenumber // 4 AS g FROM lineitem)"


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        key("f", k % 50).alias("func"), key("s", k).alias("sym"), key("n", k).alias("name"), F.when(k % 3 == 0, "param").otherwise("local").alias("role"),
        F.when(F.col("p_size") % 2 == 0, "stack").otherwise("register").alias("storage_kind"), (-k).alias("stack_offset"), (k * 4).alias("pc_addr"), (F.col("p_size") % 5 == 0).alias("is_isolated"),
        F.when(F.col("p_size") % 4 == 1, key("XMM", "p_size")).otherwise("RDI").alias("reg"),
    )


def _varnodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(key("f", F.col("l_partkey") % 50).alias("func"), key("s", "l_partkey").alias("sym"), F.expr("l_linenumber div 4").alias("merge_group"))


@query(f"""WITH {SYMBOLS_SQL}, m AS (SELECT func, sym FROM vn GROUP BY 1, 2 HAVING count(DISTINCT g) > 1) SELECT 'merged' AS what, func, sym FROM m UNION ALL SELECT 'split', sy.func, sy.sym FROM sy JOIN m USING (func, sym) WHERE role = 'param' AND NOT isolated
UNION ALL SELECT 'used', func, sym FROM sy WHERE sym IN (SELECT sym FROM vn) UNION ALL SELECT 'integer', func, sym FROM sy WHERE reg NOT LIKE '%XMM%'""")
def symbol_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged variables, parameters to split, used symbols, parameters outside of vector registers."""
    s, v = _symbols(spark, sf_dir), _varnodes(spark, sf_dir)
    found = {"merged": calls.merged_variables(v), "split": symbols.split_parameters(s, v), "used": symbols.used_symbols(s, v), "integer": symbols.integer_parameters(s)}
    out = [x.select(F.lit(what).alias("what"), "func", "sym") for what, x in found.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("""SELECT CASE WHEN p_size % 2 = 0 THEN 'f' || p_partkey % 50 || ':stack[' || CASE WHEN p_partkey = 0 THEN '0x0' ELSE '-0x' || lower(to_hex(p_partkey)) END || ']' WHEN p_partkey % 3 = 0 THEN 'f' || p_partkey % 50 || ':n' || p_partkey ELSE 'f' || p_partkey % 50 || ':RegUniq[0x' || lower(to_hex(p_partkey * 4)) || ']' END AS loc, 's' || p_partkey AS old_sym, 't' || p_partkey AS new_sym FROM part""")
def symbol_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols found again by their places after another decompilation renamed them."""
    s = _symbols(spark, sf_dir)
    return symbols.match_symbols(s, s.withColumn("sym", F.concat(F.lit("t"), F.substring("sym", 2, 20))))


@query("""SELECT DISTINCT l_suppkey AS func, l_orderkey || ':' || l_linenumber AS op FROM lineitem WHERE (l_suppkey, l_partkey) IN (SELECT p_partkey % 100 + 1, p_partkey FROM part) OR (l_suppkey, -l_orderkey) IN (SELECT s_suppkey, -s_nationkey FROM supplier)""")
def traced_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations with an input that holds a fact (P8); a part's node and an order's are never the same, whatever their numbers."""
    op = F.concat(F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string"))
    ops = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("func"), op.alias("op"), F.array(key("p", "l_partkey"), key("o", "l_orderkey")).alias("input_vns"))
    facts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 100 + 1).alias("func"), key("p", "p_partkey").alias("vn")).unionByName(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("func"), key("o", "s_nationkey").alias("vn")))
    return symbols.traced_ops(ops, facts)


@query("""WITH f AS (SELECT DISTINCT l_suppkey AS func, l_linenumber AS vn, 'e' || l_partkey AS expr FROM lineitem) SELECT func, vn, expr, (row_number() OVER (PARTITION BY func, vn ORDER BY expr) - 1)::INT AS ord FROM f QUALIFY row_number() OVER (PARTITION BY func, vn ORDER BY expr) <= 10""")
def bounded_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten facts of each variable."""
    return calls.bounded_facts(table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("func"), F.col("l_linenumber").alias("vn"), key("e", "l_partkey").alias("expr")))


@query("""SELECT o_custkey AS func, o_orderkey AS vn, CASE WHEN strpos('FOP', lead(o_orderstatus) OVER w) > strpos('FOP', o_orderstatus) THEN lead(o_orderstatus) OVER w ELSE o_orderstatus END AS dt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)""")
def types_beyond_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order is cast to the customer's next one: the more specific status counts."""
    orders = table(spark, sf_dir, "orders")
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    casts = orders.select(F.col("o_custkey").alias("func"), F.lit("CAST").alias("opcode"), nxt.alias("output_vn"), F.array("o_orderkey").alias("input_vns")).where("output_vn IS NOT NULL")
    ranks = orders.select(F.col("o_orderstatus").alias("dt")).distinct().select("dt", F.expr("instr('FOP', dt)").alias("rank"))
    return symbols.type_through_casts(orders.select(F.col("o_custkey").alias("func"), F.col("o_orderkey").alias("vn"), F.col("o_orderstatus").alias("dt")), casts, ranks)


@query("""SELECT p_name AS dt, p_size AS length, '/c/' || p_type AS category FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_size DESC, p_type DESC) = 1""")
def type_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per type name."""
    return types.load_catalogue(table(spark, sf_dir, "part").select(F.col("p_name").alias("dt"), F.col("p_size").alias("length"), key("/c/", "p_type").alias("category")))


TYPES_SQL = "t AS (SELECT p_partkey AS dt, CASE p_partkey % 5 WHEN 0 THEN 'struct' WHEN 1 THEN 'union' WHEN 2 THEN 'pointer' WHEN 3 THEN 'array' ELSE 'primitive' END AS kind, CASE p_size % 3 WHEN 0 THEN 'struct' WHEN 1 THEN 'union' ELSE 'primitive' END AS other, '/' || p_type || '/' || p_brand AS category FROM part)"


@query(f"""WITH {TYPES_SQL}, w AS (SELECT *, CASE other WHEN 'struct' THEN 'Struct' WHEN 'union' THEN 'Union' ELSE 'Primitive' END AS word FROM t)
SELECT dt, CASE kind WHEN 'struct' THEN 'NestedStruct' WHEN 'union' THEN 'NestedUnion' WHEN 'array' THEN 'ArrayOf' || word WHEN 'pointer' THEN 'PointerTo' || word ELSE 'Primitive' END AS "desc", kind IN ('struct', 'union') OR kind = 'pointer' AND other <> 'primitive' AS complex, category LIKE '/ECONOMY/%' AS economy FROM w""")
def type_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member descriptions, complex types, and types below a category."""
    k, size = F.col("p_partkey"), F.col("p_size")
    kind = F.when(k % 5 == 0, "struct").when(k % 5 == 1, "union").when(k % 5 == 2, "pointer").when(k % 5 == 3, "array").otherwise("primitive")
    rows = table(spark, sf_dir, "part").select(k.alias("dt"), kind.alias("kind"), F.when(size % 3 == 0, "struct").when(size % 3 == 1, "union").otherwise("primitive").alias("pointee_kind"), F.concat(F.lit("/"), "p_type", F.lit("/"), "p_brand").alias("category"))
    flag = lambda found, name: found.select("dt", F.lit(True).alias(name))
    out = rows.join(flag(symbols.complex_types(rows), "complex"), "dt", "left").join(flag(symbols.in_category(rows, "/ECONOMY"), "economy"), "dt", "left")
    return out.select("dt", types.describe_member(F.col("kind"), F.col("pointee_kind"), F.col("pointee_kind")).alias("desc"), F.coalesce("complex", F.lit(False)).alias("complex"), F.coalesce("economy", F.lit(False)).alias("economy"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, o BETWEEN 0 AND 8192 AS sane, o % 8 = 0 AS aligned, o <> 0 AS nonzero, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'qword *' WHEN l_returnflag = 'R' THEN CASE s WHEN 1 THEN 'byte' WHEN 2 THEN 'word' WHEN 4 THEN 'dword' WHEN 8 THEN 'qword' ELSE 'undefined' END ELSE l_returnflag END AS dt
FROM (SELECT *, l_partkey * 8 - l_orderkey % 640 AS o, l_linenumber AS s FROM lineitem)""")
def scalar_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset sanity, alignment, constants, and stand-ins of undefined types."""
    o = F.col("l_partkey") * 8 - F.col("l_orderkey") % 640
    undefined = F.col("l_returnflag") == "R"
    dt = S.normal_type(F.col("l_linenumber"), F.col("l_returnflag"), undefined, F.col("l_linestatus") == "O")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", S.sane_offset(o).alias("sane"), S.aligned(o).alias("aligned"), S.nonzero_constant(F.lit("const"), o).alias("nonzero"), dt.alias("dt"))


@query("""SELECT l_orderkey, 'Struct_' || substr(sha256(string_agg(DISTINCT 'e' || l_partkey, ',' ORDER BY 'e' || l_partkey)), 1, 8) AS name FROM lineitem GROUP BY 1""")
def short_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names from member keys: equal members, equal names."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(S.unique_names("Struct", F.collect_set(key("e", "l_partkey"))).alias("name"))


# Constraints.


@query(f"""WITH {accesses_sql()} SELECT CASE WHEN o_orderstatus = 'F' THEN 'c' || o_custkey ELSE 'o' || base END AS c, count(*)::BIGINT AS accesses, count(DISTINCT "offset")::BIGINT AS fields FROM fa LEFT JOIN orders ON o_orderkey = base GROUP BY 1""")
def built_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accesses by the component of their base, or by the base itself outside of the graph."""
    rows = accesses(spark, sf_dir).withColumn("base", key("o", "base"))
    labels = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(key("o", "o_orderkey").alias("node"), key("c", "o_custkey").alias("label"))
    return constraints.build(rows, labels).groupBy("c").agg(F.count("*").alias("accesses"), F.count_distinct("offset").alias("fields"))


@query("""WITH r AS (SELECT 'c' || o_custkey AS c, (l_linenumber - 1) * 4::BIGINT AS "offset", 'k' || p_size AS target, count(DISTINCT l_partkey) AS variables FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE (l_linenumber - 1) * 4 % 8 = 0 GROUP BY 1, 2, 3)
SELECT c, "offset", target, variables::BIGINT AS variables FROM r QUALIFY row_number() OVER (PARTITION BY c, "offset" ORDER BY variables DESC, target) = 1""")
def pointer_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's aligned fields point to the size of the part in that line; most parts win."""
    rows = table(spark, sf_dir, "lineitem").select(key("o", "l_orderkey").alias("base"), ((F.col("l_linenumber") - 1) * 4).cast("long").alias("offset"), key("p", "l_partkey").alias("field_expr"))
    own = table(spark, sf_dir, "orders").select(key("o", "o_orderkey").alias("expr"), key("c", "o_custkey").alias("c")).unionByName(table(spark, sf_dir, "part").select(key("p", "p_partkey").alias("expr"), key("k", "p_size").alias("c")))
    return constraints.final_references(constraints.references(rows, own, own))


@query("""SELECT 'o' || o_orderkey AS c, 'o' || min(o_orderkey::VARCHAR) OVER (PARTITION BY o_custkey) AS label FROM orders UNION SELECT 'c' || o_custkey, 'c' || o_custkey FROM orders""")
def merged_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders that one place of a customer leads to are one constraint."""
    refs = table(spark, sf_dir, "orders").select(key("c", "o_custkey").alias("c"), F.lit(0).alias("offset"), key("o", "o_orderkey").alias("target"))
    nodes = refs.select("c").unionByName(refs.select(F.col("target").alias("c"))).distinct()
    return constraints.merge_aliases(nodes.withColumn("offset", F.lit(0)).withColumn("size", F.lit(8)), refs)


@query("""SELECT 'n' || c_nationkey AS "outer", 'k' || o_orderpriority AS "inner", o_orderkey % 8 * 8 AS delta, count(DISTINCT o_orderkey)::BIGINT AS variables FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 8 <> 0 GROUP BY 1, 2, 3""")
def nesting_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as arguments, at an offset of their customers: a priority is nested in a nation."""
    orders = table(spark, sf_dir, "orders")
    exprs = orders.select(key("o", "o_orderkey").alias("expr"), F.lit("sum").alias("kind"), key("c", "o_custkey").alias("base"), (F.col("o_orderkey") % 8 * 8).alias("off"), F.lit(None).cast("string").alias("idx"))
    own = orders.select(key("o", "o_orderkey").alias("expr"), key("k", "o_orderpriority").alias("c")).unionByName(table(spark, sf_dir, "customer").select(key("c", "c_custkey").alias("expr"), key("n", "c_nationkey").alias("c")))
    return constraints.nesting_candidates(exprs, exprs, own)


@query(f"""WITH {accesses_sql("l_partkey")}, {MODE_SQL} SELECT a.p_partkey AS c, "offset" + 64 * d AS "offset", m.size, m.dt FROM part a, range(0, 12) t(d) JOIN mode m ON m.base = a.p_partkey + d WHERE a.p_partkey % 12 + d < 12""")
def populated_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is nested in the one before, in chains of twelve: the fields of all that follow come along."""
    modes = fields.most_accessed(accesses(spark, sf_dir, "l_partkey")).withColumnRenamed("base", "c")
    part = table(spark, sf_dir, "part")
    nests = part.where("p_partkey % 12 < 11").select(F.col("p_partkey").alias("outer"), (F.col("p_partkey") + 1).alias("inner"), F.lit(64).cast("long").alias("delta"))
    return constraints.populate(modes, nests).join(part.select(F.col("p_partkey").alias("c")), "c", "left_semi")


@query(f"""WITH {accesses_sql("l_partkey")} SELECT 'kept' AS what, p_partkey AS c FROM part WHERE p_partkey IN (SELECT base FROM fa) AND p_size % 3 <> 0 AND p_size % 7 <> 0 UNION ALL SELECT 'empty', p_partkey FROM part WHERE p_partkey NOT IN (SELECT base FROM fa WHERE "offset" = 4) AND p_size % 3 <> 0 AND p_size % 7 <> 0""")
def filtered_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints that are neither primitive nor in the middle of a pointer chain, and empty ones."""
    every = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("c"), "p_size")
    held = accesses(spark, sf_dir, "l_partkey").select(F.col("base").alias("c"), "offset")
    third, seventh = every.where("p_size % 3 = 0"), every.where("p_size % 7 = 0")
    kept = constraints.drop_redundant(every.select("c"), held, third, seventh).select(F.lit("kept").alias("what"), "c")
    return kept.unionByName(constraints.empty_constraints(every, held.where("offset = 4"), third, seventh).select(F.lit("empty").alias("what"), "c"))


@query(f"""WITH {accesses_sql()}, p AS (SELECT base // 2 * 2 AS c, base % 2 AS rank, "offset", size, dt, op FROM fa), bad AS (SELECT DISTINCT a.c FROM p a JOIN p b ON a.c = b.c AND a.rank <> b.rank AND a."offset" < b."offset" AND b."offset" < a."offset" + a.size),
m AS (SELECT c, "offset", count(DISTINCT (size, dt, op))::BIGINT AS accesses FROM p WHERE c NOT IN (SELECT c FROM bad) GROUP BY 1, 2), r AS (SELECT o_orderkey // 2 * 2 AS c, (o_custkey % 3 * 4)::BIGINT AS "offset", arg_max(o_orderpriority, o_orderkey % 2) AS target FROM orders GROUP BY 1, 2)
SELECT m.c, "offset", accesses, target FROM m LEFT JOIN r USING (c, "offset")""")
def merged_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring orders merged unless they conflict; where both have a reference the second's counts."""
    rows = accesses(spark, sf_dir).withColumnRenamed("base", "c")
    orders = table(spark, sf_dir, "orders")
    everyone = rows.select("c").unionByName(orders.select(F.col("o_orderkey").alias("c"))).select(F.expr("c div 2 * 2").alias("first")).distinct()
    refs = orders.select(F.col("o_orderkey").alias("c"), (F.col("o_custkey") % 3 * 4).alias("offset"), F.col("o_orderpriority").alias("target"), F.lit(1).alias("ptr_level"))
    nests = orders.where("false").select(F.col("o_orderkey").alias("outer"), F.col("o_orderkey").alias("inner"), F.lit(0).alias("delta"))
    merged, ref, _ = constraints.merge_constraints(everyone.select("first", (F.col("first") + 1).alias("second")), rows, refs, nests)
    return merged.groupBy("c", "offset").agg(F.count("*").alias("accesses")).join(ref.select("c", "offset", "target"), ["c", "offset"], "left")


@query("""WITH w AS (SELECT (l_linenumber - 1) * 8::BIGINT AS "offset", 'p' || l_orderkey % 1000 AS base, 'e' || l_partkey AS field_expr FROM lineitem) SELECT DISTINCT base, "offset", field_expr FROM w WHERE (base, "offset") IN (SELECT 'p' || p_partkey, (p_size % 8 * 8)::BIGINT FROM part)""")
def fields_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expressions of a field of a base."""
    held = table(spark, sf_dir, "lineitem").select(key("p", F.col("l_orderkey") % 1000).alias("base"), ((F.col("l_linenumber") - 1) * 8).cast("long").alias("offset"), key("e", "l_partkey").alias("field_expr"))
    return constraints.field_expressions(held, table(spark, sf_dir, "part").select(key("p", "p_partkey").alias("base"), (F.col("p_size") % 8 * 8).cast("long").alias("offset")))


@query("""SELECT 'c' || o_custkey AS component, bool_or(o_orderstatus = 'P') AS is_composite, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS attributes, array_to_string(list_sort(list(DISTINCT o_orderkey % 9)), ',') AS sizes, array_to_string(list_sort(list(DISTINCT o_orderkey % 4)), ',') AS element_sizes, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS inferred FROM orders GROUP BY 1""")
def merged_skeletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a customer's orders hold apart from fields."""
    orders = table(spark, sf_dir, "orders").withColumn("base", F.col("o_orderkey"))
    members = orders.select("base", key("c", "o_custkey").alias("component"), (F.col("o_orderstatus") == "P").alias("is_composite"))
    out = fields.merge_skeletons(members, orders.select("base", F.col("o_orderpriority").alias("attr")), orders.select("base", (F.col("o_orderkey") % 9).alias("size")), orders.select("base", (F.col("o_orderkey") % 4).alias("size")), orders.select("base", F.col("o_orderstatus").alias("dt")))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("attributes", "sizes", "element_sizes", "inferred")})


# Candidates and the judge.


@query(f"""WITH {accesses_sql("l_partkey")}, r AS (SELECT base AS c, 4 AS s, 12 AS e, op, "offset" FROM fa WHERE base % 2 = 0) SELECT DISTINCT c, s AS start, e AS "end", op AS base FROM r WHERE "offset" >= 4 AND "offset" < 12 UNION SELECT DISTINCT base, NULL, NULL, op FROM fa WHERE base % 2 = 1""")
def retyped_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables to be typed anew: those that access a candidate's range, or all where it has none (M7)."""
    rows = accesses(spark, sf_dir, "l_partkey").select(F.col("base").alias("c"), F.col("op").alias("base"), "offset")
    even = F.col("c") % 2 == 0
    return candidates.retype_variables(rows, rows.select("c").distinct().select("c", F.when(even, 4).alias("start"), F.when(even, 12).alias("end")))


@query("""SELECT p_brand AS brand, p_name AS name, p_size AS members FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_name) = 1""")
def most_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The type with most members of each group."""
    return candidates.most_members(table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.col("p_size").alias("members")), "brand")


@query("""SELECT p_brand AS c, p_type AS start, min(p_partkey) AS name, p_size AS layout_hash FROM part GROUP BY 1, 2, 4""")
def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate for each layout in a range."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("c"), F.col("p_type").alias("start"), F.lit(0).alias("end"), F.col("p_partkey").alias("name"), F.col("p_size").alias("layout_hash"))
    return candidates.dedup_candidates(rows).drop("end")


JUDGED_SQL = "k AS (SELECT p_partkey // 2 AS m, p_partkey % 2 AS side, p_partkey AS p, f, (p_partkey * (f + 3)) % 17 AS code FROM part, range(0, 2) t(f))"


@query(f"""WITH {JUDGED_SQL}, j AS (SELECT a.p AS player1, b.p AS player2, count(*) FILTER (a.code >= b.code) AS zero, count(*) FILTER (a.code < b.code) AS one FROM k a JOIN k b ON a.m = b.m AND a.f = b.f AND a.side = 0 AND b.side = 1 GROUP BY 1, 2) SELECT player1, player2, zero > one AS first_wins FROM j""")
def judged_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches decided by votes on the code of functions that both candidates have."""
    part = table(spark, sf_dir, "part")
    codes = part.select(F.lit("g").alias("grp"), F.col("p_partkey").alias("player"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("func")).withColumn("code", F.col("player") * (F.col("func") + 3) % 17)
    pairs = part.groupBy(F.expr("p_partkey div 2").alias("m")).agg(F.min("p_partkey").alias("player1"), F.max("p_partkey").alias("player2")).where("player1 < player2")
    judge = tournament.vote_judge(codes, lambda c: c.select("match", F.when(F.col("code1") >= F.col("code2"), 0).otherwise(1).alias("vote")))
    return judge(pairs.select(F.lit("g").alias("grp"), F.lit("w").alias("bracket"), "player1", "player2")).select("player1", "player2", "first_wins")


# Sizes, calls and graphs.


def _wrappers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, orders): a constant of each order flows to its customer's allocation; the result flows to orders that are not filled."""
    orders = table(spark, sf_dir, "orders")
    to = orders.select(key("k", "o_orderkey").alias("src"), key("n", "o_custkey").alias("dst"), F.lit("CALL").alias("edge_type"))
    back = orders.where("o_orderstatus <> 'F'").select(key("r", "o_custkey").alias("src"), key("v", "o_orderkey").alias("dst"), F.lit("RETURN").alias("edge_type"))
    return to.unionByName(back), orders


@query("""SELECT 'v' || o_orderkey AS receiver, o_orderkey AS cs, o_orderkey % 64 AS size FROM orders WHERE o_orderstatus <> 'F'""")
def wrapper_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constants that reach an allocation count where its result flows to the caller."""
    edges, orders = _wrappers(spark, sf_dir)
    allocations = orders.select(F.col("o_custkey").alias("cs"), key("n", "o_custkey").alias("size_expr"), key("r", "o_custkey").alias("result")).distinct()
    constants = orders.select(key("k", "o_orderkey").alias("expr"), F.col("o_orderkey").alias("cs"), (F.col("o_orderkey") % 64).alias("value"), key("v", "o_orderkey").alias("receiver"))
    return sizes.wrapper_sizes(edges, allocations, constants)


@query("""SELECT 'k' || o_orderkey AS src, 'n' || o_custkey AS dst, 'CALL' AS edge_type FROM orders""")
def cut_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a wrapper's result to its receivers go."""
    edges, orders = _wrappers(spark, sf_dir)
    return sizes.cut_wrappers(edges, orders.select(key("r", "o_custkey").alias("src"), key("v", "o_orderkey").alias("dst")))


@query(f"""WITH {GEOGRAPHY_SQL} SELECT src AS caller, dst AS callee FROM geo WHERE src LIKE 'r%' AND substr(src, 2)::INT % 2 = 0 UNION SELECT g.src, g.dst FROM geo g JOIN geo up ON up.dst = g.src WHERE up.src LIKE 'r%' AND substr(up.src, 2)::INT % 2 = 0 AND substr(g.src, 2)::INT % 5 <> 0""")
def called_from_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call graph below every other region; every fifth nation is external and not entered (G1)."""
    edges = geography(spark, sf_dir)
    ends = edges.select(F.col("src").alias("func")).unionByName(edges.select(F.col("dst").alias("func"))).distinct()
    number = F.substring("func", 2, 20).cast("long")
    entry = number * 4 + F.expr("instr('rncs', substring(func, 1, 1))")
    functions = ends.select("func", entry.alias("entry"), F.col("func").alias("name"), (F.col("func").startswith("n") & (number % 5 == 0)).alias("is_external"), F.lit(False).alias("is_thunk"))
    insts = edges.join(functions.select(F.col("func").alias("dst"), F.col("entry").alias("flow")), "dst").select(F.col("src").alias("caller"), F.lit("CALL").alias("mnemonic"), "flow")
    return calls.call_graph(functions, insts, functions.where(F.col("func").startswith("r") & (number % 2 == 0)).select("func"))


@query(f"""WITH RECURSIVE {GEOGRAPHY_SQL}, u AS (SELECT src AS a, dst AS b FROM geo UNION SELECT dst, src FROM geo), p AS (SELECT 'n0' AS node, 'n0' AS path UNION ALL SELECT u.b, p.path || '>' || u.b FROM p JOIN u ON u.a = p.node WHERE NOT list_contains(string_split(p.path, '>'), u.b)) SELECT 'n0' AS seed, node, path FROM p""")
def shortest_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes on the way from one nation to all it is linked with."""
    tree = materialize(graph.shortest_paths(geography(spark, sf_dir), table(spark, sf_dir, "nation").where("n_nationkey = 0").select(F.lit("n0").alias("node"))), "tree")
    return graph.backtrack(tree, tree.select("seed", "node")).select("seed", "node", F.array_join("path", ">").alias("path"))


@query(f"""WITH {GEOGRAPHY_SQL} SELECT src, dst, edge_type FROM geo WHERE edge_type <> 'RETURN' AND dst NOT IN (SELECT 'c' || c_custkey FROM customer WHERE c_acctbal < 0) AND src <> 'n3' AND dst <> 'n3'""")
def removed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of two types, without those to customers in debt and at one nation."""
    edges = geography(spark, sf_dir)
    evil = edges.join(table(spark, sf_dir, "customer").where("c_acctbal < 0").select(key("c", "c_custkey").alias("dst")), "dst", "left_semi")
    typed = edges.where(F.col("edge_type").isin("CALL", "DATAFLOW"))
    return graph.without_nodes(graph.without_edges(typed, evil), table(spark, sf_dir, "nation").where("n_nationkey = 3").select(key("n", "n_nationkey").alias("node"))).select("src", "dst", "edge_type")


@query("""SELECT 'n' || c_nationkey AS label, count(*) + 1 AS nodes FROM customer GROUP BY c_nationkey HAVING NOT bool_or(c_acctbal < -950)""")
def processable_graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations whose customers all have an edge; those deep in debt have lost theirs."""
    customer = table(spark, sf_dir, "customer")
    edges = customer.where("c_acctbal >= -950").select(key("n", "c_nationkey").alias("src"), key("c", "c_custkey").alias("dst"))
    nodes = customer.select(key("c", "c_custkey").alias("node"), key("n", "c_nationkey").alias("label"))
    return graph.processable(edges, nodes.unionByName(nodes.select(F.col("label").alias("node"), "label").distinct()))


@query(f"""WITH {TURNS_SQL}, n AS (SELECT src AS node FROM steps UNION SELECT dst FROM steps) SELECT node, split_part(node, ':', 1) || ':0' AS label FROM n""")
def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations closed to rings by an edge back from the last turn."""
    steps = turns(spark, sf_dir)
    last = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).where("last >= 1")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    return graph.strong_components(steps.unionByName(last.select(name(F.col("last")).alias("src"), name(F.lit(0)).alias("dst"))))


@query(f"""WITH {GEOGRAPHY_SQL}, n AS (SELECT src AS node FROM geo UNION SELECT dst FROM geo), h AS (SELECT node, CASE substr(node, 1, 1) WHEN 'r' THEN 2 WHEN 'n' THEN (node IN (SELECT src FROM geo))::INT ELSE 0 END AS height FROM n) SELECT node, height::INT AS height, row_number() OVER (PARTITION BY height ORDER BY node)::INT AS ord FROM h""")
def post_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves before nations before regions (O1)."""
    return graph.post_order(geography(spark, sf_dir))


@query(f"""WITH {GEOGRAPHY_SQL}, d AS (SELECT node, sum(i)::BIGINT AS n_in, sum(o)::BIGINT AS n_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM geo UNION ALL SELECT dst, 1, 0 FROM geo) GROUP BY 1) SELECT node, n_in, n_out FROM d WHERE node LIKE 'n%' ORDER BY n_out, node LIMIT 1""")
def least_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nation with the fewest customers and suppliers."""
    return graph.least_degree(geography(spark, sf_dir), table(spark, sf_dir, "nation").select(key("n", "n_nationkey").alias("node")), "n_out")
