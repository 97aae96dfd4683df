"""Queries of the graph, call, size and type operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls, graph, sizes, types
from ..storage import materialize
from .views import GEOGRAPHY_SQL, TURNS_SQL, geography, table, turns

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


@query("""SELECT 'o' || o_orderkey AS node, 'c' || o_custkey AS label FROM orders UNION SELECT 'c' || o_custkey, 'c' || o_custkey FROM orders UNION SELECT 'c' || c_custkey, 'c' || c_custkey FROM customer""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with its customer; customers without orders are alone."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    edges = table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"))
    return graph.min_labels(edges, nodes=table(spark, sf_dir, "customer").select(name("c", "c_custkey").alias("node")))


@query(f"WITH {GEOGRAPHY_SQL}, n AS (SELECT src AS node, 0 AS i, 1 AS o FROM geo UNION ALL SELECT dst, 1, 0 FROM geo) SELECT node, CASE WHEN sum(i) = 0 THEN 'source' ELSE 'sink' END AS role FROM n GROUP BY node HAVING sum(i) = 0 OR sum(o) = 0")
def sources_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.sources_and_sinks(geography(spark, sf_dir))


PATHS_SQL = f"WITH RECURSIVE {GEOGRAPHY_SQL}, p AS (SELECT DISTINCT src AS node, src AS path FROM geo WHERE src NOT IN (SELECT dst FROM geo) UNION ALL SELECT g.dst, p.path || '>' || g.dst FROM p JOIN geo g ON g.src = p.node)"


@query(f"{PATHS_SQL} SELECT path FROM p WHERE node NOT IN (SELECT src FROM geo)")
def all_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.simple_paths(geography(spark, sf_dir)).select(F.array_join("path", ">").alias("path"))


def _with_back_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geography, and an edge back to the nation from each customer in debt."""
    back = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
    return geography(spark, sf_dir).select("src", "dst").unionByName(back)


@query("""WITH b AS (SELECT DISTINCT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer WHERE c_acctbal < 0) SELECT src, dst FROM b UNION SELECT dst, src FROM b""")
def backward_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges back from customers in debt lie on no simple path from a source to a sink."""
    edges = _with_back_edges(spark, sf_dir)
    return graph.backward_edges(edges, graph.simple_paths(edges))


@query("""SELECT DISTINCT 'c' || c_custkey AS node FROM customer WHERE c_acctbal < 0""")
def uncovered_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an edge back are no sinks, so no path ends there."""
    edges = _with_back_edges(spark, sf_dir)
    return graph.uncovered_nodes(edges, graph.simple_paths(edges))


@query("""SELECT conv_id || ':0' AS path FROM conversations GROUP BY conv_id HAVING max(turn) >= 1 UNION ALL SELECT string_agg(conv_id || ':' || turn, '>' ORDER BY turn) FROM conversations WHERE turn >= 1 GROUP BY conv_id""")
def covered_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations closed to rings have no sources and sinks: the first turn covers itself, the others follow on one path."""
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    back = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last")).where("last >= 1").select(name(F.col("last")).alias("src"), name(F.lit(0)).alias("dst"))
    edges = materialize(turns(spark, sf_dir).unionByName(back), "edges")
    paths = materialize(graph.cover(edges, graph.simple_paths(edges)), "covered")
    graph.assert_covered(edges, paths)
    return paths.select(F.array_join("path", ">").alias("path"))


REACH_SQL = f"""WITH RECURSIVE {TURNS_SQL}, s AS (SELECT DISTINCT conv_id || ':' || turn AS node FROM conversations WHERE turn = 4),
r AS (SELECT node AS seed, node, 0 AS depth FROM s UNION SELECT r.seed, steps.src, r.depth + 1 FROM r JOIN steps ON steps.dst = r.node WHERE r.depth < 3)"""


@query(f"{REACH_SQL} SELECT seed, node, min(depth)::INT AS depth FROM r GROUP BY 1, 2")
def reach_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = table(spark, sf_dir, "conversations").where("turn = 4").select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("node"))
    return graph.reach(turns(spark, sf_dir), seeds, forward=False, depth=3)


@query(f"""WITH RECURSIVE {TURNS_SQL}, t AS (SELECT DISTINCT conv_id, turn, conv_id || ':' || turn AS src, conv_id || ':' || (turn * 2) AS dst FROM conversations),
r AS (SELECT src AS seed, src AS node FROM t UNION SELECT r.seed, steps.dst FROM r JOIN steps ON steps.src = r.node) SELECT src, dst, EXISTS (SELECT 1 FROM r WHERE seed = src AND node = dst) AS has_path FROM t""")
def path_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    pairs = table(spark, sf_dir, "conversations").select(name(F.col("turn")).alias("src"), name(F.col("turn") * 2).alias("dst")).distinct()
    return graph.path_exists(turns(spark, sf_dir), pairs)


@query(f"""WITH RECURSIVE {GEOGRAPHY_SQL}, u AS (SELECT src AS a, dst AS b FROM geo UNION SELECT dst, src FROM geo),
r AS (SELECT 'n0' AS node, 0 AS depth UNION SELECT u.b, r.depth + 1 FROM r JOIN u ON u.a = r.node WHERE r.depth < 6) SELECT 'n0' AS seed, node, min(depth)::INT AS depth FROM r GROUP BY node""")
def shortest_path_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = table(spark, sf_dir, "nation").where("n_nationkey = 0").select(F.lit("n0").alias("node"))
    return graph.shortest_paths(geography(spark, sf_dir), seed).select("seed", "node", "depth")


@query(f"""WITH RECURSIVE {GEOGRAPHY_SQL}, r AS (SELECT 'n' || n_nationkey AS seed, 'n' || n_nationkey AS node FROM nation UNION SELECT r.seed, geo.dst FROM r JOIN geo ON geo.src = r.node),
x AS (SELECT seed, 'k' || (CAST(substr(node, 2) AS BIGINT) % 200) AS node FROM r WHERE node LIKE 'c%') SELECT a.seed AS a, b.seed AS b, count(*)::BIGINT AS shared FROM (SELECT DISTINCT * FROM x) a JOIN (SELECT DISTINCT * FROM x) b ON a.node = b.node AND a.seed < b.seed GROUP BY 1, 2""")
def reachable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"))
    found = graph.reach(geography(spark, sf_dir), nations).where("node LIKE 'c%'")
    folded = found.select("seed", F.concat(F.lit("k"), (F.substring("node", 2, 20).cast("long") % 200).cast("string")).alias("node")).distinct()
    return graph.shared_reach(folded)


@query(f"""WITH {GEOGRAPHY_SQL} SELECT count(DISTINCT node)::BIGINT AS nodes, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM geo))::BIGINT AS edges FROM (SELECT src AS node FROM geo UNION ALL SELECT dst FROM geo)""")
def graph_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = geography(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).agg(F.count_distinct("node").alias("nodes"), F.lit(1).alias("_k"))
    return nodes.join(edges.agg(F.count_distinct("src", "dst").alias("edges"), F.lit(1).alias("_k")), "_k").select("nodes", "edges")


EVENT_EDGES = "ev AS (SELECT user_id AS src, event_id % 100 AS dst, event_type AS edge_type, event_id AS ord FROM events)"


@query(f"""WITH {EVENT_EDGES} SELECT src, dst, edge_type FROM ev QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY ord, edge_type) = 1""")
def first_edge_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), (F.col("event_id") % 100).alias("dst"), F.col("event_type").alias("edge_type"), F.col("event_id").alias("ord"))
    return graph.dedup_edges(rows)


@query("""WITH p AS (SELECT o_custkey AS path, o_custkey // 10 AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_orderstatus AS st FROM orders),
t AS (SELECT k, count(DISTINCT path) AS paths FROM p GROUP BY k), c AS (SELECT k, pos, min(st) AS lo, max(st) AS hi, count(*) AS n FROM p GROUP BY k, pos),
b AS (SELECT c.k, pos, lo, max(CASE WHEN lo = hi AND n = paths THEN 0 ELSE 1 END) OVER (PARTITION BY c.k ORDER BY pos) AS broken FROM c JOIN t ON c.k = t.k)
SELECT t.k, string_agg(lo, '>' ORDER BY pos) AS prefix FROM t LEFT JOIN b ON b.k = t.k AND broken = 0 GROUP BY t.k""")
def common_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))), lambda x: x["o_orderstatus"]).alias("path"))
    return graph.common_prefix(rows.select(F.expr("o_custkey div 10").alias("k"), "path"), ["k"]).select("k", F.array_join("prefix", ">").alias("prefix"))


@query("""WITH f AS (SELECT o_orderkey AS func, o_orderstatus = 'P' AS x FROM orders), c AS (SELECT DISTINCT l_suppkey * 7 % 1500 AS callee FROM lineitem)
SELECT func FROM f WHERE NOT x AND (func = 0 OR func NOT IN (SELECT callee FROM c))""")
def call_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    functions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("func"), F.col("o_orderkey").alias("entry"), F.when(F.col("o_orderkey") == 0, "main").otherwise("f").alias("name"), (F.col("o_orderstatus") == "P").alias("is_external"), F.lit(False).alias("is_thunk"))
    insts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("caller"), F.lit("CALL").alias("mnemonic"), (F.col("l_suppkey") * 7 % 1500).alias("flow"))
    return calls.call_roots(functions, insts)


STITCH_SQL = "a AS (SELECT l_orderkey % 101 AS caller, l_linenumber AS idx, l_suppkey AS callee, l_partkey AS src FROM lineitem WHERE l_orderkey % 101 <> l_suppkey)"


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(call sites, functions, facts): each line is a call of its supplier by one of 101 functions, some of them suppliers, with the part as the argument in its place and the receiver."""
    line, caller = table(spark, sf_dir, "lineitem"), (F.col("l_orderkey") % 101).alias("caller")
    args = F.array(*[F.when(F.col("l_linenumber") == k + 1, F.col("l_partkey")) for k in range(7)])
    sites = line.select(F.col("l_orderkey").alias("cs"), caller, F.col("l_suppkey").alias("callee_entry"), args.alias("args"), F.col("l_partkey").alias("receiver"))
    functions = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("func"), F.col("s_suppkey").alias("entry"))
    return sites, functions, line.select(caller.alias("func"), F.col("l_partkey").alias("vn"), F.col("l_partkey").alias("expr")).distinct()


@query(f"""WITH {STITCH_SQL}, p AS (SELECT s_suppkey AS callee, i AS idx, s_suppkey * 10 + i AS dst FROM supplier, range(1, 8) t(i) WHERE i <= 2 + s_nationkey % 6) SELECT DISTINCT src, dst, 'CALL' AS edge_type FROM a JOIN p USING (callee, idx) WHERE src <> dst""")
def arg_param_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arguments to parameters but for recursive calls; vararg callees have a fixed number."""
    sites, functions, facts = _calls(spark, sf_dir)
    params = functions.select("func", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("idx")).select("func", "idx", (F.col("func") * 10 + F.col("idx") + 1).alias("expr"))
    fixed = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("callee"), (2 + F.col("s_nationkey") % 6).alias("fixed"))
    return calls.stitch_arguments(sites, functions, params, facts, fixed)


@query(f"""WITH {STITCH_SQL} SELECT DISTINCT callee * 1000 + 7 AS src, a.src AS dst, 'RETURN' AS edge_type FROM a JOIN supplier ON s_suppkey = callee WHERE callee * 1000 + 7 <> a.src""")
def return_stitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier's function returns, to the receivers of its calls."""
    sites, functions, facts = _calls(spark, sf_dir)
    return calls.stitch_returns(sites, functions, functions.select("func", (F.col("func") * 1000 + 7).alias("expr")), facts)


@query("""WITH c AS (SELECT event_id AS cs, CASE event_id % 4 WHEN 0 THEN 'malloc' WHEN 1 THEN 'calloc' WHEN 2 THEN 'memcpy' ELSE 'free' END AS name, user_id % 9 AS a, event_id % 5 AS b FROM events)
SELECT cs, 'r' || cs AS holder, a::BIGINT AS size FROM c WHERE name = 'malloc' AND a > 0 UNION ALL SELECT cs, 'r' || cs, a * b FROM c WHERE name = 'calloc' AND a * b > 0
UNION ALL SELECT cs, 'x' || cs, 16 FROM c WHERE name = 'memcpy' UNION ALL SELECT cs, 'y' || cs, 16 FROM c WHERE name = 'memcpy'""")
def alloc_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cs = F.col("event_id")
    name = F.when(cs % 4 == 0, "malloc").when(cs % 4 == 1, "calloc").when(cs % 4 == 2, "memcpy").otherwise("free")
    text = cs.cast("string")
    rows = table(spark, sf_dir, "events").select(cs.alias("cs"), name.alias("name"), F.array(F.col("user_id") % 9, cs % 5, F.lit(16).cast("long")).alias("arg_values"), F.array(F.concat(F.lit("x"), text), F.concat(F.lit("y"), text)).alias("arg_exprs"), F.concat(F.lit("r"), text).alias("receiver"))
    return calls.external_sizes(rows)


@query("""WITH a AS (SELECT user_id AS cs, max(event_id % 16) AS v FROM events WHERE event_type = 'click' GROUP BY 1), b AS (SELECT user_id AS cs, min(event_id % 64) AS v FROM events WHERE event_type <> 'click' GROUP BY 1) SELECT a.cs, (a.v * b.v)::BIGINT AS size FROM a JOIN b USING (cs)""")
def calloc_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks tell a count, all other events a size."""
    events = table(spark, sf_dir, "events")
    counts = events.where("event_type = 'click'").groupBy(F.col("user_id").alias("cs")).agg(F.max(F.col("event_id") % 16).alias("value"))
    each = events.where("event_type <> 'click'").groupBy(F.col("user_id").alias("cs")).agg(F.min(F.col("event_id") % 64).alias("value"))
    return calls.calloc_sizes(counts, each)


@query("""WITH n AS (SELECT l_partkey AS callee, l_orderkey, count(*) AS n FROM lineitem GROUP BY 1, 2 UNION ALL SELECT p_partkey, -1, 1 + p_size % 2 FROM part) SELECT callee, min(n)::BIGINT AS fixed FROM n GROUP BY callee HAVING count(DISTINCT n) > 1""")
def vararg_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("callee"), "l_orderkey").agg(F.count("*").alias("n_args"))
    return calls.vararg_functions(sites, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("callee"), (1 + F.col("p_size") % 2).cast("long").alias("n_params")))


@query("""WITH s AS (SELECT c_custkey // 3 AS expr, (c_nationkey % 2 + 1) * 8 AS size, 'CALLSITE' AS t FROM customer UNION ALL SELECT s_suppkey, (s_nationkey % 3 + 1) * 8, 'EXPRESSION' FROM supplier),
p AS (SELECT expr, expr % 2 = 0 AS stack, count(DISTINCT size) AS n, max(size) AS only_size, count(DISTINCT CASE WHEN t = 'CALLSITE' THEN size END) AS ns, count(DISTINCT CASE WHEN t = 'EXPRESSION' THEN size END) AS ne, max(CASE WHEN t = 'CALLSITE' THEN size END) AS site, max(CASE WHEN t = 'EXPRESSION' THEN size END) AS own FROM s GROUP BY 1),
z AS (SELECT expr, CASE WHEN n = 1 THEN only_size WHEN stack AND ns = 1 THEN site WHEN NOT stack AND ns = 1 AND ne = 1 THEN greatest(site, own) END AS size FROM p) SELECT expr, coalesce(size, -1)::BIGINT AS size, size IS NULL AS is_union FROM z""")
def size_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "customer").select(F.expr("c_custkey div 3").alias("expr"), ((F.col("c_nationkey") % 2 + 1) * 8).cast("long").alias("size"), F.lit("CALLSITE").alias("source_type"))
    b = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("expr"), ((F.col("s_nationkey") % 3 + 1) * 8).cast("long").alias("size"), F.lit("EXPRESSION").alias("source_type"))
    return sizes.resolve_sizes(a.unionByName(b).withColumn("on_stack", F.col("expr") % 2 == 0)).fillna({"size": -1})


@query("""WITH s AS (SELECT 'n' || n_nationkey AS node, (1 + n_nationkey % 4 // 2) * 16 AS size FROM nation WHERE n_nationkey % 2 = 0), own AS (SELECT 'c' || c_custkey AS node, 16 * (1 + (c_acctbal < 0)::INT) AS size FROM customer WHERE c_acctbal < 100),
leaf AS (SELECT 'c' || c_custkey AS node, 'n' || c_nationkey AS nat FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
f AS (SELECT leaf.node, nat, coalesce(own.size, s.size) AS size, coalesce(own.size <> s.size, false) AS conflict FROM leaf LEFT JOIN own ON own.node = leaf.node LEFT JOIN s ON s.node = nat WHERE own.size IS NOT NULL OR s.size IS NOT NULL),
o AS (SELECT nat, min(size) AS lo, max(size) AS hi FROM f WHERE NOT conflict GROUP BY nat),
n AS (SELECT 'n' || n_nationkey AS node, 'r' || n_regionkey AS reg, s.size IS NULL AS new, coalesce(s.size, lo) AS size, coalesce(lo <> hi OR coalesce(s.size, lo) <> lo, false) AS conflict FROM nation LEFT JOIN s ON s.node = 'n' || n_nationkey LEFT JOIN o ON o.nat = 'n' || n_nationkey WHERE s.size IS NOT NULL OR lo IS NOT NULL),
r1 AS (SELECT 'r' || n_regionkey AS node, min(size) AS lo, max(size) AS hi FROM nation JOIN s ON s.node = 'n' || n_nationkey GROUP BY 1), r2 AS (SELECT reg AS node, min(size) AS lo, max(size) AS hi FROM n WHERE new AND NOT conflict GROUP BY 1),
r AS (SELECT coalesce(r1.node, r2.node) AS node, coalesce(r1.lo, r2.lo) AS size, coalesce(r1.lo <> r1.hi, false) OR coalesce(r2.lo <> r2.hi OR coalesce(r1.lo, r2.lo) <> r2.lo, false) AS conflict FROM r1 FULL JOIN r2 ON r1.node = r2.node)
SELECT node, size::BIGINT AS size, conflict FROM f UNION ALL SELECT node, size, conflict FROM n UNION ALL SELECT node, size, conflict FROM r""")
def size_propagate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the nations and poor customers have sizes: they spread down to customers and suppliers, then up to nations and regions."""
    nations = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("node"), F.expr("(1 + n_nationkey % 4 div 2) * 16").cast("long").alias("size"))
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 100").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"), (16 * (1 + (F.col("c_acctbal") < 0).cast("int"))).cast("long").alias("size"))
    return sizes.propagate_sizes(geography(spark, sf_dir), nations.unionByName(poor))


TYPES_SQL = """t AS (SELECT 'P' || p_partkey AS dt, CASE WHEN p_partkey % 10 = 0 THEN 'struct' WHEN p_partkey % 10 = 1 THEN 'union' WHEN p_partkey % 10 IN (2, 3, 4, 5) THEN 'pointer' WHEN p_partkey % 10 = 6 THEN 'typedef' ELSE 'primitive' END AS kind, CASE WHEN p_size % 2 = 0 THEN '/DWARF/a' ELSE '/lib' END AS category,
 CASE WHEN p_partkey % 10 IN (2, 3, 4, 5) THEN 'P' || (p_partkey - 2) END AS pointee, CASE WHEN p_partkey % 10 = 6 THEN 'P' || (p_partkey - 2) END AS typedef_of FROM part)"""


def _types(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    digit = key % 10
    kind = F.when(digit == 0, "struct").when(digit == 1, "union").when(digit.isin(2, 3, 4, 5), "pointer").when(digit == 6, "typedef").otherwise("primitive")
    down = F.concat(F.lit("P"), (key - 2).cast("string"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("P"), key.cast("string")).alias("dt"), kind.alias("kind"), F.when(F.col("p_size") % 2 == 0, "/DWARF/a").otherwise("/lib").alias("category"), F.when(digit.isin(2, 3, 4, 5), down).alias("pointee"), F.when(digit == 6, down).alias("typedef_of"))


@query(f"""WITH RECURSIVE {TYPES_SQL}, w AS (SELECT dt, dt AS root, 0 AS lv FROM t UNION ALL SELECT w.dt, coalesce(t.typedef_of, t.pointee), w.lv + (t.typedef_of IS NULL)::INT FROM w JOIN t ON t.dt = w.root WHERE coalesce(t.typedef_of, t.pointee) IS NOT NULL),
f AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY dt ORDER BY lv DESC, root NOT IN (SELECT dt FROM t WHERE coalesce(typedef_of, pointee) IS NOT NULL) DESC) = 1),
b AS (SELECT t.dt, CASE WHEN t.kind = 'typedef' THEN u.kind ELSE t.kind END AS own FROM t LEFT JOIN t u ON u.dt = t.typedef_of)
SELECT b.dt, CASE WHEN own = 'pointer' THEN 'PointerTo' || CASE k.kind WHEN 'struct' THEN 'Struct' WHEN 'union' THEN 'Union' ELSE 'Primitive' END WHEN own = 'struct' THEN 'StackStruct' WHEN own = 'union' THEN 'StackUnion' ELSE 'Primitive' END AS "desc", lv AS ptr_level FROM b JOIN f ON f.dt = b.dt LEFT JOIN t k ON k.dt = f.root""")
def describe_pointer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return types.describe_variable(_types(spark, sf_dir))


@query(f"""WITH {TYPES_SQL} SELECT DISTINCT dt FROM t WHERE kind IN ('struct', 'union') AND dt NOT IN (SELECT dt FROM t WHERE category LIKE '/DWARF%' AND kind IN ('struct', 'union'))""")
def lib_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _types(spark, sf_dir)
    return types.used_library_types(rows, types.user_types(rows))
