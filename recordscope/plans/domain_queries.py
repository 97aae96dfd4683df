"""Queries of the constraint, candidate, tournament and document operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..operators import candidates, constraints, fields, intervals, layout, tournament
from . import interpreter
from .layout_queries import REPEATS_SQL
from .views import MODE_SQL, accesses, accesses_sql, table

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


FA = "WITH " + accesses_sql()
PARTS = "WITH " + accesses_sql("l_partkey")


def _named(rows: DataFrame) -> DataFrame:
    return rows.withColumnRenamed("base", "c")


INFERRED_SQL = """inf AS (SELECT p_partkey AS c, 'T' || p_size AS dt, CASE WHEN p_size % 3 = 0 THEN 'array' ELSE 'struct' END AS kind, p_size * 4 AS length, 'E' || p_size % 4 AS element FROM part WHERE p_partkey % 4 = 0
 UNION ALL SELECT p_partkey, 'U' || p_size, 'struct', p_size % 2 * 8, NULL FROM part WHERE p_partkey % 8 = 0)"""


def _inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    size = F.col("p_size")
    a = part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("c"), F.concat(F.lit("T"), size.cast("string")).alias("dt"), F.when(size % 3 == 0, "array").otherwise("struct").alias("kind"), (size * 4).alias("length"), F.concat(F.lit("E"), (size % 4).cast("string")).alias("element"))
    b = part.where("p_partkey % 8 = 0").select(F.col("p_partkey").alias("c"), F.concat(F.lit("U"), size.cast("string")).alias("dt"), F.lit("struct").alias("kind"), (size % 2 * 8).alias("length"), F.lit(None).cast("string").alias("element"))
    return a.unionByName(b)


@query(f"""{PARTS}, {MODE_SQL}, {INFERRED_SQL}, own AS (SELECT base AS c, count(DISTINCT "offset") AS fields, min("offset") AS first, min(size) AS low, max(size) AS high FROM fa GROUP BY 1), m AS (SELECT base AS c, dt FROM mode WHERE "offset" = 0),
k AS (SELECT c, count(*) AS kinds, bool_and(kind = 'array') AS arrays, count(DISTINCT CASE WHEN length > 0 THEN length END) AS lengths, min(element) AS element FROM inf GROUP BY 1),
j AS (SELECT coalesce(own.c, k.c) AS c, own.* EXCLUDE (c), k.* EXCLUDE (c, kinds), coalesce(kinds, 0) AS kinds, m.dt AS m FROM own FULL JOIN k ON own.c = k.c LEFT JOIN m ON m.c = own.c)
SELECT c, CASE WHEN (fields = 1 AND first = 0 AND kinds = 0) OR (kinds > 0 AND arrays) OR lengths > 1 THEN 'pointer_to_primitive' ELSE 'primitive_array' END AS mark,
 CASE WHEN fields = 1 AND first = 0 AND kinds = 0 THEN m WHEN kinds > 0 AND arrays THEN element WHEN lengths > 1 THEN NULL ELSE m END AS final_type FROM j
WHERE (fields = 1 AND first = 0 AND kinds = 0) OR (kinds > 0 AND arrays) OR lengths > 1 OR (fields > 1 AND first = 0 AND low = high AND high < 8)""")
def primitive_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accesses(spark, sf_dir, "l_partkey")
    return constraints.mark_primitive(_named(fields.size_profile(rows)), _named(fields.most_accessed(rows)), _inferred(spark, sf_dir))


@query(f"""{FA}, r AS (SELECT base % 97 AS c, "offset", (base + "offset") % 89 AS target, count(DISTINCT base) AS variables FROM fa WHERE "offset" % 8 = 0 GROUP BY 1, 2, 3) SELECT c, "offset", target, variables::BIGINT AS variables FROM r QUALIFY row_number() OVER (PARTITION BY c, "offset" ORDER BY variables DESC, target) = 1""")
def reference_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accesses(spark, sf_dir).where("offset % 8 = 0")
    refs = rows.groupBy((F.col("base") % 97).alias("c"), "offset", ((F.col("base") + F.col("offset")) % 89).alias("target")).agg(F.count_distinct("base").alias("variables"))
    return constraints.final_references(refs)


@query("""WITH RECURSIVE s AS (SELECT 'P' || p_partkey AS c FROM part WHERE p_size % 2 = 0), r AS (SELECT 'P' || p_partkey AS c, 0 AS o, 'P' || (p_partkey // 2) AS target FROM part WHERE p_partkey > 1),
h AS (SELECT r.c AS at, r.target AS nxt FROM r JOIN s USING (c)), w AS (SELECT c, o, target, 1 AS lv FROM r UNION ALL SELECT w.c, w.o, h.nxt, w.lv + 1 FROM w JOIN h ON h.at = w.target)
SELECT c, o::BIGINT AS "offset", arg_max(target, lv) AS target, max(lv)::INT AS ptr_level FROM w GROUP BY c, o""")
def pointer_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References through constraints that are lone pointers: half of the parts are."""
    part = table(spark, sf_dir, "part")
    name = lambda k: F.concat(F.lit("P"), k.cast("string"))
    eight = F.when(F.col("p_size") % 2 == 0, 8).otherwise(4)
    profile = part.select(name(F.col("p_partkey")).alias("c"), F.lit(0).alias("offset"), eight.alias("min_size"), eight.alias("max_size"))
    refs = part.where("p_partkey > 1").select(name(F.col("p_partkey")).alias("c"), F.lit(0).cast("long").alias("offset"), name(F.expr("p_partkey div 2")).alias("target"))
    return constraints.pointer_chains(refs, profile)


@query(f"""{PARTS}, p AS (SELECT base AS c, "offset", min(size) AS lo, max(size) AS hi FROM fa GROUP BY 1, 2), m AS (SELECT * FROM p WHERE lo <> hi AND NOT (c % 5 = 0 AND "offset" = 0))
SELECT c, "offset" AS start, "offset" + hi AS "end", 'union' AS kind, 0 AS size FROM m UNION ALL SELECT DISTINCT m.c, m."offset", m."offset" + hi, 'struct', f.size FROM m JOIN fa f ON f.base = m.c AND f."offset" = m."offset" """)
def size_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accesses(spark, sf_dir, "l_partkey")
    profile = _named(fields.size_profile(rows))
    refs = profile.where("c % 5 = 0 AND offset = 0").select("c", "offset")
    found = candidates.size_variants(profile, _named(rows).select("c", "offset", "size").distinct(), refs)
    return found.fillna({"size": 0})


HEX = "'0x' || lower(to_hex({}))"


@query(f"""{PARTS}, {MODE_SQL}, b AS (SELECT base, "offset", size FROM mode), {REPEATS_SQL},
own AS (SELECT base, count(DISTINCT "offset") AS n, min("offset") AS first, min(size) AS lo, max(size) AS hi FROM fa GROUP BY base), mark AS (SELECT *, n > 1 AS small FROM own WHERE first = 0 AND (n = 1 OR lo = hi AND hi < 8)),
mixed AS (SELECT base, "offset" AS o, max(size) AS hi FROM fa GROUP BY 1, 2 HAVING min(size) <> max(size)),
pm AS (SELECT *, CASE WHEN lag(size) OVER w = size AND "offset" - lag("offset") OVER w = size AND size <> 8 THEN 0 ELSE 1 END AS brk FROM b WINDOW w AS (PARTITION BY base ORDER BY "offset")), pi AS (SELECT *, sum(brk) OVER (PARTITION BY base ORDER BY "offset") AS island FROM pm WHERE size <> 8),
pr AS (SELECT base, min("offset") AS s, min(size) AS size, count(*) AS n FROM pi GROUP BY base, island), pa AS (SELECT base, s + ((8 - s % 8) % 8) AS start, s + n * size AS "end", n - ((8 - s % 8) % 8) // size AS n FROM pr WHERE ((8 - s % 8) % 8) % size = 0),
plain AS (SELECT base, string_agg("offset" || ':' || size, ',' ORDER BY "offset") AS layout FROM b GROUP BY base),
runs AS (SELECT base, start, "end", capacity, unnest(['struct', 'nested_array']) AS kind FROM rc UNION ALL SELECT base, start, "end", 1, unnest(['struct', 'array']) FROM pa WHERE n >= 4),
made AS (SELECT base, 'range' AS scope, o AS start, o + hi AS "end", 'union_' || {HEX.format("o")} || '_all' AS name, 'union' AS kind, NULL AS layout FROM mixed
 UNION ALL SELECT DISTINCT m.base, 'range', o, o + hi, 'struct_' || {HEX.format("o")} || '_' || f.size, 'struct', (SELECT string_agg("offset" || ':' || CASE WHEN "offset" = o THEN f.size ELSE size END, ',' ORDER BY "offset") FROM b WHERE b.base = m.base) FROM mixed m JOIN (SELECT DISTINCT base, "offset", size FROM fa) f ON f.base = m.base AND f."offset" = o
 UNION ALL SELECT runs.base, 'range', start, "end", kind || '_' || {HEX.format("start")} || '_' || capacity, kind, CASE WHEN kind = 'struct' THEN layout END FROM runs JOIN plain ON plain.base = runs.base),
free AS (SELECT * FROM made WHERE base NOT IN (SELECT base FROM mark)),
every AS (SELECT base, scope, start, "end", name, kind, layout FROM free UNION ALL SELECT base, 'global', NULL, NULL, unnest([dt, 'plain']), unnest(['primitive', 'struct']), unnest([NULL, '']) FROM mark JOIN mode USING (base) WHERE small AND "offset" = 0
 UNION ALL SELECT base, 'final', NULL, NULL, 'plain', 'struct', '' FROM own WHERE base NOT IN (SELECT base FROM mark) AND base NOT IN (SELECT base FROM free))
SELECT base AS c, scope, start::BIGINT AS start, "end"::BIGINT AS "end", name, kind FROM every QUALIFY row_number() OVER (PARTITION BY base, start, "end", coalesce(layout, 'name ' || name) ORDER BY name) = 1""")
def generated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All candidates of every part's constraint, one for each layout in a range (M1 to M4, M6)."""
    rows = _named(accesses(spark, sf_dir, "l_partkey"))
    profile, modes = fields.size_profile(rows, ("c", "offset")), fields.most_accessed(rows, ("c", "offset"))
    none = profile.where("false").select("c", "offset")
    marks = constraints.mark_primitive(profile, modes, _inferred(spark, sf_dir).where("false"))
    kinds = modes.select("c", "offset", "size", F.concat(F.lit("u"), F.col("size").cast("string")).alias("kind"))
    return candidates.generate(modes.select("c").distinct(), kinds, profile, rows.select("c", "offset", "size").distinct(), none, marks).drop("layout_hash")


CLEAN_SQL = f"""{FA}, h AS (SELECT o_custkey AS k, base, "offset", size FROM fa JOIN orders ON o_orderkey = base),
bad AS (SELECT DISTINCT a.k FROM h a JOIN h b ON a.k = b.k AND a."offset" < b."offset" AND b."offset" < a."offset" + a.size), node AS (SELECT DISTINCT o_custkey AS k, o_orderkey::VARCHAR AS node FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1) OR o_orderkey IN (SELECT base FROM fa))"""


@query(f"""{CLEAN_SQL}, l AS (SELECT k, min(node) AS label FROM node GROUP BY k) SELECT node, label FROM node JOIN l USING (k) WHERE k NOT IN (SELECT k FROM bad)""")
def clean_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without any conflict keep all their orders together."""
    rows, edges, whole = _history(spark, sf_dir)
    _, labels = layout.remove_conflicts(edges, rows)
    held = rows.join(whole.select(F.col("node").alias("base"), "k"), "base")
    return labels.join(whole, "node").join(intervals.conflicted(held, ["k"]), "k", "left_anti").select("node", "label")


@query(f"""{CLEAN_SQL} SELECT count(*)::BIGINT AS nodes, 0::BIGINT AS conflicted, 0::BIGINT AS strangers FROM node""")
def conflict_free_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No component keeps a conflict between two nodes, none is lost, and none joins orders of two customers."""
    rows, edges, whole = _history(spark, sf_dir)
    _, labels = layout.remove_conflicts(edges, rows)
    held = rows.join(labels.select(F.col("node").alias("base"), "label"), "base")
    strangers = labels.join(whole, "node").groupBy("label").agg(F.count_distinct("k").alias("n")).where("n > 1")
    counts = [labels.select("node").distinct(), intervals.cross_conflicted(held, "label", "base"), strangers]
    one = [x.agg(F.count("*").alias(n)) for x, n in zip(counts, ("nodes", "conflicted", "strangers"))]
    return one[0].withColumn("_", F.lit(1)).join(one[1].withColumn("_", F.lit(1)), "_").join(one[2].withColumn("_", F.lit(1)), "_").drop("_")


def _history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fields, edges, orders with their customer k): orders linked along each customer's history."""
    from pyspark.sql import Window

    rows = accesses(spark, sf_dir).select(F.col("base").cast("string").alias("base"), "offset", "size").distinct()
    nxt = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    orders = table(spark, sf_dir, "orders")
    edges = orders.select(F.col("o_orderkey").cast("string").alias("src"), nxt.cast("string").alias("dst")).where("dst IS NOT NULL")
    return rows, edges, orders.select(F.col("o_orderkey").cast("string").alias("node"), F.col("o_custkey").alias("k"))


@query(None)
def conflict_free_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders linked along each customer's history; conflicting layouts are cut apart. clean_components and conflict_free_invariants hold it against SQL."""
    rows, edges, _ = _history(spark, sf_dir)
    _, labels = layout.remove_conflicts(edges, rows)
    return labels


@query("""WITH RECURSIVE n AS (SELECT p_brand AS grp, count(*) AS n, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS player FROM part GROUP BY 1), s AS (SELECT grp, n AS w, 0::BIGINT AS l, 0 AS r FROM n
 UNION ALL SELECT grp, CASE WHEN w = 1 AND l = 1 THEN 1 ELSE (w + 1) // 2 END, CASE WHEN w = 1 AND l = 1 THEN 0 ELSE (l + 1) // 2 + w // 2 END, r + 1 FROM s WHERE w + l > 1) SELECT s.grp, player, max(r)::INT AS rounds FROM s JOIN n ON n.grp = s.grp GROUP BY 1, 2""")
def tournament_champion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a judge that goes by price the dearest part of a brand wins, whatever the pairing."""
    players = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("player"), F.col("p_retailprice").alias("score"))
    return tournament.run_tournaments(players)[0]


@query("""SELECT p_brand AS grp, count(*)::BIGINT - 1 AS eliminated FROM part GROUP BY 1 HAVING count(*) > 1""")
def tournament_eliminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every player but one is eliminated: by a second loss in the losers' bracket, or in the final."""
    players = table(spark, sf_dir, "part").select(F.col("p_brand").alias("grp"), F.col("p_partkey").alias("player"), F.col("p_retailprice").alias("score"))
    _, games = tournament.run_tournaments(players)
    return games.where("bracket <> 'w'").groupBy("grp").agg(F.count("*").alias("eliminated"))


@query("""WITH v AS (SELECT l_orderkey AS match, CASE WHEN l_quantity < 25 THEN 0 ELSE 1 END AS vote FROM lineitem) SELECT match, count(*) FILTER (vote = 0) > count(*) FILTER (vote = 1) AS first_wins FROM v GROUP BY 1""")
def match_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tournament.votes_to_winner(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("match"), F.when(F.col("l_quantity") < 25, 0).otherwise(1).alias("vote")))


@query(f"""{PARTS}, {MODE_SQL}, r AS (SELECT DISTINCT base AS c, 4 AS s, 12 AS e FROM mode WHERE base % 2 = 0), b AS (SELECT base AS c, "offset", dt AS value FROM mode), w AS (SELECT base AS c, "offset", max(dt) AS value FROM fa GROUP BY 1, 2)
SELECT c, "offset", value FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.c = b.c AND b."offset" >= s AND b."offset" < e) UNION ALL SELECT w.c, "offset", value FROM w JOIN r ON r.c = w.c WHERE "offset" >= s AND "offset" < e""")
def range_layout_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _named(accesses(spark, sf_dir, "l_partkey"))
    base = fields.most_accessed(rows, ("c", "offset")).select("c", "offset", F.col("dt").alias("value"))
    other = rows.groupBy("c", "offset").agg(F.max("dt").alias("value")).withColumn("player", F.lit("b"))
    ranges = base.where("c % 2 = 0").select("c").distinct().select("c", F.lit(4).alias("start"), F.lit(12).alias("end"), F.lit("b").alias("player"))
    return tournament.merge_ranges_of_champions(base, ranges, other)


@query(f"""{PARTS}, {MODE_SQL}, m AS (SELECT base AS c, "offset" AS o, size::VARCHAR AS size, CASE WHEN base % 3 = 0 AND "offset" = 0 THEN 'Pointer' ELSE 'Primitive' END AS d, CASE WHEN base % 3 = 0 AND "offset" = 0 THEN 'void' || repeat('*', 1 + base % 2) ELSE dt END AS type, CASE WHEN base % 3 = 0 AND "offset" = 0 THEN 'ref_' ELSE 'field_' END AS stem FROM mode WHERE NOT (base % 5 = 0 AND "offset" >= 8 AND "offset" < 16)
 UNION ALL SELECT DISTINCT base, 8, '8', 'Array', 'array of 4', 'array_field_' FROM mode WHERE base % 5 = 0)
SELECT c, '{{"desc":"Structure","layout":{{' || string_agg('"0x' || lower(to_hex(o)) || '":{{"desc":"' || d || '","size":' || size || ',"type":"' || type || '","name":"' || stem || '0x' || lower(to_hex(o)) || '"}}', ',' ORDER BY o) || '}}}}' AS doc FROM m GROUP BY c""")
def emit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts with pointers at the start of every third part and an array in every fifth."""
    modes = _named(fields.most_accessed(accesses(spark, sf_dir, "l_partkey")))
    owners = modes.select("c").distinct()
    refs = modes.where("c % 3 = 0 AND offset = 0").select("c", "offset", (1 + F.col("c") % 2).cast("int").alias("ptr_level"))
    arrays = owners.where("c % 5 = 0").select("c", F.lit(8).cast("long").alias("start"), F.lit(16).cast("long").alias("end"), F.lit(4).alias("element_size"))
    return sources.struct_document(candidates.components_by_mode(modes, refs, arrays))


@query("""SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events""")
def parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""SELECT time_bucket(INTERVAL '5 minutes', ts) AS start, user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2, 3""")
def windowed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming count of accesses per time window."""
    return table(spark, sf_dir, "events").groupBy(F.window("ts", "5 minutes").alias("w"), "user_id", "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "user_id", "event_type", "n")


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, CASE WHEN l_linenumber = 1 THEN '*p' ELSE '*(p + 0x' || lower(to_hex((l_linenumber - 1) * 8)) || ')' END AS v FROM lineitem)
SELECT 'p' AS base, ((n - 1) * 8)::BIGINT AS "offset", v AS field_expr, 'f' || o || ':' || n || ':1' AS op, 'LOAD' AS access_type, 'qword' AS dt, 8 AS size, 0::BIGINT AS scale FROM l UNION ALL SELECT v, 0, '*' || v, 'f' || o || ':' || n || ':2', 'STORE', 'dword', 4, 0 FROM l""")
def interpreted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a function that loads its lines' fields: p + 4 * line, then a store through the loaded pointer."""
    line = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_orderkey").cast("string")).alias("func"), "l_linenumber")
    kind = "struct<vn:string,size:int,sym:string,dt:string,value:long,space:string>"

    def node(vn, size=8, sym=None, dt=None, value=0, space="register"):
        return F.struct(vn.alias("vn"), F.lit(size).alias("size"), F.lit(sym).cast("string").alias("sym"), F.lit(dt).cast("string").alias("dt"), (value if not isinstance(value, int) else F.lit(value)).cast("long").alias("value"), F.lit(space).alias("space")).cast(kind)

    def operations(line):
        n = line.cast("string")
        base, at, loaded = node(F.lit("p"), sym="p"), node(F.concat(F.lit("a"), n)), node(F.concat(F.lit("v"), n), dt="qword")
        offset = node(F.concat(F.lit("c"), n), value=(line - 1) * 8, space="const")
        one = node(F.lit("one"), 4, dt="dword", value=1, space="const")
        made = (("INT_ADD", at, [base, offset]), ("LOAD", loaded, [at]), ("STORE", F.lit(None).cast(kind), [loaded, one]))
        return F.array(*[
            F.struct((line * 3 + k).cast("long").alias("ord"), F.concat("func", F.lit(":"), n, F.lit(f":{k}")).alias("op"), F.lit(opcode).alias("opcode"), out.alias("out"), F.array(*ins).alias("ins"))
            for k, (opcode, out, ins) in enumerate(made)
        ])

    functions = line.groupBy("func").agg(F.flatten(F.transform(F.collect_set("l_linenumber"), operations)).alias("ops"))
    return interpreter.field_accesses(interpreter.learn(functions, exprs=False))
