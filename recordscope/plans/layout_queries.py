"""Queries of the field, interval and window operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import functions as S
from ..operators import fields, intervals, windows
from .views import MODE_SQL, accesses, accesses_sql, bands, table

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


@query(f"""{FA}, {MODE_SQL} SELECT base, "offset", size, dt AS type, 'field_0x' || lower(to_hex("offset")) AS name, n::BIGINT AS n FROM mode""")
def most_accessed_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each base's fields by their most common type, named by offset."""
    found = fields.most_accessed(accesses(spark, sf_dir))
    return found.select("base", "offset", "size", F.col("dt").alias("type"), S.field_name(F.col("offset"), F.lit("primitive")).alias("name"), "n")


@query(f"""{FA} SELECT base, "offset", dt, size, count(*)::BIGINT AS n FROM fa GROUP BY ALL""")
def field_type_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.type_counts(accesses(spark, sf_dir))


@query(f"""{FA} SELECT base, "offset", min(size) AS min_size, max(size) AS max_size, count(DISTINCT dt)::BIGINT AS types, count(*)::BIGINT AS accesses, min(size) = max(size) AS same_size FROM fa GROUP BY 1, 2""")
def field_size_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.size_profile(accesses(spark, sf_dir))


@query(f"""{FA} SELECT base, count(*)::BIGINT AS accesses, count(DISTINCT "offset")::BIGINT AS fields FROM fa GROUP BY 1""")
def access_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accesses(spark, sf_dir).groupBy("base").agg(F.count("*").alias("accesses"), F.count_distinct("offset").alias("fields"))


@query(f"""WITH {accesses_sql("l_suppkey")}, own AS (SELECT base, max("offset" + size) AS size FROM fa GROUP BY 1),
known AS (SELECT s_suppkey AS base, max(abs(s_acctbal)::BIGINT % 64) AS size FROM supplier GROUP BY 1)
SELECT coalesce(o.base, k.base) AS base, greatest(o.size, k.size)::BIGINT AS size FROM own o FULL JOIN known k ON o.base = k.base""")
def constraint_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("base"), (F.bround(F.abs("s_acctbal"), 0).cast("long") % 64).alias("size"))
    profile = fields.size_profile(accesses(spark, sf_dir, "l_suppkey"))
    return fields.constraint_sizes(profile, known)


@query(f"""{FA} SELECT base FROM fa GROUP BY base HAVING count(DISTINCT "offset") = 1 AND min("offset") = 0""")
def pointer_to_primitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.single_field(fields.size_profile(accesses(spark, sf_dir)))


@query(f"""{FA} SELECT base, max(size) AS element_size FROM fa GROUP BY base HAVING count(DISTINCT "offset") > 1 AND min("offset") = 0 AND min(size) = max(size) AND max(size) < 8""")
def small_equal_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.small_equal_members(fields.size_profile(accesses(spark, sf_dir)))


PAIR = 'a."offset" < b."offset" AND b."offset" < a."offset" + a.size'


@query(f"""{FA} SELECT DISTINCT a.base FROM fa a JOIN fa b ON a.base = b.base AND {PAIR}""")
def interval_conflict_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.conflicted(accesses(spark, sf_dir))


@query(f"""{FA}, {MODE_SQL} SELECT DISTINCT a.base FROM mode a JOIN mode b ON a.base = b.base AND {PAIR}""")
def interval_conflict_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.conflicted(fields.most_accessed(accesses(spark, sf_dir)))


@query(f"""WITH {accesses_sql("l_suppkey")}, links AS (SELECT DISTINCT base AS "outer", base % 7 + 1 AS "inner", 8 * (base % 3) AS delta FROM fa)
SELECT DISTINCT "outer", "inner", delta FROM links JOIN fa a ON a.base = "outer" JOIN fa b ON b.base = "inner"
WHERE (a."offset" < b."offset" + delta AND b."offset" + delta < a."offset" + a.size) OR (b."offset" + delta < a."offset" AND a."offset" < b."offset" + delta + b.size)""")
def nest_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accesses(spark, sf_dir, "l_suppkey").select("base", "offset", "size").distinct()
    links = rows.select(F.col("base").alias("outer"), (F.col("base") % 7 + 1).alias("inner"), (8 * (F.col("base") % 3)).alias("delta")).distinct()
    return intervals.nest_conflicts(rows, rows, links)


MEMBERS = "mem AS (SELECT o_orderkey AS base, o_custkey || '/' || o_orderpriority AS component FROM orders)"


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("base"), F.concat_ws("/", F.col("o_custkey").cast("string"), "o_orderpriority").alias("component"))


@query(f"""{FA}, {MEMBERS} SELECT component, "offset", count(DISTINCT (base, op))::BIGINT AS accesses, array_to_string(list_sort(list(DISTINCT size)), ',') AS sizes, array_to_string(list_sort(list(DISTINCT dt)), ',') AS types FROM fa JOIN mem USING (base) GROUP BY 1, 2""")
def skeleton_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = fields.merge_layouts(accesses(spark, sf_dir), _members(spark, sf_dir))
    return merged.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("sizes", "types")})


@query(f"""{FA}, {MEMBERS}, f AS (SELECT component, base, "offset", size FROM fa JOIN mem USING (base)) SELECT DISTINCT component FROM f EXCEPT SELECT a.component FROM f a JOIN f b ON a.component = b.component AND a.base <> b.base AND {PAIR}""")
def mergeable_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = accesses(spark, sf_dir).join(_members(spark, sf_dir), "base")
    return rows.select("component").distinct().join(intervals.cross_conflicted(rows, "component", "base"), "component", "left_anti")


@query(f"""{FA}, {MODE_SQL}, g AS (SELECT base, "offset", size, lead("offset") OVER (PARTITION BY base ORDER BY "offset") - "offset" AS gap FROM mode) SELECT base, "offset", size, gap, gap < size AS drop_field, gap < 8 AS drop_reference FROM g WHERE gap < greatest(size, 8)""")
def member_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.member_conflicts(fields.most_accessed(accesses(spark, sf_dir)))


@query(f"""{FA}, {MODE_SQL} SELECT a.base, a."offset", a.size, coalesce((SELECT min(b."offset") FROM mode b WHERE b.base = a.base AND b."offset" >= a."offset" + a.size), -1)::BIGINT AS next_start FROM mode a""")
def next_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.next_start(fields.most_accessed(accesses(spark, sf_dir)).select("base", "offset", "size")).fillna({"next_start": -1})


RANGES = "r AS (SELECT o_custkey AS k, epoch(o_orderdate)::BIGINT // 86400 AS s, epoch(o_orderdate)::BIGINT // 86400 + 10 + o_orderkey % 50 AS e FROM orders)"
ISLANDS = f"""{RANGES}, n AS (SELECT *, CASE WHEN s < max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM r),
i AS (SELECT *, sum(new) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n)"""


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), day.alias("start"), (day + 10 + F.col("o_orderkey") % 50).alias("end"))


@query(f"""WITH {ISLANDS} SELECT k, min(s) AS start, max(e) AS "end", count(*)::BIGINT AS merged FROM i GROUP BY k, island""")
def merged_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge_ranges(_ranges(spark, sf_dir), ["k"])


@query(f"""WITH {RANGES}, p AS (SELECT o_custkey AS k, o_orderkey AS id, epoch(o_orderdate)::BIGINT // 86400 + 40 AS pt FROM orders) SELECT k, id, pt FROM p WHERE EXISTS (SELECT 1 FROM r WHERE r.k = p.k AND s <= pt AND pt < e)""")
def range_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    points = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), (day + 40).alias("pt"))
    return intervals.in_ranges(points, intervals.merge_ranges(_ranges(spark, sf_dir), ["k"]), ["k"], "pt")


BANDS = """b AS (SELECT l_partkey AS base, (l_linenumber - 1) * 2::BIGINT AS "offset", least(max(CASE WHEN l_quantity <= 25 THEN 1 WHEN l_quantity <= 48 THEN 2 ELSE 4 END), 2) AS size FROM lineitem GROUP BY 1, 2),
f AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY "offset") - 1 AS idx FROM b)"""


@query(f"""WITH {BANDS}, m AS (SELECT *, CASE WHEN lag(size) OVER w = size AND "offset" - lag("offset") OVER w = size THEN 0 ELSE 1 END AS brk FROM f WINDOW w AS (PARTITION BY base ORDER BY idx)),
i AS (SELECT *, sum(brk) OVER (PARTITION BY base ORDER BY idx) AS island FROM m), r AS (SELECT base, min("offset") AS s, min(size) AS size, count(*) AS n FROM i GROUP BY base, island),
t AS (SELECT *, ((8 - s % 8) % 8) // size AS skip FROM r WHERE ((8 - s % 8) % 8) % size = 0)
SELECT base, (s + skip * size)::BIGINT AS start, (s + n * size)::BIGINT AS "end", (n - skip)::BIGINT AS repeats, size FROM t WHERE n - skip >= 3""")
def sliding_repeat_primitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.primitive_repeats(bands(spark, sf_dir), threshold=3)
    return found.select("base", "start", "end", "repeats", F.element_at("shape", 1)["size"].alias("size"))


#: Wide records: four parts make a base of up to 28 fields, so that windows of up to nine fields can repeat three times.
WIDE = """b AS (SELECT l_partkey // 4 AS base, ((l_partkey % 4) * 7 + l_linenumber - 1) * 2::BIGINT AS "offset", least(max(CASE WHEN l_quantity <= 25 THEN 1 WHEN l_quantity <= 48 THEN 2 ELSE 4 END), 2) AS size FROM lineitem GROUP BY 1, 2)"""
#: Complex repeats of the fields in b (base, offset, size) as rc, by a threshold of 3.
REPEATS_SQL = """rl AS (SELECT base, list("offset" ORDER BY "offset") AS o, list(size ORDER BY "offset") AS s FROM b GROUP BY base),
r1 AS (SELECT rl.*, cap FROM rl, range(2, 15) t(cap) WHERE len(o) >= cap), r2 AS (SELECT *, unnest(range(0, len(o) - cap + 1)) AS idx FROM r1),
r3 AS (SELECT base, cap, idx, o[idx + 1] AS o1, list_transform(o[idx + 1:idx + cap], lambda x: x - o[idx + 1]) AS rel, s[idx + 1:idx + cap] AS z FROM r2),
r4 AS (SELECT *, rel[cap] + z[cap] AS used, list_max(z) AS most FROM r3 WHERE list_min(z) < list_max(z) AND len(list_filter(range(2, cap + 1), lambda j: rel[j] <> ceil((rel[j - 1] + z[j - 1]) / z[j])::BIGINT * z[j])) = 0),
r5 AS (SELECT *, ceil(used / most)::BIGINT * most AS span, idx % cap AS lane FROM r4), r6 AS (SELECT *, CASE WHEN idx - lag(idx) OVER q = cap AND rel = lag(rel) OVER q AND z = lag(z) OVER q AND o1 - lag(o1) OVER q = lag(span) OVER q THEN 0 ELSE 1 END AS brk FROM r5 WINDOW q AS (PARTITION BY base, cap, lane ORDER BY idx)),
r7 AS (SELECT *, sum(brk) OVER (PARTITION BY base, cap, lane ORDER BY idx) AS island FROM r6), r8 AS (SELECT base, cap, min(o1) AS start, min(o1) + count(*) * min(span) AS "end", count(*) AS repeats, any_value(rel) AS rel, any_value(z) AS z FROM r7 GROUP BY base, cap, lane, island HAVING count(*) >= 3),
r9 AS (SELECT *, max("end") OVER (PARTITION BY base, rel, z ORDER BY start, "end" DESC, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r8),
rc AS (SELECT base, start::BIGINT AS start, "end"::BIGINT AS "end", repeats::BIGINT AS repeats, cap::INT AS capacity FROM r9 WHERE reach IS NULL OR "end" > reach)"""


@query(f"""WITH {WIDE}, {REPEATS_SQL} SELECT * FROM rc""")
def sliding_repeat_complex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of records of any width, by the operator's own threshold."""
    band = F.when(F.col("l_quantity") <= 25, 1).when(F.col("l_quantity") <= 48, 2).otherwise(4)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.expr("l_partkey div 4").alias("base"), (((F.col("l_partkey") % 4) * 7 + F.col("l_linenumber") - 1) * 2).alias("offset")).agg(F.least(F.max(band), F.lit(2)).alias("size"))
    return windows.complex_repeats(rows.withColumn("kind", F.concat(F.lit("u"), F.col("size").cast("string")))).select("base", "start", "end", "repeats", "capacity")


@query(f"""WITH {accesses_sql("l_partkey")}, {MODE_SQL}, l AS (SELECT base, string_agg("offset" || ':' || size, ',' ORDER BY "offset") AS layout_key FROM mode GROUP BY base) SELECT layout_key, min(base) AS base, count(*)::BIGINT AS bases FROM l GROUP BY 1""")
def layout_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.dedup_layouts(fields.layouts(fields.most_accessed(accesses(spark, sf_dir, "l_partkey"))))


@query(f"""{FA}, {MODE_SQL}, l AS (SELECT base, flatten(list([ "offset"::BIGINT, size::BIGINT] ORDER BY "offset")) AS v FROM mode GROUP BY base) SELECT base, list_reduce(list_prepend(1::BIGINT, v), lambda h, x: (h * 31 + x) % 4294967296)::BIGINT AS layout_hash FROM l""")
def layout_hash31(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.layout_hash(fields.layouts(fields.most_accessed(accesses(spark, sf_dir)))).select("base", "layout_hash")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, 'f' || l_suppkey || ':' || CASE WHEN l_linenumber % 3 = 0 THEN 'stack[' || CASE WHEN o < 0 THEN '-0x' ELSE '0x' END || lower(to_hex(abs(o))) || ']' WHEN l_linenumber % 3 = 1 THEN 'p' || l_linenumber ELSE 'RegUniq[0x' || lower(to_hex(l_partkey)) || ']' END AS loc
FROM (SELECT *, (l_quantity::BIGINT - 25) * 8 AS o FROM lineitem)""")
def location_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    kind = F.when(line % 3 == 0, "stack").when(line % 3 == 1, "param").otherwise("register")
    loc = S.location_key(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")), kind, F.concat(F.lit("p"), line.cast("string")), (F.col("l_quantity").cast("long") - 25) * 8, F.col("l_partkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", line, "l_suppkey", loc.alias("loc"))


@query("""SELECT o_orderkey, s AS size, CASE s WHEN 1 THEN ((v % 256) + 128) % 256 - 128 WHEN 2 THEN ((v % 65536) + 32768) % 65536 - 32768 WHEN 4 THEN ((v % 4294967296) + 2147483648) % 4294967296 - 2147483648 ELSE v END AS signed FROM (SELECT o_orderkey, (1 << (o_orderkey % 4)::INT) AS s, (o_totalprice * 100000)::BIGINT AS v FROM orders)""")
def signed_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.expr("shiftleft(1, CAST(o_orderkey % 4 AS INT))")
    value = F.bround(F.col("o_totalprice") * 100000, 0).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", size.alias("size"), S.signed_constant(value, size).alias("signed"))
