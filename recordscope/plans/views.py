"""The synthetic tables seen as access facts and graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fields import dedup_accesses


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _op(base: str) -> str:
    """What stands for the accessing operation: another key than the base."""
    return "l_orderkey" if base == "l_partkey" else "l_partkey"


def accesses(spark: SparkSession, sf_dir: str, base: str = "l_orderkey") -> DataFrame:
    """lineitem as deduplicated accesses: base, offset, op, dt, size."""
    size = F.when(F.col("l_quantity") <= 15, 1).when(F.col("l_quantity") <= 30, 2).when(F.col("l_quantity") <= 45, 4).otherwise(8)
    rows = table(spark, sf_dir, "lineitem").select(F.col(base).alias("base"), ((F.col("l_linenumber") - 1) * 4).cast("long").alias("offset"), F.col(_op(base)).alias("op"), F.concat("l_returnflag", "l_linestatus").alias("dt"), size.alias("size"))
    return dedup_accesses(rows)


def accesses_sql(base: str = "l_orderkey") -> str:
    """The same as a common table expression named fa."""
    return f"""raw AS (SELECT {base} AS base, ((l_linenumber - 1) * 4)::BIGINT AS "offset", {_op(base)} AS op, l_returnflag || l_linestatus AS dt,
 CASE WHEN l_quantity <= 15 THEN 1 WHEN l_quantity <= 30 THEN 2 WHEN l_quantity <= 45 THEN 4 ELSE 8 END AS size FROM lineitem),
fa AS (SELECT base, "offset", op, dt, size FROM raw QUALIFY row_number() OVER (PARTITION BY base, "offset", op ORDER BY dt, size) = 1)"""


#: Each field with its most common type, from fa.
MODE_SQL = """freq AS (SELECT base, "offset", dt, size, count(*) AS n FROM fa GROUP BY ALL),
mode AS (SELECT * FROM freq QUALIFY row_number() OVER (PARTITION BY base, "offset" ORDER BY n DESC, size DESC, dt) = 1)"""


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields per part with one size each, as the repeat detection wants them: base, offset, size, kind."""
    band = F.when(F.col("l_quantity") <= 25, 1).when(F.col("l_quantity") <= 48, 2).otherwise(4)
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("base"), ((F.col("l_linenumber") - 1) * 4).cast("long").alias("slot")).agg(F.max(band).alias("size"))
    return rows.select("base", (F.col("slot") / 4).cast("long").alias("slot"), "size").select("base", F.expr("slot * 2").alias("offset"), F.least("size", F.lit(2)).alias("size"), F.concat(F.lit("u"), F.least("size", F.lit(2)).cast("string")).alias("kind"))


def geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region -> nation -> customer and supplier, as src, dst, edge_type."""
    nation, customer, supplier = (table(spark, sf_dir, t) for t in ("nation", "customer", "supplier"))
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"), F.lit("DATAFLOW").alias("edge_type"))
        .unionByName(customer.select(name("n", "c_nationkey").alias("src"), name("c", "c_custkey").alias("dst"), F.lit("CALL").alias("edge_type")))
        .unionByName(supplier.select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst"), F.lit("RETURN").alias("edge_type")))
    )


GEOGRAPHY_SQL = """geo AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'DATAFLOW' AS edge_type FROM nation
 UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'CALL' FROM customer
 UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, 'RETURN' FROM supplier)"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation to the next, as src, dst."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    nxt = rows.select("conv_id", (F.col("turn") - 1).alias("turn"))
    return rows.join(nxt, ["conv_id", "turn"], "left_semi").select(name(F.col("turn")).alias("src"), name(F.col("turn") + 1).alias("dst")).distinct()


TURNS_SQL = """steps AS (SELECT DISTINCT a.conv_id || ':' || a.turn AS src, b.conv_id || ':' || b.turn AS dst
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
