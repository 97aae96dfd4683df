"""Weighted rendezvous sharding of stable record keys, in DataFrame functions only.

A key's shard is the one with the largest score ``-weight / ln(u)``, where u
in (0, 1) is hashed from (key, shard). A new shard can only win keys for
itself, so a grown shard count moves no row between old shards. Within its
shard a row gets a gapless slot: the rows are written once with a number each,
dealt to sub-slots by a hash of that number, numbered within each, and shifted
by the counts of the sub-slots before. No task sees a whole shard, and no key,
null or not, meets in one task, however many rows it has.

Defined results: a null key is a key of its own (all null keys share a shard);
rows with equal keys, repeated rows too, share a shard and get different
slots, in no given order; ties of scores go to the smaller shard; null text
counts no bytes, and texts of any length are sized whole; an empty table gives
no rows; extra columns pass through untouched, whatever their names, but for
those that are added.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.skew import unused
from ..storage import materialize
from .tables import read

#: Rows of one (shard, sub-slot) are numbered in one task; this many rows are meant.
ROWS_A_SUB_SLOT = 20_000
#: Sub-slots of a shard at least.
LEAST_SUB_SLOTS = 8


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard (an int from 0) of a key under these shard weights."""
    def score(shard: int, weight: float) -> Column:
        unit = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((F.lit(-float(weight)) / F.log(unit)).alias("score"), F.lit(-shard).alias("less"))

    return (-F.array_max(F.array(*[score(s, w) for s, w in enumerate(weights) if w > 0]))["less"]).cast("int")


def number_slots(df: DataFrame, shard: str, sub_slots: int) -> DataFrame:
    """Adds ``slot``: gapless from 0 within each shard."""
    seat, sub, at, start, rows = unused([*df.columns, "slot"], "_seat", "_sub", "_at", "_start", "_rows")
    dealt = materialize(df.drop("slot").withColumn(seat, F.monotonically_increasing_id()), "seats")
    dealt = dealt.withColumn(sub, F.pmod(F.xxhash64(seat), F.lit(sub_slots)).cast("int"))
    counts = dealt.groupBy(shard, sub).agg(F.count("*").alias(rows))
    before = Window.partitionBy(shard).orderBy(sub).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(shard, sub, F.coalesce(F.sum(rows).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(shard, sub).orderBy(seat)
    numbered = dealt.withColumn(at, F.row_number().over(within) - 1)
    return numbered.join(starts, [shard, sub]).withColumn("slot", (F.col(start) + F.col(at)).cast("long")).drop(seat, sub, at, start)


def shard_records(df: DataFrame, key: str, weights: Sequence[float], grown: Sequence[float] | None = None, sub_slots: int = 64) -> DataFrame:
    """Adds shard and slot in place of columns of these names, and with grown weights ``grown_shard``, the shard under those."""
    named = F.coalesce(F.col(key).cast("string"), F.lit("\u0000null"))
    out = df.withColumn("shard", rendezvous_shard(named, weights))
    if grown is not None:
        out = out.withColumn("grown_shard", rendezvous_shard(named, grown))
    return number_slots(out, "shard", sub_slots)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    text = F.col("text")
    sized = docs.select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    shards = 40
    sub_slots = max(LEAST_SUB_SLOTS, docs.count() // (shards * ROWS_A_SUB_SLOT) + 1)
    placed = shard_records(sized, "doc_id", [1.0] * shards, [1.0] * (shards + 1), sub_slots)
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
