"""Joins that keep a hot key from landing in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the salted side for each hot key.
SALTS = 256
#: A key is hot from this share of all rows on; so there are at most 1 / share of them.
HOT_SHARE = 0.0005
#: ... but never below this many rows, which one task takes with ease.
HOT_ROWS = 200


def unused(columns: Sequence[str], *stems: str) -> list[str]:
    """Column names for passing use that are not among columns, in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def hot_keys(counted: DataFrame, key: str, rows: str, total: int) -> DataFrame:
    """Keys with so many rows that a task of their own would be slow.

    counted has one row per key with its row count. As a hot key holds at
    least HOT_SHARE of all rows, the result has at most 1 / HOT_SHARE rows,
    so it may be broadcast whatever the input's size.
    """
    return counted.where(F.col(rows) >= F.lit(max(HOT_ROWS, int(total * HOT_SHARE)))).select(key)


def salted_lookup(many: DataFrame, one: DataFrame, key: str, hot: DataFrame, spread: Column, how: str = "inner") -> DataFrame:
    """many JOIN one ON key, where one has one row per key and hot lists the hot ones.

    Rows of a hot key are dealt by (key, salt) with the salt from spread; the
    other side holds one copy per salt for hot keys only. how: inner or left.
    """
    name, flag, salt = unused([*many.columns, *one.columns], "_hot_key", "_hot", "_salt")
    mark = F.broadcast(hot.select(F.col(key).alias(name), F.lit(True).alias(flag)))
    left = many.join(mark, F.col(key) == F.col(name), "left").withColumn(salt, F.when(F.col(flag), F.pmod(spread, F.lit(SALTS)).cast("int")).otherwise(F.lit(0))).drop(name, flag)
    right = one.join(mark, F.col(key) == F.col(name), "left").withColumn(salt, F.explode(F.when(F.col(flag), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(name, flag)
    return left.join(right, [key, salt], how).drop(salt)


#: Bits of the map that maybe_member broadcasts: 8 MB whatever the number of keys.
MAP_BITS = 26
_PAGE = 32_768


def maybe_member(rows: DataFrame, key: str, keys: DataFrame, name: str) -> DataFrame:
    """Adds the boolean ``name``: false only where rows' key is not among keys' column of the same name.

    A bitmap over hashed keys of a fixed size is broadcast. It spares a shuffle
    of the rows that are surely not members; true needs an exact join after.
    """
    at, page, held = unused(rows.columns, "_at", "_page", "_map")
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << MAP_BITS))
    pages = keys.select(place(F.col(key)).alias(at)).groupBy(F.expr(f"{at} div {_PAGE}").alias(page)).agg(F.bitmap_construct_agg((F.col(at) % _PAGE)).alias(held))
    placed = rows.withColumn(at, place(F.col(key))).withColumn(page, F.expr(f"{at} div {_PAGE}"))
    byte = F.conv(F.hex(F.expr(f"substring({held}, cast({at} % {_PAGE} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    bit = F.expr("1") == F.call_function("shiftright", byte, (F.col(at) % 8).cast("int")).bitwiseAND(1)
    return placed.join(F.broadcast(pages), page, "left").withColumn(name, F.coalesce(bit, F.lit(False))).drop(at, page, held)
