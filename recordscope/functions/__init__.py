"""Scalar column functions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Offsets that are taken for field offsets, both ends included.
MAX_OFFSET = 0x2000


def sane_offset(offset: Column) -> Column:
    return offset.between(0, MAX_OFFSET)


def aligned(offset: Column, pointer_size: int = 8) -> Column:
    return offset % pointer_size == 0


def signed_constant(value: Column, size: Column) -> Column:
    """The value's low ``size`` bytes as a two's-complement number."""
    bits = (F.lit(64) - size * 8).cast("int")
    moved = F.call_function("shiftleft", value.cast("long"), bits)
    return F.call_function("shiftright", moved, bits)


def hex_text(value: Column) -> Column:
    """0x2f; -0x2f for negative numbers."""
    return F.concat(F.when(value < 0, F.lit("-0x")).otherwise(F.lit("0x")), F.lower(F.hex(F.abs(value.cast("long")))))


def from_hex_text(text: Column) -> Column:
    bare = F.regexp_replace(text, "^-?0x", "")
    return F.when(text.startswith("-"), -F.conv(bare, 16, 10).cast("long")).otherwise(F.conv(bare, 16, 10).cast("long"))


def location_key(func: Column, kind: Column, name: Column, offset: Column, pc: Column) -> Column:
    """A variable's stable key: ``func:stack[-0x10]``, ``func:name`` or ``func:RegUniq[0x40]``."""
    return F.concat(func, F.lit(":"), F.when(kind == "stack", F.concat(F.lit("stack["), hex_text(offset), F.lit("]"))).when(kind == "param", name).otherwise(F.concat(F.lit("RegUniq["), hex_text(pc), F.lit("]"))))


def size_name(size: Column, name: Column, undefined: Column) -> Column:
    """An undefined type's stand-in by its size; other types keep their names."""
    by_size = F.when(size == 1, "byte").when(size == 2, "word").when(size == 4, "dword").when(size == 8, "qword").otherwise("undefined")
    return F.when(undefined, by_size).otherwise(name)


def normal_type(size: Column, name: Column, undefined: Column, pointer: Column, pointer_size: int = 8) -> Column:
    """size_name, but for a pointer to an undefined type: a pointer to the stand-in of a pointer's own length."""
    return F.when(pointer & undefined, F.concat(size_name(F.lit(pointer_size), name, undefined), F.lit(" *"))).otherwise(size_name(size, name, undefined))


def unique_names(stem: str, keys: Column) -> Column:
    """stem and a short id of the member keys, so equal members share a name and no counter is kept."""
    return F.concat(F.lit(stem + "_"), short_id(keys))


def is_variable(kind: Column, nested_kind: Column) -> Column:
    """A symbol, what is loaded through an address, or a symbol's reference."""
    return kind.isin("sym", "deref") | ((kind == "ref") & (nested_kind == "sym"))


def nonzero_constant(kind: Column, value: Column) -> Column:
    return (kind == "const") & (value != 0)


def hash31(values: Column, seed: int = 1) -> Column:
    """The 31-polynomial over an array of whole numbers, as an unsigned 32-bit number."""
    return F.aggregate(values, F.lit(seed).cast("long"), lambda h, x: (h * 31 + x.cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))


def short_id(keys: Column) -> Column:
    """Eight hexadecimal digits from a set of member keys."""
    return F.substring(F.sha2(F.array_join(F.array_sort(F.array_distinct(keys)), ","), 256), 1, 8)


def field_name(offset: Column, kind: Column) -> Column:
    """Member names by offset: ref_0x.., array_field_0x.. or field_0x.."""
    return F.concat(F.when(kind == "pointer", "ref_").when(kind == "array", "array_field_").otherwise("field_"), hex_text(offset))
