"""Abstract interpretation of one function's operations, one row per function.

Operations are read once, in block order. A variable node holds up to
MOST_FACTS expressions. The result is a long table of what was learnt: facts,
access points, edges, arguments, returned expressions, attributes.

What a function teaches depends on its body alone: its operations in order,
without their names, and the variables to skip. A worker takes many functions at
once, interprets each body of theirs once, and puts in the names of functions
and operations column by column.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import MAX_OFFSET
from ..operators.calls import MOST_FACTS
from ..storage import materialize
from .expressions import Expr, add, aliases, closure, constant, dereference, field_access, multiply, reference, row, symbol

#: base, off and scale are those of the field that an access point is, null if it is none.
LEARNT = "func string, what string, a string, b string, op string, kind string, dt string, size int, n long, base string, off long, scale long"
#: Rows of expressions have more columns; their expr is a.
ROWS = LEARNT + ", idx string, nested string, sym string, const long, root_sym string"
EXPR = ("kind", "base", "idx", "scale", "off", "nested", "sym", "const", "root_sym", "func")
#: Bytes of bodies that are worked on at once, and of those whose results a worker remembers.
SLICE, KEPT = 16_000_000, 8_000_000
OPS = "func string, ord long, op string, opcode string, out struct<vn:string,size:int,sym:string,dt:string,value:long,space:string>, ins array<struct<vn:string,size:int,sym:string,dt:string,value:long,space:string>>"


def signed(value: int, size: int) -> int:
    bits = 8 * size
    value &= (1 << bits) - 1
    return value - (1 << bits) if value >> (bits - 1) else value


class Function:
    """The state of one function's interpretation."""

    def __init__(self, name: str, skip: set[str] = frozenset()):
        self.name, self.skip = name, skip  # skip: variables of several merge groups, which get no edges
        self.facts: dict[str, list[Expr]] = {}
        self.makers: dict[str, dict] = {}
        self.learnt: dict[tuple, tuple | None] = {}
        self.seen: dict[Expr, None] = {}

    def put(self, what: str, a: object = None, b: object = None, op: str | None = None, kind: str | None = None, dt: str | None = None, size: int | None = None, n: int | None = None) -> None:
        text = lambda x: None if x is None else str(x)
        self.learnt[self.name, what, text(a), text(b), op, kind, dt, size, n] = field_access(a) if what == "access" else None

    def hold(self, vn: str, e: Expr | None) -> None:
        if e is None:
            return
        held = self.facts.setdefault(vn, [])
        if e not in held and len(held) < MOST_FACTS:
            held.append(e)
            self.note(e)

    def note(self, e: Expr) -> None:
        for x in closure(e):
            if x not in self.seen:
                self.seen[x] = None
                for a, b in aliases(x):
                    self.put("edge", a, b, kind="ALIAS")

    def edge(self, a: Expr, b: Expr) -> None:
        if a != b and str(a) not in self.skip and str(b) not in self.skip:
            self.put("edge", a, b, kind="DATAFLOW")

    def of(self, v: dict) -> list[Expr]:
        return self.facts.get(v["vn"], [])

    def traced(self, v: dict) -> bool:
        return v["vn"] in self.facts

    def run(self, ops: list[dict]) -> None:
        for op in ops:
            for v in (op["out"], *(op["ins"] or [])):
                if v and v["sym"]:
                    self.hold(v["vn"], symbol(v["sym"]))
            if op["out"]:
                self.makers[op["out"]["vn"]] = op
        for op in ops:
            handler = HANDLERS.get(op["opcode"])
            if handler:
                handler(self, op)


def _const(v: dict) -> int | None:
    return signed(v["value"], v["size"]) if v["space"] == "const" else None


def _sane(n: int | None) -> bool:
    return n is not None and 0 <= n <= MAX_OFFSET


def _add(f: Function, op: dict, sign: int = 1) -> None:
    a, b = op["ins"]
    delta = _const(b)
    if not f.traced(a):
        return
    if delta is not None:
        if _sane(sign * delta):
            for e in f.of(a):
                f.hold(op["out"]["vn"], add(e, constant(sign * delta)))
    elif f.traced(b):
        for e in f.of(a):
            for x in f.of(b):
                f.hold(op["out"]["vn"], add(e, x))


def _assign(f: Function, op: dict) -> None:
    (v, *_), out = op["ins"], op["out"]
    if not f.traced(v) and f.traced(out) and v["space"] != "const":
        for e in list(f.of(out)):
            f.hold(v["vn"], e)
        maker = f.makers.get(v["vn"])
        if maker is not None and maker["opcode"] in HANDLERS and maker["opcode"] not in ("COPY", "CAST", "SUBPIECE"):
            HANDLERS[maker["opcode"]](f, maker)
        return
    for e in list(f.of(v)):
        for x in f.of(out):
            f.edge(e, x)
        f.hold(out["vn"], e)


def _ptradd(f: Function, op: dict) -> None:
    base, index, scale = op["ins"]
    step, at = _const(scale), _const(index)
    if not f.traced(base) or step is None:
        return
    if at is not None:
        if _sane(at * step):
            for e in f.of(base):
                f.hold(op["out"]["vn"], add(e, constant(at * step)))
    elif f.traced(index) and _sane(step):
        for e in f.of(base):
            for x in f.of(index):
                product = multiply(x, constant(step))
                f.hold(op["out"]["vn"], add(e, product) if product else None)


def _ptrsub(f: Function, op: dict, stack_register: str = "RSP") -> None:
    base, offset = op["ins"]
    found = []
    if offset["sym"] and (base["vn"].startswith(stack_register) or _const(base) == 0):
        found = [reference(symbol(offset["sym"]))]
    elif f.traced(base) and _sane(_const(offset)):
        found = [x for e in f.of(base) if (x := add(e, constant(_const(offset))))]
    for e in found:
        for x in list(f.of(op["out"])):
            f.edge(e, x)
        f.hold(op["out"]["vn"], e)


def _phi(f: Function, op: dict) -> None:
    if op["out"]["sym"]:
        f.hold(op["out"]["vn"], symbol(op["out"]["sym"]))
        return
    for v in op["ins"]:
        for e in list(f.of(v)):
            f.hold(op["out"]["vn"], e)


def _extend(f: Function, op: dict) -> None:
    for e in list(f.of(op["ins"][0])):
        f.hold(op["out"]["vn"], e)


def _mult(f: Function, op: dict) -> None:
    a, b = op["ins"]
    if _const(a) is not None:
        a, b = b, a
    if f.traced(a) and _sane(_const(b)):
        for e in f.of(a):
            f.hold(op["out"]["vn"], multiply(e, constant(_const(b))))


def _load(f: Function, op: dict) -> None:
    out = op["out"]
    for a in list(f.of(op["ins"][-1])):
        if a.kind == "const":
            continue
        v = dereference(a)
        f.note(v)
        f.put("access", v, op=op["op"], kind="LOAD", dt=out["dt"], size=out["size"])
        for x in f.of(out):
            f.edge(v, x)
        f.hold(out["vn"], v)


def _store(f: Function, op: dict) -> None:
    value = op["ins"][-1]
    for a in list(f.of(op["ins"][-2])):
        if a.kind == "const":
            continue
        v = dereference(a)
        f.note(v)
        f.put("access", v, op=op["op"], kind="STORE", dt=value["dt"], size=value["size"])
        for x in f.of(value):
            f.edge(x, v)


def _call(f: Function, op: dict) -> None:
    for k, v in enumerate(op["ins"][1:]):
        n = _const(v)
        if n is not None:
            f.put("const_arg", constant(n), op=op["op"], n=k)
        for e in f.of(v):
            f.put("arg", e, op=op["op"], n=k)
            f.put("attr", e, kind="ARGUMENT")
    if op["out"]:
        for e in f.of(op["out"]):
            f.put("receiver", e, op=op["op"])


def _callind(f: Function, op: dict) -> None:
    for e in f.of(op["ins"][0]):
        f.put("attr", e, kind="CODE_PTR")


def _return(f: Function, op: dict) -> None:
    for v in op["ins"]:
        for e in f.of(v):
            f.put("return", e)
            f.put("attr", e, kind="RETURN")


HANDLERS: dict[str, Callable[[Function, dict], None]] = {
    "INT_ADD": _add, "INT_SUB": lambda f, op: _add(f, op, -1), "COPY": _assign, "CAST": _assign, "SUBPIECE": _assign, "PTRADD": _ptradd, "PTRSUB": _ptrsub, "MULTIEQUAL": _phi,
    "INT_ZEXT": _extend, "INT_SEXT": _extend, "INT_MULT": _mult, "LOAD": _load, "STORE": _store, "CALL": _call, "CALLIND": _callind, "RETURN": _return,
}


def _long(n: int | None) -> int | None:
    return n if n is not None and -(1 << 63) <= n < 1 << 63 else None


def _rows(body: str, exprs: bool, names: list[int] | None = None) -> list[tuple]:
    """What a function with this body teaches, as ROWS without func; op is a place among its operations, or what names has there."""
    given = json.loads(body)
    f = Function("", set(given["skip"]))
    ops = given["ops"] or []
    f.run([o | {"op": k} for o, k in zip(ops, names or range(len(ops)))])
    out = []
    for (_, what, a, b, op, kind, dt, size, n), field in f.learnt.items():
        base, off, _, scale = field or (None, None, None, None)
        out.append((what, a, b, op, kind, dt, size, n, None if base is None else str(base), _long(off), _long(scale), None, None, None, None, None))
    for e in f.seen if exprs else ():
        r = row(e, "")
        out.append(("expr", r["expr"], None, None, r["kind"], None, None, None, r["base"], _long(r["off"]), _long(r["scale"]), r["idx"], r["nested"], r["sym"], _long(r["const"]), r["root_sym"]))
    return out


_TYPES = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]


def _taught(functions: pa.RecordBatch, kept: dict[str, list[tuple]], exprs: bool) -> pa.RecordBatch:
    """ROWS of a slice of functions (func, body, names)."""
    func, body, names = functions.columns
    starts, ops = np.asarray(names.offsets), names.values
    coded = body.dictionary_encode()
    which = np.array(coded.indices)
    found = []
    for b in coded.dictionary.to_pylist():
        if b not in kept:
            kept[b] = _rows(b, exprs)
        found.append(kept[b])
    own = ops.slice(starts[0], starts[-1] - starts[0])
    if own.null_count > 1 or len(own.unique()) < len(own):
        # Operations with one name are the same in what is learnt, so these functions are read by themselves.
        for i, held in enumerate(names.to_pylist()):
            first: dict[str, int] = {}
            numbers = [first.setdefault(x, k) for k, x in enumerate(held or ())]
            if len(first) < len(numbers):
                which[i] = len(found)
                found.append(_rows(body[i].as_py(), exprs, numbers))
    lengths = np.array([len(r) for r in found], dtype=np.int64)
    first_row = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    n = lengths[which]
    owner = np.repeat(np.arange(len(which)), n)
    take = pa.array(np.arange(len(owner)) + np.repeat(first_row[which] - (np.cumsum(n) - n), n))
    columns = list(zip(*(r for rows in found for r in rows))) or [()] * len(_TYPES)
    out = [pa.array(c, t).take(take) for c, t in zip(columns, _TYPES)]
    held = out[3].is_valid().to_numpy(zero_copy_only=False)
    out[3] = ops.take(pa.array(out[3].fill_null(0).to_numpy() + starts[owner], mask=~held))
    return pa.RecordBatch.from_arrays([func.take(pa.array(owner)), *out], [x.split()[0] for x in ROWS.split(", ")])


def gathered(ops: DataFrame) -> DataFrame:
    """(func, ops): the operations of each function, whose schema is OPS, in one row."""
    return ops.groupBy("func").agg(F.collect_list(F.struct("ord", "op", "opcode", "out", "ins")).alias("ops"))


def learn(functions: DataFrame, skip: DataFrame | None = None, exprs: bool = True) -> DataFrame:
    """ROWS of functions (func, ops), ops being structs of ord, op, opcode, out and ins; functions are independent, so this is one pass over rows.

    skip: (func, sym) variables that get no edges. exprs: rows of expressions too.
    """
    none = F.array().cast("array<string>")
    if skip is None:
        marked = functions.withColumn("skip", none)
    else:
        marked = functions.join(skip.groupBy("func").agg(F.sort_array(F.collect_set("sym")).alias("skip")), "func", "left").withColumn("skip", F.coalesce("skip", none))
    ordered = marked.select("func", "skip", F.sort_array("ops").alias("ops"))
    body = F.to_json(F.struct("skip", F.transform("ops", lambda x: F.struct(x["opcode"].alias("opcode"), x["out"].alias("out"), x["ins"].alias("ins"))).alias("ops")), {"ignoreNullFields": "false"})
    named = ordered.select(F.col("func").cast("string").alias("func"), body.alias("body"), F.transform("ops", lambda x: x["op"]).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[tuple]] = {}
        held = 0
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + SLICE, "right")))
                known = len(kept)
                yield _taught(batch.slice(at, to - at), kept, exprs)
                held += sum(len(x) for x in islice(kept, known, None))
                if held > KEPT:
                    kept.clear()
                    held = 0
                at = to

    return named.mapInArrow(run, ROWS)


def interpret(ops: DataFrame, skip: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(learnt, exprs) of ops, whose schema is OPS.

    skip: (func, sym) variables that get no edges.
    """
    found = materialize(learn(gathered(ops), skip), "learnt")
    exprs = found.where("what = 'expr'").select(F.col("a").alias("expr"), *EXPR)
    return found.where("what <> 'expr'").drop("idx", "nested", "sym", "const", "root_sym"), exprs


def field_accesses(learnt: DataFrame, exprs: DataFrame | None = None) -> DataFrame:
    """(base, offset, field_expr, op, access_type, dt, size, scale): access points seen as fields of their base.

    exprs isn't needed: each access point comes with its field.
    """
    points = learnt.where("what = 'access' AND base IS NOT NULL").repartition("op").dropDuplicates(["op", "a", "kind"])
    return points.select("base", F.col("off").alias("offset"), F.col("a").alias("field_expr"), "op", F.col("kind").alias("access_type"), "dt", "size", "scale")
