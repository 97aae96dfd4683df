"""A run from hand-made facts to documents."""

import json

import pytest

from recordscope import sources
from recordscope.plans import inference

Q, D, I = ("qword", 8), ("dword", 4), ("int", 4)


class Program:
    """Facts of a few functions, written down operation by operation."""

    def __init__(self):
        self.tables = {name: [] for name in sources.FACTS}
        self.seq = 0

    def function(self, name, entry, external=False):
        self.tables["functions"].append((name, entry, name, external, False))

    def symbol(self, func, sym, role="param", idx=0, dt="long"):
        self.tables["symbols"].append((func, sym, sym, role, idx if role == "param" else None, dt, "register", None, 64 + len(self.tables["symbols"]), None, True))
        self.node(func, sym, sym=sym)

    def node(self, func, vn, dt="qword", size=8, sym=None, const=None):
        if not any(r[:2] == (func, vn) for r in self.tables["varnodes"]):
            self.tables["varnodes"].append((func, vn, "register" if const is None else "const", const or 0, size, None, sym, dt, 0))
        return vn

    def const(self, func, value):
        return self.node(func, f"#{value}", "long", 8, const=value)

    def op(self, func, opcode, out, *ins):
        self.seq += 1
        op = f"{func}.{self.seq}"
        self.tables["pcode_ops"].append((func, 0, self.seq, op, opcode, out, list(ins)))
        return op

    def at(self, func, base, offset):
        """base + offset"""
        if not offset:
            return base
        out = self.node(func, f"{base}+{offset}")
        if not any(o[5] == out and o[0] == func for o in self.tables["pcode_ops"]):
            self.op(func, "INT_ADD", out, base, self.const(func, offset))
        return out

    def load(self, func, base, offset, kind):
        out = self.node(func, f"{base}[{offset}]{kind[0]}", *kind)
        self.op(func, "LOAD", out, self.at(func, base, offset))
        return out

    def call(self, func, callee, entry, *args, receiver=None):
        self.tables["call_insts"].append((func, 1000 + self.seq, "CALL", entry))
        op = self.op(func, "CALL", receiver, self.const(func, entry), *args)
        self.tables["call_sites"].append((op, func, op, entry, list(args), receiver, 0))

    def frames(self, spark):
        return {name: spark.createDataFrame(rows, sources.FACTS[name]) for name, rows in self.tables.items()}


@pytest.fixture(scope="module")
def run(spark):
    """main passes p to work: fields at 4 (int), 8, 0x28 and 0x30 (pointers), 0x18, 0x20; what lies at 0x28 is also passed on by itself."""
    p = Program()
    for name, entry in (("main", 1), ("work", 2), ("inner", 3)):
        p.function(name, entry)
    p.function("malloc", 9, external=True)
    p.symbol("main", "m", "local")
    p.symbol("work", "p")
    p.symbol("inner", "q")
    p.call("main", "malloc", 9, p.const("main", 56), receiver="m")
    p.call("main", "work", 2, "m")
    p.load("work", "p", 4, I)
    for offset in (0x18, 0x20):
        p.load("work", "p", offset, Q)
    first = p.load("work", "p", 8, Q)
    p.load("work", first, 0, Q)
    p.load("work", first, 8, D)
    for offset in (0x28, 0x30):  # both lead to records of the same kind
        link = p.load("work", "p", offset, Q)
        p.load("work", link, 0, Q)
        p.load("work", link, 8, D)
    p.call("work", "inner", 3, p.at("work", "p", 0x28))
    p.load("inner", "q", 0, Q)
    p.load("inner", "q", 8, Q)
    for name, kind, length in (("long", "primitive", 8), ("int", "primitive", 4), ("qword", "primitive", 8), ("dword", "primitive", 4)):
        p.tables["data_types"].append((name, kind, length, length, None, None, None, "/"))
    facts = p.frames(spark)
    return facts, inference.infer(facts)


def test_calls_join_what_flows_together(run):
    _, found = run
    c = {r.expr: r.c for r in found.members.collect()}
    assert c["main:m"] == c["work:p"] and c["inner:q"] == c["(work:p + 0x28)"] != c["work:p"]
    assert {(r.node, r.size) for r in found.sizes.collect()} == {("main:m", 56), ("work:p", 56)}


def test_a_document_has_layout_references_and_nests(run):
    _, found = run
    c = {r.expr: r.c for r in found.members.collect()}
    docs = {r.c: (r.kind, json.loads(r.doc)) for r in found.documents.collect()}
    kind, doc = docs[c["work:p"]]
    assert kind == "_final"
    (name, body), = doc.items()
    assert name.startswith("Struct_") and body["desc"] == "Structure"
    assert {k: (v["desc"], v["size"], v["type"]) for k, v in body["layout"].items()} == {
        "0x4": ("Primitive", 4, "int"), "0x8": ("Pointer", 8, "void *"), "0x18": ("Primitive", 8, "qword"), "0x20": ("Primitive", 8, "qword"), "0x28": ("Pointer", 8, "void *"), "0x30": ("Pointer", 8, "void *"),
    }
    assert list(body["layout"]) == ["0x4", "0x8", "0x18", "0x20", "0x28", "0x30"]
    target = {k: v["refSkt"] for k, v in body["ptrRef"].items()}
    assert set(target) == {"0x8", "0x28", "0x30"} and all(v["ptrLevel"] == 1 for v in body["ptrRef"].values())
    assert target["0x8"] == c["*(work:p + 0x8)"] and target["0x30"] == c["*(work:p + 0x30)"]
    assert body["nest"] == {"0x28": c["inner:q"]}
    assert body["layout"]["0x8"]["name"] == f"ref_0x8_{target['0x8']}"
    assert body["anonTypes"] == {} and body["decompilerInferred"] == {"composite": [], "array": [], "primitive": []}


def test_documents_are_read_back_without_loss(spark, run, tmp_path):
    _, found = run
    for r in found.documents.where("kind = '_final'").collect():
        (tmp_path / f"{abs(hash(r.c))}_final.json").write_text(r.doc)
    back = sources.type_documents(sources.read_documents(spark, str(tmp_path), "final"), "final")
    from pyspark.sql import functions as F

    again = {r.name: json.loads(r.doc) for r in back.select("name", F.to_json("type_doc").alias("doc")).collect()}
    for r in found.documents.where("kind = '_final'").collect():
        for name, body in json.loads(r.doc).items():
            assert again[name] == body


def test_variables_are_listed_by_place(run):
    facts, found = run
    docs = {r.func: json.loads(r.doc) for r in inference.variable_index(facts, found.members).collect()}
    c = {r.expr: r.c for r in found.members.collect()}
    assert docs["work"]["Name"] == "work" and docs["work"]["Parameters"]["work:p"]["TypeConstraint"] == c["work:p"]
