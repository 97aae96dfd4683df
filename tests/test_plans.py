"""Expression algebra, the interpreter, documents and the registered queries."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from recordscope import sources
from recordscope.plans import catalogue, interpreter
from recordscope.plans.expressions import add, aliases, constant, dereference, field_access, multiply, reference, root_symbol, symbol

DIR = "/root/testdata/sf0.001"


def test_expression_algebra():
    p, i = symbol("p"), symbol("i")
    assert str(add(add(p, constant(8)), constant(8))) == "(p + 0x10)"
    element = add(p, multiply(i, constant(16)))
    assert str(add(element, constant(8))) == "(p + i * 0x10 + 0x8)"
    assert add(element, element) is None and add(p, constant(0)) == p
    assert reference(dereference(p)) == p and str(dereference(add(p, constant(8)))) == "*(p + 0x8)"
    assert aliases(element) == [(element, p)]
    assert field_access(dereference(add(element, constant(8)))) == (p, 8, i, 16)
    assert root_symbol(dereference(element)) == "p"
    with pytest.raises(ValueError):
        dereference(constant(4))


def node(vn, size=8, sym=None, dt=None, value=0, space="register"):
    return (vn, size, sym, dt, value, space)


def test_interpreter_follows_loads(spark):
    ops = [
        ("f", 0, "o0", "INT_ADD", node("a"), [node("p", sym="p"), node("c", value=16, space="const")]),
        ("f", 1, "o1", "LOAD", node("v", dt="qword"), [node("a")]),
        ("f", 2, "o2", "STORE", None, [node("v"), node("k", 4, dt="dword", value=1, space="const")]),
        ("f", 3, "o3", "RETURN", None, [node("v")]),
        ("g", 0, "q0", "INT_SUB", node("b"), [node("p", sym="p"), node("c", value=16, space="const")]),
    ]
    learnt, exprs = interpreter.interpret(spark.createDataFrame(ops, interpreter.OPS))
    found = interpreter.field_accesses(learnt, exprs)
    assert sorted((r.base, r.offset, r.access_type, r.size) for r in found.collect()) == [("*(p + 0x10)", 0, "STORE", 4), ("p", 16, "LOAD", 8)]
    assert [r.a for r in learnt.where("what = 'return'").collect()] == ["*(p + 0x10)"]


def test_documents_round_trip(spark, tmp_path):
    doc = {"globalMorph": {"T1": {"desc": "Structure", "layout": {"0x8": {"desc": "Primitive", "size": 4, "type": "dword", "name": "field_0x8"}}}}}
    (tmp_path / "a_global_morph.json").write_text(json.dumps(doc))
    found = sources.type_documents(sources.read_documents(spark, str(tmp_path), "global_morph"), "global_morph")
    row = found.collect()[0]
    assert row["name"] == "T1" and row.type_doc.layout["0x8"].size == 4


def test_dot_and_timings(spark, tmp_path):
    (tmp_path / "g.dot").write_text('digraph {\n  "a" -> "b" [label="CALL"];\n  "b" -> "c" [label="X"];\n}\n')
    assert sorted((r.src, r.dst, r.label) for r in sources.read_dot(spark, str(tmp_path / "g.dot")).collect()) == [("a", "b", "CALL"), ("b", "a", "CALL"), ("b", "c", "X"), ("c", "b", "X")]
    (tmp_path / "log.txt").write_text("x\nType Analysis time: 1.5s\nReTyping time: 2s\nTotal time: 3.5s\n")
    assert sources.read_timings(spark, str(tmp_path / "log.txt")).select("analysis_s", "retyping_s", "total_s").collect()[0] == (1.5, 2.0, 3.5)
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin/e").write_bytes(b"\x7fELFxx")
    (tmp_path / "bin/t").write_bytes(b"text")
    assert sources.elf_files(spark, str(tmp_path / "bin")).count() == 1


def one(opcode, out, *ins, seeds=("p", "q")):
    """What a function learns from one operation on variables that hold symbols: facts of the output, edges, accesses, other rows."""
    f = interpreter.Function("f")
    named = {s: dict(zip(NODE, node(s, sym=s))) for s in seeds}
    given = [named.get(x, dict(zip(NODE, x if isinstance(x, tuple) else node(x)))) for x in ins]
    to = None if out is None else dict(zip(NODE, out if isinstance(out, tuple) else node(out)))
    f.run([{"ord": 1, "op": "o", "opcode": opcode, "out": to, "ins": given}])
    rows = [r[1:] for r in f.learnt]
    return [str(e) for e in f.facts.get(to["vn"], [])] if to else [], sorted((a, b) for w, a, b, *_ in rows if w == "edge"), [r for r in rows if r[0] != "edge"]


NODE = ("vn", "size", "sym", "dt", "value", "space")


def const(value, size=8):
    return node(f"#{value}", size, value=value, space="const")


def test_every_opcode():
    assert one("INT_ADD", "o", "p", const(8))[0] == ["(p + 0x8)"] and one("INT_ADD", "o", "p", "q")[0] == ["(p + q * 0x1)"]
    assert one("INT_SUB", "o", "p", const(0xFFFFFFFFFFFFFFF8))[0] == ["(p + 0x8)"] and one("INT_SUB", "o", "p", const(8))[0] == []
    assert one("INT_ADD", "o", "p", const(0x2000))[0] == ["(p + 0x2000)"] and one("INT_ADD", "o", "p", const(0x2001))[0] == [] and one("INT_ADD", "o", "x", const(8))[0] == []
    for opcode in ("COPY", "CAST", "SUBPIECE"):
        assert one(opcode, node("o", sym="r"), "p", *([const(0)] if opcode == "SUBPIECE" else []))[:2] == (["r", "p"], [("p", "r")])
        assert one(opcode, "q", "x", seeds=("q",))[0] == []
    assert one("COPY", node("q", sym="q"), "x", seeds=())[2] == []
    assert one("PTRADD", "o", "p", const(3), const(16))[0] == ["(p + 0x30)"] and one("PTRADD", "o", "p", "q", const(16))[0] == ["(p + q * 0x10)"] and one("PTRADD", "o", "p", const(3), "q")[0] == []
    assert one("PTRSUB", "o", node("RSP"), node("#", sym="s", space="const"))[0] == ["&s"] and one("PTRSUB", "o", const(0), node("#", sym="g", space="const"))[0] == ["&g"]
    assert one("PTRSUB", "o", "p", const(24))[0] == ["(p + 0x18)"]
    assert one("MULTIEQUAL", "o", "p", "q")[0] == ["p", "q"] and one("MULTIEQUAL", node("o", sym="r"), "p", "q")[0] == ["r"]
    assert one("INT_ZEXT", "o", "p")[0] == one("INT_SEXT", "o", "p")[0] == ["p"]
    assert one("INT_MULT", "o", "p", const(4))[0] == ["(p * 0x4)"] == one("INT_MULT", "o", const(4), "p")[0]
    facts, edges, rows = one("LOAD", node("o", 4, "r", "int"), node("ram", space="const"), "p")
    assert facts == ["r", "*p"] and edges == [("*p", "r")] and ("access", "*p", None, "o", "LOAD", "int", 4, None) in rows
    _, edges, rows = one("STORE", None, node("ram", space="const"), "p", node("q", 2, "q", "short"), seeds=("p",))
    assert edges == [("q", "*p")] and ("access", "*p", None, "o", "STORE", "short", 2, None) in rows
    rows = one("CALL", node("o", sym="r"), const(64), "p", const(5))[2]
    assert {r[0]: r[1] for r in rows} == {"arg": "p", "attr": "p", "const_arg": "0x5", "receiver": "r"}
    assert one("CALLIND", None, "p")[2] == [("attr", "p", None, None, "CODE_PTR", None, None, None)]
    assert {r[0] for r in one("RETURN", None, "p")[2]} == {"return", "attr"} and one("CBRANCH", None, "p") == ([], [], [])


def test_documents_of_candidates(spark, tmp_path):
    rows = lambda schema, *data: spark.createDataFrame(list(data), schema)
    members = rows("c string, offset long, size int, type string, name string, kind string", ("k", 16, 24, "Anon_1[3]", "array_field_0x10", "array"), ("k", 0, 8, "void *", "ref_0x0_t", "pointer"), ("k", 8, 4, "U", "field_0x8", "union"))
    anon = rows("c string, name string, doc string", ("k", "Anon_1", '{"0x0":{"desc":"Primitive"}}'), ("k", 'odd"name', "[]"))
    docs = sources.full_documents(members, rows("c string, offset long, target string, ptr_level int", ("k", 0, "t", 2)), rows("c string, offset long, target string", ("k", 16, "Anon_1")), anon, rows("c string, dt string, kind string", ("k", "sockaddr", "struct"), ("k", "a[4]", "array")))
    body = json.loads(docs.first().doc)
    assert list(body["layout"]) == ["0x0", "0x8", "0x10"] and body["layout"]["0x10"]["desc"] == "Array" and body["ptrRef"] == {"0x0": {"refSkt": "t", "ptrLevel": 2}}
    assert body["nest"] == {"0x10": "Anon_1"} and body["anonTypes"] == {"Anon_1": {"0x0": {"desc": "Primitive"}}, 'odd"name': []} and body["decompilerInferred"] == {"composite": ["sockaddr"], "array": ["a[4]"], "primitive": []}
    kinds = rows("c string, start long, end long, name string, doc string", ("k", 8, 16, "B", "{}"), ("k", 8, 16, "A", "{}"), ("k", 0, 4, "A", '{"x":1}'))
    assert json.loads(sources.range_documents(kinds).first().doc) == {"rangeMorph": [{"startOffset": "0x0", "endOffset": "0x4", "types": {"A": {"x": 1}}}, {"startOffset": "0x8", "endOffset": "0x10", "types": {"A": {}, "B": {}}}]}
    assert json.loads(sources.global_documents(kinds.where("start = 0")).first().doc) == {"globalMorph": {"A": {"x": 1}}}
    assert json.loads(sources.inferred_documents(rows("c string, dt string, kind string", ("k", "sockaddr", "struct"))).first().doc) == {"desc": "DecompilerInferred", "decompilerInferred": {"composite": ["sockaddr"], "array": [], "primitive": []}}
    library = sources.type_library(rows("program string, section string, name string, doc string", ("p", "UD_Struct", "S", '{"desc":"Structure"}')))
    assert json.loads(library.first().doc) == {"Lib_Struct": {}, "Lib_Union": {}, "UD_Struct": {"S": {"desc": "Structure"}}, "UD_Union": {}}
    sources.write_documents(sources.final_documents(kinds.where("start = 0")), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).where("kind = '_final'").count() == 1
    for name in ("a/x_TypeConstraint_1.json", "a/x_varType.json", "b/x_varType.json"):
        (tmp_path / "runs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / name).write_text("{}")
    assert [r.folder.rsplit("/", 1)[1] for r in sources.typed_folders(spark, str(tmp_path / "runs")).collect()] == ["a"]
    (tmp_path / "config.yml").write_text("projects:\n  - a\n  - b\n")
    pytest.importorskip("yaml")
    assert sources.read_config(str(tmp_path / "config.yml")) == {"projects": ["a", "b"]}


@pytest.mark.parametrize("name", [n for n in catalogue.queries() if n in catalogue.oracle_sql()])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = catalogue.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    rel = con.sql(catalogue.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    plain = lambda v: float(v) if isinstance(v, float) else v
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    want = sorted(repr(tuple(plain(v) for v in r)) for r in rel.select(*[f'"{c}"' for c in columns]).fetchall())
    assert got == want


def tables(spark, folder, **rows):
    """Small tables in a folder, as a query reads them; a view of DuckDB for each."""
    con = duckdb.connect()
    for name, (schema, data) in rows.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def same_as_sql(spark, folder, con, name):
    df = catalogue.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    got, want = map(repr, sorted(map(tuple, df.collect()), key=repr)), map(repr, sorted(con.sql(f"SELECT {columns} FROM ({catalogue.oracle_sql()[name]})").fetchall(), key=repr))
    assert list(got) == list(want)


def test_traced_operations_keep_parts_and_orders_apart(spark, tmp_path):
    lines = [(43354, 0, 611, 4), (0, 7, 1, 1), (5, 300, 611, 1), (9, 0, 1, 2), (3, 12, 5, 1), (None, 0, 1, 3)]
    con = tables(
        spark, tmp_path, lineitem=("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int", lines),
        part=("p_partkey long", [(0,), (300,)]), supplier=("s_suppkey long, s_nationkey int", [(611, 0), (1, 4), (5, 3), (None, 0)]),
    )
    same_as_sql(spark, tmp_path, con, "traced_operations")


def test_equal_bodies_are_interpreted_once(monkeypatch):
    import pyarrow as pa

    ops = [dict(zip(("opcode", "out", "ins"), ("LOAD", dict(zip(NODE, node("v", dt=dt))), [dict(zip(NODE, node("p", sym="p")))]))) for dt in ("qword", "int")]
    bodies = [json.dumps({"skip": [], "ops": [o]}) for o in ops]
    batch = pa.RecordBatch.from_arrays([pa.array([f"f{k}" for k in range(1000)]), pa.array([bodies[k % 3 == 0] for k in range(1000)]), pa.array([[f"o{k}"] for k in range(1000)])], ["func", "body", "names"])
    read, rows = [], interpreter._rows
    monkeypatch.setattr(interpreter, "_rows", lambda body, *a: read.append(body) or rows(body, *a))
    kept = {}
    found = [r for part in (batch.slice(0, 600), batch.slice(600)) for r in interpreter._taught(part, kept, False).to_pylist()]
    assert sorted(read) == sorted(bodies)
    assert [(r["func"], r["op"], r["dt"], r["base"], r["off"]) for r in found] == [(f"f{k}", f"o{k}", ("qword", "int")[k % 3 == 0], "p", 0) for k in range(1000)]


def test_functions_taken_together_learn_what_each_does(spark, monkeypatch):
    """Against one function at a time: all opcodes, equal bodies, operations of one name, skipped variables, odd names, numbers beyond a long."""
    import random

    monkeypatch.setattr(interpreter, "SLICE", 5000)
    monkeypatch.setattr(interpreter, "KEPT", 20000)
    rng = random.Random(7)
    opcodes = {"LOAD": 1, "STORE": 2, "RETURN": 1, "CALLIND": 1, "INT_ZEXT": 1, "COPY": 1, "SUBPIECE": 2, "PTRADD": 3, "CALL": 3, "MULTIEQUAL": 2}

    def some(k):
        names = ("p", 'q"\\', "\u00e4\U0001f600")
        if k % 4 == 0:
            return node(f"c{k}", value=rng.choice((4, 8, 0x2000, -8, 0)), space="const")
        return node(f"v{k % 7}", rng.choice((4, 8)), rng.choice((None, None, *names)), rng.choice((None, "int")))

    rows, bodies = [], []
    for _ in range(40):
        ops = []
        for k in range(rng.randrange(0, 12)):
            opcode = rng.choice(list(interpreter.HANDLERS))
            ops.append((opcode, None if opcode in ("STORE", "RETURN", "CALLIND") else some(rng.randrange(1, 4)), [some(rng.randrange(20)) for _ in range(opcodes.get(opcode, 2))]))
        bodies.append(ops)
    huge = [("INT_MULT", node(f"m{k}"), [node(f"m{k - 1}" if k else "p", sym=None if k else "p"), node("c", value=0x2000, space="const")]) for k in range(8)]
    bodies.append([*huge, ("LOAD", node("x"), [node("m7")]), ("INT_ADD", node("y"), [node("b", sym="b"), node("m7")]), ("LOAD", node("z"), [node("y")])])
    for k in range(300):
        for i, (opcode, out, ins) in enumerate(bodies[k % len(bodies)]):
            name = None if k == 9 else "same" if k % 50 == 3 else f"f{k}.{i}"
            rows.append((f"f{k}", i, name, opcode, out, ins))
    skips = [("f5", "p"), ("f46", "p"), ("f7", 'q"\\')]
    learnt, exprs = interpreter.interpret(spark.createDataFrame(rows, interpreter.OPS).repartition(7), spark.createDataFrame(skips, "func string, sym string"))
    want, want_exprs = [], []
    long = lambda v: v if v is None or abs(v) < 1 << 63 else None
    for name in dict.fromkeys(r[0] for r in rows):
        f = interpreter.Function(name, {s for g, s in skips if g == name})
        struct = lambda v: v and dict(zip(NODE, v))
        f.run([{"ord": r[1], "op": r[2], "opcode": r[3], "out": struct(r[4]), "ins": [struct(v) for v in r[5]]} for r in rows if r[0] == name])
        want += f.learnt
        want_exprs += [tuple(long(v) if isinstance(v, int) else v for v in interpreter.row(e, name).values()) for e in f.seen]
    columns = ["func", "what", "a", "b", "op", "kind", "dt", "size", "n"]
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in learnt.select(columns).collect()) and len(want) > 1000
    names = ["expr", "kind", "base", "idx", "scale", "off", "nested", "sym", "const", "root_sym", "func"]
    assert sorted(map(repr, want_exprs)) == sorted(repr(tuple(r)) for r in exprs.select(names).collect())
    # Fields as by a join with the expressions.
    keyed = {e[0]: dict(zip(names, e)) for e in want_exprs}
    fields = set()
    for _, what, a, _, op, kind, *_ in want:
        if what == "access" and keyed[a]["kind"] == "deref":
            inner = keyed[keyed[a]["nested"]]
            whole = inner["kind"] == "sum"
            fields.add((inner["base"] if whole else inner["expr"], inner["off"] if whole else 0, a, op, kind, inner["scale"] if whole else 0))
    got = interpreter.field_accesses(learnt, exprs).select("base", "offset", "field_expr", "op", "access_type", "scale").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, (x for x in fields if x[0] is not None))) and len(got) > 100


def test_interpreted_fields_with_odd_keys(spark, tmp_path):
    lines = [(k // 3 - 5, k % 7 + 1, 1.0) for k in range(200)] + [(1, 1, 2.0), (1, 1, 3.0), (None, 2, 1.0), (None, 5, 1.0), (2**62, 1, 1.0)]
    con = tables(spark, tmp_path, lineitem=("l_orderkey long, l_linenumber int, l_quantity double", lines))
    same_as_sql(spark, tmp_path, con, "interpreted_fields")
