"""Sources and sinks: fact tables, JSON documents, DOT graphs, run logs, binaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Schemas of the fact tables, as DDL.
FACTS = {
    "functions": "func string, entry long, name string, is_external boolean, is_thunk boolean",
    "call_insts": "caller string, inst long, mnemonic string, flow long",
    "data_types": "dt string, kind string, length int, alignment int, pointee string, element string, typedef_of string, category string",
    "dt_components": "dt string, ordinal int, offset int, comp_dt string, field_name string",
    "symbols": "func string, sym string, name string, role string, param_idx int, dt string, storage_kind string, stack_offset long, pc_addr long, global_addr long, is_isolated boolean",
    "varnodes": "func string, vn string, space string, value long, size int, reg string, sym string, dt string, merge_group int",
    "pcode_ops": "func string, block int, seq int, op string, opcode string, output_vn string, input_vns array<string>",
    "call_sites": "cs string, caller string, op string, callee_entry long, args array<string>, receiver string, bb_addr long",
}
FIELD = "struct<desc:string,size:int,type:string,name:string>"
TYPE_DOC = f"struct<desc:string,type:string,layout:map<string,{FIELD}>,ptrRef:map<string,struct<refSkt:string,ptrLevel:int>>,nest:map<string,string>,anonTypes:variant,decompilerInferred:struct<composite:array<string>,array:array<string>,primitive:array<string>>,decompiledCode:map<string,string>>"
DOCUMENTS = {
    "final": f"map<string,{TYPE_DOC}>",
    "global_morph": f"struct<desc:string,globalMorph:map<string,{TYPE_DOC}>>",
    "range_morph": f"struct<desc:string,rangeMorph:array<struct<startOffset:string,endOffset:string,desc:string,types:map<string,{TYPE_DOC}>>>>",
}


def read_facts(spark: SparkSession, folder: str, name: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).schema(FACTS[name]).load(f"{folder}/{name}")


def read_documents(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(path, doc) of JSON documents; keys are data, so the schema is given, not inferred."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return text.select("path", F.from_json("value", DOCUMENTS[kind]).alias("doc"))


def type_documents(documents: DataFrame, kind: str) -> DataFrame:
    """(path, start, end, name, type_doc): one row per candidate type."""
    if kind == "final":
        return documents.select("path", F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.explode("doc").alias("name", "type_doc"))
    if kind == "global_morph":
        return documents.select("path", F.lit(None).cast("string").alias("start"), F.lit(None).cast("string").alias("end"), F.explode("doc.globalMorph").alias("name", "type_doc"))
    ranges = documents.select("path", F.explode("doc.rangeMorph").alias("r"))
    return ranges.select("path", F.col("r.startOffset").alias("start"), F.col("r.endOffset").alias("end"), F.explode("r.types").alias("name", "type_doc"))


def read_dot(spark: SparkSession, path: str) -> DataFrame:
    """(path, src, dst, label) of DOT files, each edge both ways; of edges between the same nodes the last label counts."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value", F.monotonically_increasing_id().alias("at"))
    arrow = r'^\s*"?([^"\[\]]+?)"?\s*-[->]\s*"?([^"\[\]]+?)"?\s*(?:\[(.*)\])?\s*;?\s*$'
    edges = lines.where(F.col("value").rlike(arrow)).select("path", "at", F.regexp_extract("value", arrow, 1).alias("src"), F.regexp_extract("value", arrow, 2).alias("dst"), F.regexp_extract(F.regexp_extract("value", arrow, 3), r'label\s*=\s*"?([^",\]]*)"?', 1).alias("label"))
    both = edges.unionByName(edges.select("path", "at", F.col("dst").alias("src"), F.col("src").alias("dst"), "label"))
    return both.groupBy("path", "src", "dst").agg(F.max_by("label", "at").alias("label"))


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """(path, analysis_s, retyping_s, total_s) from run logs."""
    text = spark.read.text(path, wholetext=True)
    number = lambda name: F.regexp_extract("value", name + r"\s*time:\s*([0-9.]+)s", 1).cast("double")
    return text.select(F.input_file_name().alias("path"), number("Type Analysis").alias("analysis_s"), number("ReTyping").alias("retyping_s"), number("Total").alias("total_s"))


def timing_totals(timings: DataFrame) -> DataFrame:
    return timings.agg(*[F.sum(c).alias(c) for c in ("analysis_s", "retyping_s", "total_s")])


def elf_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of files that start with the ELF magic number."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.hex(F.substring("content", 1, 4)) == "7F454C46").select("path", "length")


def _hex_key(offset: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(offset.cast("long"))))


def _by_offset(rows: DataFrame, key: str, offset: str, value: Column, name: str) -> DataFrame:
    """(key, name): a map by hexadecimal offset, in the order of offsets."""
    entry = F.struct(F.col(offset).alias("at"), F.struct(_hex_key(F.col(offset)).alias("k"), value.alias("v")).alias("e"))
    return rows.groupBy(key).agg(F.map_from_entries(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"])).alias(name))


def _field(kind: Column) -> Column:
    return F.struct(F.initcap(kind).alias("desc"), F.col("size").cast("int").alias("size"), F.col("type"), F.col("name"))


def struct_document(members: DataFrame, key: str = "c") -> DataFrame:
    """(key, doc): each record's JSON layout by hexadecimal offset. members: (key, offset, size, type, name, kind)."""
    held = _by_offset(members, key, "offset", _field(F.col("kind")), "layout")
    return held.select(key, F.to_json(F.struct(F.lit("Structure").alias("desc"), "layout")).alias("doc"))


def anonymous_documents(shapes: DataFrame) -> DataFrame:
    """(name, doc): the layout of each anonymous record of a repeat. shapes: (name, shape array<struct<at, size, kind>>); a kind that ends in * is a pointer."""
    flat = shapes.dropDuplicates(["name"]).select("name", F.explode("shape").alias("x")).select(F.col("name").alias("owner"), F.col("x.at").alias("offset"), F.col("x.size").alias("size"), F.col("x.kind").alias("type"))
    pointer = F.col("type").endswith("*")
    named = flat.withColumn("kind", F.when(pointer, "pointer").otherwise("primitive")).withColumn("name", F.concat(F.when(pointer, "ref_").otherwise("field_"), _hex_key(F.col("offset"))))
    return _by_offset(named, "owner", "offset", _field(F.col("kind")), "layout").select(F.col("owner").alias("name"), F.to_json("layout").alias("doc"))


def full_documents(members: DataFrame, refs: DataFrame, nests: DataFrame, anonymous: DataFrame, inferred: DataFrame, key: str = "c") -> DataFrame:
    """(key, doc): each record's whole JSON document, as TYPE_DOC has it, but for rendered code.

    members: (key, offset, size, type, name, kind); refs: (key, offset, target,
    ptr_level); nests: (key, offset, target); anonymous: (key, name, doc), JSON
    of an anonymous record or union; inferred: (key, dt, kind).
    """
    out = _by_offset(members, key, "offset", _field(F.col("kind")), "layout")
    out = out.join(_by_offset(refs, key, "offset", F.struct(F.col("target").alias("refSkt"), F.col("ptr_level").cast("int").alias("ptrLevel")), "ptrRef"), key, "left")
    out = out.join(_by_offset(nests, key, "offset", F.col("target"), "nest"), key, "left")
    pair = F.concat(F.to_json(F.struct(F.col("name").alias("n"))), F.lit(""))
    quoted = F.substring(pair, 6, F.length(pair) - 6)  # the name as JSON writes it
    anon = anonymous.select(key, "name", F.concat(quoted, F.lit(":"), "doc").alias("_e")).groupBy(key).agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_set("_e")), ","), F.lit("}")).alias("anonTypes"))
    kind = lambda *names: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*names), F.col("dt"))))
    found = inferred.groupBy(key).agg(F.struct(kind("struct", "union", "composite").alias("composite"), kind("array").alias("array"), kind("primitive", "pointer").alias("primitive")).alias("decompilerInferred"))
    out = out.join(anon, key, "left").join(found, key, "left")
    empty = F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))
    none = F.array().cast("array<string>")
    doc = F.struct(
        F.lit("Structure").alias("desc"), F.col("layout"), F.coalesce("ptrRef", F.from_json(F.lit("{}"), "map<string,struct<refSkt:string,ptrLevel:int>>")).alias("ptrRef"), F.coalesce("nest", empty).alias("nest"),
        F.parse_json(F.coalesce("anonTypes", F.lit("{}"))).alias("anonTypes"), F.coalesce("decompilerInferred", F.struct(none.alias("composite"), none.alias("array"), none.alias("primitive"))).alias("decompilerInferred"),
    )
    return out.select(key, F.to_json(doc).alias("doc"))


def _joined(names: Column, docs: Column) -> Column:
    """One JSON object of documents by name, in the order of names."""
    quoted = F.to_json(F.struct(names.alias("n")))
    entry = F.struct(names.alias("n"), F.concat(F.substring(quoted, 6, F.length(quoted) - 6), F.lit(":"), docs).alias("e"))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), ","), F.lit("}"))


def final_documents(docs: DataFrame) -> DataFrame:
    """(kind, c, doc) of constraints with one final type. docs: (c, name, doc). Judged champions are written the same way."""
    return docs.groupBy("c").agg(_joined(F.col("name"), F.col("doc")).alias("doc")).select(F.lit("_final").alias("kind"), "c", "doc")


def inferred_documents(inferred: DataFrame) -> DataFrame:
    """(kind, c, doc) of constraints whose type the decompiler has told. inferred: (c, dt, kind)."""
    kind = lambda *names: F.array_sort(F.collect_set(F.when(F.col("kind").isin(*names), F.col("dt"))))
    held = F.struct(kind("struct", "union", "composite").alias("composite"), kind("array").alias("array"), kind("primitive", "pointer").alias("primitive"))
    return inferred.groupBy("c").agg(held.alias("x")).select(F.lit("_final_DI").alias("kind"), "c", F.to_json(F.struct(F.lit("DecompilerInferred").alias("desc"), F.col("x").alias("decompilerInferred"))).alias("doc"))


def global_documents(candidates: DataFrame) -> DataFrame:
    """(kind, c, doc) of constraints with candidates for the whole. candidates: (c, name, doc)."""
    docs = candidates.groupBy("c").agg(_joined(F.col("name"), F.col("doc")).alias("m"))
    return docs.select(F.lit("_global_morph").alias("kind"), "c", F.concat(F.lit('{"globalMorph":'), "m", F.lit("}")).alias("doc"))


def range_documents(candidates: DataFrame) -> DataFrame:
    """(kind, c, doc) of constraints with candidates for ranges. candidates: (c, start, end, name, doc)."""
    per = candidates.groupBy("c", "start", "end").agg(_joined(F.col("name"), F.col("doc")).alias("types"))
    entry = F.struct("start", "end", F.concat(F.lit('{"startOffset":"'), _hex_key(F.col("start")), F.lit('","endOffset":"'), _hex_key(F.col("end")), F.lit('","types":'), "types", F.lit("}")).alias("e"))
    docs = per.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["e"]), ",").alias("m"))
    return docs.select(F.lit("_range_morph").alias("kind"), "c", F.concat(F.lit('{"rangeMorph":['), "m", F.lit("]}")).alias("doc"))


def type_library(types: DataFrame) -> DataFrame:
    """(program, doc): a program's user and library records. types: (program, section UD_Struct, UD_Union, Lib_Struct or Lib_Union, name, doc)."""
    per = types.groupBy("program", "section").agg(_joined(F.col("name"), F.col("doc")).alias("m"))
    every = types.select("program").distinct().select("program", F.explode(F.array(*[F.lit(x) for x in ("UD_Struct", "UD_Union", "Lib_Struct", "Lib_Union")])).alias("section"))
    return every.join(per, ["program", "section"], "left").groupBy("program").agg(_joined(F.col("section"), F.coalesce("m", F.lit("{}"))).alias("doc"))


def union_layout(members: DataFrame, key: str = "c") -> DataFrame:
    """(key, doc): a union's fields as a JSON array, named by their order. members: (key, size, type, kind)."""
    listed = F.array_sort(F.collect_set(F.struct("type", "size", "kind")))
    named = F.transform(listed, lambda x, i: F.struct(F.initcap(x["kind"]).alias("desc"), x["size"].cast("int").alias("size"), x["type"].alias("type"), F.concat(F.lit("union_member_"), i.cast("string")).alias("name")))
    return members.groupBy(key).agg(F.to_json(named).alias("doc"))


def union_document(members: DataFrame, key: str = "c") -> DataFrame:
    """(key, doc): a union's members named by their order. members: (key, type, size)."""
    listed = F.array_sort(F.collect_set(F.struct("type", "size")))
    named = F.transform(listed, lambda x, i: F.struct(F.concat(F.lit("union_member_"), i.cast("string")).alias("name"), x["type"].alias("type"), x["size"].alias("size")))
    return members.groupBy(key).agg(F.to_json(F.struct(F.lit("Union").alias("desc"), named.alias("members"))).alias("doc"))


def read_config(path: str) -> dict:
    """A run's settings from a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def typed_folders(spark: SparkSession, path: str) -> DataFrame:
    """(folder) of run outputs that hold both constraint documents and a variable index; only names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    name = F.element_at(F.split("path", "/"), -1)
    held = files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).agg(F.bool_or(name.contains("TypeConstraint")).alias("constraints"), F.bool_or(name.contains("varType")).alias("variables"))
    return held.where("constraints AND variables").select("folder")


def variable_index(variables: DataFrame) -> DataFrame:
    """(func, doc): a function's name, parameters and locals by location key. variables: (func, func_name, role, loc, name, desc, c)."""
    entry = F.struct("loc", F.struct(F.col("name").alias("Name"), "desc", F.col("c").alias("TypeConstraint")).alias("v"))
    of = lambda role: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("role") == role, entry))))
    return variables.groupBy("func", "func_name").agg(of("param").alias("p"), of("local").alias("l")).select("func", F.to_json(F.struct(F.col("func_name").alias("Name"), F.col("p").alias("Parameters"), F.col("l").alias("LocalVariables"))).alias("doc"))


def document_kind(has_inferred: Column, n_global: Column, n_range: Column, has_final: Column) -> Column:
    """The suffix of a constraint's document; null where there is nothing to say. With both kinds of candidates, both are written by the caller."""
    return F.when(has_inferred, "_final_DI").when((n_global == 0) & (n_range == 0) & has_final, "_final").when(n_global > 0, "_global_morph").when(n_range > 0, "_range_morph")


def write_documents(documents: DataFrame, folder: str) -> None:
    """JSON lines, a folder per kind. documents: (kind, c, doc)."""
    documents.write.mode("overwrite").partitionBy("kind").json(folder)


def dot_text(edges: DataFrame, key: str = "component") -> DataFrame:
    """(key, dot): each component as a DOT graph. edges: (key, src, dst, edge_type)."""
    line = F.concat(F.lit('  "'), F.col("src"), F.lit('" -> "'), F.col("dst"), F.lit('" [label="'), F.col("edge_type"), F.lit('"];'))
    return edges.groupBy(key).agg(F.concat(F.lit("digraph {\n"), F.array_join(F.array_sort(F.collect_set(line)), "\n"), F.lit("\n}")).alias("dot"))


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(FACTS[name])
