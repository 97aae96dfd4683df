"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of a text is a blob, named by the SHA-256 of its UTF-8 bytes.
The ledger is a table with a row per blob and scan: which rule versions were
run on the blob and what they found. A scan runs only the pairs of blob and
rule version that the ledger does not have, once per blob however many paths
hold it; findings are then joined back to all paths. New rules or versions
make only their own pairs unseen.

Positions come without UDFs: ``regexp_extract_all`` gives a rule's matches,
``split`` by the same pattern what lies between them, and sums of both lengths
the starts. Positions are code points, the end exclusive.

Digests go first: texts of blobs that one path holds and that the ledger
surely lacks are scanned where they are read; only texts of other blobs, known by a
bitmap of bounded size, are shuffled, one per blob.

The ledger may hold a pair more than once, from scans that ran at the same time or
from a repeated append: equal findings count once.

Defined results: a null text is an empty one and has no findings; equal texts
have equal findings; rows with equal keys, repeated rows too, are rows of
their own; a null key is kept; texts are scanned whole, however long; findings
that start together are in the order of the rules; an empty table gives no
rows; columns that are not asked for are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, maybe_member, salted_lookup
from ..storage import materialize, new_folder
from .tables import read


@dataclass(frozen=True)
class Rule:
    """pattern: leftmost non-overlapping matches; those whose group has fewer than ``least`` characters are dropped."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int
    hint: str = ""

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# Fixed by the query's contract.
ASSIGN = "(" + "|".join([*map(either_case, ("password", "passwd", "secret", "token")), either_case("api") + "_?" + either_case("key")]) + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
BASE = (Rule("assign", 1, ASSIGN, 2, 8), Rule("access", 1, "AKIA[A-Z0-9]+", 0, 16, "AKIA"), Rule("hex", 1, "[0-9a-f]+", 0, 32))
#: Public formats of further secrets.
TOKENS = (
    *BASE,
    Rule("github", 1, "gh[pousr]_[A-Za-z0-9]+", 0, 40, "gh"),
    Rule("jwt", 1, "eyJ[A-Za-z0-9_-]+[.]eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 0, 40, "eyJ"),
)
PEM = "-----BEGIN [A-Z ]*PRIVATE KEY-----"
# A key's lines may be joined by a written \n. Without an END line, a key ends with its base64 lines, of which the last may be short.
_GAP = r"(?:\s|\\[nr])*+"
_HEADERS = rf"(?:{_GAP}(?:Proc-Type|DEK-Info): [^\n\\]*+)*+"
_BODY = rf"(?:{_GAP}[A-Za-z0-9+/]{{16,}}+={{0,2}})++(?:{_GAP}[A-Za-z0-9+/]++={{0,2}})?+"
KEY_BLOCK = rf"{PEM}(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----|{_HEADERS}(?:{_BODY})?+)"
RULES = (*TOKENS, Rule("pem", 2, KEY_BLOCK, 0, 1, "-----BEGIN "))
#: The query's SQL is fixed: its pem rule is the BEGIN line alone.
SQL_RULES = (*TOKENS, Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, "-----BEGIN "))
FOUND = "array<struct<rule:string,start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<rule, start, end>> of a rule's findings, by start."""
    pattern = _narrowed(rule)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x))
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), lambda x: F.length(x) >= rule.least)
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    steps = F.arrays_zip(gaps.alias("gap"), lengths.alias("size"), kept.alias("kept"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(FOUND).alias("out"))

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        end = start + F.coalesce(x["size"], F.lit(0))
        one = F.struct(F.lit(rule.kind).alias("rule"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["kept"], F.array_append(done["out"], one)).otherwise(done["out"]).alias("out"))

    found = F.aggregate(steps, zero, step, lambda done: done["out"])
    hinted = F.contains(text, F.lit(rule.hint)) & text.rlike(pattern) if rule.hint else text.rlike(pattern)
    return F.when(hinted, found).otherwise(F.array().cast(FOUND))


def scan_unseen(docs: DataFrame, text: str, ledger: DataFrame | None, rules: Sequence[Rule]) -> DataFrame:
    """New ledger rows (blob, scanned, found): the pairs of blob and rule version that ledger does not hold."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    named = docs.select(F.sha2(whole, 256).alias("blob"), whole.alias("content"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    none = F.array().cast("array<string>")
    # Blobs that several paths hold, or that the ledger knows, and what is left to do for them.
    apart = named.groupBy("blob").agg(F.count("*").alias("paths"))
    if ledger is None:
        apart = apart.where("paths > 1").select("blob", keys.alias("todo"))
    else:
        seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("scanned"))).alias("seen"))
        apart = apart.join(seen, "blob", "left").where("paths > 1 OR seen IS NOT NULL").select("blob", F.array_except(keys, F.coalesce("seen", none)).alias("todo"))
    apart = materialize(apart, "blobs")
    marked = maybe_member(named, "blob", apart, "apart")
    alone = marked.where("NOT apart").select("blob", "content", keys.alias("todo"))
    # The bitmap may hold a lone blob for one of apart, so the exact join keeps those.
    rest = marked.where("apart").groupBy("blob").agg(F.first("content").alias("content")).join(apart, "blob", "left").select("blob", "content", F.coalesce("todo", keys).alias("todo"))
    blobs = alone.unionByName(rest)
    found = F.concat(*[F.when(F.array_contains("todo", r.key), spans(F.col("content"), r)).otherwise(F.array().cast(FOUND)) for r in rules])
    return blobs.where(F.size("todo") > 0).select("blob", F.col("todo").alias("scanned"), found.alias("found"))


def ledger_findings(ledger: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(blob, found) by these rule versions, in the order of start, then of the rules; blobs without findings are left out."""
    current = F.array(*[F.lit(r.key) for r in rules])
    rank = F.array(*[F.lit(r.kind) for r in rules])
    # A blob's rows each hold other rule versions; only rows with a version in force count.
    rows = ledger.where((F.size("found") > 0) & F.arrays_overlap("scanned", current))
    kinds = F.transform(F.array_intersect("scanned", current), lambda k: F.substring_index(k, "@", 1))
    rows = rows.withColumn("found", F.filter("found", lambda x: F.array_contains(kinds, x["rule"])))
    merged = rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    ordered = F.array_sort(F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.array_position(rank, x["rule"]).alias("rank"), x["end"].alias("end"), x["rule"].alias("rule"))))
    return merged.select("blob", ordered.alias("found"))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, ledger_path: str | None = None, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """(key, blob, found) and the columns in ``keep`` for every path; the ledger at ledger_path gets the pairs that it had not."""
    spark = docs.sparkSession
    ledger = None
    if ledger_path is None:
        ledger_path = new_folder(spark, "ledger")
    else:
        try:
            ledger = spark.read.parquet(ledger_path)
        except Exception as e:  # no table there yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
    scan_unseen(docs, text, ledger, rules).write.mode("append").parquet(ledger_path)
    findings = ledger_findings(spark.read.parquet(ledger_path), rules)
    paths = docs.select(F.col(key), *keep, F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))
    counted = materialize(paths.groupBy("blob").agg(F.count("*").alias("paths")).where(F.col("paths") > 1), "counts")
    hot = hot_keys(counted, "blob", "paths", docs.count())
    return salted_lookup(paths, findings, "blob", hot, F.xxhash64(F.col(key)), "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<start:int,rank:int,end:int,rule:string>>")))


def redact(text: Column, found: Column, sign: str = "[SECRET]") -> Column:
    """The text with each run of findings that overlap replaced by a sign."""
    def step(done: Column, x: Column) -> Column:
        apart = x["start"] >= done["at"]
        gap = F.substring(text, done["at"] + 1, x["start"] - done["at"])
        return F.struct(F.greatest(done["at"], x["end"]).alias("at"), F.when(apart, F.concat(done["out"], gap, F.lit(sign))).otherwise(done["out"]).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    replaced = F.aggregate(found, zero, step, lambda done: F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))
    return F.when(F.size(found) > 0, replaced).otherwise(text)


def _line(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")


def _count(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["rule"] == kind)).cast("long")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("found")
    base = F.filter(found, lambda x: x["rank"] <= len(BASE))
    counts = [_count(found, r.kind).alias(f"n_{r.kind}") for r in BASE]
    return find_secrets(read(spark, sf_dir, "documents")).select("doc_id", *counts, F.sha2(_line(base), 256).alias("base_sha256"), _line(found).alias("spans"))


def _narrowed(rule: Rule) -> str:
    """A pattern without the runs that would be dropped anyway: a short run of one character class holds no other match."""
    return f"[0-9a-f]{{{rule.least},}}" if rule.pattern == "[0-9a-f]+" else rule.pattern


def _duck(rules: Sequence[Rule]) -> str:
    quoted = [_narrowed(r).replace("'", "''") for r in rules]
    lists = ", ".join(f"regexp_extract_all(t, '{p}') AS m{k}, regexp_extract_all(t, '{p}', {r.group}) AS v{k}, regexp_split_to_array(t, '{p}') AS g{k}" for k, (r, p) in enumerate(zip(rules, quoted)))
    total = "coalesce(list_sum(list_transform({}, lambda x: length(x))), 0)::BIGINT"
    one = lambda k, r: f"list_filter(list_transform(range(1, len(m{k}) + 1), lambda i: {{'s': {total.format(f'g{k}[1:i]')} + {total.format(f'm{k}[1:i-1]')}, 'k': {k}, 'n': length(m{k}[i]), 'r': '{r.kind}', 'v': length(v{k}[i])}}), lambda x: x.v >= {r.least})"
    line = "coalesce(array_to_string(list_transform({}, lambda x: x.r || ':' || x.s || ':' || (x.s + x.n)), ','), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS MATERIALIZED (SELECT doc_id, {lists} FROM d),
f AS MATERIALIZED (SELECT doc_id, list_sort(flatten([{', '.join(one(k, r) for k, r in enumerate(rules))}])) AS found FROM l)
SELECT doc_id, {', '.join(f"len(list_filter(found, lambda x: x.r = '{r.kind}'))::BIGINT AS n_{r.kind}" for r in BASE)},
 sha256({line.format(f"list_filter(found, lambda x: x.k < {len(BASE)})")}) AS base_sha256, {line.format("found")} AS spans
FROM f"""


OP6_SQL = _duck(SQL_RULES)
