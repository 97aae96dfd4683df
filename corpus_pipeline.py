"""The corpus pipeline: documents to packed sequences, in stages that are each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of documents, COLUMNS; a stage reads
these only, so extra columns of whatever names end with it. Every stage keeps
null ids, nulls in lang, source and n_chars, and null texts, which count as
empty; texts of any length are read whole; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordscope.llm import near_duplicates, packing, quality, secrets
from recordscope.llm.tables import read
from recordscope.operators.skew import maybe_member
from recordscope.storage import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier, fitted on the labels, does not reject.

    Repeated rows and rows with equal ids are scored one by one; a score of just
    the threshold is kept; a text without words gets the score of the bias.
    """
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    return quality.score(docs.select(*COLUMNS), model).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that links connect.

    It is a row of the class of equal texts that stands for the group, that with the smallest id;
    ties, repeated rows too, go by lang, source and n_chars; a null id comes last.
    """
    known = materialize(near_duplicates.linked_classes(docs), "classes")
    named = docs.select(*COLUMNS).withColumn("digest", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)))
    # Most rows are surely kept and need no shuffle; of the others, each task hands on one row for each text.
    marked = maybe_member(named, "digest", known.where("copies > 1 OR NOT leads"), "doubtful")
    order = Window.partitionBy("digest").orderBy(F.asc_nulls_last("doc_id"), "lang", "source", "n_chars")
    first = marked.where("doubtful").withColumn("_rn", F.row_number().over(order)).where("_rn = 1")
    rest = first.join(known.where("leads").select("digest"), "digest", "left_semi")
    return marked.where("NOT doubtful").select(*COLUMNS).unionByName(rest.select(*COLUMNS))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret that the scan finds by a sign; documents without are untouched, null texts stay null.

    Repeated rows and rows with equal ids are each redacted; n_chars is counted anew where a text changes.
    """
    found = secrets.find_secrets(docs.select(*COLUMNS), keep=COLUMNS[1:])
    text = secrets.redact(F.col("text"), F.col("found"))
    return found.select("doc_id", text.alias("text"), "lang", "source", F.when(F.size("found") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, placed in sequences of at most 1024 tokens.

    A null or empty text is one piece, the end id; repeated rows and rows with equal or null ids are documents of their own.
    """
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", drop_low_quality),
    ("ngram_jaccard", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs


#: A trained classifier and library tokenisation can't be expressed in SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
