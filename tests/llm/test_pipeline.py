"""The corpus pipeline on a small corpus, against a brute-force version of every stage."""

import random
import re

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from recordscope.llm import near_duplicates, packing  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    good = ["river", "stone", "quiet", "light", "with", "the", "under", "morning", "field", "garden", "slowly", "walks"]
    bad = ["buy!!", "$$$", "click***", "###", "win%%%"]
    texts = [" ".join(rng.choice(good) for _ in range(60)) for _ in range(40)]
    texts += [texts[0], texts[1] + " end", texts[2] + ' password = "hunter2hunter2" done']
    texts += [texts[3].replace(texts[3].split()[-1], "token: abcdefgh12")]
    texts += [" ".join(rng.choice(bad) for _ in range(60)) for _ in range(20)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(5, texts[5], "en", "s", len(texts[5]))]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    n_good = 44
    spark.createDataFrame([(k, int(k < n_good), 0) for k in range(len(texts))], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted([*range(n_good), 5])

    sets = {k: set(near_duplicates.grams(texts[k]).tolist()) for k in range(n_good)}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    one = {k for k in sets if find(k) == k}
    single = corpus_pipeline.drop_near_duplicates(spark, kept, str(tmp_path))
    assert single.columns == docs.columns and sorted(r.doc_id for r in single.collect()) == sorted(one) and len(one) < n_good

    pattern = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]{8,}"
    clean = {r.doc_id: r.text for r in corpus_pipeline.redact_secrets(spark, docs.where(F.col("doc_id") < n_good).dropDuplicates(["doc_id"]), str(tmp_path)).collect()}
    assert clean == {k: re.sub(pattern, "[SECRET]", texts[k]) for k in range(n_good)}

    final = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    encode = packing.library_encoder(packing_path(), 2)
    assert {r.doc_id: r.n for r in final} == {k: len(encode([clean[k]])[0]) // 4 for k in one}


def packing_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_stages_take_empty_tables_and_null_ids(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in ([], [(None, None, None, None, None), (None, "a b c d e f", None, None, 1)]):
        docs = spark.createDataFrame(rows, SCHEMA)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.count() == len(rows)


def test_stages_take_repeated_rows_long_texts_and_clashing_columns(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = [(1, "long " * 100_000, "en", "s", 1)] * 2 + [(None, "without an id", "en", "s", 1)] * 3 + [(2, "a text", "en", "s", 1), (2, "an other", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("digest", "score", "_rn", "doubtful", "found", "seat", "leads")})
    kept = corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path))
    assert kept.columns == list(corpus_pipeline.COLUMNS) and kept.count() == 7
    single = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert single.columns == list(corpus_pipeline.COLUMNS) and sorted((r.doc_id or 0, r.text[:4]) for r in single.collect()) == [(0, "with"), (1, "long"), (2, "a te"), (2, "an o")]
    assert corpus_pipeline.redact_secrets(spark, docs, str(tmp_path)).count() == 7
    packed = corpus_pipeline.pack_sequences(spark, docs, str(tmp_path))
    assert packed.where("piece = 0").count() == 7 and packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()


def test_unlike_texts_of_one_id_stay(spark, tmp_path):
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(7, body, "en", "s", 1), (7, "quite another text", "en", "s", 1), (7, "quite another text", "en", "s", 1), (8, f"{body} end", "en", "s", 1), (9, "alone", "en", "s", 1)]
    out = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)).collect()
    assert sorted((r.doc_id, r.text) for r in out) == [(7, "quite another text"), (7, body), (9, "alone")]
