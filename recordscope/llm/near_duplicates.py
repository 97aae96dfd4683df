"""N-gram Jaccard join by MinHash banding, verified on full n-gram sets.

Rows with equal texts form a class, represented by its smallest id. A class's
signature is the minimum of each of bands x rows hash functions over its word
n-grams; numbers of bands and rows are chosen so that a pair at the threshold
shares a band with the target recall at the least number of hashes. Classes
are shuffled on their bands' hashes; in each bucket, pairs that share no
earlier band are compared on their full n-gram sets, so every candidate pair
is compared once. No pair leaves its task: a bucket gives each member its
number of linked rows and one edge of a shallow tree for each linked cluster.

Buckets above BLOCK members are cut into blocks, and each pair of blocks is a
task of its own. Of buckets with the same members, only that of the first band
is read. A class's text, one row of it, travels to the buckets once per bucket
that is read.

Words are lower-cased runs between white space; a text of fewer than n words
is one n-gram of all its words; one without words links to equal texts only.

Defined results: a null text is an empty one; a class whose rows all have null
keys has a null class_id, and comes after the others when a cluster is named;
rows with equal keys are rows of their own, also if their texts differ, and a
class with the key of another is a class of its own; texts are read whole,
however long; a similarity of just the threshold links; an empty table gives
no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import min_labels
from ..operators.skew import hot_keys, maybe_member, salted_lookup
from ..storage import materialize
from .tables import read, small

#: Words of an n-gram, least similarity, and recall of a pair at that similarity.
NGRAM, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Members of a bucket's block; two blocks meet in a task.
BLOCK = 400
#: Children of a node in the trees of linked clusters.
FAN = 32
#: Columns of the incidence matrix that are multiplied at a time.
COLUMNS = 4096


def bands_and_rows(threshold: float, recall: float, most: int = 256) -> tuple[int, int]:
    """The (bands, rows) that meet the recall at the threshold and let through least at half of it, within ``most`` hashes."""
    fits = []
    for rows in range(1, 17):
        bands = 1
        while 1 - (1 - threshold**rows) ** bands < recall and bands * rows <= most:
            bands += 1
        if bands * rows <= most:
            fits.append(((1 - (1 - (threshold / 2) ** rows) ** bands) + bands * rows / 2000, bands, rows))
    return min(fits)[1:]


BANDS, ROWS = bands_and_rows(THRESHOLD, RECALL)
_GRAMS = np.random.default_rng(20240229).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
_ODD, _ADD = _GRAMS[0] | np.uint64(1), _GRAMS[1]


def grams(text: str, n: int = NGRAM) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = [" ".join(words)] if len(words) < n else map(" ".join, zip(*(words[k:] for k in range(n))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter(map(digest, joined), np.uint64))


def band_hashes(hashes: np.ndarray) -> np.ndarray:
    """BANDS hashes of the minima of ROWS functions each."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512, None] * _ODD + _ADD
        part ^= part >> np.uint64(31)
        low = np.minimum(low, part.min(axis=0))
    out = np.zeros(BANDS, np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches):
        known: dict[str, list[int] | None] = {}  # copies often come together
        bands = []
        for text in b["text"].to_pylist():
            if text not in known:
                hashes = grams(text)
                known[text] = band_hashes(hashes).tolist() if len(hashes) else None
            bands.append(known[text])
        yield pa.RecordBatch.from_arrays([b["id"], b["digest"], pa.array(bands, pa.list_(pa.int64()))], ["id", "digest", "bands"])


def sets_linked(sets: list[np.ndarray], wanted: np.ndarray, threshold: float) -> np.ndarray:
    """Of the pairs in wanted (a boolean matrix, upper triangle), those whose Jaccard similarity is at least the threshold."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    small, large = np.minimum(sizes[:, None], sizes), np.maximum(sizes[:, None], sizes)
    wanted = wanted & (small >= threshold * large - 1e-9)
    linked = np.zeros((n, n), bool)
    rows, columns = np.nonzero(wanted)
    if len(rows) <= 4 * n:
        for i, j in zip(rows.tolist(), columns.tolist()):
            shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            linked[i, j] = shared >= threshold * (sizes[i] + sizes[j] - shared) - 1e-9
        return linked
    live = np.flatnonzero(wanted.any(0) | wanted.any(1))
    owner = np.repeat(np.arange(len(live)), sizes[live])
    _, column, count = np.unique(np.concatenate([sets[k] for k in live]), return_inverse=True, return_counts=True)
    often = count[column] > 1
    new = np.cumsum(count > 1) - 1
    owner, column = owner[often], new[column[often]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((len(live), len(live)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, (at, at + COLUMNS))
        part = np.zeros((len(live), COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        shared += part @ part.T
    both = sizes[live][:, None] + sizes[live] - shared
    linked[np.ix_(live, live)] = shared >= threshold * both - 1e-9
    return linked & wanted


def _compare(band: int, left: int, right: int, ids: list[int], copies: np.ndarray, bands: np.ndarray, blocks: np.ndarray, texts: list[str]) -> tuple[list[int], list[int], list[int]]:
    """(id, linked rows, parent in a tree of linked members) of the members with links."""
    n = len(ids)
    wanted = np.triu(np.ones((n, n), bool), 1)
    if left != right:
        wanted &= blocks[:, None] != blocks
    for earlier in range(band):
        wanted &= bands[:, earlier][:, None] != bands[:, earlier]
    if not wanted.any():
        return [], [], []
    sets = [grams(t) for t in texts]
    linked = sets_linked(sets, wanted, THRESHOLD)
    linked |= linked.T
    counts = linked @ copies
    out_ids, out_counts, parents = [], [], []
    seen = np.zeros(n, bool)
    for start in np.flatnonzero(counts):
        if seen[start]:
            continue
        member = np.zeros(n, bool)
        member[start] = True
        edge = member.copy()
        while edge.any():
            edge = linked[edge].any(0) & ~member
            member |= edge
        seen |= member
        own = np.flatnonzero(member)
        for k, at in enumerate(own):
            out_ids.append(ids[at])
            out_counts.append(int(counts[at]))
            parents.append(ids[own[(k - 1) // FAN if k else 0]])
    return out_ids, out_counts, parents


KEY = ("band", "bucket", "left", "right")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads rows sorted by KEY, one bucket block pair after the other."""
    def result(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        rows.sort()
        ids, copies, bands, blocks, texts = zip(*rows)
        found = _compare(key[0], key[2], key[3], list(ids), np.array(copies), np.array(bands), np.array(blocks), list(texts))
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["own", "n", "parent"])

    current, rows = None, []
    for b in batches:
        columns = [b[c].to_pylist() for c in (*KEY, "own", "copies", "bands", "block", "content")]
        for *key, own, copies, bands, block, text in zip(*columns):
            if key != current:
                if len(rows) > 1:
                    yield result(tuple(current), rows)
                current, rows = key, []
            rows.append((own, copies, bands, block, text))
    if len(rows) > 1:
        yield result(tuple(current), rows)


def _rows(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text, digest): digest is the text's SHA-256."""
    content = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(key).cast("long").alias("id"), content.alias("text"), F.unhex(F.sha2(content, 256)).alias("digest"))


def linked_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(digest, class_id, cluster_id, copies, linked, leads) of each class: its rows, the rows of other classes that it links to, and whether it stands for its cluster."""
    spark = docs.sparkSession
    rows = _rows(docs, key, text)
    signed = rows.mapInArrow(_sign, "id long, digest binary, bands array<long>")
    classes = materialize(signed.groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"), F.first("bands").alias("bands")), "classes")
    parts = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))

    # A class goes by its smallest id, or by its place in order if classes share one or have none; the smallest of a cluster stands for it either way.
    shared = not classes.groupBy("class_id").count().where("count > 1 OR class_id IS NULL").isEmpty()
    if shared:
        classes = materialize(classes.orderBy(F.asc_nulls_last("class_id"), "digest").withColumn("own", F.monotonically_increasing_id()), "classes")
    else:
        classes = classes.withColumn("own", F.col("class_id"))

    # Buckets, without those whose members are those of an earlier band's bucket.
    spread = classes.where(F.col("bands").isNotNull()).select("own", F.posexplode("bands").alias("band", "hash")).select("own", F.xxhash64("band", "hash").alias("bucket"), F.col("band").cast("short").alias("band"))
    mixed = F.xxhash64("own")
    buckets = spread.groupBy("bucket").agg(F.count("*").alias("members"), F.bit_xor(mixed).alias("x"), F.min("band").alias("band")).where("members > 1")
    buckets = buckets.groupBy("members", "x").agg(F.min(F.struct("band", "bucket")).alias("b")).select("b.bucket", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), "members")
    buckets = materialize(buckets, "buckets")
    hot = hot_keys(buckets, "bucket", "members", classes.count())
    members = salted_lookup(maybe_member(spread, "bucket", buckets, "kept").where("kept").drop("kept"), buckets.select("bucket", "blocks"), "bucket", hot, mixed)
    block = F.pmod(F.xxhash64("own", F.lit("block")), F.col("blocks")).cast("int")
    members = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("band", "bucket", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "own")

    # Texts go along once per bucket, from one row of each class.
    held = members.select("own").distinct().join(classes, "own").select("own", "class_id", "digest", "copies", "bands")
    held = materialize(held, "held")
    texts = maybe_member(rows.select(F.col("id").alias("class_id"), "digest", F.col("text").alias("content")), "class_id", held, "held").where("held")
    texts = texts.groupBy("digest").agg(F.first("content").alias("content")).join(held.drop("class_id"), "digest").drop("digest")
    dealt = members.join(texts, "own").repartition(parts, *KEY).sortWithinPartitions(*KEY)
    verified = materialize(dealt.select(*KEY, "own", "copies", "bands", "block", "content").mapInArrow(_verify, "own long, n long, parent long"), "verified")

    counts = verified.groupBy("own").agg(F.sum("n").alias("linked"))
    clusters = min_labels(verified.where("own <> parent").select(F.col("own").alias("src"), F.col("parent").alias("dst")), "src", "dst")
    known = classes.select("own", "digest", "class_id", "copies").join(counts, "own", "left").join(clusters.select(F.col("node").alias("own"), "label"), "own", "left")
    known = known.select("own", "digest", "class_id", "copies", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("label", "own").alias("label"))
    if shared:
        sizes = materialize(clusters.groupBy("label").count(), "sizes")
        names = classes.select(F.col("own").alias("label"), F.col("class_id").alias("cluster_id"))
        known = salted_lookup(known, names, "label", hot_keys(sizes, "label", "count", classes.count()), mixed)
    else:
        known = known.withColumn("cluster_id", F.col("label"))
    return known.select("digest", "class_id", "cluster_id", "copies", "linked", (F.col("own") == F.col("label")).alias("leads"))


def jaccard_links(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, cluster_id, n_copies, n_links) of every row.

    class_id: the smallest id with an equal text; cluster_id: the smallest id
    that links lead to; n_copies: rows of the class; n_links: other rows with
    an equal text or a similarity at or above the threshold.
    """
    known = materialize(linked_classes(docs, key, text).drop("leads"), "linked")
    total = known.agg(F.sum("copies")).first()[0] or 0
    out = salted_lookup(_rows(docs, key, text).select("id", "digest"), known, "digest", hot_keys(known, "digest", "copies", total), F.xxhash64(F.monotonically_increasing_id()))
    return out.select(F.col("id").alias(key), "class_id", "cluster_id", F.col("copies").alias("n_copies"), (F.col("linked") + F.col("copies") - 1).alias("n_links"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(read(spark, sf_dir, "documents"))
