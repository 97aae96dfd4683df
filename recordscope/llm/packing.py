"""Best-fit packing of tokenised documents, with bounds that certify the result.

Each document's ids (its tokens and one end id) become pieces of at most the
capacity; only longer documents are cut, and then only the first piece may be
shorter. Pieces are dealt to partitions by their place in the table of pieces,
not by their keys, so no key is hot. Each partition is packed by best-fit
decreasing and gets a lower bound from dual-feasible functions. A partition
whose bin count meets its bound is certified: no packing of its documents has
fewer bins, and it keeps them.

Partitions are then joined, FAN at a time, into larger ones, whose bin counts
and sums of dual-feasible functions are those of their parts together. A joint
partition is certified in the same way. One with a gap lets its parts exchange
documents: those of each part's emptiest bins meet, best-fit decreasing runs
again on them, and its result is taken if it needs fewer bins. So it goes on to
the one partition of all documents, whose gap is the distance of the whole
result from the bound. A part hands on the emptiest of the bins that it last
packed, whatever their fill, up to about HANDED pieces, which bounds a task.

Defined results: a null text is an empty one and makes one piece, the end id;
rows with equal doc_id, or null ones, are packed as documents of their own,
repeated rows too; texts are encoded whole, however long; ties in length are
broken by the place in the table; an empty table gives no rows; only doc_id
and text are read, whatever other columns there are.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize, union_all
from .tables import read, small, texts_of
from .words import Memo

#: Pieces of a first partition, as a mean; partitions of the next one; pieces that a part hands on to it, or one bin.
GROUP_PIECES, FAN, HANDED = 32_000, 64, 4_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Bits of a sequence's number for its bin and for its partition.
BIN_BITS, HOME_BITS = 20, 38
#: Dual-feasible functions of each family.
DFF_STEPS = 64

#: Words that a worker remembers.
WORDS_KEPT = 400_000
#: Words that are given to the library as one string.
JOINED = 500

Encode = Callable[[list[str]], list[bytes]]


def vocabulary_ranks(path: str) -> dict[bytes, int]:
    """The byte strings of a tokenizers file's vocabulary, whose ids are the order of its merges."""
    # This format writes a byte that is no visible character as the next free character from 256 on.
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    special = {x["content"] for x in file["added_tokens"]}
    return {bytes(byte_of[c] for c in token): k for token, k in file["model"]["vocab"].items() if token not in special}


def library_encoder(path: str, end_id: int) -> Encode:
    """Encodes whole texts to the ids of a tokenizers file and the end id, as little-endian unsigned 32-bit.

    tiktoken's core does the merges, at a fraction of the time; tests hold the
    ids against those of the tokenizers library.
    """
    import public_tokenizers
    import tiktoken

    ranks = vocabulary_ranks(path)
    library = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    starts = np.zeros(max(ranks.values()) + 1, bool)
    starts[[k for token, k in ranks.items() if token.startswith(b" ")]] = True
    lone = re.compile(r" \S+").fullmatch

    def make(texts: list[str]) -> list[bytes]:
        """Words with one space, before them, are encoded many at a time: their first tokens are those that start with a space."""
        out: list[bytes] = [b""] * len(texts)
        words = [k for k, t in enumerate(texts) if lone(t)]
        whole = sorted(set(range(len(texts))) - set(words))
        for at in range(0, len(words), JOINED):
            part = words[at : at + JOINED]
            ids = library.encode_to_numpy("".join([texts[k] for k in part]), disallowed_special=())
            cuts = np.flatnonzero(starts[ids])
            if len(cuts) != len(part):
                whole += part
                continue
            raw, bounds = ids.tobytes(), [*(cuts * 4).tolist(), len(ids) * 4]
            for k, a, b in zip(part, bounds, bounds[1:]):
                out[k] = raw[a:b]
        for k in whole:
            out[k] = library.encode_to_numpy(texts[k], disallowed_special=()).tobytes()
        return out

    memo = Memo(make, WORDS_KEPT)
    end = array("I", [end_id]).tobytes()
    return lambda texts: [x + end for x in memo.encode(texts)]


def file_encoder(path: str, end_id: int) -> Encode:
    """library_encoder between the file's added tokens, which get their own ids wherever a text has them, as by the library's defaults."""
    encode = library_encoder(path, end_id)
    with open(path, encoding="utf-8") as f:
        added = {x["content"]: array("I", [x["id"]]).tobytes() for x in json.load(f)["added_tokens"]}
    if not added:
        return encode
    at = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
    end = array("I", [end_id]).tobytes()

    def run(texts: list[str]) -> list[bytes]:
        split = [at.split(t) for t in texts]  # added tokens are at the odd places
        between = iter(encode([x for parts in split for x in parts[::2]]))
        return [b"".join(added[x] if k % 2 else next(between)[: -len(end)] for k, x in enumerate(parts)) + end for parts in split]

    return run


_ENCODERS: dict[tuple[str, int], Encode] = {}


def encoder(path: str, end_id: int) -> Encode:
    """One file_encoder per worker process, with all words it remembers."""
    if (path, end_id) not in _ENCODERS:
        _ENCODERS[path, end_id] = file_encoder(path, end_id)
    return _ENCODERS[path, end_id]


def cut(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of each piece."""
    total = len(ids) // 4
    at, piece = 0, 0
    while at < total:
        length = total % capacity or capacity if piece == 0 else capacity
        yield piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])
        at, piece = at + length, piece + 1


def tokenise(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of each whole text; seat numbers the rows of the table that this is written to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, seat = encoder(path, end_id), TaskContext.get().partitionId() << 33
        for b in small(batches):
            rows = [(k, *x) for k, ids in enumerate(encode(texts_of(b))) for x in cut(ids, capacity)]
            owner, *columns = list(zip(*rows))
            typed = [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            seats = pa.array(np.arange(seat, seat + len(rows)))
            seat += len(rows)
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(pa.array(owner, pa.int64())), *typed, seats], ["doc_id", "piece", "start", "length", "ids_crc32", "seat"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{PIECES}, seat long")


def feasible_functions(capacity: int) -> list[tuple[int, int]]:
    """(family, parameter) of the dual-feasible functions in use: 0 for f_e with e, 1 for u_k with k."""
    return [(0, e) for e in sorted({1, *range(1, capacity // 2 + 1, max(1, capacity // (2 * DFF_STEPS)))})] + [(1, k) for k in range(1, DFF_STEPS)]


def feasible_sums(lengths: np.ndarray, capacity: int) -> list[int]:
    """The sum of each dual-feasible function over the lengths, in 1 / scale of a capacity; sums of parts add up."""
    sizes, counts = np.unique(lengths, return_counts=True)
    out = []
    # f_e: above C - e counts as C, below e as 0. u_k: (k + 1) s / C as a whole number stays, else it is rounded down, over k.
    for family, x in feasible_functions(capacity):
        if family == 0:
            value = np.where(sizes > capacity - x, capacity, np.where(sizes < x, 0, sizes))
        else:
            scaled = (x + 1) * sizes
            value = np.where(scaled % capacity == 0, sizes * x, scaled // capacity * capacity)  # times x * capacity / capacity
        out.append(int((value * counts).sum()))
    return out


def bound_of(sums: list[int], capacity: int) -> int:
    """The least bins that these sums allow."""
    return max(-(-s // (capacity if family == 0 else x * capacity)) for s, (family, x) in zip(sums, feasible_functions(capacity)))


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest of the bounds by total size and two families of dual-feasible functions."""
    return bound_of(feasible_sums(lengths, capacity), capacity) if len(lengths) else 0


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each length and its offset there; lengths come in their order."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room that is left
    open_rooms = 0  # bit r: some bin has room r
    made = 0
    order = np.argsort(-lengths, kind="stable")
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        fit = open_rooms >> n
        if fit:
            r = n + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            b, r, made = made, capacity, made + 1
        bins[k], offsets[k] = b, capacity - r
        left = r - n
        if left:
            if not room[left]:
                open_rooms |= 1 << left
            room[left].append(b)
    return bins, offsets


PACKED = f"{PIECES}, seat long, dealt long, turn int, home long, bin long, offset long, handed boolean, bins long, sums array<long>"


def handed_on(bins: np.ndarray, fill: np.ndarray, most: int = HANDED) -> np.ndarray:
    """Whether each piece lies in one of the emptiest bins: as many as hold ``most`` pieces, at least one."""
    counts = np.bincount(bins, minlength=len(fill))
    order = np.argsort(fill, kind="stable")
    upto = np.cumsum(counts[order])
    chosen = np.zeros(len(fill), bool)
    chosen[order[: max(1, int(np.searchsorted(upto, most, "right")))]] = True
    return chosen[bins]


def _pack(capacity: int, turn: int, most: int) -> Callable[[pa.Table], pa.Table]:
    """Packs a partition. Bins that it had before (turn, home, bin) stay where its gap, in the column bins, is 0, or unless fewer will do.

    Gives back the pieces, and in the first row's bins the bins that it saved, or in
    turn 0 those that it has, with the sums of the dual-feasible functions.
    """
    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by([("seat", "ascending")])
        lengths, dealt = g["length"].to_numpy(), g["dealt"].to_numpy()
        own = [g[c].to_numpy() for c in ("turn", "home", "bin")]
        _, old = np.unique(np.stack(own), axis=1, return_inverse=True)
        old = old.ravel()
        had = int(old.max()) + 1 if turn else 0
        bins, saved = old, 0
        if not turn or g["bins"][0].as_py() > 0:
            new, offsets = best_fit_decreasing(lengths, capacity)
            need = int(new.max()) + 1
            if not turn or need < had:
                bins, saved = new, had - need if turn else need
                for name, values in {"turn": np.full(len(g), turn, np.int32), "home": dealt, "bin": bins, "offset": offsets}.items():
                    g = g.set_column(g.schema.get_field_index(name), name, pa.array(values))
        first = np.arange(len(g)) == 0
        fill = np.bincount(bins, lengths)
        sums = [feasible_sums(lengths, capacity)] + [None] * (len(g) - 1) if not turn else [None] * len(g)
        for name, values in {"handed": pa.array(handed_on(bins, fill, most)), "bins": pa.array(np.where(first, saved, 0)), "sums": pa.array(sums, pa.list_(pa.int64()))}.items():
            g = g.set_column(g.schema.get_field_index(name), name, values)
        return g

    return run


def pack(pieces: DataFrame, capacity: int, group_pieces: int = GROUP_PIECES, fan: int = FAN, handed: int = HANDED) -> DataFrame:
    """Adds sequence_id, offset and gap to pieces, a written table with a number, seat, of each row.

    gap: bins of the whole result above its lower bound; 0 certifies that no
    packing of these documents has fewer.
    """
    groups = max(1, -(-pieces.count() // group_pieces))
    zero = {"turn": F.lit(0), "bins": F.lit(0).cast("long"), "handed": F.lit(False), "sums": F.lit(None).cast("array<long>")} | {c: F.lit(0).cast("long") for c in ("home", "bin", "offset")}
    dealt = pieces.withColumn("dealt", F.pmod(F.xxhash64("seat"), F.lit(groups))).withColumns(zero)
    settled, certificates, turn, gap = [], None, 0, 0
    scales = F.array(*[F.lit(capacity if family == 0 else x * capacity).cast("long") for family, x in feasible_functions(capacity)])
    while True:
        packed = materialize(dealt.select(*[f.split()[0] for f in PACKED.split(", ")]).groupBy("dealt").applyInArrow(_pack(capacity, turn, handed), PACKED), "packed")
        told = packed.groupBy("dealt").agg(F.sum("bins").alias("bins"), F.first("sums", ignorenulls=True).alias("sums"))
        if turn:
            told = certificates.join(told.select("dealt", F.col("bins").alias("saved")), "dealt", "left").select("dealt", (F.col("bins") - F.coalesce("saved", F.lit(0))).alias("bins"), "sums")
        # The next partitions: their parts' bins, and their bounds from the parts' sums.
        joint = told.withColumn("dealt", F.floor(F.col("dealt") / fan)).select("dealt", "bins", F.posexplode("sums").alias("at", "sum")).groupBy("dealt", "at").agg(F.sum("bins").alias("bins"), F.sum("sum").alias("sum"))
        joint = joint.groupBy("dealt").agg(F.first("bins").alias("bins"), F.transform(F.array_sort(F.collect_list(F.struct("at", "sum"))), lambda x: x["sum"]).alias("sums"))
        certificates = materialize(joint, "certificates")
        bounds = F.array_max(F.transform(F.arrays_zip(F.col("sums").alias("sum"), scales.alias("scale")), lambda x: F.ceil(x["sum"] / x["scale"]).cast("long")))
        gaps = certificates.select("dealt", (F.col("bins") - bounds).alias("bins"))
        if groups == 1:
            last = gaps.first()
            gap = last["bins"] if last else 0
            settled.append(packed)
            break
        settled.append(packed.where("NOT handed"))
        groups, turn = -(-groups // fan), turn + 1
        dealt = packed.where("handed").withColumn("dealt", F.floor(F.col("dealt") / fan)).drop("bins").join(gaps, "dealt")
    number = F.shiftleft(F.col("turn").cast("long"), HOME_BITS + BIN_BITS - 5) + F.shiftleft("home", BIN_BITS) + F.col("bin")
    out = [x.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset", F.lit(gap).cast("long").alias("gap")) for x in settled]
    return union_all(out)


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Whole documents as pieces in sequences of at most ``capacity`` tokens."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return pack(materialize(tokenise(docs, path, end_id, capacity), "pieces"), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"))
