"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding.

BPE's result for a text is the one token sequence whose tokens are each whole
under the merges and whose neighbours are each compatible: merging the two
tokens' bytes gives the two tokens. So a transducer that guesses where tokens
end reads a text from left to right. Determinised, its state holds the
vocabulary-trie node of every token under way, each with the tokens before it
that are not emitted yet. A move by one byte emits what all of these have in
common, so a token comes out as soon as no later byte can change it; what a
state holds back is the lookahead. A token under way began at most the longest
token's bytes ago, so guesses differ in where these last bytes are cut, and
their paths meet before them but for a few tokens (``lookahead`` tells how many
any state met so far holds). At the end, the guess that has no token under way
gives the rest. States and moves are made when a text first needs them and are
dropped together when there are too many.

Decoding takes ids in any chunks. A UTF-8 state machine reads bytes one by one
and holds the bytes of a character that is not yet whole; tokens that take it
from start to start are looked up as texts.

Defined results: a null text is an empty one; an empty text has no tokens, and
its digests are those of the empty string; ids outside of the vocabulary raise
KeyError; bytes that are no UTF-8 decode to U+FFFD, one for each longest start
of a character; null doc_ids are kept, rows with equal doc_ids or texts,
repeated rows too, are rows of their own; texts of any length are read whole;
an empty table gives no rows; only doc_id and text are read, whatever other
columns there are.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .tables import read, small, texts_of
from .words import Memo

#: States that are kept at once.
MOST_STATES = 200_000
#: A guess is dropped early if at most so many tokens can still come of it, and none may follow the one before.
FEW = 2
#: Matches of at most this many bytes are encoded side by side.
SIDE_BY_SIDE = 64


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes one match of the pre-tokenizer pattern at a time."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.trie: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                following = self.trie[node].get(byte)
                if following is None:
                    following = self.trie[node][byte] = len(self.trie)
                    self.trie.append({})
                    self.token_at.append(-1)
                node = following
            self.token_at[node] = rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.below: dict[int, list[int]] = {}
        self.grown: dict[int, tuple[list[bytes], list[bytes]] | None] = {}
        self.kind = np.full(256, -1, np.intp)  # columns of the tables below, given to bytes as they are met
        self.kinds = 0
        self.reset()

    def reset(self) -> None:
        #: The last token emitted, and (trie node, tokens not emitted yet) of each guess; the last guess is at a token's end.
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple[int, tuple]] = []
        self.moves: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        #: Emissions of moves and rests of states as numbers, for the tables; 0 emits nothing.
        self.emitted: dict[tuple[int, ...], int] = {(): 0}
        self.tokens, self.starts, self.counts = array("I"), array("q", [0]), array("q", [0])
        self.rests = array("q")
        self.lookahead = 0
        self.intern((-1, ((0, ()),)))
        self.next = np.full((1024, max(32, self.kinds)), -1, np.int32)
        self.out = np.zeros_like(self.next)

    def intern(self, key: tuple[int, tuple]) -> int:
        number = self.ids.get(key)
        if number is None:
            number = self.ids[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
            self.rests.append(self.emission(key[1][-1][1]))
            self.lookahead = max(self.lookahead, *(len(held) for _, held in key[1]))
        return number

    def emission(self, tokens: tuple[int, ...]) -> int:
        number = self.emitted.get(tokens)
        if number is None:
            number = self.emitted[tokens] = len(self.starts)
            self.starts.append(len(self.tokens))
            self.counts.append(len(tokens))
            self.tokens.extend(tokens)
        return number

    def merged(self, raw: bytes, below: int = 1 << 60) -> list[bytes]:
        """The merges of a rank under below applied one by one: the definition, used once for each token."""
        parts, ranks = [raw[k : k + 1] for k in range(len(raw))], self.ranks
        while len(parts) > 1:
            best, at = min((ranks.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edges(self, token: int) -> tuple[list[bytes], list[bytes]] | None:
        """What the token's first and its last part grow through, from one byte to all of it; None if the merges never make it."""
        known = self.grown.get(token, 0)
        if known == 0:
            raw = self.bytes_of[token]
            known = ([raw], [raw])
            if len(raw) > 1:
                halves = self.merged(raw, token)
                known = None
                if len(halves) == 2 and (left := self.edges(self.ranks[halves[0]])) and (right := self.edges(self.ranks[halves[1]])):
                    known = (left[0] + [raw], right[1] + [raw])
            self.grown[token] = known
        return known

    def compatible(self, a: int, b: int) -> bool:
        """Whether token b may follow a; a = -1: whether b may come first.

        Both tokens grow at their own merges' ranks. It may not follow if at some
        time a merge across the border comes before the next one on either side.
        """
        known = self.pairs.get((a, b))
        if known is None:
            after = self.edges(b)
            known = after is not None
            if known and a >= 0:
                left, right, ranks, i, j = self.edges(a)[1], after[0], self.ranks, 0, 0
                never = 1 << 60
                while True:
                    across = ranks.get(left[i] + right[j], never)
                    grow_a = ranks[left[i + 1]] if i + 1 < len(left) else never
                    grow_b = ranks[right[j + 1]] if j + 1 < len(right) else never
                    if across < grow_a and across <= grow_b and across < never:
                        known = False
                        break
                    if grow_a == grow_b == never:
                        break
                    if grow_a <= grow_b:
                        i += 1
                    else:
                        j += 1
            if len(self.pairs) >= 500_000:
                self.pairs.clear()
            self.pairs[a, b] = known
        return known

    def alive(self, node: int, before: int) -> bool:
        """Whether some token below a node may follow ``before``; not looked into where there are more than FEW."""
        below = self.below.get(node)
        if below is None:
            below, todo = [], [*self.trie[node].values()]
            while todo and len(below) <= FEW:
                at = todo.pop()
                if self.token_at[at] >= 0:
                    below.append(self.token_at[at])
                todo += self.trie[at].values()
            self.below[node] = below
        return len(below) > FEW or any(self.compatible(before, token) for token in below)

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """The state after one more byte, and the tokens that are settled by it."""
        emitted, guesses = self.states[state]
        after, ended = [], None
        for node, held in guesses:
            following = self.trie[node].get(byte)
            if following is None:
                continue
            before = held[-1] if held else emitted
            if self.trie[following] and self.alive(following, before):
                after.append((following, held))
            token = self.token_at[following]
            if token >= 0 and ended is None and self.compatible(before, token):
                ended = (*held, token)
        if ended is None:
            raise ValueError(f"no token covers byte {byte}")
        after.append((0, ended))
        shared = 0
        shortest = min(after, key=lambda x: len(x[1]))[1]
        while shared < len(shortest) and all(held[shared] == shortest[shared] for _, held in after):
            shared += 1
        if shared:
            emitted, after = ended[shared - 1], [(node, held[shared:]) for node, held in after]
        # The last token emitted matters only to a guess that holds none.
        key = (emitted if len(shortest) == shared else -1, tuple(after))
        move = self.moves[state][byte] = (self.intern(key), ended[:shared])
        return move

    def stream(self, raw: Iterable[int]) -> Iterator[int]:
        """Tokens as soon as no later byte can change them."""
        state = 0
        for byte in raw:
            if len(self.states) > MOST_STATES:
                key = self.states[state]
                self.reset()
                state = self.intern(key)
            state, settled = self.moves[state].get(byte) or self._move(state, byte)
            if settled:
                yield from settled
        yield from self.states[state][1][-1][1]

    def encode(self, raw: bytes) -> list[int]:
        """A match's ids; one that is a token as a whole is that token."""
        whole = self.ranks.get(raw)
        return [whole] if whole is not None else list(self.stream(raw))

    def _table(self) -> None:
        """Room for the moves of all states, as dense tables by state and kind of byte."""
        rows, columns = self.next.shape
        if len(self.states) > rows or self.kinds > columns:
            shape = (max(len(self.states), rows * 3 // 2) if len(self.states) > rows else rows, max(self.kinds, columns + 16) if self.kinds > columns else columns)
            for name in ("next", "out"):
                new = np.full(shape, -1, np.int32)
                new[:rows, :columns] = getattr(self, name)
                setattr(self, name, new)

    def encode_many(self, raws: list[bytes]) -> list[bytes]:
        """The ids of each, as bytes of unsigned 32-bit integers; all are read side by side, a byte at a time."""
        if len(self.states) > MOST_STATES:
            self.reset()
        out: list[bytes] = [b""] * len(raws)
        order = sorted(range(len(raws)), key=lambda k: -len(raws[k]))
        for k in order:
            if len(raws[k]) <= SIDE_BY_SIDE:
                break
            out[k] = array("I", self.encode(raws[k])).tobytes()
        order = [k for k in order if 0 < len(raws[k]) <= SIDE_BY_SIDE]
        for at in range(0, len(order), 20_000):
            self._side_by_side(raws, order[at : at + 20_000], out)
        return out

    def _side_by_side(self, raws: list[bytes], order: list[int], out: list[bytes]) -> None:
        sizes = np.array([len(raws[k]) for k in order])
        flat = np.frombuffer(b"".join([raws[k] for k in order]), np.uint8)
        for byte in np.unique(flat).tolist():
            if self.kind[byte] < 0:
                self.kind[byte] = self.kinds
                self.kinds += 1
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        state = np.zeros(len(order), np.int32)
        emitted = np.zeros((len(order), int(sizes[0]) + 1), np.int32)
        for i in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -i, "left"))  # the longest come first
            byte = flat[starts[:n] + i]
            kind = self.kind[byte]
            self._table()
            to = self.next[state[:n], kind]
            for code in np.unique(state[:n][to < 0].astype(np.int64) << 8 | byte[to < 0]).tolist():
                number, settled = self._move(code >> 8, code & 255)
                self._table()
                self.next[code >> 8, self.kind[code & 255]], self.out[code >> 8, self.kind[code & 255]] = number, self.emission(settled)
            emitted[:n, i] = self.out[state[:n], kind]
            state[:n] = self.next[state[:n], kind]
        emitted[:, -1] = np.array(self.rests)[state]
        # What was emitted, match after match, as tokens.
        row, _ = np.nonzero(emitted)
        number = emitted[emitted > 0]
        counts = np.array(self.counts)[number]
        ends = np.cumsum(counts)
        where = np.repeat(np.array(self.starts)[number] - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)
        packed = np.array(self.tokens, np.uint32)[where].astype("<u4").tobytes()
        stop = 0
        for k, count in zip(order, (np.bincount(row, counts, len(order)).astype(np.int64) * 4).tolist()):
            out[k] = packed[stop : stop + count]
            stop += count
        for k in order:  # a match that is a token as a whole is that token
            whole = self.ranks.get(raws[k])
            if whole is not None and len(out[k]) != 4:
                out[k] = array("I", [whole]).tobytes()


#: What may follow a lead byte: how many bytes, and the first one's range; the others are 0x80 to 0xBF.
LEADS = {
    **{b: (1, 0x80, 0xBF) for b in range(0xC2, 0xE0)}, 0xE0: (2, 0xA0, 0xBF), **{b: (2, 0x80, 0xBF) for b in range(0xE1, 0xF0)}, 0xED: (2, 0x80, 0x9F),
    0xF0: (3, 0x90, 0xBF), **{b: (3, 0x80, 0xBF) for b in range(0xF1, 0xF4)}, 0xF4: (3, 0x80, 0x8F),
}


class Utf8Stream:
    """A state machine over bytes; ``push`` gives the characters that are whole by now."""

    def __init__(self) -> None:
        #: Bytes that the character under way still needs, the next one's range, and the character's bits so far.
        self.need, self.low, self.high, self.bits = 0, 0, 0, 0

    def push(self, raw: bytes) -> str:
        need, low, high, bits, out = self.need, self.low, self.high, self.bits, []
        for byte in raw:
            if need:
                if low <= byte <= high:
                    bits, need, low, high = bits << 6 | byte & 0x3F, need - 1, 0x80, 0xBF
                    if not need:
                        out.append(chr(bits))
                    continue
                out.append("\ufffd")
                need = 0
            if byte < 0x80:
                out.append(chr(byte))
            elif byte in LEADS:
                need, low, high = LEADS[byte]
                bits = byte & (0x3F >> need)
            else:
                out.append("\ufffd")
        self.need, self.low, self.high, self.bits = need, low, high, bits
        return "".join(out)

    def end(self) -> str:
        rest, self.need = "\ufffd" * bool(self.need), 0
        return rest


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        self.fst = Transducer(load_ranks(path))
        self.find = regex.compile(pattern).findall
        self.table = [self.fst.bytes_of.get(k) for k in range(max(self.fst.bytes_of) + 1)]
        self.texts: list[str | None] = []
        for raw in self.table:
            try:
                self.texts.append(raw.decode() if raw is not None else None)
            except UnicodeDecodeError:  # the token does not take the machine from start to start
                self.texts.append(None)
        self.decimal = [str(k) for k in range(len(self.table))]
        self.memo = Memo(self._pieces)

    def _pieces(self, texts: list[str]) -> list[bytes]:
        """Ids of strings that are encoded apart."""
        matches, owner = [], []
        for k, text in enumerate(texts):
            found = self.find(text)
            matches += found
            owner.append(len(found))
        ids = self.fst.encode_many([m.encode() for m in matches])
        at, out = 0, []
        for n in owner:
            out.append(ids[at] if n == 1 else b"".join(ids[at : at + n]))
            at += n
        return out

    def encode_texts(self, texts: list[str]) -> list[array]:
        """Ids of each text, as unsigned 32-bit integers."""
        return [array("I", x) for x in self.memo.encode(texts)]

    def encode(self, text: str) -> array:
        return self.encode_texts([text])[0]

    def line(self, ids: Iterable[int]) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        try:
            return b"".join([self.table[k if k >= 0 else len(self.table)] for k in ids])
        except (IndexError, TypeError) as e:
            raise KeyError("an id is not in the vocabulary") from e

    def decode_stream(self, chunks: Iterable[Sequence[int]]) -> Iterator[str]:
        stream, texts, size = Utf8Stream(), self.texts, len(self.texts)
        for ids in chunks:
            if len(ids) and not 0 <= min(ids) <= max(ids) < size:
                raise KeyError("an id is not in the vocabulary")
            found = list(map(texts.__getitem__, ids))
            if None in found or stream.need:
                found = [stream.push(self.decode_bytes((k,))) if text is None or stream.need else text for k, text in zip(ids, found)]
            yield "".join(found)
        yield stream.end()


_LOADED: dict[tuple[str, str], ByteBpe] = {}
#: Ids that are decoded at a time.
DECODE_IDS = 65_536


def codec(path: str, pattern: str) -> ByteBpe:
    """One per worker process, with all that it has learned so far."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe(path, pattern)
    return _LOADED[path, pattern]


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each whole text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in small(batches):
            ids = pa.array([x.tolist() for x in bpe.encode_texts(texts_of(b))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b["doc_id"], ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids decode to the empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in small(batches):
            texts = ["".join(bpe.decode_stream(x[k : k + DECODE_IDS] for k in range(0, len(x), DECODE_IDS))) for x in (y or [] for y in b["ids"].to_pylist())]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of each text's ids and of what the ids decode to, made in one pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for b in small(batches):
            counts, encoded, decoded = [], [], []
            for ids in bpe.encode_texts(texts_of(b)):
                digest = hashlib.sha256()
                for part in bpe.decode_stream(ids[k : k + DECODE_IDS] for k in range(0, len(ids), DECODE_IDS)):
                    digest.update(part.encode())
                counts.append(len(ids))
                encoded.append(hashlib.sha256(bpe.line(ids).encode()).hexdigest())
                decoded.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
