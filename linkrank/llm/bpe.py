"""Byte-level BPE: a lazily determinised finite-state transducer encodes, an incremental UTF-8 machine decodes (operator 8).

Two tokens are *neighbours* if merging their joined bytes gives the two tokens again. A sequence of tokens is the
encoding of its bytes just if all its pairs are neighbours, so the prefixes of an input have encodings that extend one
another: a non-deterministic transducer reads a byte, moves down the vocabulary's byte trie, and where it stands at a
token that is a neighbour of the last one may finish it. Determinising gives states of a few threads, each with a trie
node and the tokens that it has not shared with the others yet; tokens go out as soon as all threads agree, which is
after bounded lookahead. States are made when first reached and kept, up to a bound.

Pieces matched by the split pattern are encoded separately; a piece that is a token is that token.

Edge cases: null texts count as empty and have no tokens; texts of any length are read whole; special tokens' strings
are ordinary text; of equal ranks none occurs twice, and where merges tie the leftmost goes first; repeated rows each
give a row; an empty table gives an empty result; a column of the name of the result is replaced, all others stay.
Decoding bytes that are not UTF-8 gives U+FFFD as Python's "replace" does.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import resident, text_batches

#: Bounds of what a Python worker keeps: transducer states, neighbour tests, and encoded pieces.
MAX_STATES, MAX_PAIRS, MAX_PIECES = 300_000, 400_000, 400_000

# Split patterns for which ASCII texts have a form without character tables.
PLAIN_FORM = {
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""":
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+""",
}


def read_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class _State:
    __slots__ = ("threads", "moves")

    def __init__(self, threads):
        self.threads = threads  # ((last finished token or -1, trie node), ...), the node of a thread that begins a token is 0
        self.moves: dict[int, tuple[_State, int]] = {}  # byte: the next state, and the token that ends here


class Transducer:
    #: Bytes after which tokens that no thread can change any more are sent.
    SEND = 256

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.length = [len(self.bytes_of.get(i, b"")) for i in range(max(ranks.values()) + 1)]
        # the trie: child[node * 256 + byte]; node 0 is the root; token_at[node] or -1; depth[node] bytes from the root
        self.child: dict[int, int] = {}
        self.token_at, self.depth = [-1], [0]
        for token, rank in ranks.items():
            node = 0
            for x in token:
                node = self.child.setdefault(node << 8 | x, len(self.token_at))
                if node == len(self.token_at):
                    self.token_at.append(-1)
                    self.depth.append(0)
            self.token_at[node], self.depth[node] = rank, len(token)
        self.inner = {key >> 8 for key in self.child}  # nodes that go on
        for key, node in self.child.items():  # parents come before their children
            self.depth[node] = self.depth[key >> 8] + 1
        self.pairs: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.states: dict[tuple, _State] = {}
        self.start = self._state(((-1, 0),))

    def _state(self, threads: tuple) -> _State:
        out = self.states.get(threads)
        if out is None:
            out = self.states[threads] = _State(threads)
        return out

    def stays(self, raw: bytes, at: int) -> bool:
        """Whether plain merging of ``raw`` ends with the two parts that meet at byte ``at`` (0: with one part).

        Plain merging: of adjacent parts that join to a token, the lowest rank first, the leftmost of equals.
        """
        rank, none = self.ranks.get, len(self.token_at)
        parts = [raw[i : i + 1] for i in range(len(raw))]
        ranks = [rank(raw[i : i + 2], none) for i in range(len(raw) - 1)]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            if i + 1 == at:
                return False
            if i + 1 < at:
                at -= 1
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
        return len(parts) == (2 if at else 1)

    def neighbours(self, a: int, b: int) -> bool:
        """Whether b may follow a (-1: begin) in an encoding."""
        own = self.whole.get(b)
        if own is None:
            own = self.whole[b] = self.stays(self.bytes_of[b], 0)
        if a < 0 or not own:
            return own
        found = self.pairs.get(a << 32 | b)
        if found is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            found = self.pairs[a << 32 | b] = self.stays(self.bytes_of[a] + self.bytes_of[b], len(self.bytes_of[a]))
        return found

    def _move(self, state: _State, byte: int) -> tuple[_State, int]:
        child, inner, token_at = self.child.get, self.inner, self.token_at
        live, ended = [], -1
        for last, node in state.threads:
            to = child(node << 8 | byte)
            if to is None:
                continue
            if to in inner:
                live.append((last, to))
            # just one thread can end a token here, as what was read has one encoding
            if ended < 0 and token_at[to] >= 0 and self.neighbours(last, token_at[to]):
                ended = token_at[to]
        live.append((ended, 0))
        if len(self.states) >= MAX_STATES:
            self._reset()
        return self._state(tuple(live)), ended

    def encode(self, raw: bytes) -> list[int]:
        """The tokens of one piece."""
        state, ends, sent, base = self.start, [], [], 0
        for byte in raw:
            move = state.moves.get(byte)
            if move is None:
                move = state.moves[byte] = self._move(state, byte)
            state, token = move
            ends.append(token)
            if len(ends) >= self.SEND and len(ends) % self.SEND == 0:
                fixed, done = self._fixed(state, ends)
                sent += fixed
                if done:
                    del ends[:done]
        return sent + self._back(ends, len(ends))

    def _back(self, ends: list[int], at: int) -> list[int]:
        """Tokens of what was read up to ``at``, from the last to the first and turned."""
        out, length = [], self.length
        while at > 0:
            out.append(ends[at - 1])
            at -= length[ends[at - 1]]
        out.reverse()
        return out

    def _fixed(self, state: _State, ends: list[int]) -> tuple[list[int], int]:
        """Tokens that all threads share, and their bytes: no further input can change them."""
        paths = [self._back(ends, len(ends) - self.depth[node]) for _, node in state.threads]
        shared = 0
        while all(len(p) > shared and p[shared] == paths[0][shared] for p in paths):
            shared += 1
        return paths[0][:shared], sum(self.length[t] for t in paths[0][:shared])


class Utf8Stream:
    """Incremental decoding: text goes out as soon as its bytes are whole."""

    def __init__(self):
        self.held = b""

    @staticmethod
    def incomplete(tail: bytes) -> int:
        """How many bytes at the end of ``tail`` begin a character that isn't whole yet."""
        for back in range(1, min(3, len(tail)) + 1):
            lead = tail[-back]
            if lead >= 0xC0:  # a lead byte: what does it still ask for?
                asked = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                if lead in (0xC0, 0xC1) or lead > 0xF4 or back >= asked:
                    return 0
                second = tail[-back + 1] if back > 1 else None
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(lead, 0x80)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(lead, 0xBF)
                return back if second is None or low <= second <= high else 0
            if lead < 0x80:
                return 0
        return 0

    def feed(self, chunk: bytes, last: bool = False) -> str:
        raw = self.held + chunk
        keep = 0 if last else self.incomplete(raw[-3:])
        self.held = raw[len(raw) - keep :] if keep else b""
        return raw[: len(raw) - keep].decode("utf-8", "replace") if keep else raw.decode("utf-8", "replace")


class Codec:
    """Encoder and decoder of whole texts; one per Python worker."""

    #: Tokens that are decoded together.
    STEP = 65_536

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst = Transducer(ranks)
        self.pieces = regex.compile(pattern)
        self.plain = re.compile(PLAIN_FORM[pattern]) if pattern in PLAIN_FORM else self.pieces
        self.known: dict[str, bytes] = {}  # and those before them, so that frequent pieces stay
        self.older: dict[str, bytes] = {}
        self.table = [self.fst.bytes_of.get(i, b"") for i in range(max(ranks.values()) + 1)]

    def _piece(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            raw = piece.encode("utf-8")
            rank = self.fst.ranks.get(raw)
            packed = np.asarray([rank] if rank is not None else self.fst.encode(raw), "<u4").tobytes()
        if len(self.known) >= MAX_PIECES // 2:
            self.known, self.older = {}, self.known
        if len(piece) <= 64:
            self.known[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        make, split = self._piece, self.plain if text.isascii() else self.pieces
        return b"".join([self.known.get(p) or make(p) for p in split.findall(text)])

    def decode(self, ids: np.ndarray) -> Iterator[str]:
        stream, table = Utf8Stream(), self.table
        for at in range(0, len(ids), self.STEP):
            yield stream.feed(b"".join([table[i] for i in ids[at : at + self.STEP].tolist()]))
        yield stream.feed(b"", last=True)


def _codec(key: tuple, vocabulary: dict[bytes, int], pattern: str) -> Codec:
    if key not in resident:
        resident.clear()
        resident[key] = Codec(vocabulary, pattern)
    return resident[key]


class Tokenizer:
    """Encodes and decodes columns. ``path`` is a rank file that the driver reads; its size (some MB) bounds what is sent."""

    def __init__(self, spark, path: str, pattern: str):
        text_batches(spark)
        with open(path, "rb") as f:
            self.raw = f.read()
        self.shared = spark.sparkContext.broadcast(self.raw)
        self.pattern = pattern
        self.key = (hashlib.sha256(self.raw).hexdigest(), pattern)

    def _worker(self):
        shared, key, pattern = self.shared, self.key, self.pattern

        def get() -> Codec:
            return resident[key] if key in resident else _codec(key, read_ranks(shared.value.splitlines()), pattern)

        return get

    def encode(self, docs: DataFrame, text: str = "text", out: str = "ids") -> DataFrame:
        """``docs`` without ``text`` and with the token ids as an array."""
        get, names = self._worker(), [c for c in docs.columns if c not in (text, out)]
        schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = get()
            for batch in batches:
                for part in _light(batch, text):
                    packed = [codec.encode(x or "") for x in part.column(text).to_pylist()]
                    offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in packed])]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), ids], [*names, out])

        return docs.select(*names, text).mapInArrow(run, schema)

    def round_trip(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, and decoded from the ids alone."""
        get = self._worker()
        schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), *(T.StructField(n, t) for n, t in (("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())))])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = get()
            for batch in batches:
                counts, encoded, decoded = [], [], []
                for x in batch.column(text):
                    packed = codec.encode(x.as_py() or "")
                    counts.append(len(packed) // 4)
                    encoded.append(hashlib.sha256(packed).hexdigest())
                    back = hashlib.sha256()
                    for y in codec.decode(np.frombuffer(packed, "<u4")):
                        back.update(y.encode("utf-8"))
                    decoded.append(back.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())], schema.names)

        return docs.select(key, text).mapInArrow(run, schema)

    def decode(self, rows: DataFrame, ids: str = "ids", out: str = "text") -> DataFrame:
        """``rows`` without ``ids`` and with their text; null ids give an empty text."""
        get, names = self._worker(), [c for c in rows.columns if c not in (ids, out)]
        schema = T.StructType([*(rows.schema[c] for c in names), T.StructField(out, T.StringType(), False)])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = get()
            for batch in batches:
                texts = ["".join(codec.decode(np.asarray(x.as_py() or [], "<u4"))) for x in batch.column(ids)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], [*names, out])

        return rows.select(*names, ids).mapInArrow(run, schema)


def _light(batch: pa.RecordBatch, text: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes of text each, one row at least."""
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0))
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)
