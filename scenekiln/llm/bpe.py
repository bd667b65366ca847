"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 state machine.

The merges are compiled into a transducer over bytes. A BPE encoding has two properties that make one possible:
a token sequence is the encoding of its bytes exactly if each adjacent pair is the encoding of its own bytes, and
the encoding of a prefix that ends where a token starts never changes afterwards. So a state needs only the longest
suffix that some token still continues, and, for each place in it where a token may start, the token that ends there.
A transition gives the token that ends at its byte. Tokens that the paths to all open places share are settled; an open
place is never further back than the longest token, which bounds the lookahead. States and transitions are made when
first met and kept, up to a bound in bytes, per Python worker; so are encoded pieces.

Rows: null text counts as empty (no ids), repeated rows are encoded alike, an empty table gives an empty table, texts
of any length are streamed through the transducer in linear time. A column of the input that is named like the new
column is replaced by it; other columns stay.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import sys
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenekiln.llm.worker import kept

#: Bounds of what a worker keeps. The transducer: slots of 8 bytes for transitions and of 4 for states (powers of two, two
#: thirds of them are filled), and bytes of the states' keys; 24 MB in all. Bytes of each of two generations of encoded
#: pieces, what a piece takes besides its letters and ids, and most letters of one that is kept.
MOVE_SLOTS, STATE_SLOTS, KEY_BYTES = 1 << 20, 1 << 19, 12 << 20
STORE_BYTES, PER_PIECE, MAX_KEPT = 12 << 20, 56, 48
#: Rows that are put out at once, pieces that are joined at once, letters up to which a text's pieces are listed at once.
OUT_ROWS, JOINED, LISTED = 256, 1 << 16, 1 << 20

#: Letters and numbers of a newer Unicode than the tokenizer library knows, which are neither to it. First
#: and last code point of each range.
NEWER = """
0558-0558 058b-058c 088f-088f 0c5c-0c5c 0cdc-0cdc 208f-208f 209d-209f a7ce-a7cf a7d2-a7d2 a7d4-a7d4 a7dd-a7dd a7e2-a7e2
a7f1-a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a-11b0a 11db0-11ddb 11de0-11de9 11df1-11df1
1246f-1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2
18e00-19191 191a0-191d2 1b123-1b128 1b168-1b168 1d6a6-1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de
1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e-2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a rank file: base64 and the rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes pieces of bytes by the ranks; see the module's text.

    A state is a number. Its key holds the places where a token may start and from which some token still goes on: what
    has been read since the earliest of them, and for each how many bytes that is and the token that ends there (-1: the
    start); the last place is the end of the input. Keys lie one after the other in one array, found by an open hash
    table. A transition, state and byte to the next state, is one number of such a table; the token that ends at the byte
    is the next state's last.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.unended = {token[:n] for token in ranks for n in range(1, len(token))}
        self.halves: dict[int, tuple[int, int] | None] = {}
        self._forget()

    def _forget(self) -> None:
        self.moves, self.n_moves = array("Q", bytes(8 * MOVE_SLOTS)), 0
        self.slots, self.keys, self.ends = array("I", bytes(4 * STATE_SLOTS)), bytearray(), array("I", [0])
        self.last = array("i", [0])  # number 0 is no state, as 0 marks a free slot
        self.start = self._state(self._key(b"", [(0, -1)]), -1)

    def _state(self, key: bytes, token: int) -> int:
        """The number of the state of that key."""
        at = hash(key) & (STATE_SLOTS - 1)
        while state := self.slots[at]:
            if self.keys[self.ends[state - 1] : self.ends[state]] == key:
                return state
            at = (at + 1) & (STATE_SLOTS - 1)
        self.slots[at] = state = len(self.last)
        self.keys += key
        self.ends.append(len(self.keys))
        self.last.append(token)
        return state

    def _full(self) -> bool:
        return 3 * self.n_moves > 2 * MOVE_SLOTS or 3 * len(self.last) > 2 * STATE_SLOTS or len(self.keys) > KEY_BYTES

    @staticmethod
    def _key(since: bytes, places: list[tuple[int, int]]) -> bytes:
        n = len(places)
        return struct.pack(f"<H{n}H{n}i", n, *(size for size, _ in places), *(before for _, before in places)) + since

    def places(self, state: int) -> list[tuple[bytes, int]]:
        """What has been read since each open place, longest first, and the token that ends there."""
        key = self.keys[self.ends[state - 1] : self.ends[state]]
        n = key[0] | key[1] << 8
        numbers, since = struct.unpack_from(f"<{n}H{n}i", key, 2), bytes(key[2 + 6 * n :])
        return [(since[len(since) - size :], before) for size, before in zip(numbers[:n], numbers[n:])]

    def _merged(self, data: bytes, below: float = math.inf) -> list[bytes]:
        """The definition: merge the adjacent pair of least rank (under `below`), leftmost first, until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while True:
            best = min(((self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.ranks), default=None)
            if best is None or best[0] >= below:
                return parts
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes `token`; (-1, -1) for a byte, None if the merges never form it."""
        known = self.halves.get(token, False)
        if known is False:
            data = self.tokens[token]
            merged = self._merged(data, below=token)
            known = (-1, -1) if len(data) == 1 else (self.ranks[merged[0]], self.ranks[merged[1]]) if len(merged) == 2 else None
            self.halves[token] = known
        return known

    def _spine(self, token: int, side: int) -> list[tuple[bytes, float]] | None:
        """What stands at one end (0: left, 1: right) of a token while its bytes merge, each with the rank that ends it.

        None: the merges never form the token.
        """
        found, ends = [], math.inf
        while True:
            parts = self._parts(token)
            if parts is None:
                return None
            found.append((self.tokens[token], ends))
            if parts[side] < 0:
                return found[::-1]
            token, ends = parts[side], token

    def _follows(self, before: int, token: int) -> bool:
        """Whether `token` may stand after `before` (-1: at the start).

        Both grow towards their common border in order of rank; they may not stand together if what stands on either
        side of the border merges across it first. Of equal ranks the leftmost goes first.
        """
        right = self._spine(token, 0)
        left = right and (right if before < 0 else self._spine(before, 1))
        if not left or before < 0:
            return bool(left)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            across = self.ranks.get(x + y, math.inf)
            if across < x_ends and across <= y_ends and across < math.inf:
                return False
            if x_ends == y_ends == math.inf:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def _make(self, state: int, byte: int, at: int) -> int:
        """The state after `state` at `byte`; the transition is kept in the free slot `at`."""
        last, longest, places, token = bytes((byte,)), b"", [], -1
        ranks, unended = self.ranks, self.unended
        for since, before in self.places(state):
            grown = since + last
            if token < 0 and grown in ranks and self._follows(before, ranks[grown]):
                token = ranks[grown]
            if grown in unended:
                longest = longest or grown
                places.append((len(grown), before))
        if token < 0:
            raise ValueError(f"no token covers byte {byte}")
        key = self._key(longest, [*places, (0, token)])
        if self._full():  # the state that is left is forgotten too
            self._forget()
            return self._state(key, token)
        after = self._state(key, token)
        self.moves[at] = (state << 8 | byte) << 24 | after
        self.n_moves += 1
        return after

    def _read(self, state: int, data: Iterable[int], ends: list[int]) -> int:
        """The state after `data`; the token that ends at each byte goes to `ends`."""
        moves, last = self.moves, self.last
        for byte in data:
            key = state << 8 | byte
            at = key * 0x9E3779B1 >> 12 & (MOVE_SLOTS - 1)
            while (move := moves[at]) >> 24 != key:
                if not move:
                    state = self._make(state, byte, at)
                    moves, last = self.moves, self.last
                    break
                at = at + 1 & (MOVE_SLOTS - 1)
            else:
                state = move & 0xFFFFFF
            ends.append(last[state])
        return state

    def _back(self, ends: list[int], at: int) -> list[int]:
        """The tokens up to place `at`, from the token that ends at each place."""
        out, sizes = [], self.sizes
        while at > 0:
            token = ends[at - 1]
            out.append(token)
            at -= sizes[token]
        out.reverse()
        return out

    def stream(self, data: bytes, lookahead: int = 4096) -> Iterator[int]:
        """Ids of the bytes. After each `lookahead` bytes what all open places have in common is emitted."""
        state, ends = self.start, []
        for at in range(0, len(data), lookahead):
            state = self._read(state, data[at : at + lookahead], ends)
            paths = [self._back(ends, len(ends) - len(since)) for since, _ in self.places(state)]
            settled = 0
            while all(len(p) > settled and p[settled] == paths[0][settled] for p in paths):
                settled += 1
            yield from paths[0][:settled]
            del ends[: sum(self.sizes[t] for t in paths[0][:settled])]
        yield from self._back(ends, len(ends))

    def piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > MAX_KEPT:
            return list(self.stream(data))
        ends: list[int] = []
        self._read(self.start, data, ends)
        return self._back(ends, len(ends))


def for_latin(pattern: str) -> re.Pattern:
    """The pattern for texts of code points below 256: each class escape stands for the ones of them that it matches."""

    def listed(escape: str) -> str:
        return "".join(f"\\x{i:02x}" for i in range(256) if regex.fullmatch(escape, chr(i)))

    out, at, inside = [], 0, False
    for found in regex.finditer(r"\\[pP]\{[^}]*\}|\\[sSdDwW]|\\.|\[|\]", pattern, flags=regex.DOTALL):
        out.append(pattern[at : found.start()])
        at, token = found.end(), found.group()
        if token[0] == "\\" and token[1] in "pPsSdDwW":
            token = listed(token) if inside else f"[{listed(token)}]"
        elif token in "[]":
            inside = token == "["
        out.append(token)
    return re.compile("".join(out) + pattern[at:])


class Store(dict):
    """Pieces to their ids as little-endian unsigned 32-bit integers, in two generations of bounded bytes."""

    def __init__(self, transducer: Transducer):
        super().__init__()
        self.transducer, self.older, self.room = transducer, {}, STORE_BYTES

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            found = self.transducer.piece(piece.encode())
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= MAX_KEPT:
            self.room -= PER_PIECE + sys.getsizeof(piece) + sys.getsizeof(ids)
            if self.room < 0:  # what is used again is taken over from the older ones
                self.older, self.room = dict(self), STORE_BYTES
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Splits texts by the pattern and encodes each piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern, self.latin = regex.compile(pattern), for_latin(pattern)
        ends = [[int(x, 16) for x in span.split("-")] for span in NEWER.split()]
        self.newer = regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ends) + "]")
        self.beyond = regex.compile(f"[\\U{ends[0][0]:08x}-\\U0010ffff]")  # most texts have none of these
        self.store = Store(self.transducer)

    def pieces(self, text: str) -> Iterator[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            found = text
            if self.beyond.search(text) and self.newer.search(text):
                found = self.newer.sub("͸", text)  # neither letter, number nor space to either library
            return (text[m.start() : m.end()] for m in self.pattern.finditer(found))
        if len(text) > LISTED:
            return (m.group() for m in self.latin.finditer(text))
        return self.latin.findall(text)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def packed(self, text: str) -> bytes:
        """Ids of the text as little-endian unsigned 32-bit integers."""
        found = map(self.store.__getitem__, self.pieces(text))
        if len(text) <= LISTED:
            return b"".join(found)
        return b"".join(iter(lambda: b"".join(islice(found, JOINED)), b""))


def _ids(parts: list[bytes]) -> pa.ListArray:
    """The ids of several texts as one Arrow array."""
    ends = np.cumsum([0] + [len(p) // 4 for p in parts], dtype=np.int32)
    values = np.frombuffer(b"".join(parts), "<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values, pa.int32()))


def utf8_step(state: tuple[int, int, int], byte: int) -> tuple[int, int, int] | None:
    """The UTF-8 machine. State: bytes still due and the range of the next one; None: the byte cannot stand here."""
    due, low, high = state
    if due:
        return (due - 1, 0x80, 0xBF) if low <= byte <= high else None
    if byte < 0x80:
        return (0, 0, 0)
    if 0xC2 <= byte <= 0xDF:
        return (1, 0x80, 0xBF)
    if 0xE0 <= byte <= 0xEF:
        return (2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF)
    if 0xF0 <= byte <= 0xF4:
        return (3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF)
    return None


class StreamingDecoder:
    """Turns ids into text as they come; a character that tokens share is held back until it is whole.

    The machine runs over what follows the last byte that can begin a character: all before it is decided. Bytes that
    are no UTF-8 become U+FFFD.
    """

    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.held = b""

    def feed(self, ids: Iterable[int]) -> str:
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] & 0xC0 != 0x80:
                state: tuple[int, int, int] | None = (0, 0, 0)
                for byte in data[-back:]:
                    state = utf8_step(state, byte)
                    if state is None:
                        break
                if state and state[0]:
                    cut = len(data) - back
                break
        self.held = data[cut:]
        return data[:cut].decode("utf-8", errors="replace")

    def finish(self) -> str:
        held, self.held = self.held, b""
        return held.decode("utf-8", errors="replace")


def _codec(key: str, spec) -> Codec:
    """The worker's codec, kept across tasks so that the transducer's states are made once."""
    store = kept("bpe")
    if key not in store:
        store.clear()
        store[key] = Codec(*spec.value)
    return store[key]


class BpeOperator:
    """Encoding and decoding of columns. The vocabulary (a file of bounded size) goes to executors as a broadcast."""

    def __init__(self, spark, ranks_path: str, pattern: str):
        ranks = read_ranks(ranks_path)
        if len(ranks) > 1_000_000:
            raise ValueError("a rank file of over a million tokens is not broadcast")
        if max(ranks.values()) >= 1 << 24:
            raise ValueError("a transition holds ids below 2^24")
        self.spec = spark.sparkContext.broadcast((ranks, pattern))
        self.key = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()

    def ids(self, text: Column | str) -> Column:
        """array<int> of the ids of a string column; null: no ids."""
        key, spec = self.key, self.spec

        @F.arrow_udf("array<int>")
        def encode(texts: pa.Array) -> pa.Array:
            codec = _codec(key, spec)
            return _ids([codec.packed(text.as_py() or "") for text in texts])

        return encode(text)

    def text(self, ids: Column | str) -> Column:
        """The decoded string of an array<int> column; null stays null."""
        key, spec = self.key, self.spec

        @F.arrow_udf("string")
        def decode(lists: pa.Array) -> pa.Array:
            tokens = _codec(key, spec).transducer.tokens
            out = []
            for one in lists:
                if (found := one.as_py()) is None:
                    out.append(None)
                    continue
                decoder = StreamingDecoder(tokens)
                out.append(decoder.feed(found) + decoder.finish())
            return pa.array(out, pa.string())

        return decode(ids)

    def digest(self, ids: Column | str) -> Column:
        """struct<n_tokens, ids_sha256, decoded_sha256>, the text decoded in chunks as a stream."""
        key, spec = self.key, self.spec

        @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
        def digests(lists: pa.Array) -> pa.Array:
            tokens = _codec(key, spec).transducer.tokens
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            counts, first, second = [], [], []
            for a, b in zip(ends, ends[1:]):
                own = values[a:b]
                decoder, seen = StreamingDecoder(tokens), hashlib.sha256()
                for at in range(0, len(own), 65_536):
                    seen.update(decoder.feed(own[at : at + 65_536].tolist()).encode())
                seen.update(decoder.finish().encode())
                counts.append(len(own))
                first.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                second.append(seen.hexdigest())
            return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

        return digests(ids)

    def encode(self, df: DataFrame, text_col: str = "text", ids_col: str = "token_ids", intact_col: str | None = None) -> DataFrame:
        """`df` with the ids of `text_col` in `ids_col` and, if named, whether decoding gives the text back.

        A task holds one batch of its input and few rows of output.
        """
        key, spec = self.key, self.spec
        added = [c for c in (ids_col, intact_col) if c]
        rest = df.drop(*[c for c in added if c != text_col])
        read = "__text"
        while read.lower() in (c.lower() for c in df.columns):  # a name that no column of the input has
            read += "_"
        source = rest.withColumn(read, F.col(f"`{text_col}`"))
        source = source.drop(text_col) if text_col in added else source
        schema = T.StructType([f for f in source.schema.fields if f.name != read] + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(intact_col, T.BooleanType())] if intact_col else []))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codec = _codec(key, spec)
            decoder = StreamingDecoder(codec.transducer.tokens)
            for batch in batches:
                for at in range(0, batch.num_rows, OUT_ROWS):
                    part = batch.slice(at, OUT_ROWS)
                    texts = [t or "" for t in part.column(read).to_pylist()]
                    ids = [codec.packed(t) for t in texts]
                    columns = {n: part.column(n) for n in part.schema.names if n != read}
                    columns[ids_col] = _ids(ids)
                    if intact_col:
                        columns[intact_col] = pa.array([decoder.feed(np.frombuffer(i, "<u4").tolist()) + decoder.finish() == t for i, t in zip(ids, texts)], pa.bool_())
                    yield pa.RecordBatch.from_pydict(columns)

        return source.mapInArrow(run, schema)

    def decode(self, df: DataFrame, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
        """`df` with the text of `ids_col` in `text_col`."""
        return df.withColumn(text_col, self.text(F.col(f"`{ids_col}`")))
