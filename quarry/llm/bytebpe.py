"""Operator 2: byte-level BPE as a lazily determinised transducer, and streaming decoding.

Two tokens may stand next to each other in an encoding if and only if merging their
joined bytes gives back just these two; a sequence is the encoding of its bytes if and
only if all neighbours may. So the merges compile to a machine over bytes whose paths
are tries of tokens joined where neighbours fit, and exactly one path is alive at the
end of every prefix. Determinising it, a state holds the last emitted token and, for
every boundary from which a token may still go on, the tokens since then with the place
in the trie. Reading a byte moves all of them; the tokens on which all agree are
emitted. Boundaries older than the longest token have died, so the lookahead is
bounded. States and transitions are made when first met; the first ``MAX_STATES`` are
kept, others are made again when needed (results do not depend on what is kept).
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import use_small_batches
from .pretokens import pretokens

MAX_STATES = 250_000
MAX_WORDS = 150_000  # outputs of whole matches that are kept, twice
MAX_PAIRS = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[int]:
    """Merges the adjacent pair of lowest rank, leftmost first, until none is left (or
    until ``least`` parts are)."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > least:
        best, at = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best == 1 << 60:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class State:
    """The last token emitted (-1: none), the boundaries alive as (tokens since, place in
    the trie), the moves known, and the tokens to emit if the match ends here."""

    __slots__ = ("last", "alive", "moves", "rest", "stays")

    def __init__(self, last: int, alive: tuple):
        self.last, self.alive, self.moves, self.stays = last, alive, {}, False
        self.rest = next(chain for chain, node in alive if node == 0)


class Transducer:
    """Bytes of one match in, token ids out."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}  # trie: node * 256 + byte -> node
        self.token = [-1]
        self.inner = [False]  # has a child
        for t, i in ranks.items():
            node = 0
            for c in t:
                key = node << 8 | c
                if (nxt := self.child.get(key)) is None:
                    nxt = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
                    self.inner[node] = True
                node = nxt
            self.token[node] = i
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, list | None] = {}
        self.known: dict = {}
        self.start = self._state(-1, (((), 0),))

    def _state(self, last: int, alive: tuple) -> State:
        key = (last, alive)
        if (s := self.known.get(key)) is None:
            s = State(last, alive)
            if len(self.known) < MAX_STATES:
                self.known[key] = s
                s.stays = True
        return s

    def edge(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """The parts that stand at the right (side 1) or left (0) end of a token while it is
        merged, each with the rank of the merge that takes it up; None if merges never build
        the token."""
        key = token << 1 | side
        if key not in self.edges:
            out, t, until = [], token, 1 << 60
            while True:
                piece = self.tokens[t]
                out.append((piece, until))
                if len(piece) == 1:
                    break
                two = merge(piece, self.ranks, 2)
                if len(two) != 2 or self.ranks.get(self.tokens[two[0]] + self.tokens[two[1]]) != t:
                    out = None
                    break
                t, until = two[side], t
            self.edges[key] = out
        return self.edges[key]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``right`` may follow ``left`` (-1: begin a match): no part at the end of
        ``left`` merges with a part at the start of ``right`` before both are taken up by
        merges inside their tokens (of equal ranks the one further left comes first)."""
        key = left << 20 | right
        if (ok := self.pairs.get(key)) is None:
            if len(self.pairs) > MAX_PAIRS:
                self.pairs.clear()
            after = self.edge(right, 0)
            before = self.edge(left, 1) if left >= 0 else []
            ok = after is not None and before is not None and not any(
                (m := self.ranks.get(x + y)) is not None and m < x_until and m <= y_until
                for x, x_until in before for y, y_until in after)
            self.pairs[key] = ok
        return ok

    def _move(self, state: State, byte: int) -> tuple[State, tuple]:
        last, after, boundary = state.last, [], None
        child, token, inner = self.child, self.token, self.inner
        for chain, node in state.alive:
            if (nxt := child.get(node << 8 | byte)) is None:
                continue
            if (t := token[nxt]) >= 0 and boundary is None and self.fits(chain[-1] if chain else last, t):
                boundary = (*chain, t)
            if inner[nxt]:
                after.append((chain, nxt))
        after.append((boundary, 0))
        n, first = 0, after[0][0]
        while n < len(first) and all(len(c) > n and c[n] == first[n] for c, _ in after):
            n += 1
        if n:
            last, after = first[n - 1], [(c[n:], node) for c, node in after]
        move = (self._state(last, tuple(after)), first[:n])
        if move[0].stays:
            state.moves[byte] = move
        return move

    def encode(self, match: bytes) -> list[int]:
        """Ids of one match of the splitting pattern. A match that is a token itself is
        that token even where merges would not build it, as in the tiktoken library."""
        if match in self.ranks:
            return [self.ranks[match]]
        out: list[int] = []
        state = self.start
        for byte in match:
            state, emitted = state.moves.get(byte) or self._move(state, byte)
            if emitted:
                out += emitted
        return [*out, *state.rest]


class Encoder:
    """Texts in, little-endian unsigned 32-bit ids out; keeps the outputs of recent matches."""

    def __init__(self, ranks: dict[bytes, int]):
        self.machine = Transducer(ranks)
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        words, kept, older = pretokens(text), self.kept, self.older
        for w in set(words):
            if w not in kept:
                kept[w] = older.get(w) or np.array(self.machine.encode(w.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        out = b"".join([kept[w] for w in words])
        if len(kept) > MAX_WORDS:
            self.kept, self.older = {}, kept
        return out


def _utf8_machine() -> list[list[int]]:
    """next state by state and byte. 0: between characters; 1, 2, 3: as many continuation
    bytes to come; 4..7: after E0, ED, F0, F4, which narrow the next byte; -1: malformed."""
    table = [[-1] * 256 for _ in range(8)]
    for b in range(256):
        if b < 0x80:
            table[0][b] = 0
        elif 0xC2 <= b <= 0xDF:
            table[0][b] = 1
        elif 0xE0 <= b <= 0xEF:
            table[0][b] = {0xE0: 4, 0xED: 5}.get(b, 2)
        elif 0xF0 <= b <= 0xF4:
            table[0][b] = {0xF0: 6, 0xF4: 7}.get(b, 3)
        if 0x80 <= b <= 0xBF:
            table[1][b], table[2][b], table[3][b] = 0, 1, 2
            table[4 if b >= 0xA0 else 5][b] = 1
            if b >= 0x90:
                table[6][b] = 2
            else:
                table[7][b] = 2
    return table


UTF8 = _utf8_machine()


class Decoder:
    """Streaming decoding: token ids in, as much text as is complete out. The machine
    above tells whether the end of what has come is inside a character; that end waits.
    Malformed bytes become U+FFFD."""

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.waiting = tokens, b""

    def feed(self, ids) -> str:
        data = self.waiting + b"".join([self.tokens[i] for i in ids])
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            if data[-back] >= 0xC0:  # the last lead byte
                state = 0
                for b in data[-back:]:
                    state = UTF8[state][b] if state >= 0 else -1
                cut = len(data) - back if state > 0 else cut
                break
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def end(self) -> str:
        rest, self.waiting = self.waiting, b""
        return rest.decode("utf-8", "replace")


def decode(ids: np.ndarray, tokens: list[bytes], step: int = 1 << 14):
    """The text of an id sequence, piece by piece."""
    d = Decoder(tokens)
    for i in range(0, len(ids), step):
        yield d.feed(ids[i:i + step].tolist())
    yield d.end()


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(read_ranks(path))
    return _ENCODERS[path]


def encode_table(docs: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids): ``ids`` holds little-endian unsigned 32-bit token ids. One row per
    row; null texts count as empty and have no ids. Other columns are ignored. The rank
    file must be readable under its path on every worker."""
    def run(batches):
        encoder = _encoder(ranks_path)
        for batch in batches:
            ids = [encoder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    use_small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary")


def decode_table(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded ``text``."""
    def run(batches):
        machine = _encoder(ranks_path).machine
        tokens = [machine.tokens.get(i, b"") for i in range(max(machine.tokens) + 1)]
        for batch in batches:
            texts = ["".join(decode(np.frombuffer(x or b"", "<u4"), tokens)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")
