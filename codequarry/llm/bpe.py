"""Byte-level BPE as a finite-state transducer, and its streaming inverse.

A sequence of tokens is what merging by rank gives exactly when each two neighbours, merged alone, stay as they
are. So every prefix of a piece has one last token: of the tokens that end there, the one that may follow the last token of the
prefix before it. That makes encoding a finite-state transducer over bytes. Its state is the longest end of what was read
that begins some token, with the last tokens of the prefixes in that reach; the merges are compiled into
deterministic transitions lazily, each when it is first taken. A token leaves as soon as every prefix still in reach goes through it,
so that lookahead is bounded. Tables are bounded: a full one is emptied and filled again.

Decoding joins token bytes and cuts them where a character of UTF-8 is complete, so that ids may arrive in pieces.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import memo, prepared

# White space of Unicode, as the pattern's \s means it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_COARSE = re.compile(rf" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
_LETTERS = re.compile(r" ?[^\W\d_]+")
MOST_STATES, MOST_PAIRS, MOST_CHUNKS, LONGEST_CHUNK, LOOKAHEAD = 250_000, 300_000, 300_000, 40, 256


PART = 1 << 20  # characters or ids of a text that are taken apart at once


def read_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


def merged(ranks: dict[bytes, int], piece: bytes, below: int = 1 << 40) -> list[int]:
    """Merge the pair of least rank, leftmost first, until none is left with a rank below ``below``; for short pieces."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(pairwise(parts)))
        if rank >= below:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class Transducer:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size_of = {rank: len(token) for token, rank in ranks.items()}
        self.child: dict[int, int] = {}  # of node << 8 | byte
        self.token_at: dict[int, int] = {}
        self.depth = array("H", [0])
        for token, rank in ranks.items():
            node = 0
            for b in token:
                up = node
                node = self.child.setdefault(up << 8 | b, len(self.depth))
                if node == len(self.depth):
                    self.depth.append(self.depth[up] + 1)
            self.token_at[node] = rank
        # of each node, the longest proper end of its bytes that is a node too; nodes by depth, so that the shorter ones are known
        self.shorter = array("I", bytes(4 * len(self.depth)))
        for edge in sorted(self.child, key=lambda e: self.depth[e >> 8]):
            if up := edge >> 8:
                self.shorter[self.child[edge]] = self._extend(self.shorter[up], edge & 255)
        self._endings: dict[int, list[int]] = {}
        self._fits: dict[int, bool] = {}
        self._split: dict[int, tuple[int, int] | None] = {}
        self._reset()

    def _reset(self):
        start = (0, (None,))
        self.states = [start]
        self.number = {start: 0}
        self.moves: list[dict[int, tuple[int, int]]] = [{}]

    def _extend(self, node: int, byte: int) -> int:
        while (to := self.child.get(node << 8 | byte)) is None:
            if node == 0:
                return 0
            node = self.shorter[node]
        return to

    def _tokens_ending(self, node: int) -> list[int]:
        """Tokens that the bytes of a node end in, the longest first."""
        found = self._endings.get(node)
        if found is None:
            found, at = [], node
            while at:
                if at in self.token_at:
                    found.append(self.token_at[at])
                at = self.shorter[at]
            self._endings[node] = found
        return found

    def _halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives this one; None for a single byte."""
        if token not in self._split:
            data = self.bytes_of[token]
            parts = merged(self.ranks, data, token) if len(data) > 1 else []
            self._split[token] = (parts[0], parts[1]) if len(parts) == 2 else None
        return self._split[token]

    def _meet(self, left: int, right: int) -> bool:
        """Whether merging the bytes of two tokens gives the two back. Merges inside either come in the order of their ranks, so the seam is
        looked at under ever smaller halves, the one that was merged last taken apart first; a merge over the seam that comes
        before the next one inside would have won."""
        before = 1 << 40
        while True:
            over = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if over is not None and over < before:
                return False
            # of equal ranks the left one merges first, and then the seam comes after it
            if left > right:
                half, before, first = self._halves(left), left, True
            else:
                half, before, first = self._halves(right), right + 1, False
            if half is None:  # a byte; the other side may still be taken apart
                other = right if first else left
                half = self._halves(other)
                if half is None:
                    return True
                first, before = not first, other + (1 if first else 0)
            if first:
                left = half[1]
            else:
                right = half[0]

    def fits(self, left: int | None, right: int) -> bool:
        """Two tokens may stand side by side if merging their bytes gives them back."""
        key = ~right if left is None else left << 32 | right
        known = self._fits.get(key)
        if known is None:
            if len(self._fits) > MOST_PAIRS:
                self._fits.clear()
            known = self._fits[key] = merged(self.ranks, self.bytes_of[right]) == [right] if left is None else self._meet(left, right)
        return known

    def _step(self, state: int, byte: int) -> tuple[int, int]:
        """(next state, last token of the longer prefix)."""
        node, lasts = self.states[state]
        node = self._extend(node, byte)
        for token in self._tokens_ending(node):
            if self.fits(lasts[-self.size_of[token]], token):
                break
        else:
            raise ValueError(f"the vocabulary has no token for byte {byte}")
        key = (node, (*lasts, token)[-1 - self.depth[node]:])
        to = self.number.get(key)
        if to is None:
            to = self.number[key] = len(self.states)
            self.states.append(key)
            self.moves.append({})
        move = self.moves[state][byte] = (to, token)
        return move

    def _path(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end:
            out.append(lasts[end - 1])
            end -= self.size_of[out[-1]]
        out.reverse()
        return out

    def _certain(self, lasts: list[int], reach: int) -> int:
        """The last position that the path of every prefix in reach goes through."""
        n = len(lasts)
        ways = {n}
        at = n
        while at:
            at -= self.size_of[lasts[at - 1]]
            ways.add(at)
        least = n
        for end in range(max(1, n - reach), n):
            while end not in ways:
                end -= self.size_of[lasts[end - 1]]
            least = min(least, end)
        return least

    def stream(self, data: Iterable[int]) -> Iterator[int]:
        """Token ids of one piece, in portions: each LOOKAHEAD bytes, all that are certain."""
        state, lasts = 0, []
        for byte in data:
            state, last = self.moves[state].get(byte) or self._step(state, byte)
            lasts.append(last)
            if len(lasts) % LOOKAHEAD == 0:
                cut = self._certain(lasts, self.depth[self.states[state][0]])
                yield from self._path(lasts, cut)
                del lasts[:cut]
        yield from self._path(lasts, len(lasts))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)  # a piece that is a token is never split
        if whole is not None:
            return [whole]
        if len(self.states) > MOST_STATES:
            self._reset()
        if len(piece) >= LOOKAHEAD:
            return list(self.stream(piece))
        state, lasts, moves = 0, [], self.moves
        for byte in piece:
            state, last = moves[state].get(byte) or self._step(state, byte)
            lasts.append(last)
        return self._path(lasts, len(lasts))


class _Recent(dict):
    """A lookup table of two generations: when the younger is full it becomes the older, so what is in use stays. One entry
    is ``made`` where there is none; keys longer than LONGEST_CHUNK are not kept."""

    def __init__(self, made, most: int):
        super().__init__()
        self.made, self.most, self.older = made, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.made(key)
        if len(key) <= LONGEST_CHUNK:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Texts to ids. A chunk is a run without white space and the space before it, or white space; no match of the pattern
    crosses its edge. Chunks and pieces that were met lately are looked up, in tables of at most 2 and 4 times MOST_CHUNKS entries
    of LONGEST_CHUNK characters and their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.transducer = Transducer(ranks)
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?![^{SPACE}])").replace(r"\s", f"[{SPACE}]"))
        self.chunks = _Recent(self._chunk, MOST_CHUNKS)
        self.pieces = _Recent(self._piece, 2 * MOST_CHUNKS)

    def _piece(self, piece: str) -> bytes:
        return np.array(self.transducer.encode(piece.encode()), "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if _LETTERS.fullmatch(chunk) and chunk.lstrip(" ").isalpha():
            return self.pieces[chunk]
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not text:
            return b""
        if len(text) <= PART:
            return b"".join(map(self.chunks.__getitem__, _COARSE.findall(text)))
        return b"".join([self.chunks[m[0]] for m in _COARSE.finditer(text)])  # chunks of a long text are met one by one


# Bytes that must follow each lead byte of UTF-8; others stand alone or are errors that the codec replaces.
_FOLLOW = [0] * 0xC2 + [1] * 0x1E + [2] * 0x10 + [3] * 5 + [0] * 11


class Decoder:
    """Ids to text, fed in any portions: the state is the unfinished character at the end, three bytes at most."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rest = b""

    def feed(self, ids: list[int]) -> str:
        data = self.rest + b"".join(map(self.tokens.__getitem__, ids))
        cut = len(data)
        for back in range(1, min(3, cut) + 1):
            byte = data[cut - back]
            if byte & 0xC0 != 0x80:  # the lead of the last character, or a byte alone
                if _FOLLOW[byte] >= back:
                    cut -= back
                break
        self.rest = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.rest = self.rest, b""
        return rest.decode("utf-8", "replace")


def _encoder(raw: bytes, pattern: str) -> Encoder:
    held = memo("bpe encoder")
    if (raw, pattern) not in held:
        held.clear()
        held[raw, pattern] = Encoder(read_ranks(raw), pattern)
    return held[raw, pattern]


def _token_list(raw: bytes) -> list[bytes]:
    held = memo("bpe tokens")
    if raw not in held:
        held.clear()
        ranks = read_ranks(raw)
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        held[raw] = tokens
    return held[raw]


def _vocabulary(path: str, spark):
    """The rank file, read once on the driver: one vocabulary, below some MB whatever the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns and ``out``, the ids of the whole text as little-endian unsigned 32-bit integers (binary).

    ``pattern`` cuts the text; each match is encoded by itself, and the strings of special tokens are ordinary
    text. A null or empty text has no ids. ``out`` replaces a column of that name.
    """
    ranks = _vocabulary(ranks_path, prepared(docs.sparkSession))

    @F.arrow_udf("binary")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(ranks.value, pattern)
        for texts in batches:
            yield pa.array([encoder.encode(t) for t in texts.to_pylist()], pa.binary())

    return docs.withColumn(out, ids(F.col(text).cast("string")))


def _spelled(tokens: list[bytes], packed: bytes | None, portion: int = 8192) -> str:
    """The text of packed ids, decoded by portions."""
    numbers, decoder = np.frombuffer(packed or b"", "<u4"), Decoder(tokens)
    parts = [decoder.feed(numbers[i:i + portion].tolist()) for i in range(0, len(numbers), portion)]
    return "".join([*parts, decoder.finish()])


def decode(docs: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded", portion: int = 8192) -> DataFrame:
    """All columns and ``out``, the text that the ids spell; null ids give the empty text. ``portion`` ids are held decoded
    at a time. Bytes that are no UTF-8 become U+FFFD."""
    ranks = _vocabulary(ranks_path, prepared(docs.sparkSession))

    @F.arrow_udf("string")
    def spelled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = _token_list(ranks.value)
        for column in batches:
            yield pa.array((_spelled(tokens, packed.as_py(), portion) for packed in column), pa.string())

    return docs.withColumn(out, spelled(F.col(ids)))


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns and ``ids`` and ``decoded``, as ``encode`` and then ``decode`` give them, by one worker a core and row by row, so
    that one vocabulary and one text are held. The two columns replace columns of these names."""
    ranks = _vocabulary(ranks_path, prepared(docs.sparkSession))

    @F.arrow_udf("struct<ids: binary, decoded: string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder, tokens = _encoder(ranks.value, pattern), _token_list(ranks.value)
        for column in batches:
            ids, texts = [], []
            for t in column:
                ids.append(encoder.encode(t.as_py()))
                texts.append(_spelled(tokens, ids[-1]))
            yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["ids", "decoded"])

    done = docs.drop("ids", "decoded").withColumn("_both", both(F.col(text).cast("string")))
    return done.select("*", "_both.ids", "_both.decoded").drop("_both")
