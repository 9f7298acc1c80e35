"""Byte-level BPE in linear time per piece.

Token bytes are mapped to Latin-1 so that an Aho-Corasick automaton over characters
finds every token in a piece in one pass. Encoding goes from left to right with the
longest token at each place; where it does not fit behind the last one, a shorter
prefix of it is tried, then the last one is taken back. Whether two tokens may stand
side by side (merging their joint bytes gives just these two) is memoised. A place
from which no continuation exists is barred, so each is left at most once.

A text is cut at every space before a character that is no white space. The split
pattern always begins a piece there, so the ids of such a part depend on it alone
and are kept in a bounded cache per worker; most parts of a text are words seen
before.

Defined cases: a null or empty text has no ids; texts are encoded whole, whatever
their length; repeated rows are encoded alike; an empty table gives no rows; columns
other than those named are dropped, whatever their names.
"""

from __future__ import annotations

import base64
import functools
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Parts kept per worker and kind; the cache starts afresh when it is full.
CACHE_PARTS = 400_000
#: Longer parts are not kept.
CACHE_LENGTH = 64


class PartCache:
    """ids of whole texts from ids of parts. encode: bytes of ids (unsigned 32-bit,
    little-endian) of a string whose ends are piece boundaries."""

    def __init__(self, encode: Callable[[str], bytes]) -> None:
        import regex

        self.encode = encode
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.blanks = regex.compile(r" \s")

    def ids(self, text: str) -> bytes:
        parts = text.split(" ")
        if self.blanks.search(text) or text.endswith(" "):
            return self.encode(text)
        head, known = parts[0], self.tails
        out = [known.get(p) for p in parts]
        out[0] = self._kept(self.heads, head, head)
        if None in out:
            for i, found in enumerate(out):
                if found is None:
                    out[i] = self._kept(known, parts[i], " " + parts[i])
        return b"".join(out)

    def _kept(self, cache: dict[str, bytes], key: str, part: str) -> bytes:
        found = cache.get(key)
        if found is None:
            found = self.encode(part)
            if len(part) <= CACHE_LENGTH:
                if len(cache) >= CACHE_PARTS:
                    cache.clear()
                cache[key] = found
        return found


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class BytePairEncoder:
    """Encodes and decodes by the ranks of a vocabulary and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import ahocorasick
        import regex

        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.pieces = regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int | None] = {}
        reachable = {t: r for t, r in ranks.items() if len(t) == 1 or self.merged(t) == [r]}
        for token, rank in reachable.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
            self.shorter[rank] = next((reachable[token[:n]] for n in range(len(token) - 1, 0, -1) if token[:n] in reachable), None)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.cache = PartCache(self._encode_part)

    def merged(self, piece: bytes) -> list[int]:
        """Merging step by step: the least rank first, then the leftmost. Only for
        short byte strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fit(self, left: int, right: int) -> bool:
        found = self.fits.get((left, right))
        if found is None:
            if len(self.fits) >= 4 * CACHE_PARTS:
                self.fits.clear()
            found = self.fits[left, right] = self.merged(self.bytes_of[left] + self.bytes_of[right]) == [left, right]
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (length, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - length + 1] = rank
        barred = bytearray(n + 1)
        tokens: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            last = tokens[-1] if tokens else None
            while True:
                end = pos + len(self.bytes_of[token])
                if not barred[end] and (last is None or self._fit(last, token)):
                    tokens.append(token)
                    pos = end
                    if pos < n:
                        token = longest[pos]
                    break
                shorter = self.shorter[token]
                if shorter is None:
                    barred[pos] = 1
                    token = tokens.pop()
                    pos -= len(self.bytes_of[token])
                    break
                token = shorter
        return tokens

    def _encode_part(self, part: str) -> bytes:
        known, out = self.known, []
        for piece in self.pieces.findall(part):
            found = known.get(piece)
            if found is None:
                found = array("I", self.encode_piece(piece.encode())).tobytes()
                if len(piece) <= CACHE_LENGTH:
                    if len(known) >= CACHE_PARTS:
                        known.clear()
                    known[piece] = found
            out.append(found)
        return b"".join(out)

    def encode(self, text: str | None) -> bytes:
        """ids as unsigned 32-bit little-endian integers."""
        return self.cache.ids(text) if text else b""

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, memoryview(ids).cast("I")))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    """One encoder per worker and vocabulary."""
    return BytePairEncoder(read_ranks(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """id, ids (binary: unsigned 32-bit little-endian) and, if asked for, decoded
    (binary: the bytes that the ids stand for). path: a rank file that every executor
    has."""
    rows = df.select(id_col, text_col)
    kinds = [rows.schema[id_col], T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.BinaryType())] * decode

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                ids = [own.encode(t) for t in batch.column(1).to_pylist()]
                columns = [batch.column(0), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=[k.name for k in kinds])

    return rows.mapInArrow(run, T.StructType(kinds))
