"""Packing documents into sequences by cutting-stock column generation.

A document's tokens are cut into full sequences and a remainder. The histogram of
remainders, by length rounded up to GRAIN tokens, is a cutting-stock problem: each
sequence is cut by a pattern, a multiset of lengths that fits. A linear program over
few patterns gives each length a price; a knapsack by dynamic programming finds the
pattern worth most at these prices; patterns are added until none is worth more than
a sequence. Uses are rounded down, and what remains is packed first-fit-decreasing on
the histogram. Remainders are then ranked within their length and take their place in
a pattern by arithmetic on the rank, so no task sees more than one salted part of a
length.

The program has at most capacity / GRAIN lengths, so its size does not depend on the
input; only a histogram of (length, salt) counts reaches the driver, with one salt for
every RANKED pieces of a length, and at most PARTS_MOST of them for large inputs.

Defined cases: a null or empty text has the end token alone; a document longer than a
sequence is cut, any other stays whole unless it tops up others; repeated rows are
packed as often as they occur; texts of any length are read whole; an empty table gives
no rows; columns other than those named are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm.bpe import PartCache
from clausewright.llm.durable import durable
from clausewright.llm.memory import giving_back, kept

CAPACITY = 2048
END_TOKEN = 1
GRAIN = 8
#: Pieces of a length that are ranked together, on average, and the most parts of all
#: lengths: beyond, parts grow.
RANKED, PARTS_MOST = 200, 1 << 16
#: Patterns added to the program at most.
ROUNDS = 4000
#: The search ends when the program's value is within this share of its lower bound.
TOLERANCE = 1e-3
#: Weight of the best feasible prices so far when a pattern is sought.
SMOOTHING = 0.8

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, ids binary"


class Tokens:
    """Ids of whole texts. Parts come from the vocabulary's ranks; a text in which
    special tokens or rare white space occur goes to the tokenizer itself."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        own = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        byte_of = {chr(c): c for c in own} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in own)}
        self.special = [t["content"] for t in file["added_tokens"]]
        ranks = {bytes(byte_of[c] for c in token): rank for token, rank in file["model"]["vocab"].items() if token not in self.special}
        del file
        coded = tiktoken.Encoding("parts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cache = PartCache(lambda part: array("I", coded.encode_ordinary(part)).tobytes())

    @functools.cached_property
    def tokenizer(self):  # noqa: ANN201
        """Loaded where a text asks for it: it takes tens of megabytes a worker."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special) or self.cache.blanks.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self.cache.ids(text)


@functools.lru_cache(maxsize=2)
def tokens(path: str, pattern: str) -> Tokens:
    return Tokens(path, pattern)


kept("packing", tokens.cache_clear)


def token_pieces(df: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens and, if asked
    for, ids (unsigned 32-bit little-endian). path: a tokenizer file that every
    executor has."""
    names = [c.split()[0] for c in PIECES.split(", ")]
    end = array("I", [END_TOKEN]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(path, pattern)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.ids(text) + end
                for start in range(0, len(ids), 4 * capacity):
                    piece = ids[start : start + 4 * capacity]
                    rows.append((doc, start // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4, piece if with_ids else None))
            kinds = [pa.int64()] * 5 + [pa.binary()]
            for at in range(0, len(rows), 10_000):
                columns = zip(*rows[at : at + 10_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return df.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(giving_back(run, keep="packing"), PIECES)


def price_pattern(prices: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[float, dict[int, int]]:
    """The pattern worth most: an unbounded knapsack over lengths 1 to capacity."""
    usable = np.flatnonzero((prices > 1e-12) & (demand > 0))
    sizes, worths = usable + 1, prices[usable]
    best = np.zeros(capacity + 1)
    last = np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fitting[room]:
            worth = worths[:n] + best[room - sizes[:n]]
            k = worth.argmax()
            if worth[k] > best[room] + 1e-12:
                best[room], last[room] = worth[k], usable[k]
    pattern: dict[int, int] = {}
    room = capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            pattern[int(last[room])] = pattern.get(int(last[room]), 0) + 1
            room -= int(last[room]) + 1
    return float(best[capacity]), pattern


def column_generation(demand: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """Patterns (length index -> copies) and fractional uses that cover demand[i]
    pieces of length i + 1 with the fewest sequences of the capacity.

    Prices swing from round to round, so patterns are sought at a mean of the
    program's prices and the best feasible ones so far, which begin at length over
    capacity. Any prices divided by the worth of their best pattern bound the least
    number of sequences from below; the search ends near that bound."""
    rows = np.flatnonzero(demand)
    at = {int(r): k for k, r in enumerate(rows)}
    patterns = [{int(r): capacity // (int(r) + 1)} for r in rows]
    basis = list(range(len(rows)))
    inverse = np.diag([1 / p[int(r)] for p, r in zip(patterns, rows, strict=True)])
    uses = (inverse * demand[rows]).sum(axis=1)
    best = (np.arange(len(demand)) + 1) / capacity * (demand > 0)
    for turn in range(1, ROUNDS + 1):
        if turn % 200 == 0:  # rounding errors would add up
            inverse = _inverted(_matrix(patterns, basis, at))
            uses = np.maximum(0, (inverse * demand[rows]).sum(axis=1))
        if uses.sum() - (best * demand).sum() <= max(TOLERANCE * uses.sum(), 0.5):
            break
        prices = np.zeros(len(demand))
        prices[rows] = inverse.sum(axis=0)
        for share in (SMOOTHING, 0.0):
            mean = np.maximum(0, share * best + (1 - share) * prices)
            worth, pattern = price_pattern(mean, demand, capacity)
            if worth > 0 and (mean * demand).sum() / worth > (best * demand).sum():
                best = mean / worth
            gain = sum(prices[i] * n for i, n in pattern.items()) - 1
            if gain > 1e-9:
                break
        else:
            break
        column = np.zeros(len(rows))
        for length, copies in pattern.items():
            column[at[length]] = copies
        direction = (inverse * column).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratios = np.where(direction > 1e-9, uses / direction, np.inf)
        leave = int(ratios.argmin())
        if not np.isfinite(ratios[leave]):
            break
        patterns.append(pattern)
        basis[leave] = len(patterns) - 1
        pivot = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        step = ratios[leave]
        uses = np.maximum(0, uses - direction * step)
        uses[leave] = step
    return [(patterns[b], float(u)) for b, u in zip(basis, uses, strict=True) if u > 1e-9]


def _inverted(matrix: np.ndarray) -> np.ndarray:
    """Gauss and Jordan's inverse by rows. Nothing here calls a threaded library: its
    threads and the driver's others slow each other down a thousandfold."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        both -= factors[:, None] * both[k]
    return both[:, n:]


def _matrix(patterns: list[dict[int, int]], basis: list[int], at: dict[int, int]) -> np.ndarray:
    matrix = np.zeros((len(basis), len(basis)))
    for column, b in enumerate(basis):
        for length, copies in patterns[b].items():
            matrix[at[length], column] = copies
    return matrix


def plan_sequences(demand: list[int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, sequences cut by it): whole uses of the program's patterns, the rest
    first-fit-decreasing over the histogram. Every piece is in exactly one place."""
    left = np.array(demand, dtype=np.int64)
    if not left.sum():
        return []
    plan = []
    for pattern, use in sorted(column_generation(left, capacity), key=lambda p: -p[1]):
        times = min([int(use + 1e-6), *(int(left[i]) // n for i, n in pattern.items())])
        if times > 0:
            plan.append((pattern, times))
            for i, n in pattern.items():
                left[i] -= n * times
    while left.any():
        room, pattern = capacity, {}
        for i in np.flatnonzero(left)[::-1]:
            n = min(int(left[i]), room // (int(i) + 1))
            if n:
                pattern[int(i)] = n
                room -= n * (int(i) + 1)
        times = min(int(left[i]) // n for i, n in pattern.items())
        plan.append((pattern, times))
        for i, n in pattern.items():
            left[i] -= n * times
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """pieces with sequence_id and offset. Full pieces are sequences of their own;
    the others follow the plan."""
    spark = pieces.sparkSession
    bins = capacity // grain
    kind = F.when(F.col("length") == capacity, F.lit(-1)).otherwise(F.ceil(F.col("length") / grain).cast("int") - 1)
    binned = pieces.withColumn("_bin", kind)
    held = {r[0]: r[1] for r in binned.groupBy("_bin").count().collect()}
    ranked = max(RANKED, sum(held.values()) // PARTS_MOST)
    salts = [max(1, -(-held.get(b, 0) // ranked)) for b in range(-1, bins)]
    parts = F.get(F.from_json(F.lit(json.dumps(salts)), "array<int>"), F.col("_bin") + 1)
    place = F.xxhash64("doc_id", "start", "ids_crc32", *(["_copy"] if "_copy" in pieces.columns else []))
    salted = binned.withColumn("_salt", F.pmod(place, parts).cast("int"))
    counts = {(r[0], r[1]): r[2] for r in salted.groupBy("_bin", "_salt").count().collect()}
    demand = [held.get(b, 0) for b in range(bins)]
    first, bases = {}, []
    for b in range(-1, bins):
        run = 0
        for s in range(salts[b + 1]):
            first[b, s] = run
            run += counts.get((b, s), 0)
        bases.append([first[b, s] for s in range(salts[b + 1])])
    full = held.get(-1, 0)
    slots, sequence, taken = [], full, [0] * bins
    for pattern, times in plan_sequences(demand, bins):
        place = 0
        for b, copies in sorted(pattern.items(), reverse=True):
            slots.append((b, taken[b], taken[b] + copies * times, copies, sequence, place))
            taken[b] += copies * times
            place += copies
        sequence += times
    by_bin: list[list[tuple]] = [[] for _ in range(bins)]
    for slot in slots:
        by_bin[slot[0]].append(slot[1:])
    told = json.dumps([[dict(zip("abnsp", x, strict=True)) for x in rows] for rows in by_bin])
    table = F.from_json(F.lit(told), "array<array<struct<a:bigint,b:bigint,n:bigint,s:bigint,p:bigint>>>")
    starts = F.from_json(F.lit(json.dumps(bases)), "array<array<bigint>>")
    inside = Window.partitionBy("_bin", "_salt").orderBy("doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.get(F.get(starts, F.col("_bin") + 1), F.col("_salt")) + F.row_number().over(inside) - 1)
    slot = F.filter(F.get(table, F.col("_bin")), lambda x: (x["a"] <= F.col("_rank")) & (F.col("_rank") < x["b"]))[0]
    placed = ranked.withColumn("_slot", F.when(F.col("_bin") >= 0, slot)).withColumns(
        {
            "sequence_id": F.when(F.col("_bin") < 0, F.col("_rank")).otherwise(F.expr("_slot.s + (_rank - _slot.a) div _slot.n")),
            "_place": F.when(F.col("_bin") < 0, F.lit(0)).otherwise(F.expr("_slot.p + (_rank - _slot.a) % _slot.n")),
        }
    )
    order = Window.partitionBy("sequence_id").orderBy("_place")
    before = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return placed.withColumn("offset", before).drop("_bin", "_salt", "_rank", "_slot", "_place", "_copy")


def pack_documents(df: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document, with its place. The tokens are made once
    and kept in a durable table."""
    pieces = token_pieces(df, path, pattern, capacity, with_ids).withColumn("_copy", F.monotonically_increasing_id())
    return pack(durable(pieces, "token-pieces", texts=True), capacity)
