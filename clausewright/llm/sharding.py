"""Consistent-hash sharding with virtual nodes and bounded loads.

The ring is cut into SLICES equal slices; every shard owns VIRTUAL_NODES points on
it. A row's place is a hash of its text, so equal texts share a place and stay
together while they fit. A slice belongs to the first point clockwise. A shard
takes at most (1 + slack) of the mean load; what overflows continues clockwise to
the next shard with room. Slices heavier than one SLICES-th of the whole, such as
a text that a third of the rows repeat, are cut further by row id, and what is still
heavier then, as where rows are repeated in full, by the place of rows in the table
of sizes. So no unit that moves is larger than about twice that unless it is one row.

Only the loads of at most 3 * SLICES units reach the driver, whatever the input.

Defined cases: a null text counts as empty (size 1); a null id hashes as null;
rows repeated in full are shards' rows like any other and get slots of their own, and
are alike, so that it does not matter which of them is where; texts of any length are
measured whole;
a row larger than a shard's capacity goes to the shard with the least load; an
empty table gives no rows. Columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm.durable import durable

SLICE_BITS = 15
SLICES = 1 << SLICE_BITS
VIRTUAL_NODES = 64
SLACK = 0.002


def ring(shards: int, virtual_nodes: int = VIRTUAL_NODES) -> list[tuple[int, int]]:
    """Sorted (slice, shard) points; adding a shard adds points and moves none."""
    points: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.sha256(f"shard {shard} node {node}".encode()).digest()
            points.setdefault(int.from_bytes(digest[:8], "big") % SLICES, shard)
    return sorted(points.items())


def clockwise(points: list[tuple[int, int]], place: int) -> list[int]:
    """Shards in the order in which a walk from place meets them first."""
    start = bisect.bisect_left(points, (place, -1))
    return list(dict.fromkeys(shard for _, shard in points[start:] + points[:start]))


def place_units(loads: dict[int, int], slice_of: dict[int, int], shards: int, slack: float = SLACK) -> dict[int, int]:
    """Unit -> shard. Large units choose first; each stays at home if its home has
    room, else walks on; a unit for which no shard has room goes to the emptiest."""
    points = ring(shards)
    room = dict.fromkeys(range(shards), (1 + slack) * sum(loads.values()) / shards)
    walks: dict[int, list[int]] = {}
    placed: dict[int, int] = {}
    order = sorted(loads, key=lambda u: (-loads[u], u))
    rest = []
    for unit in order:
        walk = walks.setdefault(slice_of[unit], clockwise(points, slice_of[unit]))
        if loads[unit] <= room[walk[0]]:
            placed[unit] = walk[0]
            room[walk[0]] -= loads[unit]
        else:
            rest.append(unit)
    for unit in rest:
        walk = walks[slice_of[unit]]
        shard = next((s for s in walk if loads[unit] <= room[s]), max(walk, key=lambda s: (room[s], -s)))
        placed[unit] = shard
        room[shard] -= loads[unit]
    return placed


def _lookup(values: list[int], index: Column) -> Column:
    """values[index] from one folded literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")[index]


def shard_rows(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slack: float = SLACK) -> DataFrame:
    """One row per input row: id, size (UTF-8 bytes plus 1), text_crc32, shard, slot.
    Shards' sizes are near equal; slots are gapless from 0 within a shard."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = durable(
        df.select(
            F.col(id_col).alias("_id"),
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.shiftrightunsigned(F.xxhash64(text), 64 - SLICE_BITS).cast("int").alias("_slice"),
            F.monotonically_increasing_id().alias("_row"),  # a value of the written table, whatever runs again later
        ),
        "shard-sizes",
    )
    loads = {r[0]: r[1] for r in rows.groupBy("_slice").agg(F.sum("size")).collect()}
    total = sum(loads.values())
    parts = [max(1, -(-loads.get(i, 0) * SLICES // max(1, total))) for i in range(SLICES)]
    first, slice_of = [], {}
    for i, n in enumerate(parts):
        first.append(len(slice_of))
        slice_of |= {len(slice_of) + k: i for k in range(n)}
    within = F.pmod(F.xxhash64("_id", F.lit("within a slice")), _lookup(parts, F.col("_slice")))
    units = rows.withColumn("_unit", (_lookup(first, F.col("_slice")) + within).cast("int"))
    most = 2 * max(1, total // SLICES)
    heavy = units.groupBy("_unit").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).filter((F.col("size") > most) & (F.col("n") > 1))
    cuts = [1] * len(slice_of)
    for unit, size, n in heavy.collect():  # at most SLICES / 2 of them
        cuts[unit] = min(n, -(-size * SLICES // total))
    starts, slice_of_part = [], {}
    for unit, n in enumerate(cuts):
        starts.append(len(slice_of_part))
        slice_of_part |= {len(slice_of_part) + k: slice_of[unit] for k in range(n)}
    if heavy_units := len(slice_of_part) > len(slice_of):
        part = F.pmod(F.xxhash64("_row"), _lookup(cuts, F.col("_unit")))
        units = units.withColumn("_unit", (_lookup(starts, F.col("_unit")) + part).cast("int"))
    slice_of = slice_of_part if heavy_units else slice_of
    counted = {r[0]: (r[1], r[2]) for r in units.groupBy("_unit").agg(F.sum("size"), F.count(F.lit(1))).collect()}
    placed = place_units({u: s for u, (s, _) in counted.items()}, slice_of, shards, slack)
    taken = [0] * shards
    shard_of, base = [0] * len(slice_of), [0] * len(slice_of)
    for unit in sorted(counted):
        shard_of[unit], base[unit] = placed[unit], taken[placed[unit]]
        taken[placed[unit]] += counted[unit][1]
    inside = Window.partitionBy("_unit").orderBy("_id", "text_crc32", "_row")
    return units.select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        _lookup(shard_of, F.col("_unit")).cast("int").alias("shard"),
        (_lookup(base, F.col("_unit")) + F.row_number().over(inside) - 1).alias("slot"),
    )
