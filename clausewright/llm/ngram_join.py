"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its word shingles, hashed to 64 bits; documents with equal
sets are one node. All sets are sorted by one global order: shingles that many
documents share last, the most frequent at the very end, others by hash. Sets of
sizes x and y whose likeness is t or more share need(x, y) = ceil(t (x + y) / (1 + t))
shingles, hence at least m of the first x - need + m and y - need + m, for every m up
to need. With m = 1 this is the usual prefix filter; each document lengthens its
prefix, and asks for as many more shared shingles, where the counts of its prefix'
shingles say that this costs less than verifying what a short prefix lets through.

need grows with the partner's size. So the smaller document of a pair offers only
the prefix that a partner of its own size needs, under its size class, and the larger
one asks in each class for just the prefix that this class needs. A passage that many
documents share is then met only by documents which it makes alike, whatever else
they hold: pairs are filtered by the join's key, before they exist.

Near copies are joined first. Each node is verified against one node of a bucket
(nodes that share a prefix shingle): that of its buckets' stars with which it shares most. Groups of near copies
become one component at a cost linear in their size. Then every pair that is still in
different components and passes the filters is verified exactly, so no link between
components is lost; pairs within one component need no look, as they cannot change
it. Links are joined into components without the driver.

The order's list of frequent shingles is the only thing that is sent to all tasks; it
has at most FREQUENT_MOST entries by construction (a share of the corpus' shingles).
It decides what the join costs, never what it returns.

Defined cases: a null text, an empty one or one without words has an empty set and is
linked with nothing; a text with fewer words than a shingle is one shingle; texts are
read whole, however long, and hashed in blocks; repeated rows and equal sets are one
node; rows that share an id keep their own sets; a null id
counts as the largest when the least id of a component is sought; an empty table gives
no rows; other columns are ignored, whatever their names. Hashes have 64 bits: among 10^9 documents two
different sets are taken for equal with a probability of about 0.03.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.llm.components import connected_components
from clausewright.llm.durable import discard, durable
from clausewright.llm.memory import giving_back

#: Shared prefix shingles that a document may ask for.
MATCHES = (1, 2, 4, 8, 16)
#: Cost of verifying a candidate in units of reading one bucket entry.
VERIFY_COST = 20.0
FREQUENT_MOST = 400_000
#: A part of the corpus in which shingles are counted; those that two documents of it
#: share go into the corpus' counts. Of P parts, a shingle dealt evenly is seen by
#: some part once about sqrt(2 P) documents hold it.
COUNTED_SHINGLES = 1_500_000
FREQUENT_IN_PART = 2
#: Ratio of the bounds of neighbouring size classes.
CLASS_RATIO = 1.05
#: Pairs with one node that a task verifies.
PAIRS_OF_ONE = 512
#: Shingles of sets or prefixes that a task reads.
TASK_SHINGLES = 1_000_000
#: Words of 64 bits by which texts are left out that no pair needs.
FILTER_WORDS = 1 << 19
#: Pairs left for an entry from which the first round of stars pays, and a later one.
STARS_PAY = (1, 16)

_MULTIPLIER = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of a text that are hashed at once, and of a word that is hashed with others.
BLOCK, LONG_WORD = 1 << 20, 1 << 12
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


@functools.lru_cache(maxsize=4)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2 ** 64, for 2 ** bits
    places."""
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    return tuple(np.concatenate([[np.uint64(1)], np.full((1 << bits) - 1, np.uint64(x))]).cumprod(dtype=np.uint64) for x in (_MULTIPLIER, inverse))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _word_hashes(raw: bytes) -> np.ndarray:
    """A hash per word: a polynomial in its bytes. Sums of byte times power over a
    block give all its words' at once, moved to power 0 by the inverse's power. Words
    longer than LONG_WORD are hashed one by one, so that blocks stay small."""
    data = np.frombuffer(raw, np.uint8)
    edges = np.diff(_BLANK[data].astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sizes = ends - starts
    out = np.zeros(len(starts), np.uint64)
    blocks = np.searchsorted(starts, np.arange(0, len(data) + BLOCK, BLOCK))
    for first, last in zip(blocks[:-1], blocks[1:], strict=True):
        if first == last:
            continue
        base, begin = starts[first], starts[first:last] - starts[first]
        end = begin + np.minimum(sizes[first:last], LONG_WORD)
        block = data[base : base + end[-1]]
        up, down = _powers(max(12, len(block).bit_length()))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum((block + np.uint64(1)) * up[: len(block)], out=sums[1:])
        out[first:last] = _mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))
    for k in np.flatnonzero(sizes > LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(raw[starts[k] : ends[k]])
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes. Words are runs of anything but blanks, tabs
    and line ends, with A-Z lower-cased."""
    if not text:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        hashes = _word_hashes(text.encode().lower())
        if not len(hashes):
            return hashes
        n = max(1, len(hashes) - size + 1)
        joined = np.zeros(n, np.uint64)
        for i in range(min(size, len(hashes))):
            joined = joined * np.uint64(_MULTIPLIER) + hashes[i : i + n]
        if len(hashes) < size:
            joined += np.uint64(len(hashes))
        return np.unique(_mixed(joined))


def set_hash(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _signed(shingles: np.ndarray) -> np.ndarray:
    return shingles.view(np.int64)


def _sets_and_counts(df: DataFrame, size: int) -> DataFrame:
    """One row per document (id, text_hash, node, n) and, per part of the corpus, rows
    of its shared shingles (token, n). df: id, text, text_hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part: list[np.ndarray] = []
        held = 0

        def told(ids: list, hashes: list, nodes: list, tokens: list, counts: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (ids, hashes, nodes, tokens, counts)], names=["id", "text_hash", "node", "token", "n"]
            )

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(part), return_counts=True)
            often = counts >= FREQUENT_IN_PART
            none = [None] * int(often.sum())
            return told(none, none, none, _signed(tokens[often]), counts[often])

        for batch in (b.slice(start, 1000) for b in batches for start in range(0, b.num_rows, 1000)):
            nodes, counts = [], []
            for text in batch.column(1).to_pylist():
                shingles = shingle_set(text, size)
                nodes.append(set_hash(shingles) if len(shingles) else None)
                counts.append(len(shingles))
                part.append(shingles)
                held += len(shingles)
                if held >= COUNTED_SHINGLES:
                    yield frequent()
                    part, held = [], 0
            yield told(batch.column(0), batch.column(2), nodes, [None] * len(nodes), counts)
        if part:
            yield frequent()

    return df.select("id", "text", "text_hash").mapInArrow(giving_back(run), "id long, text_hash long, node long, token long, n long")


def _frequent(counted: DataFrame, rows: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Often shared shingles, sorted, and the step of each one's count: all from the
    least step on from which there are at most FREQUENT_MOST. Steps are eighths of the
    binary logarithm, so a few hundred numbers find the least one and no task ranks
    all shingles. rows: of counted."""
    sums = counted.filter("token is not null").groupBy("token").agg(F.sum("n").alias("n"))
    sums = durable(sums.withColumn("step", F.floor(8 * F.log2("n")).cast("int")), "shingle-sums", rows)
    least, held = None, 0
    for step, n in sorted(((r[0], r[1]) for r in sums.groupBy("step").count().collect()), reverse=True):
        held += n
        if held > FREQUENT_MOST:
            break
        least = step
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    rows = sums.filter(F.col("step") >= least).select("token", "step").toArrow()
    discard(sums.sparkSession, sums)
    tokens = np.ascontiguousarray(rows.column(0).to_numpy()).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], rows.column(1).to_numpy()[order]


def in_order(shingles: np.ndarray, late: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """A sorted set in the global order: frequent shingles last, by step, then hash."""
    if not len(late):
        return shingles
    at = np.minimum(np.searchsorted(late, shingles), len(late) - 1)
    is_late = late[at] == shingles
    last = shingles[is_late]
    return np.concatenate([shingles[~is_late], last[np.argsort(steps[at[is_late]], kind="stable")]])


def _prefixes(df: DataFrame, size: int, share: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """node, n and the first shingles of each set: as many as the longest prefix
    needs. A part tells each node once."""
    longest = MATCHES[-1]
    sent = df.sparkSession.sparkContext.broadcast(frequent)  # at most FREQUENT_MOST entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, steps = sent.value
        for texts in _slices(batches, 1000):
            nodes, counts, prefixes = [], [], []
            for text in dict.fromkeys(texts):
                shingles = shingle_set(text, size)
                n = len(shingles)
                if n:
                    nodes.append(set_hash(shingles))
                    counts.append(n)
                    prefixes.append(_signed(in_order(shingles, late, steps)[: n - -(-share * n // 100) + longest]))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((nodes, counts, prefixes), kinds, strict=True)], names=["node", "n", "prefix"])

    return df.select("text").mapInArrow(giving_back(run), "node long, n int, prefix array<long>")


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list]:
    """Values of the first column, few at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.column(0).slice(start, rows).to_pylist()


def needed(share: int, a: str, b: str) -> str:
    """SQL: the shingles that sets of two sizes must share."""
    return f"(({share} * ({a} + {b}) + {99 + share}) div {100 + share})"


def size_class(n: Column) -> Column:
    return F.floor(F.log(n) / math.log(CLASS_RATIO)).cast("int")


def _entries(prefixes: DataFrame, share: int, tokens: int | None = None) -> DataFrame:
    """token, node, n, pos (place in the order), rank (place among tokens that other
    nodes have too), m (what the node asks for), offers (whether a partner of the
    node's own size needs the token), met (other nodes in its buckets). Tokens of one
    node only are left out, as they can match nothing. tokens: of all prefixes."""
    nodes = durable(prefixes.groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")), "nodes", tokens, TASK_SHINGLES // 4, texts=True)
    first = F.col("n") - F.expr(needed(share, "n", "n"))
    told = nodes.select("node", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("level", F.greatest(F.lit(1), F.col("pos") - first + 1))
    counts = told.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = told.join(counts, "token")
    mine = Window.partitionBy("node")
    hits = {m: F.sum(F.when(F.col("level") <= m, F.col("df") - 1).otherwise(0)).over(mine) for m in MATCHES}
    costs = F.array(*[F.struct((hits[m] * (1 + VERIFY_COST / m)).alias("cost"), F.lit(m).alias("m")) for m in MATCHES])
    allowed = F.filter(costs, lambda c: (c["m"] == 1) | (c["m"] <= F.ceil(F.col("n") * share / 100)))
    rank = F.row_number().over(mine.orderBy("pos"))
    chosen = shared.withColumns({"m": F.array_min(allowed)["m"], "met": hits[1], "rank": rank})
    asked = chosen.filter(f"pos < n - (({share} * n + 99) div 100) + m").withColumn("offers", F.col("level") <= F.col("m"))
    entries = durable(asked.select("token", "node", "n", "pos", "rank", "m", "offers", "met"), "entries", tokens)
    discard(nodes.sparkSession, nodes)
    return entries


def _open_entries(entries: DataFrame, rows: int | None = None) -> tuple[DataFrame, int, int]:
    """Entries of buckets in which components can still meet, with the least and the
    largest size that the bucket offers (low, high); their number, and the pairs of an
    offered and any entry of different components in them. Without a label each node is
    its own component. rows: of entries."""
    size = F.when(F.col("offers"), F.col("n"))
    bounds = F.min(size).alias("low"), F.max(size).alias("high")
    c, o = F.count(F.lit(1)), F.count_if("offers")
    if "label" in entries.columns:
        sizes = entries.groupBy("token", "label").agg(c.alias("c"), o.alias("o"), *bounds)
        pairs = F.sum("c") * F.sum("o") - F.sum(F.col("c") * F.col("o"))
        per = sizes.groupBy("token").agg(c.alias("labels"), F.sum("o").alias("offered"), pairs.alias("pairs"), F.min("low").alias("low"), F.max("high").alias("high"))
    else:
        per = entries.groupBy("token").agg(c.alias("labels"), o.alias("offered"), (c * o - o).alias("pairs"), *bounds)
        entries = entries.withColumn("label", F.col("node"))
    mixed = durable(per.filter("labels > 1 and offered > 0").select("token", "pairs", "low", "high"), "open-buckets", rows)
    left = durable(entries.drop("low", "high").join(mixed.select("token", "low", "high"), "token"), "open-entries", rows and 2 * rows)
    pairs = int(mixed.agg(F.sum("pairs")).first()[0] or 0)
    discard(entries.sparkSession, mixed)
    return left, left.count(), pairs


def _star_pairs(entries: DataFrame, share: int, turn: int) -> DataFrame:
    """Each node with the star of another component that it shares most tokens with,
    if so many can be enough. A bucket's star is at first its node that meets most
    others, in later rounds one chosen by hash."""
    rank = F.col("met") if turn == 0 else F.xxhash64("node", F.lit(turn)).cast("double")
    star = F.max_by(F.struct("node", "n", "pos", "label"), F.struct(rank, F.col("node")))
    stars = entries.groupBy("token").agg(star.alias("star"))
    pair = f"star.label <> label and 100 * least(n, star.n) >= {share} * greatest(n, star.n)"
    met = entries.join(stars, "token").filter(pair).withColumn("rest", F.expr("least(n - 1 - pos, star.n - 1 - star.pos)"))
    counted = met.groupBy("node", F.col("star.node").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), F.max("rank").alias("rank"), F.max("rest").alias("rest"), F.first("n").alias("n"), F.first("star.n").alias("star_n")
    )
    enough = counted.filter(f"rank + rest >= {needed(share, 'n', 'star_n')}")
    return enough.groupBy(F.col("node").alias("a")).agg(F.max_by("b", F.struct("shared", "b")).alias("b"))


def _meetings(entries: DataFrame, share: int) -> DataFrame:
    """A row for each prefix shingle that two nodes (larger a, smaller b) of different
    components share, where it can belong to a likeness of share hundredths."""
    names = ("node", "n", "pos", "rank", "m", "label")
    least = f"(({share} * n + 99) div 100)"
    low, high = F.expr(least), F.col("n")
    asking = entries
    if "low" in entries.columns:  # only sizes that the bucket offers
        asking = entries.filter(f"high >= {least} and low <= n")
        low, high = F.greatest(low, "low"), F.least(high, "high")
    asking = asking.withColumn("class", F.explode(F.sequence(size_class(low), size_class(high))))
    floor = f"greatest({least}, cast(floor(pow({CLASS_RATIO}D, class)) as int))"
    asking = asking.filter(f"pos < n - {needed(share, 'n', floor)} + m")
    offered = entries.filter("offers").withColumn("class", size_class(F.col("n")))
    a = asking.select("token", "class", *[F.col(c).alias(f"{c}_a") for c in names])
    b = offered.select("token", "class", *[F.col(c).alias(f"{c}_b") for c in names])
    need, rest, m = needed(share, "n_a", "n_b"), "least(n_a - 1 - pos_a, n_b - 1 - pos_b)", "least(m_a, m_b)"
    fits = (
        f"label_a <> label_b and (n_b < n_a or (n_b = n_a and node_b < node_a)) and 100 * n_b >= {share} * n_a"
        f" and pos_a < n_a - {need} + {m} and pos_b < n_b - {need} + {m} and least(rank_a, rank_b) + {rest} >= {need}"
    )
    return a.join(b, ["token", "class"]).filter(fits)


def _cross_pairs(entries: DataFrame, share: int) -> DataFrame:
    """Pairs in different components that pass the length, multi-match and positional
    filters. Behind its last shared prefix shingle a pair shares at most what is left
    of the shorter rest; before it, just the shared ones seen, as the order is one."""
    need, rest, m = needed(share, "n_a", "n_b"), "least(n_a - 1 - pos_a, n_b - 1 - pos_b)", "least(m_a, m_b)"
    met = _meetings(entries, share)
    counted = met.groupBy(F.col("node_a").alias("a"), F.col("node_b").alias("b")).agg(
        F.count(F.lit(1)).alias("shared"), *[F.max(c).alias(c) for c in ("pos_a", "pos_b", "n_a", "n_b")], F.max(F.expr(m)).alias("m")
    )
    return counted.filter(f"shared >= m and shared + {rest} >= {need}").select("a", "b")


def _verified(pairs: DataFrame, docs: DataFrame, firsts: DataFrame, size: int, share: int, reads: int | None = None) -> DataFrame:
    """Those pairs (a, b) whose sets' likeness is at least share hundredths. Only sets
    that occur in pairs are built, once, and they go when the links are written: b's
    set goes to where its pairs are checked, and a's to each of its pairs. Pairs of one
    b are spread over copies of its set, one for every PAIRS_OF_ONE of them. reads:
    rows that finding the pairs takes."""
    spark = docs.sparkSession
    pairs = durable(pairs, "pairs", reads)
    wanted = durable(_roles(pairs).join(firsts, "node").select("first.id", "first.text_hash", "roles"), "roles", firsts.count() + 4 * pairs.count())
    sets = durable(_sets_of(docs, wanted, size), "sets", texts=True)
    reads = sets.agg(F.sum("read")).first()[0] or 0
    role = sets.select("shingles", F.explode("roles").alias("role"))
    left = role.filter("role.a is not null").select("role.a", "role.b", "role.part", F.col("shingles").alias("sa"))
    right = role.filter("role.a is null").select("role.b", "role.part", F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    both = left.join(right, ["b", "part"])
    links = durable(both.filter(100 * shared >= share * (F.size("sa") + F.size("sb") - shared)).select("a", "b"), "links", reads, TASK_SHINGLES)
    discard(spark, pairs, wanted, sets)
    return links


def _roles(pairs: DataFrame) -> DataFrame:
    """node, roles: where its set is needed, as structs (a, b, part); a is null where
    the set is b's. A node with many roles has several rows."""
    parts = lambda c: pairs.groupBy(c).agg(F.ceil(F.count(F.lit(1)) / PAIRS_OF_ONE).cast("int").alias(f"parts_{c}"))
    of = lambda c, other: F.pmod(F.xxhash64(other), F.col(f"parts_{c}")).cast("int")
    asked = pairs.join(parts("b"), "b").join(parts("a"), "a").select(F.col("a").alias("node"), of("a", "b").alias("row"), F.struct("a", "b", of("b", "a").alias("part")).alias("role"))
    copies = parts("b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts_b") - 1)).alias("part"))
    given = copies.select(F.col("b").alias("node"), (-1 - F.floor(F.col("part") / PAIRS_OF_ONE)).cast("int").alias("row"), F.struct(F.lit(None).cast("bigint").alias("a"), "b", "part").alias("role"))
    return asked.union(given).groupBy("node", "row").agg(F.collect_list("role").alias("roles")).select("node", "roles")


def _likely(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of df (id, text_hash) that may be wanted: all that are and, of others, the
    few whose bit a wanted one has set. So most texts are left out where they are read.
    The bits are FILTER_WORDS words at most, and decide costs only."""
    key = F.xxhash64("id", "text_hash").alias("_key")
    at, bit = F.expr(f"shiftrightunsigned(_key, 6) & {FILTER_WORDS - 1}").alias("_at"), F.expr("shiftleft(1L, cast(_key & 63 as int))").alias("_bit")
    words = wanted.select(key).select(at, bit).groupBy("_at").agg(F.bit_or("_bit").alias("_bits"))
    return df.select("*", key).select(*df.columns, at, bit).join(F.broadcast(words), "_at").filter("(_bits & _bit) <> 0").select(*df.columns)


def _sets_of(df: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """roles, shingles, read (shingles that all roles read) for every wanted row (id,
    text_hash, roles). Rows repeated in full are one."""
    me = [F.coalesce("id", F.lit(0)).alias("_id"), F.col("id").isNull().alias("_none"), "text_hash"]
    keys = ["_id", "_none", "text_hash"]
    texts = _likely(df.select("id", "text_hash", "text"), wanted).select(*me, "text").groupBy(*keys).agg(F.first("text").alias("text"))
    chosen = texts.join(wanted.select(*me, "roles"), keys).select("text", "roles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                rows = batch.slice(start, 500)
                found = [_signed(shingle_set(text, size)) for text in rows.column(0).to_pylist()]
                read = [len(s) * k for s, k in zip(found, pa.compute.list_value_length(rows.column(1)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(found, pa.list_(pa.int64())), pa.array(read, pa.int64())], names=["roles", "shingles", "read"])

    kind = wanted.schema["roles"].dataType
    return chosen.mapInArrow(giving_back(run), T.StructType([T.StructField("roles", kind), T.StructField("shingles", T.ArrayType(T.LongType())), T.StructField("read", T.LongType())]))


def _with_component(entries: DataFrame, labels: DataFrame) -> DataFrame:
    return entries.drop("label").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _node_labels(docs: DataFrame, counted: DataFrame, rows: int, firsts: DataFrame, size: int, share: int) -> DataFrame:
    """node, label of every node that is linked with another. rows: of counted."""
    spark = docs.sparkSession
    n_docs, shingles = (int(x or 0) for x in counted.filter("node is not null").agg(F.count(F.lit(1)), F.sum("n")).first())
    tokens = shingles * (100 - share) // 100 + n_docs * MATCHES[-1]
    found = _entries(_prefixes(docs, size, share, _frequent(counted, rows)), share, tokens)
    links = None
    left, n_left, pairs = _open_entries(found, found.count())
    discard(spark, found)
    turn, before = 0, None
    while pairs > STARS_PAY[turn > 0] * n_left and (before is None or pairs * 2 <= before):  # the rest is exact in any case
        new = _verified(_star_pairs(left, share, turn), docs, firsts, size, share, 2 * n_left)
        links = new if links is None else links.union(new)
        fresh, n_left, now = _open_entries(_with_component(left, connected_components(links, links.count())), n_left)
        discard(spark, left)
        left, before, pairs, turn = fresh, pairs, now, turn + 1
    last = _verified(_cross_pairs(left, share), docs, firsts, size, share, n_left + pairs)
    links = last if links is None else links.union(last)
    labels = durable(connected_components(links, links.count()), "node-labels", n_docs)
    discard(spark, left, links)
    return labels


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 80) -> DataFrame:
    """One row per document: id, text_hash, n and, of the rows with its set and of
    those that links reach from it, the first: structs (none, id, text_hash), least
    id first, null ids last. Both are null for documents without words."""
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash"))
    counted = durable(_sets_and_counts(docs, size), "shingle-counts", texts=True)
    rows = counted.filter("token is null").select("id", "text_hash", "node", "n")
    me = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    n_counted = counted.count()
    firsts = durable(rows.filter("node is not null").groupBy("node").agg(F.min(me).alias("first")), "firsts", n_counted)
    labels = _node_labels(docs, counted, n_counted, firsts, size, share)
    placed = durable(firsts.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "placed", 2 * n_counted)
    tops = placed.groupBy("label").agg(F.min("first").alias("component"))
    told = placed.join(tops, "label").select("node", F.col("first").alias("class"), "component")
    discard(df.sparkSession, labels)
    empty = rows.filter("node is null").select("id", "text_hash", "n", *[F.lit(None).cast(told.schema["class"].dataType).alias(c) for c in ("class", "component")])
    return rows.filter("node is not null").join(told, "node").select("id", "text_hash", "n", "class", "component").unionByName(empty)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the least id that links
    reach from it, its own included), class_id (of the documents with its set)."""
    return groups(df, id_col, text_col, size, share).select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component.id", "id").alias("component_id"),
        F.coalesce("class.id", "id").alias("class_id"),
    )


def first_of_each_group(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 80) -> DataFrame:
    """The rows of df without near copies: of each component the row with the least
    id (then text hash), and every row without words. Rows are told apart by id and
    text, so a null or repeated id hides no copy; of rows that repeat the kept one,
    one stays."""
    found = durable(groups(df, id_col, text_col, size, share), "groups")
    mine = F.expr("id <=> component.id and text_hash = component.text_hash")
    kept = found.filter(mine | F.col("component").isNull()).groupBy("id", "text_hash").agg(F.count(F.lit(1)).alias("_rows"), F.first(F.col("component").isNull()).alias("_empty"))
    kept = kept.select(F.col("id").alias("_id"), F.col("text_hash").alias("_hash"), ((F.col("_rows") > 1) & ~F.col("_empty")).alias("_repeated"))
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), F.struct("*").alias("row"))
    chosen = rows.join(kept, F.col("id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")))
    once = chosen.filter("_repeated").dropDuplicates(["id", "text_hash"])
    return chosen.filter("not _repeated").unionByName(once).select("row.*")
