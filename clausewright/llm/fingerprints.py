"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A text's words are the lower-cased runs between white space; its shingles are runs
of SHINGLE words (the whole sequence, if shorter), hashed to 64 bits. The sketch
holds the K least distinct hashes in ascending order. Sketches merge: the K least of
the union of parts' sketches is the sketch of the union. From sketches follow

* the number of distinct shingles: exact below K, else (K - 1) over the K-th hash's
  rank in the hash range;
* resemblance: the share of the union's K least hashes that both sketches hold;
* containment: the share of one sketch's hashes, up to the other's reach, that the
  other holds.

Everything is built from column functions, so a sketch is a row-local projection.

Defined cases: a null text counts as empty; a text without words has the empty
sketch; two empty sketches resemble and contain each other with 1, an empty and
another with 0; repeated rows have equal sketches; rows of one id follow each other by
text hash, rows repeated in full by themselves; a null id comes first; texts of any
length are read whole; an empty table gives no rows; columns other than those named are
ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausewright.llm.durable import durable

SHINGLE = 5
K = 192
#: Buckets of one level of merging: what a task sees of a group.
MERGE_SALTS = 32
#: Bytes of text in a range of ids, and the most ranges: beyond, ranges grow and spill.
RANGE_BYTES = 32 << 20
RANGES_MOST = 1 << 16


def let(value: Column, body) -> Column:
    """body(value) with value computed once, also inside lambdas of body."""
    return F.transform(F.array(value), body)[0]


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text as an ascending array of longs."""
    words = F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), "")

    def least(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(w) - (shingle - 1), F.lit(1)))
        hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, shingle)))
        return F.when(F.size(w) > 0, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).otherwise(F.array().cast("array<bigint>"))

    return let(words, least)


def text_form(sketch_col: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash, in order."""
    return F.array_join(F.transform(sketch_col, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of what two sketches stand for."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    likeness = let(union, lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(a, b), u)) / F.size(u)))
    return F.when(a == b, F.lit(1.0)).otherwise(likeness)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b holds too."""
    reach = F.when(F.size(b) < k, F.lit((1 << 63) - 1)).otherwise(F.element_at(b, -1))
    seen = let(reach, lambda r: F.filter(a, lambda h: h <= r))
    share = let(seen, lambda s: F.when(F.size(s) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(s, b)) / F.size(s)))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(share)


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def merge(df: DataFrame, group: list[str], sketch_col: str, k: int = K) -> DataFrame:
    """One sketch a group. A group's hashes first meet by hash in MERGE_SALTS salted
    parts, each of which passes on its k least, so no task sees a whole hot group."""
    each = df.select(*group, F.explode(sketch_col).alias("_h")).withColumn("_salt", F.pmod(F.col("_h"), F.lit(MERGE_SALTS)))
    least = each.distinct()
    for part in ([*group, "_salt"], group):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy("_h"))
        least = least.withColumn("_rank", rank).filter(F.col("_rank") <= k)
    return least.groupBy(*group).agg(F.sort_array(F.collect_list("_h")).alias(sketch_col))


def _table(rows: list, kind: str) -> Column:
    """A constant of an array type; it is folded when the query is planned."""
    return F.from_json(F.lit(json.dumps(rows)), kind)


def successors(df: DataFrame, id_col: str, text_col: str, told) -> DataFrame:
    """Rows id_col, this, next, times: told(text) of each row and of the row that
    follows by id and text hash (after the last: the first), a null id first. Rows that
    are repeated in full are one row that counts times times: all but the last of them
    are followed by themselves.

    Ids are cut into ranges at quantiles, ids that fill several ranges also by text
    hash. A range's first row is also sent to the range before it, which thus knows its
    own successor, and no task sees more than its range. Only ranges' bounds reach the
    driver, at most RANGES_MOST of them."""
    least = -(1 << 63)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("_id"), text.alias("this")).withColumns({"k": F.coalesce(F.col("_id").cast("bigint"), F.lit(least)), "h": F.xxhash64("this"), "times": F.lit(1).cast("bigint")})
    size = rows.agg(F.sum(F.octet_length("this"))).first()[0] or 0
    ranges = min(RANGES_MOST, max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES)))
    shares = _table([i / ranges for i in range(1, ranges)] or [0.5], "array<double>")
    quantiles = Counter(rows.agg(F.percentile_approx("k", shares, 10 * ranges)).first()[0] or [])
    cuts = sorted({(k, least + j * (1 << 64) // n) for k, n in quantiles.items() for j in range(n)})
    repeated = durable(rows.groupBy("_id", "h").agg(F.count(F.lit(1)).alias("_times")).filter("_times > 1").withColumnsRenamed({"_id": "_i", "h": "_h"}), "repeated")
    if not repeated.isEmpty():
        same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("h") == F.col("_h"))
        once = rows.drop("times").join(repeated.withColumnRenamed("_times", "times"), same).drop("_i", "_h").dropDuplicates(["_id", "h"])
        rows = rows.join(repeated, same, "left_anti").unionByName(once)
    of = _range_of(cuts)
    key = F.struct("k", "h")
    firsts = dict(sorted((r[0], (r[1].k, r[1].h)) for r in rows.groupBy(of(key).alias("r")).agg(F.min(key)).collect()))
    held = list(firsts) or [0]
    before = {r: held[i - 1] for i, r in enumerate(held)}
    pair = lambda x: {"k": x[0], "h": x[1]}
    first_key = _table([pair(firsts.get(r, (0, 0))) for r in range(len(cuts) + 1)], f"array<{_KEY}>")
    previous = _table([before.get(r, 0) for r in range(len(cuts) + 1)], "array<int>")
    place = lambda n, r: F.struct(n.cast("int").alias("copy"), r.alias("to"))
    own = place(F.lit(0), F.col("_range"))
    wrap = F.when(F.col("_range") == held[0], 2).otherwise(1)
    sent = (
        rows.withColumn("_range", of(key))
        .withColumn("_sent", F.explode(F.when(key == F.get(first_key, F.col("_range")), F.array(own, place(wrap, F.get(previous, F.col("_range"))))).otherwise(F.array(own))))
        .withColumns({"_copy": F.col("_sent.copy"), "_range": F.col("_sent.to")})
        .drop("_sent")
        .repartitionById(len(cuts) + 1, F.col("_range"))
        .withColumn("this", told(F.col("this")))
    )
    order = Window.partitionBy("_range").orderBy(F.col("_copy") == 2, "k", "h")
    met = sent.withColumn("_next", F.lead("this").over(order)).filter("_copy = 0")
    once = F.struct(F.col("_next").alias("next"), F.lit(1).cast("bigint").alias("times"))
    self = F.struct(F.col("this").alias("next"), (F.col("times") - 1).alias("times"))
    return met.select(F.col("_id").alias(id_col), "this", F.inline(F.when(F.col("times") > 1, F.array(once, self)).otherwise(F.array(once))))


_KEY = "struct<k:bigint,h:bigint>"


def _range_of(cuts: list[tuple[int, int]]):
    """Number of cuts at or below a key, found in two steps over literal arrays."""
    if not cuts:
        return lambda key: F.lit(0)
    width = max(1, int(len(cuts) ** 0.5))
    told = [{"k": k, "h": h} for k, h in cuts]
    blocks = [told[i : i + width] for i in range(0, len(told), width)]
    heads = _table([b[0] for b in blocks], f"array<{_KEY}>")
    inner = _table(blocks, f"array<array<{_KEY}>>")

    def of(key: Column) -> Column:
        block = F.size(F.filter(heads, lambda c: c <= key))
        within = F.size(F.filter(F.get(inner, block - 1), lambda c: c <= key))
        return F.when(block == 0, 0).otherwise((block - 1) * width + within).cast("int")

    return of


def edited_text(text: Column, after: Column) -> Column:
    """The last floor(n / 2) code points of text replaced by the first as many (or
    all) of after."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Every text's sketch beside those of its edited text and of the next text."""
    rows = successors(df, id_col, text_col, lambda t: F.struct(t.alias("text"), sketch(t, k).alias("sketch")))
    edited = rows.select(id_col, "times", F.col("this.text").alias("this"), F.col("this.sketch").alias("sketch"), F.col("next.sketch").alias("next_sketch"), edited_text(F.col("this.text"), F.col("next.text")).alias("edited"))
    told = edited.withColumn("edited_sketch", sketch(F.col("edited"), k))
    found = told.select(
        id_col,
        F.length("this").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        text_form(F.col("sketch")).alias("fingerprint"),
        text_form(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("shingles_estimate"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("contained_in_edited"),
        "times",
    )
    return found.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("times"))).alias("_n")).drop("times", "_n")
