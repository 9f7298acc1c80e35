"""Clause segmentation: blocks to numbered clause trees.

Markers and numbers are column expressions. Placing a marker needs the stack of open
clauses, so one Arrow function decodes a document's markers, an array on its row; the
rest is array functions on that row again. Nothing is shuffled but by document.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clausewright.functions.markers import family_name, head_marker, head_start, priority_of, scan
from clausewright.functions.numbering import parse_marker
from clausewright.sources.blocks import SEPARATOR

BODY_RUN = 100
_NO_SPANS = "cast(array() as array<struct<start: int, end: int>>)"
PAREN = ("paren-lower", "paren-upper", "paren-num")

NODE = T.StructType(
    [
        T.StructField("ord", T.IntegerType()),
        T.StructField("marker", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("path", T.ArrayType(T.LongType())),
        T.StructField("depth", T.IntegerType()),
        T.StructField("parent", T.IntegerType()),
        T.StructField("char_start", T.IntegerType()),
        T.StructField("next_start", T.IntegerType()),
        T.StructField("child_start", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("next_block", T.IntegerType()),
        T.StructField("child_block", T.IntegerType()),
    ]
)


def candidates(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every marker of every block, numbered per document in source order."""
    found = blocks.withColumn("_lead", F.length("text") - F.length(F.regexp_replace("text", r"^\s+", ""))).select(
        key, "ord", "block_id", "char_start", "_lead", F.explode(scan(F.col("text"))).alias("m")
    )
    order = Window.partitionBy(key).orderBy("ord", "m.start")
    return found.select(
        key,
        (F.row_number().over(order) - 1).cast("int").alias("candidate"),
        "block_id",
        (F.col("char_start") + F.col("m.start")).alias("source_offset"),
        F.col("m.marker").alias("marker"),
        family_name(F.col("m.priority")).alias("family"),
        (F.col("m.start") == F.col("_lead")).alias("at_block_start"),
    )


def _with_head(blocks: DataFrame) -> DataFrame:
    """blocks with _marker ("" if there is none) and its _family, each read once."""
    return blocks.withColumn("_marker", head_marker(F.col("text"))).withColumn("_family", F.when(F.col("_marker") != "", family_name(priority_of(F.col("_marker")))))


def block_starts(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Markers that begin a block, with their numbers: all that decoding needs."""
    told = _with_head(blocks).filter("_marker <> ''").select(key, (F.col("char_start") + head_start(F.col("text"))).alias("source_offset"), F.col("_marker").alias("marker"), F.col("_family").alias("family"))
    return told.withColumn("number", parse_marker(F.col("family"), F.col("marker")))


def body_start(starts: DataFrame, lengths: DataFrame, key: str = "doc_id") -> DataFrame:
    """Offset of each document's first marker, sub-parts aside, with BODY_RUN
    characters or more to the next one or the end; null if there is none."""
    order = Window.partitionBy(key).orderBy(F.desc("source_offset")).rowsBetween(Window.unboundedPreceding, -1)  # backwards: one pass
    main = F.when(~F.col("family").isin(*PAREN), F.col("source_offset"))
    runs = starts.join(lengths.select(key, "text_length"), key).withColumn("run", F.coalesce(F.min(main).over(order), F.col("text_length")) - F.col("source_offset"))
    return runs.groupBy(key).agg(F.min(F.when(F.col("run") >= BODY_RUN, main)).alias("body_offset"))


class _Marker:
    __slots__ = ("alt", "block", "family", "kind", "offset", "path", "readings", "text")

    def __init__(self, offset: int, text: str, family: str, block: int, path: list[int], alt: list[int]) -> None:
        self.offset, self.text, self.family, self.block = offset, text, family, block
        self.path, self.alt = path, alt
        self.readings = [p for p in (path, alt) if p]
        self.kind = "decimal" if family in ("section", "hier-decimal", "decimal") else family

    def starts_sequence(self) -> bool:
        return any(p[-1] == 1 for p in self.readings)

    def follows(self, other: _Marker, skip: int) -> bool:
        return any(len(a) == len(b) and a[:-1] == b[:-1] and 1 <= b[-1] - a[-1] <= 1 + skip for a in other.readings for b in self.readings)

    def opens_under(self, other: _Marker) -> bool:
        return any(b == [*a, 1] for a in other.readings for b in self.readings)

    def adopted_by(self, top: _Marker) -> bool:
        """Numbers that belong under an open clause though they do not count on."""
        numbered = self.family in ("section", "hier-decimal")
        if top.family == "region":
            return numbered
        if top.family != "article" or len(self.path) < 2 or not top.path:
            return False
        same = self.path[0] == top.path[0]
        return (same and self.kind == "decimal") or (not same and numbered and self.starts_sequence())


def _first(markers: list[_Marker], length: int) -> int:
    """Index at which the body starts, a clause's lead-in included."""
    following, head = length, None
    for i in range(len(markers) - 1, -1, -1):
        if markers[i].family not in PAREN:
            if following - markers[i].offset >= BODY_RUN:
                head = i
            following = markers[i].offset
    if head is None:
        return 0
    begin = head
    for k in range(head - 1, -1, -1):
        if markers[k].family in PAREN:
            continue
        if markers[head].opens_under(markers[k]):
            return k
        if not markers[head].follows(markers[k], 0):
            return begin
        head = k
    return begin


def _place(stack: list[_Marker], m: _Marker) -> int | None:
    for level in range(len(stack) - 1, -1, -1):
        if stack[level].kind == m.kind and m.follows(stack[level], 1):
            return level
    if m.family in ("article", "region"):
        return 0
    if not stack:
        return None if m.family in PAREN else 0
    top = stack[-1]
    if m.opens_under(top) or m.adopted_by(top) or (m.family in PAREN and m.starts_sequence()):
        return len(stack)
    return None


def _decode(markers: list[_Marker], length: int) -> list[list]:
    """The clause nodes of one document's block-start markers, as lists in NODE's order."""
    stack: list[_Marker] = []
    opened: list[list] = []
    nodes: list[list] = []
    for m in markers[_first(markers, length) :]:
        depth = _place(stack, m) if m.path else None
        if depth is None:
            continue
        for closed in opened[depth:]:
            closed[7], closed[10] = m.offset, m.block
        del stack[depth:], opened[depth:]
        path = m.path
        if depth and m.family in ("section", "hier-decimal") and stack[0].family == "article" and path[0] != stack[0].path[0]:
            path = [stack[0].path[0], *path[1:]]
        parent = None
        if opened:
            above = opened[-1]
            parent = above[0]
            if above[8] is None:
                above[8], above[11] = m.offset, m.block
        node = [len(nodes), m.text, m.family, path, depth, parent, m.offset, None, None, m.block, None, None]
        nodes.append(node)
        stack.append(m)
        opened.append(node)
    return nodes


def decode_markers(rows: list[dict] | None, length: int) -> list[dict]:
    """The clause nodes of one document's block-start markers. next_start: where the
    next node that is no deeper starts, child_start: where the first child does, null
    if there is none; block, next_block and child_block: the blocks they start in."""
    markers = [_Marker(r["source_offset"], r["marker"], r["family"], r["block"], r["number"]["path"], r["number"]["alt"]) for r in rows or []]
    return [dict(zip(NODE.names, n, strict=True)) for n in _decode(markers, length)]


_ARROW = {T.IntegerType(): pa.int32(), T.StringType(): pa.string(), T.ArrayType(T.LongType()): pa.list_(pa.int64())}
_FIELDS = [(f.name, _ARROW[f.dataType]) for f in NODE.fields]
#: Markers that are Python objects at a time, a larger document's aside.
AT_ONCE = 20_000


def _slices(sizes: list[int]) -> list[tuple[int, int]]:
    """Runs [begin, end) of documents whose markers together are AT_ONCE at most."""
    runs, begin, held = [], 0, 0
    for i, n in enumerate(sizes):
        if i > begin and held + n > AT_ONCE:
            runs.append((begin, i))
            begin, held = i, 0
        held += n
    return [*runs, (begin, len(sizes))]


def decode_arrays(markers: pa.Array, lengths: pa.Array) -> pa.Array:
    """Nodes of each document, slice by slice: column by column they become objects and
    arrays again, so what is held beside the batch itself is one slice's objects."""
    done = []
    counts = markers.value_lengths().fill_null(0).to_pylist()
    for begin, end in _slices(counts):
        flat = markers.slice(begin, end - begin).flatten()
        number = flat.field("number")
        columns = [flat.field(c).to_pylist() for c in ("source_offset", "marker", "family", "block")]
        each = list(map(_Marker, *columns, number.field("path").to_pylist(), number.field("alt").to_pylist()))
        offsets, nodes, at = [0], [], 0
        for n, length in zip(counts[begin:end], lengths.slice(begin, end - begin).to_pylist(), strict=True):
            nodes += _decode(each[at : at + n], length)
            at += n
            offsets.append(len(nodes))
        parts = zip(*nodes, strict=True) if nodes else [()] * len(_FIELDS)
        told = pa.StructArray.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(parts, _FIELDS, strict=True)], [name for name, _ in _FIELDS])
        done.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), told))
    return done[0] if len(done) == 1 else pa.concat_arrays(done)


@F.arrow_udf(T.ArrayType(NODE))
def decode(markers: pa.Array, lengths: pa.Array) -> pa.Array:
    """Nodes of each document from its markers in order and its text's length."""
    return decode_arrays(markers, lengths)


def text_lengths(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    return blocks.groupBy(key).agg(F.max("char_end").alias("text_length"))


def document_trees(blocks: DataFrame, key: str = "doc_id", with_blocks: bool = False) -> DataFrame:
    """One row per document: key, text_length, nodes and, if asked for, blocks: an
    array of (ord, page, char_start, char_end, text) in order."""
    entry = F.struct(
        (F.col("char_start") + head_start(F.col("text"))).alias("source_offset"), F.col("_marker").alias("marker"), F.col("_family").alias("family"), parse_marker(F.col("_family"), F.col("_marker")).alias("number"), F.col("ord").alias("block")
    )
    marked = _with_head(blocks).withColumn("_entry", F.when(F.col("_marker") != "", entry))
    listed = [F.array_sort(F.collect_list(F.struct("ord", "page", "char_start", "char_end", "text"))).alias("blocks")] if with_blocks else []
    docs = marked.groupBy(key).agg(F.max("char_end").alias("text_length"), F.array_sort(F.collect_list("_entry")).alias("markers"), *listed)
    return docs.withColumn("nodes", decode("markers", "text_length")).drop("markers")


def clause_nodes(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text_length and one row per clause node. blocks: ord counts each document's
    blocks from 0, as canonicalise gives it."""
    return document_trees(blocks, key).select(key, "text_length", F.inline("nodes")).drop("child_start", "block", "next_block", "child_block")


def with_inclusive_ends(nodes: DataFrame) -> DataFrame:
    """char_end: start of the next node that is no deeper, else the text's length."""
    return nodes.withColumn("char_end", F.coalesce("next_start", "text_length")).drop("next_start")


def direct_pieces(start: Column, end: Column, holes: Column) -> Column:
    """[start, end) without the holes, an array of struct(start, end) in order."""
    none = F.expr(_NO_SPANS)

    def step(acc: Column, h: Column) -> Column:
        gap = F.struct(acc["at"].alias("start"), h["start"].alias("end"))
        return F.struct(F.greatest(acc["at"], h["end"]).alias("at"), F.when(h["start"] > acc["at"], F.concat(acc["out"], F.array(gap))).otherwise(acc["out"]).alias("out"))

    def last(acc: Column) -> Column:
        return F.when(acc["at"] < end, F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), end.alias("end"))))).otherwise(acc["out"])

    return F.aggregate(F.coalesce(holes, none), F.struct(start.alias("at"), none.alias("out")), step, last)


def with_direct_spans(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """direct_spans: a clause's span without its children's."""
    children = nodes.filter("parent is not null").groupBy(key, F.col("parent").alias("ord")).agg(F.array_sort(F.collect_list(F.struct(F.col("char_start").alias("start"), F.col("char_end").alias("end")))).alias("_holes"))
    told = nodes.join(children, [key, "ord"], "left")
    return told.withColumn("direct_spans", direct_pieces(F.col("char_start"), F.col("char_end"), F.col("_holes"))).drop("_holes")


def role(family: Column) -> Column:
    return F.when(family.isin("article", "region"), family).when(family.isin("section", "hier-decimal", "decimal"), "section").otherwise("subclause")


def number(marker: Column, path: Column) -> Column:
    """The marker as shown: without a final dot, its first number that of the path."""
    shown = F.regexp_replace(F.trim(marker), r"\.+$", "")
    digits = F.regexp_extract(shown, r"\d+", 0)
    at = F.instr(shown, digits)
    rebased = F.concat(F.substring(shown, F.lit(1), at - 1), F.get(path, F.lit(0)).cast("string"), F.substring(shown, at + F.length(digits), F.length(shown)))
    return F.when((digits != "") & (digits.try_cast("bigint") != F.get(path, F.lit(0))), rebased).otherwise(shown)


def heading(direct: Column, marker: Column) -> Column:
    """The first sentence behind the marker, if it has 1 to 100 characters."""
    rest = F.when(F.startswith(direct, marker), F.substring(direct, F.length(marker) + 1, F.length(direct))).otherwise(direct)
    flat = F.regexp_replace(F.trim(F.regexp_replace(rest, r"(?U)\s+", " ")), "^[. ]+", "")
    first = F.regexp_replace(F.trim(F.split_part(flat, F.lit(". "), F.lit(1))), r"\.+$", "")
    return F.when(F.length(first).between(1, 100), first)


def page_evidence(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, page, char_start, char_end: what a clause covers on each page. A
    clause's blocks are a run of its document's, so each looks at its own run only."""

    def covered(n: Column) -> Column:
        end = F.coalesce(n["next_start"], F.col("text_length"))
        met = F.filter(_run(n["block"], F.coalesce(n["next_block"] + 1, F.size("blocks"))), lambda b: (b["char_start"] < end) & (b["char_end"] > n["char_start"]))
        return F.transform(met, lambda b: F.struct(n["ord"].alias("ord"), b["page"].alias("page"), F.greatest(n["char_start"], b["char_start"]).alias("char_start"), F.least(end, b["char_end"]).alias("char_end")))

    each = document_trees(blocks, key, True).select(key, F.inline(F.flatten(F.transform("nodes", covered))))
    return each.groupBy(key, "ord", "page").agg(F.min("char_start").alias("char_start"), F.max("char_end").alias("char_end"))


def evidence_lists(evidence: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, evidence: a clause's pages with what it covers there, by page."""
    return evidence.groupBy(key, "ord").agg(F.array_sort(F.collect_list(F.struct("page", "char_start", "char_end"))).alias("evidence"))


def _run(first: Column, end: Column) -> Column:
    """Blocks first to end, end exclusive."""
    return F.slice("blocks", first + 1, end - first)


def _text(n: Column, end: Column, end_block: Column) -> Column:
    """The text from a node's start to end, which lies in block end_block or, if that
    is null, at the document's end. Only the blocks between are read."""
    start = F.get("blocks", n["block"])["char_start"]
    last = F.coalesce(end_block + 1, F.size("blocks"))
    joined = F.array_join(F.transform(_run(n["block"], last), lambda b: b["text"]), SEPARATOR)
    return F.substring(joined, n["char_start"] - start + 1, end - n["char_start"])


def segment(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """All clauses of all documents: spans, role, number, heading and text. A document
    is one row from its blocks to its clauses; each clause takes its text from the
    blocks it covers, and rows come apart last. Children fill their parent's span from
    the first one on, so what is directly a clause's own is what lies before it."""
    end = lambda n: F.coalesce(n["next_start"], F.col("text_length"))
    own_end = lambda n: F.coalesce(n["child_start"], end(n))
    told = lambda n: F.struct(
        *[n[c].alias(c) for c in ("ord", "marker", "family", "path", "depth", "parent", "char_start")],
        end(n).alias("char_end"),
        F.when(own_end(n) > n["char_start"], F.array(F.struct(n["char_start"].alias("start"), own_end(n).alias("end")))).otherwise(F.expr(_NO_SPANS)).alias("direct_spans"),
        _text(n, end(n), n["next_block"]).alias("text"),
    )
    rows = document_trees(blocks, key, True).select(key, "text_length", F.inline(F.transform("nodes", told)))
    own = F.get("direct_spans", F.lit(0))
    part = F.substring(F.col("text"), F.lit(1), own["end"] - own["start"])  # it begins the text
    return rows.select(
        key,
        F.concat(F.lit("cl-"), F.col("ord").cast("string")).alias("clause_id"),
        "ord",
        F.when(F.col("parent").isNotNull(), F.concat(F.lit("cl-"), F.col("parent").cast("string"))).alias("parent_id"),
        "parent",
        "depth",
        "family",
        role(F.col("family")).alias("role"),
        number(F.col("marker"), F.col("path")).alias("number"),
        F.when(F.size("direct_spans") > 0, heading(part, F.col("marker"))).alias("heading"),
        "path",
        "char_start",
        "char_end",
        "direct_spans",
        "text_length",
        "text",
    )
