"""Queries over sources, markers, numbers, clause trees and their trust, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausewright.functions import numbering
from clausewright.functions.markers import FAMILIES, family_name, scan
from clausewright.operators import segmentation as seg
from clausewright.operators import trust
from clausewright.plans.corpus import contract_blocks, contract_items, contract_items_sql
from clausewright.session import table
from clausewright.sources import blocks as src


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return contract_items(spark, table(spark, sf, "orders"), table(spark, sf, "lineitem"))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    return contract_blocks(table(spark, sf, "orders"), table(spark, sf, "lineitem"))


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return seg.with_inclusive_ends(seg.clause_nodes(_blocks(spark, sf)))


def _segments(spark: SparkSession, sf: str) -> DataFrame:
    return seg.segment(_blocks(spark, sf))


def canonicalise_blocks(spark: SparkSession, sf: str) -> DataFrame:
    found = src.canonicalise(src.line_items(table(spark, sf, "documents")))
    return found.select("doc_id", "ord", "block_id", "type", "page", "char_start", "char_end", F.md5("text").alias("text_md5"))


def canonical_documents(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.documents_of(src.canonicalise(src.line_items(table(spark, sf, "documents"))))
    return docs.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"), "page_count", "n_blocks")


def page_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    blocks = src.canonicalise(src.page_range(_items(spark, sf), 1, 2))
    return blocks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.max("char_end").alias("last_end"))


def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    blocks = src.canonicalise(src.html_items(table(spark, sf, "pages")), "page_id")
    return blocks.select("page_id", "ord", "block_id", "type", "char_start", "char_end", "text")


def marker_scan_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Markers by family over every line of every document."""
    lines = src.line_items(table(spark, sf, "documents")).select(F.explode(scan(F.col("text"))).alias("m"))
    return lines.groupBy(family_name(F.col("m.priority")).alias("family")).agg(F.count(F.lit(1)).alias("markers"))


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return seg.candidates(_blocks(spark, sf))


def block_start_markers(spark: SparkSession, sf: str) -> DataFrame:
    return seg.block_starts(_blocks(spark, sf)).select("doc_id", "source_offset", "family", "marker")


def parsed_markers(spark: SparkSession, sf: str) -> DataFrame:
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), ".")
    return seg.block_starts(_blocks(spark, sf)).select(
        "doc_id", "source_offset", joined("number.path").alias("path"), joined("number.alt").alias("alt"), numbering.starts_sequence(F.col("number")).alias("starts")
    )


def roman_values(spark: SparkSession, sf: str) -> DataFrame:
    """Roman readings of the lower-cased words of all lines of each document."""
    words = F.filter(F.split(F.lower("text"), "[ \n]"), lambda w: w.rlike("^[ivxlcdm]+$"))
    uses = table(spark, sf, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    return uses.select("word", numbering.parse_roman(F.col("word")).alias("value"), "uses").filter("value is not null")


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    following = F.lead("number").over(Window.partitionBy("doc_id").orderBy("source_offset"))
    return seg.block_starts(_blocks(spark, sf)).withColumn("next", following).filter("next is not null")


def sibling_pairs(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("number"), F.col("next")
    return _pairs(spark, sf).select("doc_id", "source_offset", numbering.is_sibling_successor(a, b).alias("strict"), numbering.is_sibling_successor(a, b, 1).alias("skipping"))


def child_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf).select("doc_id", "source_offset", numbering.is_child_start(F.col("number"), F.col("next")).alias("child"))


def body_start(spark: SparkSession, sf: str) -> DataFrame:
    blocks = _blocks(spark, sf)
    return seg.body_start(seg.block_starts(blocks), seg.text_lengths(blocks))


def clause_nodes(spark: SparkSession, sf: str) -> DataFrame:
    path = F.array_join(F.col("path").cast("array<string>"), ".").alias("path")
    return seg.clause_nodes(_blocks(spark, sf)).select("doc_id", "ord", "marker", "family", path, "depth", "parent", "char_start")


def clause_inclusive_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf).select("doc_id", "ord", "char_start", "char_end")


def clause_direct_spans(spark: SparkSession, sf: str) -> DataFrame:
    spans = seg.with_direct_spans(_nodes(spark, sf))
    told = F.transform("direct_spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string")))
    return spans.select("doc_id", "ord", F.array_join(told, ",").alias("direct"))


def clause_role_counts(spark: SparkSession, sf: str) -> DataFrame:
    return seg.clause_nodes(_blocks(spark, sf)).groupBy(seg.role(F.col("family")).alias("role"), "depth").agg(F.count(F.lit(1)).alias("clauses"))


def clause_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return seg.clause_nodes(_blocks(spark, sf)).select("doc_id", "ord", seg.number(F.col("marker"), F.col("path")).alias("number"))


def clause_headings(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).select("doc_id", "ord", "heading")


def clause_page_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return seg.page_evidence(_blocks(spark, sf)).select("doc_id", "ord", F.col("page").cast("int").alias("page"), "char_start", "char_end")


def clause_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Each clause's evidence by page, as text."""
    listed = seg.evidence_lists(seg.page_evidence(_blocks(spark, sf)))
    told = F.transform("evidence", lambda e: F.concat_ws(":", e["page"].cast("string"), e["char_start"].cast("string"), e["char_end"].cast("string")))
    return listed.select("doc_id", "ord", F.array_join(told, ",").alias("evidence"))


def segmented_clauses(spark: SparkSession, sf: str) -> DataFrame:
    return _segments(spark, sf).select("doc_id", "clause_id", "parent_id", "depth", "role", "number", "heading", "char_start", "char_end", F.md5("text").alias("text_md5"))


def clause_outline(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.repeat(F.lit("   "), F.col("depth")), F.concat_ws(" ", "number", "heading"))
    return _segments(spark, sf).filter("ord < 30").select("doc_id", "ord", line.alias("line"))


def tree_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Issues of trees with faults put in by key: ends cut, starts moved, gaps."""
    nodes = _nodes(spark, sf)
    broken = nodes.withColumns(
        {
            "char_end": F.when(F.expr("doc_id % 11 = 0 and ord = 1"), F.col("text_length") + 5).when(F.expr("doc_id % 13 = 0 and depth = 0"), F.col("char_end") - 1).otherwise(F.col("char_end")),
            "char_start": F.when(F.expr("doc_id % 17 = 0 and ord = 3"), F.lit(0)).otherwise(F.col("char_start")),
        }
    )
    return trust.tree_issues(broken)


def seg_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return trust.confidence(_nodes(spark, sf)).drop("reasons")


QUERIES = {
    f.__name__: f
    for f in (
        canonicalise_blocks, canonical_documents, page_range_filter, html_blocks, marker_scan_counts, candidates, block_start_markers,
        parsed_markers, roman_values, sibling_pairs, child_pairs, body_start, clause_nodes, clause_inclusive_spans, clause_direct_spans,
        clause_role_counts, clause_numbers, clause_headings, clause_page_evidence, clause_evidence, segmented_clauses, clause_outline, tree_issues, seg_confidence,
    )
}

# --- the same in SQL ---------------------------------------------------------------

_BLANK = r"regexp_replace(text, '^\s+|\s+$', '', 'g') <> ''"
_LINES = """lines AS (
    SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS item_index, unnest(parts) AS text
    FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))"""


def _blocks_sql(items: str, key: str = "doc_id", kind: str = "'paragraph'") -> str:
    order = f"PARTITION BY {key} ORDER BY item_index"
    end = f"sum(length(text) + 2) OVER ({order} ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT {key}, CAST(row_number() OVER ({order}) - 1 AS INT) AS ord, 'b' || item_index AS block_id, {kind} AS type, text, page,
        CAST({end} - length(text) - 2 AS INT) AS char_start, CAST({end} - 2 AS INT) AS char_end
        FROM {items} WHERE {_BLANK}"""


_ROMAN_SQL = """CASE WHEN regexp_full_match(lower({0}), '[ivxlcdm]+') THEN CAST(list_sum(list_transform(range(1, length({0}) + 1), lambda i:
    CASE WHEN list_transform(string_split(lower({0}), ''), lambda c: CASE c WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END)[i]
      < list_max(list_transform(string_split(lower({0}), ''), lambda c: CASE c WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END)[i:])
    THEN -1 ELSE 1 END * list_transform(string_split(lower({0}), ''), lambda c: CASE c WHEN 'i' THEN 1 WHEN 'v' THEN 5 WHEN 'x' THEN 10 WHEN 'l' THEN 50 WHEN 'c' THEN 100 WHEN 'd' THEN 500 ELSE 1000 END)[i])) AS INT) END"""


def _roman(x: str) -> str:
    return _ROMAN_SQL.replace("{0}", x)


#: The marker families for DuckDB, which knows no look-ahead: behind one, the character
#: itself is read. At a block's start, and anywhere, the first family first.
_AHEAD = r"(?=\s)"
_HEADS = tuple((n, f"^({rx.removesuffix(_AHEAD)})" + (r"\s" if rx.endswith(_AHEAD) else "")) for n, rx in FAMILIES)
_ANYWHERE = "|".join(rx.replace(_AHEAD, r"\s") for _, rx in FAMILIES)
_WHICH = "CASE " + " ".join(f"WHEN regexp_full_match(raw, '{rx.replace(_AHEAD, chr(92) + 's')}') THEN '{n}'" for n, rx in FAMILIES) + " END"
_FAMILY = "CASE " + " ".join(f"WHEN regexp_matches(lead, '{rx}') THEN '{n}'" for n, rx in _HEADS) + " END"
_MARKER = "CASE " + " ".join(f"WHEN family = '{n}' THEN regexp_extract(lead, '{rx}', 1)" for n, rx in _HEADS) + " END"
_INTS = r"list_transform(regexp_extract_all(marker, '\d+'), lambda d: CAST(d AS INT))"
_TOKEN = r"regexp_extract(marker, '(\S+)$', 1)"
_VALUE = f"CASE WHEN regexp_full_match(token, '\\d+') THEN CAST(token AS INT) ELSE {_roman('token')} END"
_ALPHA = "CASE WHEN length(token) = 1 THEN ascii(lower(token)) - 96 END"
_AS_PATH = "CASE WHEN coalesce(v, 0) > 0 THEN [CAST(v AS INT)] ELSE CAST([] AS INT[]) END"

_CORPUS = f"""corpus_items AS ({contract_items_sql()}),
blocks AS ({_blocks_sql('corpus_items')}),
lens AS (SELECT doc_id, max(char_end) AS text_length FROM blocks GROUP BY doc_id),
heads AS (SELECT *, {_FAMILY} AS family FROM (SELECT *, regexp_replace(text, '^\\s+', '') AS lead FROM blocks)),
marked AS (SELECT doc_id, char_start + length(text) - length(lead) AS source_offset, family, {_MARKER} AS marker FROM heads WHERE family IS NOT NULL),
tokens AS (SELECT *, CASE WHEN family LIKE 'paren%' THEN marker[2:-2] ELSE {_TOKEN} END AS token FROM marked),
valued AS (SELECT *, {_VALUE} AS rv, {_ALPHA} AS av FROM tokens),
chosen AS (SELECT *, CASE family WHEN 'article' THEN rv WHEN 'region' THEN coalesce(rv, av) WHEN 'paren-upper' THEN av
    WHEN 'paren-lower' THEN CASE WHEN length(token) = 1 THEN av ELSE rv END END AS v FROM valued),
starts AS (SELECT doc_id, source_offset, family, marker,
    CASE WHEN family IN ('section', 'hier-decimal', 'decimal') THEN {_INTS} WHEN family = 'paren-num' THEN ({_INTS})[1:1] ELSE {_AS_PATH} END AS path,
    CASE WHEN family = 'paren-lower' AND length(token) = 1 AND coalesce(rv, 0) > 0 THEN [rv] ELSE CAST([] AS INT[]) END AS alt FROM chosen),
readings AS (SELECT *, list_filter([path, alt], lambda p: len(p) > 0) AS rd FROM starts)"""


def _follows(a: str, b: str, skip: int) -> str:
    return f"""len(list_filter({a}, lambda p: len(list_filter({b}, lambda q: len(p) = len(q) AND p[1:len(p) - 1] = q[1:len(q) - 1]
        AND q[len(q)] - p[len(p)] BETWEEN 1 AND {1 + skip})) > 0)) > 0"""


def _opens(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda p: len(list_filter({b}, lambda q: q = list_append(p, 1))) > 0)) > 0"


_KIND = "CASE WHEN family IN ('section', 'hier-decimal', 'decimal') THEN 'decimal' ELSE family END"
_RUNS = """runs AS (SELECT *, coalesce(min(CASE WHEN family NOT LIKE 'paren%' THEN source_offset END)
    OVER (PARTITION BY doc_id ORDER BY source_offset ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), text_length) - source_offset AS run
    FROM readings JOIN lens USING (doc_id)),
bodies AS (SELECT doc_id, min(CASE WHEN run >= 100 AND family NOT LIKE 'paren%' THEN source_offset END) AS body_offset FROM runs GROUP BY doc_id)"""

#: The lead-in rule as far as this corpus needs it: the marker before the body's first
#: one opens it or is where the body starts.
_NODES = f"""{_CORPUS},
{_RUNS},
mains AS (SELECT r.*, lag(rd) OVER w AS p_rd, lag(source_offset) OVER w AS p_off FROM readings r WHERE family NOT LIKE 'paren%' WINDOW w AS (PARTITION BY doc_id ORDER BY source_offset)),
firsts AS (SELECT b.doc_id, CASE WHEN b.body_offset IS NULL THEN -1 WHEN {_opens('m.p_rd', 'm.rd')} THEN m.p_off ELSE m.source_offset END AS first_offset
    FROM bodies b LEFT JOIN mains m ON m.doc_id = b.doc_id AND m.source_offset = b.body_offset),
cand AS (SELECT r.doc_id, row_number() OVER (PARTITION BY r.doc_id ORDER BY source_offset) AS k, source_offset AS off, family AS fam, {_KIND} AS kind, marker, path, rd
    FROM readings r JOIN firsts f ON r.doc_id = f.doc_id AND r.source_offset >= f.first_offset WHERE len(path) > 0),
walk AS (
    SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST([] AS STRUCT(kind VARCHAR, fam VARCHAR, path INT[], rd INT[][], id INT)[]) AS stack, 0 AS n, CAST(NULL AS INT) AS depth,
           CAST(NULL AS INT) AS parent, CAST(NULL AS INT[]) AS cpath, CAST(NULL AS VARCHAR) AS marker, CAST(NULL AS VARCHAR) AS fam, CAST(NULL AS INT) AS off
    FROM (SELECT DISTINCT doc_id FROM cand)
    UNION ALL
    SELECT doc_id, k, CASE WHEN d IS NULL THEN stack ELSE list_append(stack[1:d], {{'kind': kind, 'fam': fam, 'path': path, 'rd': rd, 'id': n}}) END,
           CASE WHEN d IS NULL THEN n ELSE n + 1 END, CAST(d AS INT), CASE WHEN d > 0 THEN stack[d].id END,
           CASE WHEN d > 0 AND fam IN ('section', 'hier-decimal') AND stack[1].fam = 'article' AND path[1] <> stack[1].path[1] THEN list_prepend(stack[1].path[1], path[2:]) ELSE path END,
           marker, fam, off
    FROM (SELECT *, CASE WHEN lvl IS NOT NULL THEN lvl - 1 WHEN fam IN ('article', 'region') THEN 0
            WHEN len(stack) = 0 THEN CASE WHEN fam NOT LIKE 'paren%' THEN 0 END
            WHEN {_opens('stack[len(stack)].rd', 'rd')} THEN len(stack)
            WHEN stack[len(stack)].fam = 'region' AND fam IN ('section', 'hier-decimal') THEN len(stack)
            WHEN stack[len(stack)].fam = 'article' AND len(path) >= 2 AND kind = 'decimal' AND path[1] = stack[len(stack)].path[1] THEN len(stack)
            WHEN stack[len(stack)].fam = 'article' AND len(path) >= 2 AND fam IN ('section', 'hier-decimal') AND path[1] <> stack[len(stack)].path[1]
                 AND len(list_filter(rd, lambda p: p[len(p)] = 1)) > 0 THEN len(stack)
            WHEN fam LIKE 'paren%' AND len(list_filter(rd, lambda p: p[len(p)] = 1)) > 0 THEN len(stack) END AS d
        FROM (SELECT c.doc_id, c.k, c.off, c.fam, c.kind, c.marker, c.path, c.rd, w.stack, w.n,
                list_max(list_filter(range(1, len(w.stack) + 1), lambda i: w.stack[i].kind = c.kind AND {_follows('w.stack[i].rd', 'c.rd', 1)})) AS lvl
              FROM walk w JOIN cand c ON c.doc_id = w.doc_id AND c.k = w.k + 1))),
nodes AS (SELECT walk.doc_id, n - 1 AS ord, marker, fam AS family, cpath AS path, depth, parent, off AS char_start, text_length FROM walk JOIN lens USING (doc_id) WHERE depth IS NOT NULL),
ended AS (SELECT a.*, coalesce((SELECT min(b.char_start) FROM nodes b WHERE b.doc_id = a.doc_id AND b.ord > a.ord AND b.depth <= a.depth), a.text_length) AS char_end FROM nodes a)"""

_ROLE = "CASE WHEN family IN ('article', 'region') THEN family WHEN family IN ('section', 'hier-decimal', 'decimal') THEN 'section' ELSE 'subclause' END"
_SHOWN = r"regexp_replace(marker, '\.+$', '')"
_DIGITS = rf"regexp_extract({_SHOWN}, '\d+')"
_NUMBER = f"CASE WHEN {_DIGITS} <> '' AND CAST({_DIGITS} AS INT) <> path[1] THEN regexp_replace({_SHOWN}, '\\d+', CAST(path[1] AS VARCHAR)) ELSE {_SHOWN} END"
_DIRECT = """kids AS (SELECT doc_id, parent AS ord, list({'s': char_start, 'e': char_end} ORDER BY char_start) AS holes FROM ended WHERE parent IS NOT NULL GROUP BY ALL),
gaps AS (SELECT e.doc_id, e.ord, e.marker, list_filter(list_transform(range(0, len(coalesce(holes, [])) + 1), lambda i:
    {'s': CASE WHEN i = 0 THEN e.char_start ELSE holes[i].e END, 'e': CASE WHEN i = len(coalesce(holes, [])) THEN e.char_end ELSE holes[i + 1].s END}), lambda g: g.s < g.e) AS direct
    FROM ended e LEFT JOIN kids k ON k.doc_id = e.doc_id AND k.ord = e.ord),
texts AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM blocks GROUP BY doc_id),
flat AS (SELECT g.doc_id, g.ord, regexp_replace(trim(regexp_replace(substr(t.text, CAST(direct[1].s + length(marker) + 1 AS BIGINT), CAST(direct[1].e - direct[1].s - length(marker) AS BIGINT)), '\\s+', ' ', 'g')), '^[. ]+', '') AS rest
    FROM gaps g JOIN texts t ON t.doc_id = g.doc_id),
named AS (SELECT doc_id, ord, regexp_replace(trim(string_split(rest, '. ')[1]), '\\.+$', '') AS h FROM flat)"""
_HEADING = "CASE WHEN length(h) BETWEEN 1 AND 100 THEN h END"
_BROKEN = """broken AS (SELECT doc_id, ord, depth, parent, text_length,
    CASE WHEN doc_id % 11 = 0 AND ord = 1 THEN text_length + 5 WHEN doc_id % 13 = 0 AND depth = 0 THEN char_end - 1 ELSE char_end END AS char_end,
    CASE WHEN doc_id % 17 = 0 AND ord = 3 THEN 0 ELSE char_start END AS char_start FROM ended)"""


def _issues(nodes: str) -> str:
    return f"""SELECT doc_id, 'span_out_of_bounds:cl-' || ord AS issue FROM {nodes} WHERE NOT (0 <= char_start AND char_start <= char_end AND char_end <= text_length)
    UNION ALL SELECT doc_id, 'not_monotonic:cl-' || ord FROM (SELECT *, lag(char_start, 1, -1) OVER (PARTITION BY doc_id ORDER BY ord) AS b FROM {nodes}) WHERE char_start <= b
    UNION ALL SELECT c.doc_id, 'child_outside_parent:cl-' || c.ord FROM {nodes} c LEFT JOIN {nodes} p ON p.doc_id = c.doc_id AND p.ord = c.parent
        WHERE c.parent IS NOT NULL AND NOT coalesce(p.char_start <= c.char_start AND c.char_end <= p.char_end, false)
    UNION ALL SELECT doc_id, 'top_gap_or_overlap:cl-' || ord || '->cl-' || o FROM (SELECT *, lead(char_start) OVER w AS s, lead(ord) OVER w AS o FROM {nodes} WHERE depth = 0
        WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) WHERE s IS NOT NULL AND char_end <> s"""


_HTML = r"""raw AS (SELECT page_id, regexp_replace(html, '(?s)<script\b.*?</script>|<style\b.*?</style>', '', 'g') AS html FROM pages),
tags AS (SELECT page_id, regexp_extract_all(html, '(?s)<(?:p|h[1-6]|li|td|title|figcaption)\b[^>]*>.*?</(?:p|h[1-6]|li|td|title|figcaption)>') AS hits FROM raw),
hit AS (SELECT page_id, CAST(generate_subscripts(hits, 1) - 1 AS INT) AS item_index, unnest(hits) AS h FROM tags),
items AS (SELECT page_id, item_index, regexp_extract(h, '^<([a-z0-9]+)', 1) AS tag, 1 AS page,
    trim(replace(replace(replace(replace(replace(replace(regexp_replace(h, '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&')) AS text FROM hit)"""
_TYPES = "CASE WHEN tag LIKE 'h%' OR tag = 'title' THEN 'heading' WHEN tag = 'p' THEN 'paragraph' WHEN tag = 'li' THEN 'list_item' WHEN tag = 'td' THEN 'table' ELSE 'caption' END"
_DOT = "array_to_string(path, '.')"
_W = f"WITH RECURSIVE {_NODES}"
_NEXT = f"WITH {_CORPUS}, pairs AS (SELECT *, lead(rd) OVER (PARTITION BY doc_id ORDER BY source_offset) AS nx FROM readings)"

ORACLES = {
    "canonicalise_blocks": f"""WITH {_LINES}, items AS (SELECT *, CAST(floor(item_index / 50) + 1 AS INT) AS page FROM lines),
        b AS ({_blocks_sql('items')}) SELECT doc_id, ord, block_id, type, page, char_start, char_end, md5(text) AS text_md5 FROM b""",
    "canonical_documents": f"""WITH {_LINES}, items AS (SELECT *, CAST(floor(item_index / 50) + 1 AS INT) AS page FROM lines), b AS ({_blocks_sql('items')}),
        t AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text, max(page) AS page_count, CAST(count(*) AS INT) AS n_blocks FROM b GROUP BY doc_id)
        SELECT doc_id, md5(text) AS text_md5, CAST(length(text) AS INT) AS n_chars, page_count, n_blocks FROM t""",
    "page_range_filter": f"""WITH items AS (SELECT * FROM ({contract_items_sql()}) WHERE page BETWEEN 1 AND 2), b AS ({_blocks_sql('items')})
        SELECT doc_id, count(*) AS blocks, max(char_end) AS last_end FROM b GROUP BY doc_id""",
    "html_blocks": f"WITH {_HTML}, b AS ({_blocks_sql('items', 'page_id', _TYPES)}) SELECT page_id, ord, block_id, type, char_start, char_end, text FROM b",
    "marker_scan_counts": f"""WITH {_LINES}, raws AS (SELECT unnest(regexp_extract_all(text, '{_ANYWHERE}')) AS raw FROM lines)
        SELECT {_WHICH} AS family, count(*) AS markers FROM raws GROUP BY ALL""",
    "candidates": f"""WITH {_CORPUS}, hits AS (SELECT *, regexp_extract_all(text, '{_ANYWHERE}') AS m, regexp_split_to_array(text, '{_ANYWHERE}') AS g FROM blocks),
        each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits),
        placed AS (SELECT *, m[i] AS raw, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INT) AS s FROM each)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord, s) - 1 AS INT) AS candidate, block_id, char_start + s AS source_offset, regexp_replace(raw, '\\s+$', '') AS marker,
            {_WHICH} AS family, s = length(text) - length(regexp_replace(text, '^\\s+', '')) AS at_block_start FROM placed""",
    "block_start_markers": f"WITH {_CORPUS} SELECT doc_id, source_offset, family, marker FROM marked",
    "parsed_markers": f"""WITH {_CORPUS} SELECT doc_id, source_offset, {_DOT} AS path, array_to_string(alt, '.') AS alt, len(list_filter(rd, lambda p: p[len(p)] = 1)) > 0 AS starts FROM readings""",
    "roman_values": f"""WITH words AS (SELECT unnest(regexp_split_to_array(lower(text), '[ \n]')) AS word FROM documents), told AS (SELECT word, {_roman('word')} AS value FROM words)
        SELECT word, value, count(*) AS uses FROM told WHERE value IS NOT NULL GROUP BY ALL""",
    "sibling_pairs": f"{_NEXT} SELECT doc_id, source_offset, {_follows('rd', 'nx', 0)} AS strict, {_follows('rd', 'nx', 1)} AS skipping FROM pairs WHERE nx IS NOT NULL",
    "child_pairs": f"{_NEXT} SELECT doc_id, source_offset, {_opens('rd', 'nx')} AS child FROM pairs WHERE nx IS NOT NULL",
    "body_start": f"WITH {_CORPUS}, {_RUNS} SELECT doc_id, body_offset FROM bodies",
    "clause_nodes": f"{_W} SELECT doc_id, ord, marker, family, {_DOT} AS path, depth, parent, char_start FROM nodes",
    "clause_inclusive_spans": f"{_W} SELECT doc_id, ord, char_start, char_end FROM ended",
    "clause_direct_spans": f"{_W}, {_DIRECT} SELECT doc_id, ord, array_to_string(list_transform(direct, lambda g: g.s || '-' || g.e), ',') AS direct FROM gaps",
    "clause_role_counts": f"{_W} SELECT {_ROLE} AS role, depth, count(*) AS clauses FROM nodes GROUP BY ALL",
    "clause_numbers": f"{_W} SELECT doc_id, ord, {_NUMBER} AS number FROM nodes",
    "clause_headings": f"{_W}, {_DIRECT} SELECT doc_id, ord, {_HEADING} AS heading FROM named",
    "clause_page_evidence": f"""{_W} SELECT e.doc_id, e.ord, b.page, min(greatest(e.char_start, b.char_start)) AS char_start, max(least(e.char_end, b.char_end)) AS char_end
        FROM ended e JOIN blocks b ON b.doc_id = e.doc_id AND b.char_start < e.char_end AND b.char_end > e.char_start GROUP BY ALL""",
    "clause_evidence": f"""{_W}, pages AS (SELECT e.doc_id, e.ord, b.page, min(greatest(e.char_start, b.char_start)) AS s, max(least(e.char_end, b.char_end)) AS t
        FROM ended e JOIN blocks b ON b.doc_id = e.doc_id AND b.char_start < e.char_end AND b.char_end > e.char_start GROUP BY ALL)
        SELECT doc_id, ord, string_agg(page || ':' || s || ':' || t, ',' ORDER BY page) AS evidence FROM pages GROUP BY ALL""",
    "segmented_clauses": f"""{_W}, {_DIRECT} SELECT e.doc_id, 'cl-' || e.ord AS clause_id, 'cl-' || e.parent AS parent_id, e.depth, {_ROLE} AS role, {_NUMBER} AS number, {_HEADING} AS heading,
        e.char_start, e.char_end, md5(substr(t.text, CAST(e.char_start + 1 AS BIGINT), CAST(e.char_end - e.char_start AS BIGINT))) AS text_md5
        FROM ended e JOIN named n ON n.doc_id = e.doc_id AND n.ord = e.ord JOIN texts t ON t.doc_id = e.doc_id""",
    "clause_outline": f"""{_W}, {_DIRECT} SELECT e.doc_id, e.ord, repeat('   ', e.depth) || concat_ws(' ', {_NUMBER}, {_HEADING}) AS line
        FROM ended e JOIN named n ON n.doc_id = e.doc_id AND n.ord = e.ord WHERE e.ord < 30""",
    "tree_issues": f"{_W}, {_BROKEN} {_issues('broken')}",
    "seg_confidence": f"""{_W}, arts AS (SELECT doc_id, path, lead(path) OVER (PARTITION BY doc_id ORDER BY ord) AS nx FROM nodes WHERE depth = 0 AND family = 'article'),
        o AS (SELECT doc_id, avg(CASE WHEN nx IS NOT NULL THEN CAST(nx > path AS INT) END) AS ao FROM arts GROUP BY doc_id),
        tops AS (SELECT *, last_value(CASE WHEN depth = 0 THEN family END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) AS tf FROM nodes),
        u AS (SELECT doc_id, count(DISTINCT (depth, path)) / count(*) AS un FROM tops WHERE tf <> 'region' AND depth <= 1 GROUP BY doc_id),
        i AS (SELECT doc_id, count(*) AS n FROM ({_issues('ended')}) GROUP BY doc_id),
        s AS (SELECT doc_id, coalesce(ao, 1.0) AS ao, coalesce(un, 1.0) AS un, coalesce(n, 0) AS n FROM (SELECT DISTINCT doc_id FROM nodes) LEFT JOIN o USING (doc_id) LEFT JOIN u USING (doc_id) LEFT JOIN i USING (doc_id))
        SELECT doc_id, round_even(ao, 3) AS article_order, round_even(un, 3) AS uniqueness, CASE WHEN n > 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS valid, n AS issues,
               round_even(ao * un * CASE WHEN n > 0 THEN 0.2 ELSE 1 END, 3) AS score, round_even(ao * un * CASE WHEN n > 0 THEN 0.2 ELSE 1 END, 3) < 0.85 AS needs_review FROM s""",
}
