"""Queries over facts, integrity, language, routing, deals, gold scores and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.operators import facts, integrity, trust
from clausewright.operators import metrics as mx
from clausewright.operators import segmentation as seg
from clausewright.plans import pipelines
from clausewright.plans.corpus import contract_items
from clausewright.queries_segmentation import _CORPUS, _DIRECT, _LINES, _NODES, _NUMBER, _ROLE, _blocks, _blocks_sql, _nodes, _roman, _segments
from clausewright.queries_segmentation import ORACLES as SEGMENTATION_ORACLES
from clausewright.session import table
from clausewright.sources import blocks as src
from clausewright.sources.toc import toc_gold as toc
from clausewright.streaming.segments import event_counts, segment_rows
from clausewright.vocabulary import DOCUMENT_TYPES


def _results(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Facts over all lines of documents, with faults by id."""
    blocks = src.canonicalise(src.line_items(table(spark, sf, "documents")))
    docs = src.documents_of(blocks).withColumn("result_doc_id", F.when(F.col("doc_id") % 97 == 0, -1).otherwise(F.col("doc_id")))
    i = F.col("doc_id")
    name = F.concat(F.lit("cl-"), F.col("ord").cast("string"))
    end = F.when((i % 23 == 0) & (F.col("ord") == 1), F.col("char_end") + 100_000).otherwise(F.col("char_end"))
    text = F.when((i % 29 == 0) & (F.col("ord") == 0), "something else").otherwise(F.col("text"))
    clauses = blocks.select("doc_id", F.lit("clause").alias("kind"), "ord", name.alias("id"), F.lit(None).cast("string").alias("clause_id"), "char_start", end.alias("char_end"), text.alias("text"))
    nothing = [F.lit(None).cast("int").alias("char_start"), F.lit(None).cast("int").alias("char_end"), F.lit(None).cast("string").alias("text")]
    entity_id = F.when((i % 31 == 0) & (F.col("ord") == 1), "cl-0").otherwise(F.concat(F.lit("e-"), F.col("ord").cast("string")))
    entities = blocks.select("doc_id", F.lit("entity").alias("kind"), "ord", entity_id.alias("id"), F.when(i % 37 == 0, "cl-77").otherwise(name).alias("clause_id"), *nothing)
    all_facts = clauses.unionByName(entities)
    spans = blocks.select("doc_id", "ord", F.col("page") + F.when(i % 41 == 0, 9).otherwise(0), "char_start", "char_end", F.when(i % 43 == 0, "x").otherwise(F.col("text")), F.when(i % 47 == 0, "b99").otherwise(F.col("block_id")))
    spans = spans.toDF("doc_id", "ord", "page", "char_start", "char_end", "text", "block_id")
    of_clause = spans.filter("not (doc_id % 53 = 0 and ord = 0)").withColumns({"kind": F.lit("clause"), "id": name})
    of_entity = spans.withColumns({"kind": F.lit("entity"), "id": entity_id})
    relations = blocks.select("doc_id", F.concat(F.lit("r-"), F.col("ord").cast("string")).alias("id"), entity_id.alias("source_id"), F.when(i % 59 == 0, "nowhere").otherwise(name).alias("target_id"))
    predictions = F.array(F.struct(F.lit("Parties").alias("label"), F.lit(0.6).alias("score")), F.struct(F.lit("Insurance").alias("label"), F.lit(0.6).alias("score")))
    classes = blocks.select("doc_id", F.when(i % 61 == 0, "cl-88").otherwise(name).alias("clause_id"), F.when(i % 67 == 0, "Insurance").otherwise("Parties").alias("primary_type"), predictions.alias("predictions"))
    return {"documents": docs, "blocks": blocks, "facts": all_facts, "evidence": of_clause.unionByName(of_entity), "relations": relations, "classifications": classes}


def integrity_issues(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.integrity_issues(**_results(spark, sf))


def construction_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with faults by id, against what a block may be built with."""
    blocks = src.canonicalise(src.line_items(table(spark, sf, "documents")))
    i, o = F.col("doc_id"), F.col("ord")
    broken = blocks.select(
        "doc_id", "ord",
        F.when((i % 21 == 0) & (o == 1), 0).otherwise(F.col("page")).alias("page"),
        F.when((i % 25 == 0) & (o == 2), -1).otherwise(F.col("char_start")).alias("char_start"),
        F.when((i % 19 == 0) & (o == 0), F.col("char_start") - 1).otherwise(F.col("char_end")).alias("char_end"),
        F.when((i % 27 == 0) & (o == 3), 1.5).otherwise(0.5).alias("confidence"),
    )
    return integrity.construction_issues(broken, ["doc_id", "ord"])


def evidence_verify(spark: SparkSession, sf: str) -> DataFrame:
    r = _results(spark, sf)
    return integrity.failing_evidence(r["evidence"], r["documents"]).groupBy("kind").agg(F.count(F.lit(1)).alias("failing"))


def entities_regex(spark: SparkSession, sf: str) -> DataFrame:
    return facts.entities(_blocks(spark, sf), ["doc_id", "block_id"]).groupBy("type", "entity").agg(F.count(F.lit(1)).alias("n"))


def relations_containment(spark: SparkSession, sf: str) -> DataFrame:
    """The clauses, of all depths, that each entity is found in."""
    found = facts.entities(_segments(spark, sf), ["doc_id", "clause_id"])
    return facts.relations(found, ["doc_id"])


def resolve_entities(spark: SparkSession, sf: str) -> DataFrame:
    found = facts.entities(_blocks(spark, sf), ["doc_id"])
    return found.groupBy("doc_id", "type", facts.normalised(F.col("type"), F.col("entity")).alias("value")).agg(F.count(F.lit(1)).alias("mentions"))


def deal_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical entities of deals; a nation's customers are one deal."""
    found = facts.entities(_blocks(spark, sf), ["doc_id"]).join(table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), "c_nationkey"), "doc_id")
    return facts.canonical_entities(found, F.col("c_nationkey"))


def deal_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    blocks = _blocks(spark, sf)
    deals = table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id"), F.col("c_nationkey").alias("deal_id"))
    return pipelines.deal_results(pipelines.document_results(blocks), deals)


def document_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All stages over the contract corpus, one row a document."""
    made = pipelines.Pipeline(keep=DataFrame.persist).run(contract_items(spark, table(spark, sf, "orders"), table(spark, sf, "lineitem")))
    return made["documents"].drop("reasons")


def detect_language(spark: SparkSession, sf: str) -> DataFrame:
    return facts.detect_language(table(spark, sf, "documents"))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.array(*[F.lit(t) for t, _, _ in DOCUMENT_TYPES])
    return table(spark, sf, "documents").select("doc_id", "text", F.element_at(kinds, (F.col("doc_id") % len(DOCUMENT_TYPES) + 1).cast("int")).alias("document_type"))


def detect_doctype_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return facts.with_form(_typed(spark, sf)).select("doc_id", "document_type", "category", "form")


def route_by_form(spark: SparkSession, sf: str) -> DataFrame:
    return facts.route(_typed(spark, sf), facts.quality_status(F.col("text"))).groupBy("route").agg(F.count(F.lit(1)).alias("documents"))


def bundle_page_runs(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), F.col("role").alias("type"))
    return facts.page_runs(pages)


def _region(nodes: DataFrame) -> DataFrame:
    top = F.last(F.when(F.col("depth") == 0, F.col("family")), True).over(Window.partitionBy("doc_id").orderBy("ord"))
    return nodes.withColumn("in_region", top == "region")


def segmentation_score(spark: SparkSession, sf: str) -> DataFrame:
    """Found clauses against the corpus' own articles and lines."""
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    arts = orders.select("o_orderkey", F.col("o_custkey").alias("doc_id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("a"))
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    secs = lines.select("l_orderkey", nth.alias("s")).join(arts, F.col("l_orderkey") == F.col("o_orderkey"))
    gold = arts.select("doc_id", F.concat(F.lit("ARTICLE "), F.col("a").cast("string")).alias("number"), F.lit(0).alias("depth")).unionByName(
        secs.select("doc_id", F.concat_ws(".", "a", "s").alias("number"), F.lit(1).alias("depth"))
    )
    nodes = _region(_nodes(spark, sf)).withColumn("number", seg.number(F.col("marker"), F.col("path")))
    return mx.segmentation_score(gold, nodes).drop("labelled", "predicted")


def norm_number(spark: SparkSession, sf: str) -> DataFrame:
    numbers = seg.block_starts(_blocks(spark, sf)).select("marker").distinct()
    return numbers.select("marker", mx.normal_number(F.col("marker")).alias("value"))


def toc_gold(spark: SparkSession, sf: str) -> DataFrame:
    return toc(_blocks(spark, sf))


def corpus_health(spark: SparkSession, sf: str) -> DataFrame:
    nodes = _nodes(spark, sf)
    issues = trust.tree_issues(nodes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("issues"))
    per = nodes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("family") == "article").alias("articles"), F.max("depth").alias("max_depth"))
    docs = _blocks(spark, sf).select("doc_id").distinct()
    return docs.join(per, "doc_id", "left").join(issues, "doc_id", "left").fillna({"nodes": 0, "articles": 0, "max_depth": -1, "issues": 0})


def heldout_summary(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents have no clause, a broken tree or need review, and the clauses
    of each role that reports name."""
    blocks, nodes = _blocks(spark, sf), _nodes(spark, sf)
    return mx.heldout_summary(blocks, nodes, trust.confidence(nodes), seg.role(F.col("family")))


def row_local_segments(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's functions over a batch: the same clauses without a window."""
    return segment_rows(src.documents_of(_blocks(spark, sf)))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    return event_counts(table(spark, sf, "events")).withColumn("total", F.round("total", 4))


QUERIES = {
    f.__name__: f
    for f in (
        integrity_issues, construction_issues, evidence_verify, entities_regex, relations_containment, resolve_entities, deal_aggregate, deal_pipeline, document_pipeline, detect_language,
        detect_doctype_lookup, route_by_form, bundle_page_runs, segmentation_score, norm_number, toc_gold, corpus_health, heldout_summary, row_local_segments,
        event_windows,
    )
}

# --- the same in SQL ---------------------------------------------------------------

_W = f"WITH RECURSIVE {_NODES}"
_FOUND = "[" + ", ".join(f"('{k}', '{rx}')" for k, rx in facts.ENTITY_PATTERNS) + "]"
_ENT = "ents AS (" + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, unnest(regexp_extract_all(text, '{rx}')) AS entity FROM blocks" for k, rx in facts.ENTITY_PATTERNS) + ")"
_VALUE = r"CASE type WHEN 'duration' THEN 'P' || regexp_extract(entity, '\d+(?:\.\d+)?') || 'D' WHEN 'percent' THEN regexp_extract(entity, '\d+(?:\.\d+)?') || '%' ELSE trim(entity) END"
_ENTITIES = "list_concat(" + ", ".join(f"regexp_extract_all({{0}}, '{rx}')" for _, rx in facts.ENTITY_PATTERNS) + ")"
_FULL = "full_texts AS (SELECT e.doc_id, e.ord, substr(t.text, CAST(e.char_start + 1 AS BIGINT), CAST(e.char_end - e.char_start AS BIGINT)) AS text FROM ended e JOIN texts t ON t.doc_id = e.doc_id)"
_CONFIDENCE = SEGMENTATION_ORACLES["seg_confidence"]
_LAST = r"regexp_extract(trim({0}), '(\S+)$', 1)"
_DOTTED = r"regexp_extract(trim({0}), '\d+(?:\.\d+)*')"


def _normal(x: str) -> str:
    token, digits = _LAST.replace("{0}", x), _DOTTED.replace("{0}", x)
    value = f"CASE WHEN regexp_full_match({token}, '\\d+') THEN CAST({token} AS INT) ELSE {_roman(token)} END"
    parts = f"array_to_string(list_transform(string_split({digits}, '.'), lambda d: CAST(CAST(d AS INT) AS VARCHAR)), '.')"
    return f"CASE WHEN upper(trim({x})) LIKE 'ARTICLE%' THEN 'ART:' || coalesce(CAST({value} AS VARCHAR), '-') WHEN {digits} <> '' THEN 'SEC:' || {parts} ELSE 'RAW:' || trim({x}) END"


_REF = r"(?is)^(.*\S)\s* (?:A-\w+|\d+)$"
_BARE = f"CASE WHEN regexp_matches({{0}}, '{_REF}') THEN regexp_extract({{0}}, '{_REF}', 1) ELSE {{0}} END"
_KINDS = "[" + ", ".join(f"{{'t': '{t}', 'c': " + (f"'{c}'" if c else "NULL") + ", 'f': " + (f"'{f}'" if f else "NULL") + "}" for t, c, f in DOCUMENT_TYPES) + "]"
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[\\s.,]+'), lambda w: list_contains({0}, w))"
_STOPS = "[" + ", ".join(f"{{'n': len({_WORDS.replace('{0}', '[' + ', '.join(repr(w) for w in ws) + ']')}), 'code': '{c}'}}" for c, ws in facts.STOP_WORDS) + "]"
_FACTS = f"""{_LINES}, items AS (SELECT *, CAST(floor(item_index / 50) + 1 AS INT) AS page FROM lines), every AS (SELECT b.*, i.page FROM ({_blocks_sql('items')}) b JOIN items i ON i.doc_id = b.doc_id AND 'b' || i.item_index = b.block_id),
b AS (SELECT doc_id, ord, block_id, text, page, char_start, char_end, doc_id AS i, 'cl-' || ord AS nm, CASE WHEN doc_id % 31 = 0 AND ord = 1 THEN 'cl-0' ELSE 'e-' || ord END AS eid FROM every),
d AS (SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS doc, max(page) AS page_count FROM b GROUP BY doc_id),
f AS (SELECT doc_id, 'clause' AS kind, 1 AS ko, ord, nm AS id FROM b UNION ALL SELECT doc_id, 'entity', 2, ord, eid FROM b),
ev AS (SELECT doc_id, 'clause' AS kind, nm AS id, ord, page + CASE WHEN i % 41 = 0 THEN 9 ELSE 0 END AS page, char_start, char_end, CASE WHEN i % 43 = 0 THEN 'x' ELSE text END AS text, CASE WHEN i % 47 = 0 THEN 'b99' ELSE block_id END AS block_id
    FROM b WHERE NOT (i % 53 = 0 AND ord = 0)
    UNION ALL SELECT doc_id, 'entity', eid, ord, page + CASE WHEN i % 41 = 0 THEN 9 ELSE 0 END, char_start, char_end, CASE WHEN i % 43 = 0 THEN 'x' ELSE text END, CASE WHEN i % 47 = 0 THEN 'b99' ELSE block_id END FROM b),
ends AS (SELECT doc_id, 'r-' || ord AS id, eid AS e FROM b UNION ALL SELECT doc_id, 'r-' || ord, CASE WHEN i % 59 = 0 THEN 'nowhere' ELSE nm END FROM b)"""

ORACLES = {
    "integrity_issues": f"""WITH {_FACTS}
        SELECT doc_id, 'doc_id_mismatch' AS code, '-1' AS ref FROM d WHERE doc_id % 97 = 0 AND doc_id <> -1
        UNION ALL SELECT doc_id, 'duplicate_id', id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY ko, ord) AS k FROM f) WHERE k > 1
        UNION ALL SELECT doc_id, 'missing_evidence', kind || ':' || id FROM f WHERE NOT EXISTS (SELECT 1 FROM ev WHERE ev.doc_id = f.doc_id AND ev.kind = f.kind AND ev.id = f.id)
        UNION ALL SELECT ev.doc_id, 'span_mismatch', kind || ':' || id FROM ev JOIN d ON d.doc_id = ev.doc_id WHERE substr(doc, char_start + 1, char_end - char_start) <> text
        UNION ALL SELECT ev.doc_id, 'page_out_of_range', kind || ':' || id FROM ev JOIN d ON d.doc_id = ev.doc_id WHERE page > page_count
        UNION ALL SELECT doc_id, 'bad_block_id', block_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = ev.doc_id AND b.block_id = ev.block_id)
        UNION ALL SELECT b.doc_id, 'clause_span_oob', nm FROM b JOIN d ON d.doc_id = b.doc_id WHERE i % 23 = 0 AND ord = 1 AND char_end + 100000 > length(doc)
        UNION ALL SELECT doc_id, 'clause_text_mismatch', nm FROM b WHERE i % 29 = 0 AND ord = 0 AND text <> 'something else'
        UNION ALL SELECT b.doc_id, 'clause_text_mismatch', nm FROM b JOIN d ON d.doc_id = b.doc_id WHERE i % 23 = 0 AND ord = 1 AND char_end + 100000 <= length(doc)
        UNION ALL SELECT doc_id, 'dangling_clause_id', 'entity:' || eid FROM b WHERE i % 37 = 0 AND NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = b.doc_id AND c.nm = 'cl-77')
        UNION ALL SELECT doc_id, 'dangling_ref', id || ':' || e FROM ends WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = ends.doc_id AND f.id = ends.e)
        UNION ALL SELECT doc_id, 'dangling_clause_id', 'classification:cl-88' FROM b WHERE i % 61 = 0 AND NOT EXISTS (SELECT 1 FROM b c WHERE c.doc_id = b.doc_id AND c.nm = 'cl-88')
        UNION ALL SELECT doc_id, 'primary_type_disagree', CASE WHEN i % 61 = 0 THEN 'cl-88' ELSE nm END FROM b WHERE i % 67 = 0""",
    "construction_issues": f"""WITH {_LINES}, items AS (SELECT *, CAST(floor(item_index / 50) + 1 AS INT) AS page FROM lines), b AS ({_blocks_sql('items')}),
        c AS (SELECT doc_id, ord, CASE WHEN doc_id % 21 = 0 AND ord = 1 THEN 0 ELSE page END AS page, CASE WHEN doc_id % 25 = 0 AND ord = 2 THEN -1 ELSE char_start END AS s,
            CASE WHEN doc_id % 19 = 0 AND ord = 0 THEN char_start - 1 ELSE char_end END AS e, CASE WHEN doc_id % 27 = 0 AND ord = 3 THEN 1.5 ELSE 0.5 END AS k FROM b)
        SELECT doc_id, ord, 'page_below_one' AS issue FROM c WHERE page < 1 UNION ALL SELECT doc_id, ord, 'start_below_zero' FROM c WHERE s < 0 UNION ALL SELECT doc_id, ord, 'end_below_zero' FROM c WHERE e < 0
        UNION ALL SELECT doc_id, ord, 'end_before_start' FROM c WHERE e < s UNION ALL SELECT doc_id, ord, 'confidence_out_of_range' FROM c WHERE k > 1""",
    "evidence_verify": f"WITH {_FACTS} SELECT kind, count(*) AS failing FROM ev JOIN d ON d.doc_id = ev.doc_id WHERE substr(doc, char_start + 1, char_end - char_start) <> text GROUP BY kind",
    "entities_regex": f"{_W}, {_ENT} SELECT type, entity, count(*) AS n FROM ents GROUP BY ALL",
    "relations_containment": f"""{_W}, {_DIRECT}, {_FULL}, found AS (SELECT doc_id, ord, {_ENTITIES.replace("{0}", "text")} AS e FROM full_texts)
        SELECT doc_id, 'entity_in_clause' AS type, 'e-' || unnest(range(0, len(e))) AS source_id, 'cl-' || ord AS target_id FROM found""",
    "deal_pipeline": f"""{_W}, {_DIRECT}, {_FULL}, per AS (SELECT doc_id, count(*) AS clauses, sum(len({_ENTITIES.replace("{0}", "text")})) AS entities FROM full_texts GROUP BY doc_id)
        SELECT c_nationkey AS deal_id, count(*) AS documents, CAST(sum(clauses) AS BIGINT) AS clauses, CAST(sum(entities) AS BIGINT) AS entities, count(*) FILTER (needs_review) AS to_review
        FROM per JOIN ({_CONFIDENCE}) s ON s.doc_id = per.doc_id JOIN customer ON c_custkey = per.doc_id GROUP BY ALL""",
    "document_pipeline": f"""{_W}, {_DIRECT}, {_FULL}, ent AS (SELECT doc_id, sum(len({_ENTITIES.replace("{0}", "text")})) AS n, count(*) AS c FROM full_texts GROUP BY doc_id),
        pages AS (SELECT doc_id, max(page) AS page_count, CAST(count(*) AS INT) AS n_blocks FROM blocks GROUP BY doc_id),
        s AS (SELECT doc_id, {_STOPS.replace("lower(text)", "lower(texts.text)")} AS s FROM texts), t AS (SELECT doc_id, list_sum(list_transform(s, lambda x: x.n)) AS total,
            list_sort(list_transform(s, lambda x: {{'n': -x.n, 'code': x.code}}))[1] AS best FROM s)
        SELECT p.doc_id, page_count, n_blocks, CASE WHEN total > 0 THEN best.code END AS language, CASE WHEN total > 0 THEN round_even(-best.n / total, 4) END AS confidence, coalesce(ent.c, 0) AS n_clauses,
            CAST(coalesce(ent.n, 0) AS BIGINT) AS n_entities, CAST(coalesce(ent.n, 0) AS BIGINT) AS n_relations, score, needs_review, CAST(0 AS BIGINT) AS issues
        FROM pages p JOIN t ON t.doc_id = p.doc_id LEFT JOIN ent ON ent.doc_id = p.doc_id LEFT JOIN ({_CONFIDENCE}) c ON c.doc_id = p.doc_id""",
    "segmentation_score": f"""{_W}, arts AS (SELECT o_orderkey, o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a FROM orders),
        secs AS (SELECT doc_id, a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem JOIN arts ON l_orderkey = o_orderkey),
        gold AS (SELECT DISTINCT doc_id, 'ART:' || a AS k, 0 AS want FROM arts UNION ALL SELECT DISTINCT doc_id, 'SEC:' || a || '.' || s, 1 FROM secs),
        tops AS (SELECT *, last_value(CASE WHEN depth = 0 THEN family END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ord) AS top, {_NUMBER} AS number FROM nodes),
        seen AS (SELECT doc_id, ord, depth AS got, {_normal("number")} AS k FROM tops WHERE depth <= 1 AND top <> 'region'),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY ord) AS nth FROM seen WHERE k NOT LIKE 'RAW:%'),
        met AS (SELECT coalesce(g.doc_id, r.doc_id) AS doc_id, want, got FROM gold g FULL JOIN (SELECT * FROM ranked WHERE nth = 1) r ON g.doc_id = r.doc_id AND g.k = r.k),
        sums AS (SELECT doc_id, count(*) FILTER (want = got) AS correct, count(*) FILTER (want <> got) AS wrong_depth, count(*) FILTER (got IS NULL) AS missed, count(*) FILTER (want IS NULL) AS extra,
            count(want) AS labelled, count(got) AS predicted FROM met GROUP BY doc_id),
        again AS (SELECT doc_id, count(*) AS duplicates FROM ranked WHERE nth > 1 GROUP BY doc_id)
        SELECT doc_id, correct, wrong_depth, missed, extra, coalesce(duplicates, 0) AS duplicates, CASE WHEN labelled = 0 THEN 0.0 ELSE correct / labelled END AS recall,
            CASE WHEN predicted = 0 THEN 0.0 ELSE correct / predicted END AS precision, CASE WHEN labelled + predicted = 0 THEN 0.0 ELSE 2 * correct / (labelled + predicted) END AS f1
        FROM sums LEFT JOIN again USING (doc_id)""",
    "norm_number": f"WITH {_CORPUS} SELECT DISTINCT marker, {_normal('marker')} AS value FROM marked",
    "toc_gold": f"""WITH {_CORPUS}, cut AS (SELECT doc_id, ord, trim(text) AS text, regexp_extract(trim(text), '(?i)^(?:Section\\s+)?(\\d+\\.\\d+)\\.?', 1) AS sec,
            trim(regexp_replace(trim(text), '(?i)^(?:Section\\s+)?\\d+\\.\\d+\\.?', '')) AS rest, regexp_replace(regexp_extract(trim(text), '(?i)^ARTICLE\\s+(\\S+)', 1), '\\.+$', '') AS token,
            trim(regexp_replace(trim(text), '(?i)^ARTICLE\\s+\\S+', '')) AS art_rest FROM blocks),
        told AS (SELECT doc_id, ord, CASE WHEN sec <> '' THEN 1 WHEN regexp_matches(token, '(?i)^([IVXLC]+|\\d+)$') THEN 0 END AS depth, CASE WHEN sec <> '' THEN sec ELSE 'ARTICLE ' || upper(token) END AS number,
            CASE WHEN sec <> '' THEN {_BARE.replace("{0}", "rest")} ELSE {_BARE.replace("{0}", "art_rest")} END AS heading,
            sec <> '' AND (rest = '' OR regexp_matches(rest, '{_REF}')) AS is_toc, sec <> '' AND NOT (rest = '' OR regexp_matches(rest, '{_REF}')) AS is_body FROM cut),
        listed AS (SELECT *, coalesce(max(CAST(is_toc AS INT)) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM told WHERE depth IS NOT NULL),
        stopped AS (SELECT *, max(CAST(is_body AND seen = 1 AS INT)) OVER (PARTITION BY doc_id ORDER BY ord ROWS UNBOUNDED PRECEDING) AS stop FROM listed),
        nth AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY ord) AS n FROM stopped WHERE stop = 0 AND NOT is_body)
        SELECT doc_id, ord, number, depth, heading FROM nth WHERE n = 1""",
    "heldout_summary": f"""{_W}, roles AS (SELECT count(*) FILTER ({_ROLE} = 'article') AS articles, count(*) FILTER ({_ROLE} = 'section') AS sections, count(*) FILTER ({_ROLE} = 'region') AS regions FROM nodes),
        d AS (SELECT count(DISTINCT doc_id) AS documents FROM blocks), s AS (SELECT * FROM ({_CONFIDENCE}))
        SELECT documents, documents - (SELECT count(*) FROM s) AS empty, (SELECT count(*) FILTER (issues > 0) FROM s) AS invalid, (SELECT count(*) FILTER (needs_review) FROM s) AS escalated,
            (SELECT round_even(avg(score), 6) FROM s) AS mean_score, articles, sections, regions FROM d, roles""",
    "resolve_entities": f"{_W}, {_ENT} SELECT doc_id, type, {_VALUE} AS value, count(*) AS mentions FROM ents GROUP BY ALL",
    "deal_aggregate": f"""{_W}, {_ENT} SELECT c_nationkey AS deal_id, type, {_VALUE} AS value, min(entity) AS canonical_name, count(*) AS mentions, count(DISTINCT doc_id) AS documents
        FROM ents JOIN customer ON c_custkey = doc_id GROUP BY ALL""",
    "detect_language": f"""WITH s AS (SELECT doc_id, {_STOPS} AS s FROM documents), t AS (SELECT doc_id, list_sum(list_transform(s, lambda x: x.n)) AS total,
        list_sort(list_transform(s, lambda x: {{'n': -x.n, 'code': x.code}}))[1] AS best FROM s)
        SELECT doc_id, CASE WHEN total > 0 THEN best.code END AS language, CASE WHEN total > 0 THEN round_even(-best.n / total, 4) END AS confidence FROM t""",
    "detect_doctype_lookup": f"WITH t AS (SELECT doc_id, ({_KINDS})[doc_id % {len(DOCUMENT_TYPES)} + 1] AS k FROM documents) SELECT doc_id, k.t AS document_type, k.c AS category, k.f AS form FROM t",
    "route_by_form": f"""WITH t AS (SELECT text, ({_KINDS})[doc_id % {len(DOCUMENT_TYPES)} + 1] AS k FROM documents)
        SELECT CASE WHEN length(trim(text)) = 0 OR length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) < 0.4 * length(text) THEN 'stopped' ELSE coalesce(k.f, 'review') END AS route, count(*) AS documents FROM t GROUP BY ALL""",
    "bundle_page_runs": """WITH r AS (SELECT conv_id AS doc_id, role AS type, turn, turn - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS run FROM conversations)
        SELECT doc_id, type, min(turn) AS first, max(turn) AS last FROM r GROUP BY doc_id, type, run""",
    "corpus_health": f"""{_W} SELECT doc_id, count(ord) AS nodes, count(*) FILTER (family = 'article') AS articles, coalesce(max(depth), -1) AS max_depth, 0::BIGINT AS issues
        FROM (SELECT DISTINCT doc_id FROM blocks) LEFT JOIN nodes USING (doc_id) GROUP BY doc_id""",
    "row_local_segments": f"""{_W} SELECT doc_id, ord, depth, parent, CASE WHEN family IN ('article', 'region') THEN family WHEN family LIKE 'paren%' THEN 'subclause' ELSE 'section' END AS role, {_NUMBER} AS number, char_start FROM nodes""",
    "event_windows": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
}
