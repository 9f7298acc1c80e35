"""A corpus of contracts built from the order tables, by one SQL text that Spark and
DuckDB both read: a customer is a contract, an order an article, an order line a
section. Tables of contents, Roman and relative numbers, dropped ordinals, sub-parts,
schedules and cross-references occur by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.sources.blocks import SEPARATOR, blocks_of, filled

_ROMAN = "".join(
    f"{r:<6}" for r in "I II III IV V VI VII VIII IX X XI XII XIII XIV XV XVI XVII XVIII XIX XX XXI XXII XXIII XXIV XXV XXVI XXVII XXVIII XXIX XXX XXXI XXXII XXXIII XXXIV XXXV XXXVI XXXVII XXXVIII XXXIX XL".split()
)

ITEMS_SQL = f"""
WITH arts AS (
    SELECT o_orderkey, o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a
    FROM {{orders}}),
secs AS (
    SELECT doc_id, a, l_partkey, CAST(l_quantity AS INT) AS q,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS s
    FROM {{lineitem}} JOIN arts ON l_orderkey = o_orderkey),
parts AS (
    SELECT doc_id, 0 AS k0, a AS k1, 0 AS k2, 0 AS k3, 'ARTICLE ' || CAST(a AS STRING) AS text FROM arts WHERE doc_id % 4 = 0
    UNION ALL
    SELECT DISTINCT doc_id, 1, 0, 0, 0, 'This agreement is made by and between the parties named in it.' FROM arts
    UNION ALL
    SELECT doc_id, 2, a, 0, 0,
           CASE WHEN doc_id % 2 = 0 AND a <= 40 THEN 'ARTICLE ' || trim(substr('{_ROMAN}', CAST((a - 1) * 6 + 1 AS INT), 6)) ELSE 'ARTICLE ' || CAST(a AS STRING) END
    FROM arts
    UNION ALL
    SELECT doc_id, 2, a, s, 0,
           CASE doc_id % 3 WHEN 0 THEN 'Section ' || CAST(a AS STRING) || '.' || CAST(s AS STRING)
                           WHEN 1 THEN CAST(a AS STRING) || '.' || CAST(s AS STRING) || '.'
                           ELSE 'Section 1.0' || CAST(s AS STRING) END
           || ' Delivery of part ' || CAST(l_partkey AS STRING) || '. '
           || CASE q % 5 WHEN 0 THEN 'Each party shall keep insurance. ' WHEN 1 THEN 'The license may renew as set out in Section 9.9 and (c) below. '
                         WHEN 2 THEN 'Neither party may assign this agreement. ' ELSE '' END
           || repeat('Goods are delivered as agreed between them. ', 3)
    FROM secs WHERE NOT (s = 2 AND (doc_id + a) % 7 = 0)
    UNION ALL
    SELECT doc_id, 2, a, s, 1, '(a) the first part of it, for ' || CAST(q AS STRING) || ' days' FROM secs WHERE q > 25 AND NOT (s = 2 AND (doc_id + a) % 7 = 0)
    UNION ALL
    SELECT doc_id, 2, a, s, 2, '(b) the second part of it, at USD ' || CAST(q AS STRING) || '000' FROM secs WHERE q > 25 AND NOT (s = 2 AND (doc_id + a) % 7 = 0)
    UNION ALL
    SELECT DISTINCT doc_id, 3, 0, 0, 0, 'Schedule B' FROM arts WHERE doc_id % 5 = 0
    UNION ALL
    SELECT DISTINCT doc_id, 3, 0, 1, 0, '1.1 Terms of the schedule. ' || repeat('Rates hold for a year. ', 5) FROM arts WHERE doc_id % 5 = 0
    UNION ALL
    SELECT DISTINCT doc_id, 3, 0, 2, 0, '1.2 Rates of the schedule. ' || repeat('Rates hold for a year. ', 5) FROM arts WHERE doc_id % 5 = 0),
numbered AS (
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k0, k1, k2, k3, text) - 1 AS INT) AS item_index, text FROM parts)
SELECT doc_id, item_index, 'text' AS label, text, CAST(floor(item_index / 20) + 1 AS INT) AS page FROM numbered
"""


# The same as columns: texts by the sort keys that stand for them (k0: contents, recital,
# body, schedule; k1: article; k2: section; k3: sub-part).
_TEXT = f"""
CASE WHEN k0 = 0 THEN 'ARTICLE ' || CAST(k1 AS STRING)
     WHEN k0 = 1 THEN 'This agreement is made by and between the parties named in it.'
     WHEN k0 = 2 AND k2 = 0 THEN
        CASE WHEN doc_id % 2 = 0 AND k1 <= 40 THEN 'ARTICLE ' || trim(substr('{_ROMAN}', CAST((k1 - 1) * 6 + 1 AS INT), 6)) ELSE 'ARTICLE ' || CAST(k1 AS STRING) END
     WHEN k0 = 2 AND k3 = 0 THEN
        CASE doc_id % 3 WHEN 0 THEN 'Section ' || CAST(k1 AS STRING) || '.' || CAST(k2 AS STRING)
                        WHEN 1 THEN CAST(k1 AS STRING) || '.' || CAST(k2 AS STRING) || '.'
                        ELSE 'Section 1.0' || CAST(k2 AS STRING) END
        || ' Delivery of part ' || CAST(l_partkey AS STRING) || '. '
        || CASE q % 5 WHEN 0 THEN 'Each party shall keep insurance. ' WHEN 1 THEN 'The license may renew as set out in Section 9.9 and (c) below. '
                      WHEN 2 THEN 'Neither party may assign this agreement. ' ELSE '' END
        || '{"Goods are delivered as agreed between them. " * 3}'
     WHEN k3 = 1 THEN '(a) the first part of it, for ' || CAST(q AS STRING) || ' days'
     WHEN k3 = 2 THEN '(b) the second part of it, at USD ' || CAST(q AS STRING) || '000'
     WHEN k2 = 0 THEN 'Schedule B'
     WHEN k2 = 1 THEN '1.1 Terms of the schedule. {"Rates hold for a year. " * 5}'
     ELSE '1.2 Rates of the schedule. {"Rates hold for a year. " * 5}' END"""


def _rows(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One narrow row per item: doc_id, the sort keys k0 to k3, which no two items of a
    document share, and what its text is made of."""
    a = F.row_number().over(Window.partitionBy("doc_id").orderBy("o_orderdate", "o_orderkey"))
    arts = orders.select("o_orderkey", F.col("o_custkey").alias("doc_id"), "o_orderdate").select("o_orderkey", "doc_id", a.alias("k1"))
    s = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "_at"))  # lines that the SQL does not tell apart: as they stand in the file
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").alias("q"), F.monotonically_increasing_id().alias("_at"))
    secs = lines.join(arts, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("k2", s).filter("NOT (k2 = 2 AND (doc_id + k1) % 7 = 0)")
    subs = F.explode(F.expr("CASE WHEN q > 25 THEN array(0, 1, 2) ELSE array(0) END")).alias("k3")
    tops = F.expr("""inline(concat(
        CASE WHEN doc_id % 4 = 0 THEN array(named_struct('k0', 0, 'k1', k1, 'k2', 0)) ELSE array() END,
        CASE WHEN k1 = 1 THEN array(named_struct('k0', 1, 'k1', 0, 'k2', 0)) ELSE array() END,
        array(named_struct('k0', 2, 'k1', k1, 'k2', 0)),
        CASE WHEN k1 = 1 AND doc_id % 5 = 0 THEN array(named_struct('k0', 3, 'k1', 0, 'k2', 0), named_struct('k0', 3, 'k1', 0, 'k2', 1), named_struct('k0', 3, 'k1', 0, 'k2', 2)) ELSE array() END))""")
    none = [F.lit(0).alias("k3"), F.lit(None).cast(lineitem.schema["l_partkey"].dataType).alias("l_partkey"), F.lit(None).cast("int").alias("q")]
    return secs.select("doc_id", F.lit(2).alias("k0"), "k1", "k2", subs, "l_partkey", "q").unionByName(arts.select("doc_id", tops).select("*", *none))


_KEYS = ("k0", "k1", "k2", "k3")


def contract_items(spark: SparkSession, orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Items (doc_id, item_index, label, text, page) of the contract corpus, those of
    ITEMS_SQL. Rows are dealt out and sorted by their keys and get their texts in place."""
    index = (F.row_number().over(Window.partitionBy("doc_id").orderBy(*_KEYS)) - 1).cast("int")
    told = _rows(orders, lineitem).withColumn("item_index", index)
    return told.select("doc_id", "item_index", F.lit("text").alias("label"), F.expr(_TEXT).alias("text"), _page(F.col("item_index")).alias("page"))


def contract_blocks(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """canonicalise(contract_items(...)), sorted once: items and blocks are counted in
    one window, and rows are dealt out before they get their texts."""
    texts = _rows(orders, lineitem).repartition("doc_id").withColumn("text", F.expr(_TEXT)).withColumn("_kept", filled(F.col("text")))
    order = Window.partitionBy("doc_id").orderBy(*_KEYS)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("text") + len(SEPARATOR)
    counted = texts.withColumns(
        {
            "item_index": (F.row_number().over(order) - 1).cast("int"),
            "ord": (F.count_if("_kept").over(upto) - 1).cast("int"),
            "_end": F.sum(F.when(F.col("_kept"), size)).over(upto),
        }
    )
    return blocks_of(counted.filter("_kept"), "doc_id", F.lit("text"), _page(F.col("item_index")), size)


def _page(item_index: Column) -> Column:
    return (F.floor(item_index / 20) + 1).cast("int")


def contract_items_sql() -> str:
    return ITEMS_SQL.format(orders="orders", lineitem="lineitem")
