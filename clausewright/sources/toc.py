"""Section inventories from tables of contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_REF = r"(?is)^(.*\S)\s* (?:A-\w+|\d+)$"


def toc_gold(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord, number, depth, heading of the entries before a document's body. A
    number alone or with a page reference is an entry; once one was seen, a number
    with prose is where the body begins. lines: key, ord, text."""
    text = F.trim(F.col("text"))
    sec = F.regexp_extract(text, r"(?i)^(?:Section\s+)?(\d+\.\d+)\.?", 1)
    rest = F.trim(F.regexp_replace(text, r"(?i)^(?:Section\s+)?\d+\.\d+\.?", ""))
    token = F.regexp_replace(F.regexp_extract(text, r"(?i)^ARTICLE\s+(\S+)", 1), r"\.+$", "")
    art_rest = F.trim(F.regexp_replace(text, r"(?i)^ARTICLE\s+\S+", ""))
    bare = lambda r: F.when(r.rlike(_REF), F.regexp_extract(r, _REF, 1)).otherwise(r)
    is_toc = (sec != "") & ((rest == "") | rest.rlike(_REF))
    told = lines.select(
        key,
        "ord",
        F.when(sec != "", F.lit(1)).when(token.rlike(r"(?i)^([IVXLC]+|\d+)$"), F.lit(0)).alias("depth"),
        F.when(sec != "", sec).otherwise(F.concat(F.lit("ARTICLE "), F.upper(token))).alias("number"),
        F.when(sec != "", bare(rest)).otherwise(bare(art_rest)).alias("heading"),
        is_toc.alias("is_toc"),
        ((sec != "") & ~is_toc).alias("is_body"),
    ).filter("depth is not null")
    order = Window.partitionBy(key).orderBy("ord")
    seen = F.coalesce(F.max("is_toc").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    stops = F.max((F.col("is_body") & seen).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = told.withColumn("_stop", stops).filter("_stop = 0 and not is_body")
    first = F.row_number().over(Window.partitionBy(key, "number").orderBy("ord"))
    return kept.withColumn("_n", first).filter("_n = 1").select(key, "ord", "number", "depth", "heading")
